"""Scans: string-typed CSV tables, conditions, prompts, JSON lines."""

from __future__ import annotations

import functools
from csv import reader as csv_lines

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pairs import assert_unique
from ..operators.trials import FIELDS


def _headers(spark: SparkSession, path: str | list[str], encoding: str, options: dict[str, str]) -> dict[str, list[str]]:
    """The files of each different first line. One scan of lines, of which only those where files begin are kept."""
    lines = spark.read.options(header=False, quote="", sep="\x01", encoding=encoding, **options).schema("line string").csv(path)
    own = lines.select("line", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_block_start").alias("at")).where("at = 0")
    out: dict[str, list[str]] = {}
    for r in own.groupBy("path").agg(F.min_by("line", "id").alias("line")).orderBy("path").collect():  # a row for each file
        out.setdefault((r["line"] or "").removeprefix("\ufeff").rstrip("\r"), []).append(r["path"])
    return out


def csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", glob: str | None = None, recursive: bool = False) -> DataFrame:
    """All columns as text, blank for missing, quoted line ends kept; ``_path`` is the file and ``_row`` the row in it, from 1.

    Every file goes by its own header, so files may differ in columns and their order; a header is one line. A file with
    quoted line ends is read by one task, whose row numbers are in file order.
    """
    options = {"recursiveFileLookup": str(recursive).lower()} | ({"pathGlobFilter": glob} if glob else {})
    parts, names = [], {}
    for line, files in _headers(spark, path, encoding, options).items():
        head = next(csv_lines([line], strict=False), [])
        columns = {n: f"c{i}" for i, n in reversed(list(enumerate(head))) if n}  # the first of equal names
        names |= dict.fromkeys(n for n in head if n)
        raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding=encoding, enforceSchema=True).schema(", ".join(f"c{i} string" for i in range(max(1, len(head))))).csv(files)
        parts.append(raw.select(*[F.coalesce(c, F.lit("")).alias(n) for n, c in columns.items()], F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_id")))
    if not parts:
        return spark.createDataFrame([], "_path string, _row int")
    own = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    own = own.withColumn("_row", F.row_number().over(Window.partitionBy("_path").orderBy("_id")))
    return own.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names], "_path", "_row")


def datasets(spark: SparkSession, root: str) -> list[str]:
    """The CSV files below the results folder of a project, in order; none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/results")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    files, out = fs.listFiles(path, True), set()
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.endswith(".csv"):
            out.add(name)
    return sorted(out)


def dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of ``datasets`` by its path, or by its path below ``root``; any other name raises."""
    if not name:
        raise ValueError("'' is none of the results")
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = own(name if own(name).isAbsolute() else f"{root}/{name}")
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full not in datasets(spark, root):
        raise ValueError(f"{name!r} is none of the results")
    return csv(spark, full)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def trials(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The trial fields of one file or of block files, and ``_file``, the rank of the file name, and ``_row``."""
    df = csv(spark, path, glob=glob)
    name = F.element_at(F.split("_path", "/"), -1)
    own = df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in FIELDS], "_row", name.alias("_name"))
    ranks = own.select("_name").distinct().withColumn("_file", F.row_number().over(Window.orderBy("_name")))  # one row per file
    return own.join(F.broadcast(ranks), "_name").drop("_name")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return trials(spark, folder, glob="block__*.csv")


def overlay(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Rows of both scans by file name; files of ``extra`` replace those of the same name. Both have ``_path``.

    The files of one block, as ``sinks.write_blocks`` names them, go by the block's name.
    """
    name = F.regexp_replace(F.element_at(F.split("_path", "/"), -1), r"__part-[0-9]+\.csv$", ".csv")
    a, b = base.withColumn("_name", name), extra.withColumn("_name", name)
    return a.join(b.select("_name").distinct(), "_name", "left_anti").unionByName(b, allowMissingColumns=True).drop("_name")


def conditions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(condition, outcome_type, amount); strict: types in lower case, wrong types, amounts or no rows raise."""
    df = require(csv(spark, path), ["condition", "outcome_type", "amount"]).where("trim(condition) <> ''")
    kind = F.lower(F.trim("outcome_type")) if strict else F.trim("outcome_type")
    own = df.select(F.trim("condition").alias("condition"), kind.alias("outcome_type"), F.trim("amount").try_cast("int").alias("amount"), F.col("amount").alias("_raw"))
    if strict:
        bad = own.where("outcome_type not in ('paper', 'realized') or amount is null").limit(1).collect()
        if bad:
            raise ValueError(f"bad condition {bad[0]['condition']!r}: {bad[0]['outcome_type']!r}, {bad[0]['_raw']!r}")
        if not own.limit(1).count():
            raise ValueError(f"no conditions in {path}")
    return own.drop("_raw")


def prompts(spark: SparkSession, path: str, prompt_column: str = "prompt_text", id_column: str = "prompt_id") -> DataFrame:
    """(prompt_id, prompt_text, metadata MAP): all other columns are metadata; a blank id is prompt_ and the row number from 0."""
    df = require(csv(spark, path), [prompt_column])
    others = [c for c in df.columns if c not in (prompt_column, "_path", "_row")]
    found = [F.nullif(F.trim(c), F.lit("")) for c in dict.fromkeys((id_column, "prompt_id")) if c in df.columns]
    name = F.coalesce(*found, F.format_string("prompt_%05d", F.col("_row") - 1))
    meta = F.map_from_arrays(F.array(*[F.lit(c) for c in others]), F.array(*[F.col(c) for c in others]))
    return df.select(name.alias("prompt_id"), F.col(prompt_column).alias("prompt_text"), meta.alias("metadata"), "_row")


def split_rows(df: DataFrame, split: str = "behavior_eval") -> DataFrame:
    own = df.where(F.col("split") == split)
    if not own.limit(1).count():
        raise ValueError(f"no rows of split {split}")
    return own


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each non-blank key."""
    return df.where(F.trim(key) != "").groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line, value) of text files, lines counted from 1 in each file, blank ones included.

    Nothing is sorted: ids run on within a block of a file, so a line is its block's place, from the counts of the blocks
    before it, and its distance from the block's first id. Both scans share one list of files, so they are cut alike.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    blocks = raw.groupBy("path", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    places = blocks.select("path", "_at", (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_shift"))  # one row for each block of a file
    return raw.join(places, ["path", "_at"]).select("path", (F.col("_id") + F.col("_shift")).alias("line"), "value")


def json_faults(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line, fault) of the lines that are neither blank nor a JSON object; fault: not_json or not_an_object."""
    v = F.try_parse_json("value")
    fault = F.when(v.isNull(), "not_json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_an_object")
    return numbered_lines(spark, path).where(F.col("value").rlike(r"\S")).select("path", "line", fault.alias("fault")).where("fault is not null")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One row per JSON object; blank lines are skipped and others raise: when read, or, if strict, at once and with file and line."""
    if strict and (bad := json_faults(spark, path).orderBy("path", "line").limit(1).collect()):
        raise ValueError(f"{bad[0]['path']}:{bad[0]['line']}: {bad[0]['fault'].replace('_', ' ')}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def prompt_texts(spark: SparkSession, runs: list[str], name: str = "prompts.jsonl") -> DataFrame:
    """(prompt_id, prompt_text): texts of several runs; of equal ids the last line of the last run counts.

    Runs without the file are passed over, as are blank ids; a null text is empty; a line that is not JSON raises.
    """
    hadoop, parts = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
    for k, run in enumerate(runs):
        path = hadoop(f"{run}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            parts.append(numbered_lines(spark, path.toString()).where(F.col("value").rlike(r"\S")).select(F.lit(k).alias("run"), "path", "line", F.parse_json("value").alias("v")))
    if not parts:
        return spark.createDataFrame([], "prompt_id string, prompt_text string")
    rows = functools.reduce(DataFrame.unionByName, parts)
    own = rows.select("run", "path", "line", *[F.coalesce(F.variant_get("v", f"$.{c}", "string"), F.lit("")).alias(c) for c in ("prompt_id", "prompt_text")])
    return own.where("prompt_id <> ''").groupBy("prompt_id").agg(F.max_by("prompt_text", F.struct("run", "path", "line")).alias("prompt_text"))


def merged_prompts(parts: list[DataFrame]) -> DataFrame:
    """Prompt tables as one, by column names; rows with an empty id go, ids that come again in any table raise, columns that a table lacks are blank."""
    own = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [require(p, ["prompt_id", "prompt_text"]).where("prompt_id <> ''") for p in parts])
    return assert_unique(own, "prompt_id").fillna("")
