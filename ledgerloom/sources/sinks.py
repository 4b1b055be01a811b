"""Writers: CSV with a fixed header, split files with a manifest, rewrite with a backup, JSON summaries, vector tables."""

from __future__ import annotations

import csv
import sys
import uuid
from typing import TextIO

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce
from ..operators.reorganize import file_names, manifest
from ..operators.trials import MANY_BLOCKS
from . import scratch

#: White space at the ends of cells is kept.
_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _text(df: DataFrame) -> DataFrame:
    """Booleans as True and False, null as blank."""
    return df.select(*[F.when(F.col(c), "True").otherwise(F.when(~F.col(c), "False").otherwise("")).alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", single: bool = False) -> None:
    """A folder of CSV files with header, or of one file for small results."""
    own = _text(df)
    (own.coalesce(1) if single else own).write.mode(mode).options(**_OPTIONS, emptyValue="", nullValue="").csv(path)


def print_csv(df: DataFrame, out: TextIO | None = None) -> None:
    """A small table as CSV on standard output, partition by partition."""
    writer = csv.writer(out or sys.stdout, lineterminator="\n")
    writer.writerow(df.columns)
    for row in _text(df).toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])


def append_csv(df: DataFrame, path: str) -> None:
    write_csv(df, path, "append")


def replace_csv(df: DataFrame, path: str) -> str:
    """Rewrites a table that ``df`` may read from: writes beside it, keeps the old one with ``.bak``, then renames.

    Between the two renames there is no table at ``path``; ``commits.publish`` has no such moment.
    """
    spark, new, old = df.sparkSession, f"{path}.tmp-{uuid.uuid4().hex}", f"{path}.bak"
    write_csv(df, new)
    jvm = spark.sparkContext._jvm
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        fs.delete(p(old), True)
        fs.rename(p(path), p(old))
    fs.rename(p(new), p(path))
    return old


def write_split(df: DataFrame, path: str, group_by: list[str]) -> DataFrame:
    """A folder for each group under its file name; returns the manifest. Groups of one name share a folder, none is lost."""
    own = _text(file_names(df, group_by))
    own.write.partitionBy("_name").mode("errorifexists").options(**_OPTIONS).csv(path)
    return manifest(df, group_by)


#: Most bytes of rows that a block's file holds, as Spark sorts them.
BLOCK_BYTES = 64_000_000
#: A file after the first of a block has this in its name, before the extension.
PART = "__part-"


def write_blocks(trials: DataFrame, path: str, most: int = BLOCK_BYTES) -> None:
    """One CSV file for each block, under the block's file name; a block of over ``most`` bytes has more, ``..__part-0002.csv`` and so on.

    Sizes are counted first. A block's rows are dealt to its files by a hash of their cells, and the files to tasks in order of blocks, so that
    a task sorts and writes less than twice ``most`` (exact copies of a row within an input split stay together).
    """
    spark, key = trials.sparkSession, ["model", "temperature", "prompt_version"]
    size = F.lit(16 * len(trials.columns)) + F.length(F.concat_ws("", *[F.col(c).cast("string") for c in trials.columns]))
    spelt = trials.groupBy(*key).agg(F.sum(size).alias("_bytes"))
    spelt = scratch.written(spelt.withColumn("_name", coerce.block_file(*key)), "blocks")  # a row for each block and spelling of its temperature
    sizes = spelt.groupBy("_name").agg(F.sum("_bytes").alias("_bytes"))
    before = F.sum("_bytes").over(Window.orderBy("_name")) - F.col("_bytes")
    sizes = sizes.select("_name", F.ceil(F.col("_bytes") / most).alias("_files"), F.floor(before / most).alias("_task"))
    shared = spelt.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "_name").join(sizes, "_name")
    tasks = 1 + (sizes.agg(F.max(F.col("_task") + F.col("_files"))).first()[0] or 0)
    if spelt.count() <= MANY_BLOCKS:
        shared = F.broadcast(shared)
    same = [trials[c].eqNullSafe(shared[f"_k{i}"]) for i, c in enumerate(key)]
    own = trials.join(shared, same[0] & same[1] & same[2]).withColumn("_part", F.pmod(F.xxhash64(*trials.columns, F.spark_partition_id()), "_files"))
    name = F.when(F.col("_part") == 0, F.col("_name")).otherwise(F.concat(F.regexp_replace("_name", r"\.csv$", PART), F.lpad((F.col("_part") + 1).cast("string"), 4, "0"), F.lit(".csv")))
    own = own.select(*trials.columns, name.alias("_name"), (F.col("_task") + F.col("_part")).cast("int").alias("_task"))
    work = f"{path}.tmp-{uuid.uuid4().hex}"
    _text(own.repartitionById(tasks, F.col("_task")).drop("_task")).write.partitionBy("_name").options(**_OPTIONS, emptyValue="", nullValue="").option("maxRecordsPerFile", 0).csv(work)
    jvm = spark.sparkContext._jvm
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p(path))
    for part in fs.globStatus(p(f"{work}/_name=*/part-*")) or []:
        fs.rename(part.getPath(), p(f"{path}/{part.getPath().getParent().getName().removeprefix('_name=')}"))
    fs.delete(p(work), True)


def write_vectors(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Vectors as Parquet, a folder for each layer, so that a scan of one layer reads no other."""
    df.write.mode(mode).partitionBy("layer").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.coalesce(1).write.mode(mode).json(path)
