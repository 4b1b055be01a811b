"""Several tables that change together: immutable versions, and a commit file that names the one that counts.

A version's tables are written to a folder of their own. Then a commit file of the next number is put in place by one rename,
which fails if another writer was faster. Readers take the commit of the highest number, so at any moment there is
one whole set of tables, before and after a crash at any step. The version before is kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import trials

_COMMIT = "_commit-"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    jvm, fs = _fs(spark, folder)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{_COMMIT}*")) or []
    return sorted((int(f.getPath().getName().removeprefix(_COMMIT)), f.getPath().toString()) for f in found if f.getPath().getName().removeprefix(_COMMIT).isdigit())


def _read(spark: SparkSession, commit: str) -> dict[str, str]:
    jvm, fs = _fs(spark, commit)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(commit))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _put(spark: SparkSession, folder: str, number: int, content: str) -> None:
    jvm, fs = _fs(spark, folder)
    work, target = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}") for x in (f".{uuid.uuid4().hex}", f"{_COMMIT}{number:010d}"))
    out = fs.create(work)
    out.write(bytearray(content.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(work, target):
        fs.delete(work, False)
        raise RuntimeError(f"another writer has committed number {number} of {folder}")


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]) -> int:
    """Writes a version of all tables and commits it; its number. Tables may read the version before. Versions before that one go.

    A table may be a function of the tables of this version that are written before it.
    """
    done = _commits(spark, folder)
    number, version = (done[-1][0] if done else 0) + 1, uuid.uuid4().hex
    written: dict[str, DataFrame] = {}
    for name, table in tables.items():
        df = table if isinstance(table, DataFrame) else table(written)
        df.write.parquet(f"{folder}/{version}/{name}")
        written[name] = spark.read.schema(df.schema).parquet(f"{folder}/{version}/{name}")
    _put(spark, folder, number, json.dumps({name: f"{version}/{name}" for name in tables}))
    jvm, fs = _fs(spark, folder)
    for _, old in done[:-1]:
        for path in {p.split("/")[0] for p in _read(spark, old).values()}:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{path}"), True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), False)
    return number


def current(spark: SparkSession, folder: str, name: str, back: int = 0) -> DataFrame | None:
    """A table of the last commit, or of the one ``back`` before it; None if there is none."""
    done = _commits(spark, folder)
    if len(done) <= back:
        return None
    path = _read(spark, done[-1 - back][1]).get(name)
    return None if path is None else spark.read.parquet(f"{folder}/{path}")


def reconcile(blocks: DataFrame, folder: str, step: int = 1) -> tuple[int, int]:
    """Merges block rows into the committed table and its grouped copy, both in one commit; (files, rows). Without block rows nothing happens."""
    spark = blocks.sparkSession
    files = blocks.select("_file").distinct().count()
    if not files:
        return 0, 0
    old = current(spark, folder, "merged")
    merged = trials.merge(blocks, None if old is None else old.withColumn("_row", old["trial_id"].cast("long")), step)
    key = ("condition", "model", "prompt_version")
    # the copy is made from the table as written: the merge does not run again, nor a third time to find the ranges
    publish(spark, folder, {"merged": merged, "grouped": lambda written: written["merged"].repartitionByRange(*key).sortWithinPartitions(*key)})
    return files, current(spark, folder, "merged").count()
