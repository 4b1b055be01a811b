"""What the corpus operators share: table access, written intermediate tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The application's folder that all executors see, below ``spark.checkpoint.dir``; it goes when the application ends."""
    return scratch.base(spark)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def chunks(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``most`` characters; a longer text is a range of its own."""
    at = n = 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if i > at and n + size > most:
            yield at, i
            at, n = i, 0
        n += size
    if at < len(texts):
        yield at, len(texts)


def arrow(fields: dict[str, pa.DataType], columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) for k, t in fields.items()], names=list(fields))


class Tables:
    """Intermediate tables of one job in the shared folder. Each can be dropped once what reads it has been written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/ledgerloom/{uuid.uuid4().hex}"
        self.names: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.names:
                remove(self.spark, f"{self.base}/{name}")
                self.names.remove(name)

    def keep(self, *names: str) -> None:
        """Drop all other tables."""
        self.drop(*(n for n in [*self.names] if n not in names))


#: Most ids that are broadcast: about 64 MB as a hash table.
BROADCAST_IDS = 1_000_000


def only(documents: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The rows whose doc_id is among ``ids`` (distinct, of a written table), or is not.

    The ids are counted first: up to ``BROADCAST_IDS`` are broadcast, so that the documents are not shuffled.
    More of them are joined by a shuffle. A null doc_id is among none.
    """
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    return documents.join(side, "doc_id", "left_semi" if keep else "left_anti").select(documents.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (src, dst) longs; a component is its smallest node.

    Every round each node takes the smallest label next to it, then the label of its label. Rounds end when
    nothing changes. The labels are written to the shared folder each round, and the round before's are deleted.
    Nodes without edges get no row.
    """
    tables, turn = Tables(edges.sparkSession), 0
    both = tables.write(
        edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "edges"
    )
    labels = tables.write(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels0")
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "component")
        least = near.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("most"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        # a label only falls, so nothing moved if each node saw one label and its label has itself above it
        jumped = least.join(up, "component").select("node", F.least("component", "above").alias("component"), (F.col("most") > F.least("component", "above")).alias("moved"))
        new = tables.write(jumped, f"labels{turn}")
        tables.drop(f"labels{turn - 1}")
        labels = new.select("node", "component")
        if not new.where("moved").limit(1).count():
            tables.drop("edges")
            return labels
