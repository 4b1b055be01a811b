"""Vectors in array columns: pooling, directions, projections, normalisation, group effects, encoders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def mean_vector(df: DataFrame, group: list[str], vector: str, name: str = "vector") -> DataFrame:
    """Element-wise mean of each group in double precision, with ``n`` vectors.

    Each Arrow batch becomes one partial sum per group before anything is exploded or shuffled, so what is shuffled
    grows with groups and tasks, not with vectors. Vectors of one group must be of one length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(group))), strict=True)) if group else [()] * b.num_rows
            own = b.column(len(group))
            for key, v in zip(keys, own, strict=True):
                if v.is_valid:
                    x = np.append(np.asarray(v.values.to_numpy(zero_copy_only=False), float), 1.0)
                    sums[key] = sums[key] + x if key in sums else x
            if len(sums) > 20_000:  # groups beyond are merged after the shuffle
                yield _partial(sums, group, b)
                sums = {}
        if sums:
            yield _partial(sums, group, b)

    fields = df.select(*group).schema.simpleString()[7:-1] if group else ""
    part = df.select(*group, vector).mapInArrow(run, ", ".join(x for x in (fields.replace(":", " "), "s array<double>") if x))
    at = part.select(*group, F.posexplode("s").alias("i", "v")).groupBy(*group, "i").agg(F.sum("v").alias("v"))
    out = at.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("a"))
    last = F.element_at("a", -1)["v"]
    return out.select(*group, F.transform(F.slice("a", F.lit(1), F.size("a") - 1), lambda x: x["v"] / last).alias(name), last.cast("long").alias("n"))


def _partial(sums: dict, group: list[str], like: pa.RecordBatch) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in sums], like.schema.field(i).type) for i in range(len(group))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=[*group, "s"])


def max_pool(features: DataFrame, key: str, feature: str, value: str) -> DataFrame:
    """The largest activation of each (key, feature), at least 0."""
    return features.groupBy(key, feature).agg(F.greatest(F.max(value), F.lit(0.0)).alias(value))


def pair_directions(vectors: DataFrame, pair: str, role: str, positive: str, negative: str, order: str) -> DataFrame:
    """(pair, direction, pair_norm): the positive role's vector less the negative's, of pairs that have both; the last in ``order`` counts."""
    take = [F.max_by("vector", F.when(F.col(role) == r, F.col(order))).alias(n) for r, n in ((positive, "p"), (negative, "q"))]
    both = vectors.groupBy(pair).agg(*take).where("p is not null and q is not null")
    out = both.select(pair, F.zip_with("p", "q", lambda a, b: a.cast("double") - b.cast("double")).alias("direction"))
    return out.withColumn("pair_norm", norm("direction"))


def project(vectors: DataFrame, direction: DataFrame, name: str = "projection") -> DataFrame:
    """Adds the projection on the one row of ``direction`` (column ``vector``), scaled to length one; a zero direction raises."""
    unit = direction.select(F.when(norm("vector") > 0, F.col("vector")).otherwise(F.raise_error(F.lit("a direction of length 0")).cast("array<double>")).alias("_d"))
    return vectors.join(F.broadcast(unit), F.lit(True)).withColumn(name, dot("vector", "_d") / norm("_d")).drop("_d")


def group_summary(df: DataFrame, fields: list[str], x: str) -> DataFrame:
    """(field, value, n, mean, population standard deviation) over several fields in one pass; blank values are left out."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("value")) for f in fields])
    own = df.select(x, F.explode(entries).alias("_g")).where("_g.value <> ''")
    return own.groupBy(F.col("_g.field").alias("field"), F.col("_g.value").alias("value")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def normalization(df: DataFrame, vector: str, eps: float = 1e-6) -> DataFrame:
    """One row: mean vector, n, and the mean distance from it (1 if not above ``eps``), in two passes."""
    center = mean_vector(df, [], vector, "mean")
    away = df.where(F.col(vector).isNotNull()).join(F.broadcast(center), F.lit(True)).select(norm(F.zip_with(vector, "mean", lambda a, b: a.cast("double") - b)).alias("d"))
    scale = away.agg(F.avg("d").alias("scale"))
    return center.join(F.broadcast(scale), F.lit(True)).withColumn("scale", F.when(F.col("scale") > eps, F.col("scale")).otherwise(1.0))


def _sums(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """(group, feature, n, s, q): number, sum and sum of squares of each element; each task passes on one row a group and element it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in sums], pa.string()) for i in range(len(group))]
            parts = [pa.array([v[j].tolist() for v in sums.values()], pa.list_(pa.float64())) for j in range(3)]
            return pa.RecordBatch.from_arrays([*keys, *parts], names=[*group, "n", "s", "q"])

        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in range(len(group))), strict=True)) if group else [()] * b.num_rows
            for key, v in zip(names, b.column(len(group)), strict=True):
                if v.is_valid:
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False), float)
                    own = np.stack([np.ones(len(x)), x, x * x])
                    sums[key] = sums[key] + own if key in sums else own
            if len(sums) > 20_000:  # groups beyond are merged after the shuffle
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    schema = ", ".join([*(f"{g} string" for g in group), "n array<double>", "s array<double>", "q array<double>"])
    part = df.select(*group, vector).mapInArrow(run, schema)
    each = part.select(*group, F.posexplode(F.arrays_zip("n", "s", "q")).alias("feature", "x"))
    return each.groupBy(*group, "feature").agg(F.sum("x.n").cast("long").alias("n"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q"))


def effects(df: DataFrame, key: str, vector: str, groups: DataFrame, least: int = 2, top: int | None = None) -> DataFrame:
    """Standardised one-versus-rest effects: (field, value, feature, group_count, rest_count, means, difference, effect_size[, rank]).

    df: (key, vector), vectors of one length, a feature is a place in them; groups: (key, field, value), at most one value of a
    field for a key. The rest is the total less the group, so no row is read for each other group, and vectors
    meet their groups whole: what is shuffled after that are sums.
    """
    total = _sums(df, [], vector).select("feature", F.col("n").alias("tn"), F.col("s").alias("ts"), F.col("q").alias("tq"))
    inside = _sums(df.select(key, vector).join(groups.where("value <> ''").select(key, "field", "value"), key), ["field", "value"], vector)
    inside = inside.select("field", "value", "feature", F.col("n").alias("gn"), F.col("s").alias("gs"), F.col("q").alias("gq"))
    own = inside.join(F.broadcast(total), "feature").withColumns({"rn": F.col("tn") - F.col("gn"), "rs": F.col("ts") - F.col("gs"), "rq": F.col("tq") - F.col("gq")})  # as many rows as features
    own = own.where((F.col("gn") >= least) & (F.col("rn") >= least))
    m1, m2 = F.col("gs") / F.col("gn"), F.col("rs") / F.col("rn")
    var = lambda q, n, m: F.greatest(F.col(q) / F.col(n) - m * m, F.lit(0.0))
    effect = (m1 - m2) / (F.sqrt((var("gq", "gn", m1) + var("rq", "rn", m2)) / 2) + 1e-12)
    out = own.select("field", "value", "feature", F.col("gn").alias("group_count"), F.col("rn").alias("rest_count"), m1.alias("mean_in"), m2.alias("mean_out"), (m1 - m2).alias("difference"), effect.alias("effect_size"))
    if top:
        w = Window.partitionBy("field", "value").orderBy(F.desc("effect_size"), "feature")
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return out


def best_effects(associations: DataFrame) -> DataFrame:
    """The row of the largest effect in size of each (field, value); the smaller feature among equals."""
    w = Window.partitionBy("field", "value").orderBy(F.desc(F.abs("effect_size")), "feature")
    return associations.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def top_examples(df: DataFrame, key: str, vector: str, associations: DataFrame, features: int = 25, examples: int = 5) -> DataFrame:
    """The ``examples`` largest activations of the first ``features`` distinct features by effect size; only those elements leave the vectors."""
    first = associations.groupBy("feature").agg(F.max(F.abs("effect_size")).alias("e")).orderBy(F.desc("e"), "feature").limit(features)
    picked = [r["feature"] for r in first.collect()]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.get(vector, F.lit(f)).alias("activation")) for f in picked])) if picked else F.explode(F.array().cast("array<struct<feature:int,activation:double>>"))
    own = df.select(key, each.alias("x")).select(key, "x.feature", "x.activation").where("activation is not null")
    w = Window.partitionBy("feature").orderBy(F.desc("activation"), key)
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= examples)


def sparsity(long: DataFrame, key: str, x: str) -> DataFrame:
    """Mean, exact median and largest number of active features (above 0) of a key."""
    per = long.groupBy(key).agg(F.count_if(F.col(x) > 0).alias("active"))
    return per.agg(F.avg("active").alias("mean_active"), F.median("active").alias("median_active"), F.max("active").alias("max_active"))


def encode(df: DataFrame, vector: str, weights: np.ndarray, bias: np.ndarray, center: np.ndarray, scale: float, top: int | None = None, threshold: np.ndarray | None = None) -> DataFrame:
    """Adds ``features``: normalised vectors times an encoder, then ReLU with only the ``top`` largest kept, or jumping at ``threshold``."""
    sent = df.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias.astype(np.float32), center.astype(np.float32), threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, mean, jump = sent.value
        for batch in batches:
            x = np.stack([np.asarray(v.values.to_numpy(zero_copy_only=False), np.float32) for v in batch.column(0)]) if batch.num_rows else np.zeros((0, len(mean)), np.float32)
            a = (x - mean) / np.float32(scale) @ w + b
            a = np.where(a > jump, a, 0) if jump is not None else np.maximum(a, 0)
            if top and top < a.shape[1] and len(a):
                a[a < np.partition(a, -top, 1)[:, -top][:, None]] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(list(a.astype(np.float32)), pa.list_(pa.float32()))], names=[*batch.schema.names[1:], "features"])

    from pyspark.sql.types import ArrayType, FloatType, StructType

    return df.select(F.col(vector).alias("_v"), "*").mapInArrow(run, StructType(list(df.schema.fields)).add("features", ArrayType(FloatType())))
