"""Robust summaries of one measure, optionally by group."""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tails import sign_test
from .ranks import running

QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
FRACTIONS = (0.05, 0.10, 0.20)
LARGE = (50, 100, 250, 500)
EXTREMES = (5, 10, 20, 30)


def _by_value(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """(group, x, n, below, total): counts of distinct values with the number of rows below each."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*group, x).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    up = running(counts, group, [F.col(x)], F.col("n"), "below").withColumn("below", F.col("below") - F.col("n"))
    return _matched(up, totals, group, "inner")


def _matched(left: DataFrame, right: DataFrame, group: list[str], how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right``, which has one row a group; null is a group as well."""
    if not group:
        return left.join(F.broadcast(right), F.lit(True), how)
    same = right.select(*[F.col(g).alias(f"_same_{g}") for g in group], *[c for c in right.columns if c not in group])
    cond = functools.reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_same_{g}")) for g in group])
    return left.join(same, cond, how).drop(*[f"_same_{g}" for g in group])


def exact_quantiles(df: DataFrame, group: list[str], x: str, wanted: dict[str, float]) -> DataFrame:
    """(group, one column for each wanted quantile): exact, by linear interpolation between the two rows around its place.

    From ranks over counted values, so no task holds a group. Nulls do not count; a group of nothing else has no row.
    """
    own = _by_value(df, group, x)
    parts = []
    for name, q in wanted.items():
        place = (F.col("total") - 1) * q
        low, high = (F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(x).cast("double"))) for k in (F.floor(place), F.ceil(place)))
        share = F.max(place - F.floor(place))
        parts.append(F.when(share == 0, low).otherwise(low * (1 - share) + high * share).alias(name))
    return own.groupBy(*group).agg(*parts)


def quantiles(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """Mean, exact quantiles by linear interpolation, extremes, and counts of large values."""
    stats: list[Column] = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max")]
    stats += [F.count_if(F.abs(F.col(x)) >= k).alias(f"abs_ge_{k}") for k in LARGE]
    wanted = {f"p{round(q * 100):02d}": q for q in QUANTILES}
    return _matched(df.groupBy(*group).agg(*stats), exact_quantiles(df, group, x, wanted), group)


def trimmed_and_winsorized(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """Means without, and with clamped, the int(n * fraction) smallest and largest values.

    From counts of distinct values: a value's rows that lie within the trimmed range count, and the clamped rows
    take the value at the range's ends. Each group's distinct values meet in one window.
    """
    own = _by_value(df, group, x)
    for f in FRACTIONS:
        cut = F.floor(F.col("total") * f)
        inside = F.greatest(F.lit(0), F.least(F.col("below") + F.col("n"), F.col("total") - cut) - F.greatest(F.col("below"), cut))
        own = own.withColumns({f"_in{round(f * 100)}": inside, f"_cut{round(f * 100)}": cut})
    stats = []
    for f in FRACTIONS:
        name, inside, cut = f"{round(f * 100):02d}", F.col(f"_in{round(f * 100)}"), F.max(f"_cut{round(f * 100)}")
        low, high = F.min(F.when(inside > 0, F.col(x))), F.max(F.when(inside > 0, F.col(x)))
        total = F.sum(inside * F.col(x))
        stats += [(total / F.nullif(F.sum(inside), F.lit(0))).alias(f"trim_{name}"), ((total + cut * (low + high)) / F.max("total")).alias(f"winsor_{name}")]
    return own.groupBy(*group).agg(*stats)


def without_extremes(df: DataFrame, group: list[str], x: str, order: str) -> DataFrame:
    """Means without the k largest values, and without the k largest in size; the first in ``order`` goes first among equals."""
    own = df.where(F.col(x).isNotNull()).select(*group, x, order)
    total = own.groupBy(*group).agg(F.sum(F.when(F.col(x) > 0, F.col(x))).alias("sum_positive"), F.sum(F.when(F.col(x) < 0, F.col(x))).alias("sum_negative"), F.sum(x).alias("net"), F.count("*").alias("_n"))
    for name, by in (("positive", F.col(x)), ("absolute", F.abs(F.col(x)))):
        # only the first rows of each rank are gathered: Spark limits a window's groups before the shuffle
        w = Window.partitionBy(*group).orderBy(by.desc(), order)
        top = own.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(EXTREMES))
        sums = top.groupBy(*group).agg(*[F.sum(F.when(F.col("_k") <= k, F.col(x))).alias(f"_{name}_{k}") for k in EXTREMES], F.sum(F.when((F.col("_k") <= 10) & (F.col(x) > 0), F.col(x))).alias(f"_{name}_top"))
        total = total.join(sums, group) if group else total.join(F.broadcast(sums), F.lit(True))
    left = [F.when(F.col("_n") > k, (F.col("net") - F.col(f"_{n}_{k}")) / (F.col("_n") - k)).alias(f"without_{k}_{n}") for k in EXTREMES for n in ("positive", "absolute")]
    return total.select(*group, *left, "sum_positive", "sum_negative", "net", (F.col("_positive_top") / F.nullif(F.col("net"), F.lit(0.0))).alias("top_10_share"))


def extremes(df: DataFrame, x: str, order: str, count: int = 20) -> DataFrame:
    """The rows of the ``count`` smallest and ``count`` largest values; rows among both come twice."""
    low = df.orderBy(x, order).limit(count).withColumn("side", F.lit("low"))
    return low.unionByName(df.orderBy(F.desc(x), F.desc(order)).limit(count).withColumn("side", F.lit("high")))


def signs(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """Positive, negative and zero counts with the sign test's p. The p is of two counts, so it runs on the few grouped rows."""

    def p(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(two_sided_p=[sign_test(int(i), int(j)) for i, j in zip(b["positive"], b["negative"], strict=True)])

    out = df.groupBy(*group).agg(F.count_if(F.col(x) > 0).alias("positive"), F.count_if(F.col(x) < 0).alias("negative"), F.count_if(F.col(x) == 0).alias("zero"))
    from pyspark.sql.types import DoubleType, StructType

    return out.mapInPandas(p, StructType(list(out.schema.fields)).add("two_sided_p", DoubleType()))


def bootstrap(df: DataFrame, x: str, order: str, iterations: int = 20_000, seed: int = 7) -> DataFrame:
    """(lower_95, median, upper_95) of the resampled mean of a sample that fits a task, with draws as Python's ``random`` makes them.

    One generator makes all draws in turn, so this exact form is one task; ``bootstrap_parallel`` spreads replicates.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("o")["x"].tolist()
        rng, n = random.Random(seed), len(values)
        means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(iterations))
        return pd.DataFrame([[means[int(iterations * q)] for q in (0.025, 0.5, 0.975)]], columns=["lower_95", "median", "upper_95"])

    own = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(order).alias("o"), F.lit(0).alias("g"))
    return own.groupBy("g").applyInPandas(run, "lower_95 double, median double, upper_95 double")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson(h: np.ndarray) -> np.ndarray:
    """Poisson(1) numbers from uniform 64-bit ones."""
    u = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    w = np.zeros(u.shape)
    total = term = exp(-1)
    for k in range(1, 20):
        over = u > total
        if not over.any():
            break
        w += over
        term /= k
        total += term
    return w


def bootstrap_parallel(df: DataFrame, group: list[str], x: str, key: str, replicates: int = 20_000, seed: int = 7) -> DataFrame:
    """Poisson bootstrap for samples of any size: each row weighs into each replicate by a hash of its key, in one pass of partial sums.

    A task adds up blocks of rows and replicates, and gives one row for each group and replicate.
    """
    own = df.where(F.col(x).isNotNull()).select(*group, F.col(x).cast("double").alias("_x"), F.xxhash64(F.col(key), F.lit(seed)).alias("_h"))
    schema = StructType(own.schema.fields[: len(group)]).add("_r", "integer").add("_w", "double").add("_s", "double")
    numbers = np.arange(1, replicates + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def flush(types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
            for name, (w, s) in sums.items():
                columns = [pa.array([v] * replicates, t) for v, t in zip(name, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32()), pa.array(w), pa.array(s)], names=schema.names)
            sums.clear()

        types: list[pa.DataType] = []
        for b in batches:
            types = [b.schema.field(k).type for k in range(len(group))]
            names = list(zip(*(b.column(k).to_pylist() for k in range(len(group))), strict=True)) if group else [()] * b.num_rows
            value, h = b.column(len(group)).to_numpy(zero_copy_only=False), b.column(len(group) + 1).to_numpy(zero_copy_only=False).view(np.uint64)
            places: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                places.setdefault(name, []).append(i)
            for name, at in places.items():
                total = sums.setdefault(name, np.zeros((2, replicates)))
                for i in range(0, len(at), 256):
                    rows = at[i : i + 256]
                    for j in range(0, replicates, 1024):
                        r = numbers[j : j + 1024].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        w = _poisson(_mix(h[rows][:, None] + r))
                        total[0, j : j + 1024] += w.sum(0)
                        total[1, j : j + 1024] += value[rows] @ w
                if len(sums) >= 100:
                    yield from flush(types)
        yield from flush(types)

    # spread over all cores, as the work is in the replicates and not in the rows
    parts = own.repartition(df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)
    means = parts.groupBy(*group, "_r").agg((F.sum("_s") / F.nullif(F.sum("_w"), F.lit(0.0))).alias("m"))
    return means.groupBy(*group).agg(*[F.percentile("m", F.lit(q)).alias(n) for q, n in ((0.025, "lower_95"), (0.5, "median"), (0.975, "upper_95"))])
