"""Matched pairs and matched deltas, each by one shuffle instead of a self-join."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running
from .robust import exact_quantiles


def pivot_pairs(rows: DataFrame, pair: str, role: str, roles: tuple[str, str], measures: list[str], order: str, keep: list[str] | None = None) -> DataFrame:
    """One row of each pair that has both roles: ``<measure>_<role>`` of both and ``<measure>_delta`` (second less first).

    The last row in ``order`` counts for each role; ``keep``: columns taken from the first role's row.
    """
    keep = keep or []
    take = [F.max_by(F.struct(*measures, *keep), F.when(F.col(role) == r, F.col(order))).alias(f"_{i}") for i, r in enumerate(roles)]
    out = rows.where(F.col(role).isin(*roles)).groupBy(pair).agg(*take).where("_0 is not null and _1 is not null")
    columns: list[Column] = [F.col(pair), *[F.col(f"_0.{k}").alias(k) for k in keep]]
    for m in measures:
        columns += [F.col(f"_{i}.{m}").alias(f"{m}_{r}") for i, r in enumerate(roles)]
        columns.append((F.col(f"_1.{m}") - F.col(f"_0.{m}")).alias(f"{m}_delta"))
    return out.select(*columns)


def group_means(pairs: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(key, value, pairs, mean of each measure) for each of several grouping columns, in one pass."""
    own = pairs.select(*measures, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("value")) for k in keys])).alias("_g"))
    return own.groupBy(F.col("_g.key").alias("key"), F.col("_g.value").alias("value")).agg(F.count("*").alias("pairs"), *[F.avg(m).alias(f"mean_{m}") for m in measures])


def sign_counts(value: str) -> list[Column]:
    return [F.count_if(F.col(value) > 0).alias("positive"), F.count_if(F.col(value) < 0).alias("negative"), F.count_if(F.col(value) == 0).alias("zero")]


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r) by sums; null with fewer than two rows or a constant column."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.when((F.count("*") > 1) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
    return own.agg(F.count("*").alias("n"), r.alias("r"))


def average_rank(df: DataFrame, x: str, name: str) -> DataFrame:
    """Adds the rank of ``x`` from 1, equal values sharing the mean of theirs, from counts of distinct values."""
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("_n"))
    ranks = running(counts, [], [F.col(x)], F.col("_n"), "_up").select(x, (F.col("_up") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, x, "left")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r) of the ranks of rows that have both."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return correlation(average_rank(average_rank(own, x, "_rx"), y, "_ry"), "_rx", "_ry")


def matched_deltas(rows: DataFrame, key: str, scale: str, base: float, measures: list[str], valid: str = "valid") -> DataFrame:
    """(scale, n, mean and exact median delta of each measure) of rows that are valid at a scale and at the base of the same key.

    The base row of a key travels with the others in one grouping by key; ``base`` must occur.
    """
    if not rows.where(F.col(scale) == base).limit(1).count():
        raise ValueError(f"no rows at the base scale {base}")
    own = rows.groupBy(key).agg(
        F.max_by(F.struct(valid, *measures), F.when(F.col(scale) == base, F.lit(1))).alias("_base"),
        F.collect_list(F.when(F.col(scale) != base, F.struct(scale, valid, *measures))).alias("_rest"),  # as many as scales
    )
    pairs = own.where("_base is not null").select("_base", F.explode("_rest").alias("_r")).where(f"_base.{valid} and _r.{valid}")
    delta = pairs.select(F.col(f"_r.{scale}").alias(scale), *[(F.col(f"_r.{m}") - F.col(f"_base.{m}")).alias(m) for m in measures])
    stats = delta.groupBy(scale).agg(F.count("*").alias("n"), *[F.avg(m).alias(f"mean_{m}_delta") for m in measures])
    # one row for each measure, so that all medians come from one ranking
    long = delta.select(scale, F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("x")) for m in measures])).alias("_d")).select(scale, "_d.m", "_d.x")
    middle = exact_quantiles(long, [scale, "m"], "x", {"median": 0.5})
    wide = middle.groupBy(scale).agg(*[F.max(F.when(F.col("m") == m, F.col("median"))).alias(f"median_{m}_delta") for m in measures])
    out = stats.join(wide.withColumnRenamed(scale, "_scale"), F.col(scale).eqNullSafe(F.col("_scale")), "left")
    return out.select(scale, "n", *[f"{n}_{m}_delta" for m in measures for n in ("mean", "median")])


def matched_delta_subsets(rows: DataFrame, key: str, scale: str, base: float, measures: list[str], subsets: dict[str, str]) -> DataFrame:
    """``matched_deltas`` for each subset, a name and the column that both rows of a pair must have true.

    Every scale but the base has a row for every subset; without pairs n is 0 and means and medians are NaN.
    """
    parts = [matched_deltas(rows, key, scale, base, measures, valid).withColumn("subset", F.lit(name)) for name, valid in subsets.items()]
    found = functools.reduce(DataFrame.unionByName, parts)
    every = rows.where(F.col(scale) != base).select(scale).distinct().withColumn("subset", F.explode(F.array(*map(F.lit, subsets))))
    out = every.join(found, [scale, "subset"], "left")
    return out.select(scale, "subset", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in found.columns if c.endswith("_delta")])


def scale_summary(rows: DataFrame, scale: str, valid: str, strict: str, measures: list[str]) -> DataFrame:
    """Rows, valid and strictly valid rows, and means over either, of each scale."""
    means = [F.avg(F.when(F.col(v), F.col(m))).alias(f"mean_{m}_{n}") for v, n in ((valid, "valid"), (strict, "strict")) for m in measures]
    return rows.groupBy(scale).agg(F.count("*").alias("n_rows"), F.count_if(valid).alias("valid_rows"), F.count_if(strict).alias("strict_rows"), *means)


def compliance(rows: DataFrame, scale: str, groups: list[str], ok: str) -> DataFrame:
    """Non-compliance of each scale and of each value of each grouping column within it, by grouping sets.

    ``grouping_id`` tells a rolled-up column from a null in it; nulls are shown as empty.
    """
    own = rows.select(scale, *groups, ok)
    sets = [[scale], *[[scale, g] for g in groups]]
    out = own.groupingSets([[F.col(c) for c in s] for s in sets], F.col(scale), *[F.col(g) for g in groups]).agg(
        F.count("*").alias("n_rows"), F.count_if(ok).alias("compliant"), *[F.grouping(g).alias(f"_{g}") for g in groups]
    )
    kind, value = F.lit("scale"), F.lit("all")
    for g in groups:
        kind, value = F.when(F.col(f"_{g}") == 0, g).otherwise(kind), F.when(F.col(f"_{g}") == 0, F.coalesce(F.col(g).cast("string"), F.lit(""))).otherwise(value)
    return out.select(scale, kind.alias("group_type"), value.alias("group_value"), "n_rows", "compliant", (1 - F.col("compliant") / F.col("n_rows")).alias("noncompliance_rate"))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, or an error that names up to five repeated keys."""
    bad = [r[0] for r in df.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if bad:
        raise ValueError(f"repeated {key}: {', '.join(map(str, bad))}")
    return df
