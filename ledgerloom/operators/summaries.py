"""Joins, counts, windows and orders of report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, coerce
from . import ranks


def matched(rows: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """Rows with their prompt's columns; a row without a prompt raises when it is read. Prompts' other columns get ``prompt_`` in front."""
    side = prompts.select(F.col(key), F.lit(True).alias("_there"), *[F.col(c).alias(f"prompt_{c.removeprefix('prompt_')}") for c in prompts.columns if c != key])
    lost = F.raise_error(F.concat(F.lit(f"no prompt of {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return rows.join(side, key, "left").where(F.coalesce("_there", lost)).drop("_there")


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the output has not yet; keys are compared as text, so a scale of 1.0 is not one of 1."""
    text = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    have = done.select(*[t.alias(f"_{k}") for k, t in zip(keys, text, strict=True)]).distinct()
    own = rows.withColumns({f"_{k}": t for k, t in zip(keys, text, strict=True)})
    return own.join(have, [f"_{k}" for k in keys], "left_anti").select(rows.columns)


def compared(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """All keys of both sides with their columns as text, blank on the side that lacks the key."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).cast("string").alias(f"{name}_{c}") for c in df.columns if c not in keys])

    own = side(left, names[0]).join(side(right, names[1]), keys, "full_outer")
    return own.select(*keys, *[F.coalesce(c, F.lit("")).alias(c) for c in own.columns if c not in keys])


def layer_region_counts(vectors: DataFrame, layer: str = "layer", region: str = "token_region") -> DataFrame:
    """(kind, value, count): vectors in all, by layer and by region, in one pass of partial counts."""
    got = vectors.groupingSets([[F.col(layer)], [F.col(region)], []], layer, region).agg(F.grouping_id().alias("g"), F.count("*").alias("count"))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "layer").otherwise("region")
    return got.select(kind.alias("kind"), F.coalesce(F.when(F.col("g") == 1, F.col(layer).cast("string")).when(F.col("g") == 2, F.col(region)), F.lit("")).alias("value"), "count")


def group_table(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """(keys, n, mean, median, std): sample standard deviation; groups with a null key are left out.

    The median comes from ranks within the group over counted values, so no group is held in one task.
    """
    own = df.dropna(subset=[*keys, measure])
    basic = own.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("std"))
    values = own.groupBy(*keys, F.col(measure).alias("_x")).agg(F.count("*").alias("_k"))
    # equal values are one row; what stands below each is a running sum within the group
    placed = ranks.running(values, keys, [F.col("_x")], F.col("_k"), "_end").join(basic.select(*keys, "n"), keys)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    inside = lambda at: (F.col("_end") - F.col("_k") < at) & (at <= F.col("_end"))
    middle = placed.groupBy(*keys).agg(((F.max(F.when(inside(low), F.col("_x"))) + F.max(F.when(inside(high), F.col("_x")))) / 2).alias("median"))
    return basic.join(middle, keys).select(*keys, "n", "mean", "median", "std")


def centred(df: DataFrame, group: list[str], measure: str, name: str) -> DataFrame:
    """Adds the measure less its group's mean; means are joined, so that a large group is not gathered."""
    means = df.groupBy(*group).agg(F.avg(measure).alias("_m"))
    return df.join(means, group).withColumn(name, F.col(measure) - F.col("_m")).drop("_m")


def counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns]))
    return df.select(pairs.alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("count"))


def first_filled_by(df: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    """For each column the first value in ``order`` that is not blank."""
    first = [F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(order, c)))[c].alias(c) for c in columns]
    return df.groupBy(*group).agg(*first)


def batches(df: DataFrame, order: list[Column], size: int, name: str = "batch") -> DataFrame:
    """Adds the number of each row's batch of ``size`` rows in order, from 0."""
    return ranks.numbered(df, order, "_n").withColumn(name, F.floor((F.col("_n") - 1) / size)).drop("_n")


def by_category(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Adds ``category_rank``, the place of the value in an explicit order; others come last."""
    at = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(column))
    return df.withColumn("category_rank", F.when(at > 0, at).otherwise(len(categories) + 1))


def best_choice(df: DataFrame, group: list[str], score: str, order: str) -> DataFrame:
    """The row of the greatest score in each group, the first in ``order`` among equals; by partial aggregates."""
    rest = [c for c in df.columns if c not in group]
    top = df.groupBy(*group).agg(F.min(F.struct((-F.col(score)).alias("_s"), F.col(order).alias("_o"), F.struct(*rest).alias("_r"))).alias("m"))
    return top.select(*group, "m._r.*")


def token_score(log_probability: Column | str, tokens: Column | str, prior: Column | str | None = None) -> Column:
    """Log-probability for each token, less a prior's if there is one."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    own = F.try_divide(c(log_probability), c(tokens))
    return own if prior is None else own - F.try_divide(c(prior), c(tokens))


def decided(realized: str, paper: str) -> Column:
    """The label of the higher score; a tie is REALIZED."""
    return F.when(F.col(realized) >= F.col(paper), "REALIZED").otherwise("PAPER")


PARSED = ("parsed_wager", "log_wager", "risk_profile", "valid", "valid_risk_profile", "refusal_flag", "parse_error_type")


def reparsed(trials: DataFrame, response: str = "response_text") -> DataFrame:
    """The trials with the parsed columns made anew from the responses, and ``changed``: whether any cell differs from the stored one."""
    own = trials.withColumn("_a", answers.parse_answer(F.col(response)))
    log = F.when(F.col("_a.valid"), F.log(F.col("_a.wager").cast("double")).cast("string"))
    truth = lambda x: F.when(F.col(x), "True").otherwise("False")
    new = {
        "parsed_wager": F.col("_a.wager").cast("string"), "log_wager": log, "risk_profile": F.col("_a.risk").cast("string"), "valid": truth("_a.valid"),
        "valid_risk_profile": truth("_a.valid_risk"), "refusal_flag": truth("_a.refusal"), "parse_error_type": F.col("_a.error"),
    }
    new = {c: F.coalesce(v, F.lit("")) for c, v in new.items()}
    differs = F.lit(False)
    for c, v in new.items():
        differs = differs | (coerce.comparison_cell(c) != coerce.comparison_cell(v))
    return own.withColumn("changed", differs).withColumns(new).drop("_a")


def repair_totals(repaired: DataFrame, file: str) -> DataFrame:
    """(file, rows, changed, valid) of every file and of all, named ``total``."""
    got = repaired.rollup(file).agg(F.grouping_id().alias("g"), F.count("*").alias("rows"), F.count_if("changed").alias("changed"), F.count_if(F.col("valid") == "True").alias("valid"))
    return got.select(F.when(F.col("g") == 1, "total").otherwise(F.col(file)).alias("file"), "rows", "changed", "valid")


def kept_tokens(labels: Column | str, mask: Column | str, mode: str = "all", regions: list[str] | None = None) -> Column:
    """Positions of the tokens that a mode keeps: all, those of the mask (nonpad), or the mask's last one (final); of some regions only, if given."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    at = F.sequence(F.lit(0), F.size(c(labels)) - 1)
    at = F.when(F.size(c(labels)) > 0, at).otherwise(F.array().cast("array<int>"))
    if mode != "all":
        at = F.filter(at, lambda i: F.get(c(mask), i) == 1)
    if mode == "final":
        at = F.when(F.size(at) > 0, F.array(F.element_at(at, -1))).otherwise(at)
    return at if regions is None else F.filter(at, lambda i: F.get(c(labels), i).isin(regions))


def steered(vector: str, direction: str, scale: float) -> Column:
    """A vector moved along a direction."""
    return F.zip_with(vector, direction, lambda h, d: h + F.lit(scale) * d)


def steered_tokens(tokens: str, direction: str, scale: float, positions: str = "all") -> Column:
    """The vectors of a prompt's tokens moved along a direction: all of them, or the last one only."""
    if positions not in ("all", "last"):
        raise ValueError("positions is all or last")
    moved = lambda h: F.zip_with(h, direction, lambda x, d: x + F.lit(scale) * d)
    return F.transform(tokens, lambda h, i: moved(h) if positions == "all" else F.when(i == F.size(tokens) - 1, moved(h)).otherwise(h))


def robustness(df: DataFrame, valid: str, measure: str, condition: str) -> DataFrame:
    """(model, level, temperature, prompt_version, n_rows, n_valid, n_conditions, mean) by version, and by temperature within it, in one pass.

    Null keys are groups of their own; the mean is that of valid rows, null without any.
    """
    sets = [[F.col("model"), F.col("prompt_version")], [F.col("model"), F.col("temperature"), F.col("prompt_version")]]
    got = df.groupingSets(sets, "model", "temperature", "prompt_version").agg(
        F.grouping("temperature").alias("g"), F.count("*").alias("n_rows"), F.count_if(valid).alias("n_valid"), F.countDistinct(condition).alias("n_conditions"), F.avg(F.when(F.col(valid), F.col(measure))).alias("mean")
    )
    level = F.when(F.col("g") == 1, "version").otherwise("temperature")
    return got.select("model", level.alias("level"), "temperature", "prompt_version", "n_rows", "n_valid", "n_conditions", "mean")


def attached(rows: DataFrame, side: DataFrame, key: str, name: str) -> DataFrame:
    """All rows, with the other columns of the side's row of the same key as a struct; null where there is none. The side has one row a key."""
    packed = side.select(key, F.struct(*[c for c in side.columns if c != key]).alias(name))
    return rows.join(packed, key, "left")
