"""Trial rows: identity, quality-ranked dedupe, balanced truncation, merge, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce
from ..sources import scratch
from .ranks import numbered

FIELDS = (
    "trial_id", "condition", "outcome_type", "amount", "run_number", "model", "temperature", "prompt_version", "prompt_text", "response_text",
    "parsed_wager", "log_wager", "risk_profile", "valid", "valid_risk_profile", "refusal_flag", "parse_error_type", "timestamp", "request_id",
)


def best_rows(df: DataFrame, key: list[str], quality: list[Column], order: list[str]) -> DataFrame:
    """One row of each key: the one of highest quality, the earliest in ``order`` among equals.

    max_by over one struct merges on the map side, so a key with very many rows is no burden on one task.
    """
    # the earlier of equals: smaller order values win, so their negation is compared
    rank = F.struct(*[q.alias(f"q{i}") for i, q in enumerate(quality)], *[(-F.col(c).cast("long")).alias(f"o{i}") for i, c in enumerate(order)])
    best = df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), rank).alias("_r"))
    return best.select("_r.*")


def dedupe(trials: DataFrame, order: list[str]) -> DataFrame:
    """One row of each trial identity."""
    own = trials.withColumn("_key", coerce.identity())
    return best_rows(own, ["_key"], [coerce.quality()], order).drop("_key")


def targets(runs: DataFrame, block: list[str], condition: str, run: str, step: int) -> DataFrame:
    """(block, least, target): the smallest number of distinct runs of a block's conditions, rounded down to ``step``."""
    counts = runs.select(*block, condition, run).distinct().groupBy(*block, condition).agg(F.count("*").alias("runs"))
    least = F.min("runs")
    return counts.groupBy(*block).agg(least.alias("least"), F.when(least < step, least).otherwise(F.floor(least / step) * step).alias("target"))


def balanced(trials: DataFrame, block: list[str], condition: str, run: str, step: int) -> DataFrame:
    """The first runs of each condition of a block, as many as the block's target; malformed rows stay.

    A row is malformed without a condition or a positive run. All duplicates of a chosen run stay. Nothing is
    cut for ``step`` up to 1.
    """
    if step <= 1:
        return trials
    fine = (F.coalesce(F.col(condition), F.lit("")) != "") & (F.coalesce(F.col(run), F.lit(0)) > 0)
    good = trials.where(fine)
    runs = good.select(*block, condition, run).distinct()
    chosen = numbered(runs, [F.col(run)], "_rank", group=[*block, condition]).join(targets(good, block, condition, run, step), block).where("_rank <= target").select(*block, condition, run)
    kept = good.join(chosen, [*block, condition, run], "left_semi").select(trials.columns)
    return kept.unionByName(trials.where(~fine))


def row_order() -> list[Column]:
    """Order of merged rows; temperatures sort as text."""
    return [coerce.strip("model"), coerce.temperature_key("temperature"), coerce.strip("prompt_version"), coerce.strip("condition"), coerce.run_number("run_number"), coerce.strip("request_id")]


def merge(blocks: DataFrame, output: DataFrame | None = None, step: int = 1) -> DataFrame:
    """All trials of the block files and of an older output, one row each, in order, with new trial ids.

    blocks: the fields and ``_file`` (rank of the file name), ``_row`` (row in the file). A block in the files replaces
    all rows that the output has of it; output rows without a block stay. Earlier sources win among equals: the
    output, then blocks in order, then files, then rows.
    """
    new = _keyed(blocks, F.col("_file")).where("_b is not null").withColumn("_old", F.lit(1))
    old = None if output is None else _keyed(output, F.lit(0)).withColumn("_old", F.lit(0))
    own = scratch.written(new if old is None else new.unionByName(old), "keyed")
    new = balanced(own.where("_old = 1"), ["_b"], f"_o{_CONDITION}", f"_o{_RUN}", step)
    seen = _few(own.where("_old = 1").select("_b").distinct())
    if old is not None:
        new = new.unionByName(own.where("_old = 0").join(seen, "_b", "left_anti").select(own.columns))
    ranks = own.select("_b").distinct().withColumn("_brank", F.dense_rank().over(Window.orderBy(F.col("_b").asc_nulls_first())))  # a row for each block
    ranked = new.join(_few(ranks), new["_b"].eqNullSafe(ranks["_b"])).drop(ranks["_b"])
    one = best_rows(ranked, ["_key"], [coerce.quality()], ["_old", "_brank", "_file", "_row"])
    order = [F.col(f"_o{i}") for i in range(len(row_order()))]
    return numbered(one, [*order, F.col("_file"), F.col("_row")], "_id").withColumn("trial_id", F.col("_id").cast("string")).select(*FIELDS)


#: Places of the condition and the run in ``row_order``.
_CONDITION, _RUN = 3, 4
#: Most blocks whose keys are broadcast.
MANY_BLOCKS = 100_000


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= MANY_BLOCKS else keys


def _keyed(trials: DataFrame, file: Column) -> DataFrame:
    """The fields, ``_file`` and ``_row``, and every key that a merge needs, each made once a row, as are their parts."""
    order = [c.alias(f"_o{i}") for i, c in enumerate(row_order())]
    own = trials.select(*FIELDS, file.cast("int").alias("_file"), "_row", *order)
    m, t, v, c, n, r = (F.col(f"_o{i}") for i in range(len(order)))
    block = F.when((m != "") & (t != "") & (v != ""), F.to_json(F.struct(m.alias("model"), t.alias("temperature"), v.alias("prompt_version"))))
    return own.select(*FIELDS, "_file", "_row", block.alias("_b"), coerce.identity_of(c, m, v, t, n, r).alias("_key"), *[f"_o{i}" for i in range(len(order))])


def missing_runs(conditions: DataFrame, runs: int, done: DataFrame) -> DataFrame:
    """(condition, run_number) of the plan 1..runs of every condition that is not done."""
    plan = conditions.select("condition").distinct().select("condition", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(runs).cast("long"))).alias("run_number"))
    return plan.join(done.select("condition", F.col("run_number").cast("long").alias("run_number")).distinct(), ["condition", "run_number"], "left_anti")


def resume_state(trials: DataFrame) -> DataFrame:
    """One row: number of completed keys and the largest trial id."""
    key = F.struct(coerce.strip("condition"), coerce.run_number("run_number"), coerce.strip("model"), coerce.temperature_key("temperature"), coerce.strip("prompt_version"))
    return trials.agg(F.countDistinct(F.when(coerce.run_number("run_number") > 0, key)).alias("completed"), F.coalesce(F.max(coerce.run_number("trial_id")), F.lit(0)).alias("max_trial_id"))
