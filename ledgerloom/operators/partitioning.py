"""Classification of blocks against the expected conditions and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, prompts


def block_flags(rows: DataFrame, key: list[str], condition: str, expected: list[str], drift: str | None = None) -> DataFrame:
    """(key, n_rows, n_conditions, schema_legacy, prompt_legacy): blocks whose conditions are not the expected ones, or with drifted rows.

    Conditions are collected as a set, which holds at most the distinct conditions of a block.
    """
    seen = F.collect_set(F.when(F.col(condition) != "", F.col(condition)))
    out = rows.groupBy(*key).agg(F.count("*").alias("n_rows"), seen.alias("_seen"), (F.bool_or(drift) if drift else F.lit(False)).alias("prompt_legacy"))
    want = F.array(*[F.lit(x) for x in expected]) if expected else F.array().cast("array<string>")
    odd = (F.size("_seen") > 0) & ((F.size("_seen") != len(set(expected))) | (F.size(F.array_except("_seen", want)) > 0))
    return out.select(*key, "n_rows", F.size("_seen").cast("long").alias("n_conditions"), odd.alias("schema_legacy"), "prompt_legacy")


def classify(trials: DataFrame, conditions: DataFrame, check_prompts: bool = True) -> DataFrame:
    """The trials with ``is_legacy``: unknown condition, or a block with other conditions or any drifted prompt.

    conditions: condition, outcome_type, amount; the last of equal conditions counts. Their number is a design
    parameter, so the expected prompts are broadcast.
    """
    names = [r[0] for r in conditions.select("condition").where("condition <> ''").distinct().collect()]
    if not names:
        raise ValueError("no expected conditions")
    own = trials.withColumns({"_b": coerce.partition_key(), "_c": coerce.strip("condition"), "_v": coerce.strip("prompt_version")})
    if check_prompts:
        versions = [r[0] for r in own.select("_v").where("_v <> ''").distinct().collect()]
        if unknown := sorted(set(versions) - set(prompts.VERSIONS)):
            raise ValueError(f"unknown prompt versions: {', '.join(unknown)}")
        if versions:
            spec = conditions.select(F.col("condition").alias("_c"), "outcome_type", "amount").dropDuplicates(["_c"])
            expected = spec.select("*", F.explode(F.array(*[F.lit(v) for v in versions])).alias("_v"))
            expected = expected.select("_c", "_v", prompts.normalized(prompts.prompt_text(F.col("outcome_type"), F.col("amount"), F.col("_v"))).alias("_want"))
            own = own.join(F.broadcast(expected), ["_c", "_v"], "left").withColumn("_drift", F.coalesce(prompts.normalized(F.col("prompt_text")) != F.col("_want"), F.lit(True)))
        else:
            check_prompts = False
    flags = block_flags(own, ["_b"], "_c", names, "_drift" if check_prompts else None)
    legacy = ~F.col("_c").isin(names) | F.col("schema_legacy") | F.col("prompt_legacy")
    return own.join(flags, "_b").withColumn("is_legacy", legacy).select(*trials.columns, "is_legacy")


def report(flags: DataFrame) -> DataFrame:
    """One row of counts over ``block_flags``."""
    return flags.agg(
        F.sum("n_rows").alias("rows"), F.count("*").alias("blocks"), F.count_if("schema_legacy").alias("schema_blocks"), F.count_if("prompt_legacy").alias("prompt_blocks"),
        F.count_if(F.col("schema_legacy") | F.col("prompt_legacy")).alias("legacy_blocks"),
    )
