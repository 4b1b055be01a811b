"""Progress of blocks towards a target number of runs per condition, and rollups of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_progress(rows: DataFrame, block: list[str], condition: str, run: str, expected: list[str], target: int) -> DataFrame:
    """One row per block: rows, runs, covered conditions, least and most runs, what remains, share done, missing conditions, largest deficits."""
    per = rows.groupBy(*block, condition).agg(F.count("*").alias("rows"), F.countDistinct(F.when(F.col(run) > 0, F.col(run))).alias("have"))
    listed = F.collect_list(F.when((F.col(condition) != "") & (F.col("have") > 0), F.struct(F.col(condition).alias("c"), "have")))
    got = per.groupBy(*block).agg(F.sum("rows").alias("n_rows"), F.map_from_entries(listed).alias("_m"))  # as many entries as conditions
    want = F.array(*[F.lit(x) for x in sorted(expected)])
    have = F.transform(want, lambda c: F.struct(c.alias("c"), F.coalesce(F.try_element_at("_m", c), F.lit(0)).cast("long").alias("have")))
    runs = F.map_values("_m")
    lacking = F.filter(F.transform(have, lambda x: F.struct((x["have"] - target).alias("short"), x["c"].alias("c"))), lambda x: x["short"] < 0)
    total = len(expected) * target
    add = lambda a, f: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + f(x))
    out = got.withColumn("_have", have)
    done = add(F.col("_have"), lambda x: F.least(x["have"], F.lit(target).cast("long")))
    missing = F.array_except(want, F.map_keys("_m"))
    return out.select(
        *block, "n_rows", add(runs, lambda x: x).alias("total_unique_runs"), F.size(runs).cast("long").alias("covered_conditions"),
        F.coalesce(F.array_min(runs), F.lit(0)).alias("per_condition_min"), F.coalesce(F.array_max(runs), F.lit(0)).alias("per_condition_max"),
        (F.lit(total) - done).alias("remaining_to_target"), (done * 100.0 / max(total, 1)).alias("progress_pct"),
        ((F.size(missing) == 0) & (F.size(runs) == len(expected))).alias("schema_ok"), F.array_join(missing, ",").alias("missing_conditions"),
        F.array_join(F.transform(F.slice(F.array_sort(lacking), 1, 3), lambda x: F.concat(x["c"], F.lit(":"), (-x["short"]).cast("string"))), ",").alias("top_deficits"),
    )


def by_group(progress: DataFrame, key: str) -> DataFrame:
    """Blocks, complete blocks, rows, runs and what remains of each model or other group."""
    complete = (F.col("remaining_to_target") == 0) & F.col("schema_ok")
    return progress.groupBy(key).agg(
        F.count("*").alias("blocks"), F.count_if(complete).alias("complete_blocks"), F.sum("n_rows").alias("n_rows"), F.sum("total_unique_runs").alias("runs"), F.sum("remaining_to_target").alias("remaining"),
    )
