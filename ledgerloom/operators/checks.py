"""Checks of rows in one pass: kinds of failure, their numbers, and the first places of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: What the two prompts of a pair share.
PAIR_FIELDS = ("domain", "outcome_valence", "amount_bucket", "source_llm")
#: The roles of a pair.
PAIR_ROLES = ("paper_open", "realized_closed")


def violations(df: DataFrame, checks: dict[str, Column], place: Column) -> DataFrame:
    """(kind, place): a row for each check that a row of ``df`` fails."""
    failed = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return df.select(F.explode(failed).alias("kind"), place.cast("string").alias("place"))


def counted(found: DataFrame, sample: int = 25) -> DataFrame:
    """(kind, n, places): violations of each kind, and the first ``sample`` places by name. Tasks pass on ``sample`` rows a kind."""
    sizes = found.groupBy("kind").agg(F.count("*").alias("n"))
    first = found.withColumn("_i", F.row_number().over(Window.partitionBy("kind").orderBy("place"))).where(F.col("_i") <= sample)
    shown = first.groupBy("kind").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return sizes.join(shown, "kind")


def prompt_issues(prompts: DataFrame, most: int = 25) -> DataFrame:
    """(prompt_id, pair_id, pair_role, issue, detail) of prompts on their own, of repeated ids, and of pairs.

    prompts: prompt_id, prompt_text, pair_id, pair_role and ``PAIR_FIELDS``. A pair is one prompt of each role, which share their
    fields and differ by at most ``most`` words. Pairs are judged by partial sums, so one of very many rows is no burden on a task.
    """
    cell = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = prompts.select(*[cell(c) for c in ("prompt_id", "prompt_text", "pair_id", "pair_role", *PAIR_FIELDS)])
    ends = ("prompt_id", "pair_id", "pair_role")
    own = rows.select(*ends, F.explode(text.prompt_issues(F.col("prompt_text"))).alias("issue"), F.lit("").alias("detail"))
    ids = rows.groupBy("prompt_id").count().where("count > 1")
    repeated = ids.select("prompt_id", F.lit("").alias("pair_id"), F.lit("").alias("pair_role"), F.lit("duplicate_prompt_id").alias("issue"), F.lit("").alias("detail"))
    by_role = rows.groupBy("pair_id", "pair_role").agg(F.count("*").alias("n"), F.max(text.word_count(F.col("prompt_text"))).alias("words"), *[F.max(c).alias(c) for c in PAIR_FIELDS])
    role = lambda r, c: F.max(F.when(F.col("pair_role") == r, F.col(c)))
    differs = F.array(*[F.when(role(PAIR_ROLES[0], c) != role(PAIR_ROLES[1], c), F.lit(c)) for c in PAIR_FIELDS])
    seen = F.transform(F.array_sort(F.collect_list(F.struct("pair_role", "n"))), lambda x: F.concat(F.lit('"'), x["pair_role"], F.lit('": '), x["n"].cast("string")))
    pairs = by_role.groupBy("pair_id").agg(
        ((F.count("*") == 2) & (F.max("n") == 1) & (F.count_if(F.col("pair_role").isin(*PAIR_ROLES)) == 2)).alias("whole"),
        F.concat(F.lit("{"), F.array_join(seen, ", "), F.lit("}")).alias("roles"), F.array_compact(differs).alias("differs"), F.abs(role(PAIR_ROLES[0], "words") - role(PAIR_ROLES[1], "words")).alias("delta"),
    )
    issue = lambda name, detail: F.struct(F.lit(name).alias("issue"), detail.cast("string").alias("detail"))
    mismatch = F.transform("differs", lambda c: issue("pair_metadata_mismatch", c))
    far = F.when(F.col("delta") > most, F.array(issue("pair_word_delta", F.col("delta")))).otherwise(F.filter(F.array(issue("", F.lit(""))), lambda x: F.lit(False)))
    found = F.when(F.col("whole"), F.concat(mismatch, far)).otherwise(F.array(issue("bad_pair_roles", F.col("roles"))))
    bad = pairs.select("pair_id", F.explode(found).alias("x")).select("pair_id", "x.issue", "x.detail")
    return own.unionByName(repeated).unionByName(rows.select(*ends).join(bad, "pair_id").select(*ends, "issue", "detail"))
