"""Overlap audits between candidate and reference prompts, without loss and without comparing all pairs by the costly ratio.

A pair gets a label for equal texts, a high character ratio, or a high similarity of its content words or its n-grams. Each
of these has its own way to the pairs that may have it:

- equal texts meet by an equi-join;
- sets of words or n-grams meet by prefixes: with the rarest first, two sets of similarity t share one of their first
  n - ceil(t n) + 1 elements, and the smaller has at least t times the elements of the larger; two empty sets are equal;
- the character ratio is at most twice the common characters over all characters, so counts of characters are compared, by
  blocks of texts of about the same length. What is dealt to blocks are counts, never texts, and only pairs within the
  bound come out.

Only the pairs found get all exact scores. Prompts with equal empty sets are all similar by definition, so a group of them gives
all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text
from ..sources import scratch

#: Texts of a block of which all are compared with another block in one task, by their counts of characters.
BLOCK = 2000
#: Bytes of n-grams, with 64 a row beside the text, that are broadcast.
GRAM_BYTES = 64 << 20
LIMITS = (0.82, 0.55, 0.30)
_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Against rounding, where a bound is compared with a limit.
_SLACK = 1e-9


def prepared(prompts: DataFrame, ordinal: str, n: int = 5) -> DataFrame:
    """(ordinal, id, pair, norm, tokens, grams) of prompts with prompt_id, pair_id and prompt_text."""
    own = prompts.select(F.col(ordinal).cast("long").alias("ordinal"), F.col("prompt_id").alias("id"), F.coalesce("pair_id", F.lit("")).alias("pair"), text.normalized(text.core(F.col("prompt_text"))).alias("norm"))
    return own.withColumns({"tokens": text.content_tokens(F.col("norm")), "grams": text.ngrams(F.col("norm"), n)})


def _ends(left: DataFrame, right: DataFrame, *fields: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with their fields named a_ and b_."""
    return tuple(df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("ordinal", "pair", *fields)]) for side, df in (("a", left), ("b", right)))


def _allowed(internal: bool) -> Column:
    """Within one table, each pair once, and no matched pairs."""
    matched = (F.col("a_pair") != "") & (F.col("a_pair") == F.col("b_pair"))
    return (F.col("a_ordinal") < F.col("b_ordinal")) & ~matched if internal else F.lit(True)


def _prefixes(df: DataFrame, frequency: DataFrame, column: str, limit: float) -> DataFrame:
    """(ordinal, pair, size, element) of the rarest elements of each set, as many as a similar set must meet."""
    own = df.select("ordinal", "pair", F.explode(column).alias("element")).join(frequency, "element")
    sets = own.groupBy("ordinal", "pair").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("s"))
    size = F.size("s")
    first = size - F.ceil(size * limit - _SLACK).cast("int") + 1
    return sets.select("ordinal", "pair", size.alias("size"), F.explode(F.slice("s", F.lit(1), F.least(size, first))).alias("e")).select("ordinal", "pair", "size", F.col("e.element").alias("element"))


def set_pairs(left: DataFrame, right: DataFrame, column: str, limit: float, internal: bool = False) -> DataFrame:
    """(a_ordinal, b_ordinal) of all pairs whose sets may be at least so similar, and maybe others. limit: above 0."""
    every = left.select(column) if internal else left.select(column).unionByName(right.select(column))
    frequency = every.select(F.explode(column).alias("element")).groupBy("element").agg(F.count("*").alias("n"))
    a, b = _ends(_prefixes(left, frequency, column, limit), _prefixes(right, frequency, column, limit), "size", "element")
    fits = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * limit - _SLACK
    shared = a.join(b, (F.col("a_element") == F.col("b_element")) & fits & _allowed(internal))
    empty_a, empty_b = _ends(left.where(F.size(column) == 0), right.where(F.size(column) == 0), column)
    none = empty_a.join(empty_b, (F.size(f"a_{column}") == F.size(f"b_{column}")) & _allowed(internal))
    ends = ("a_ordinal", "b_ordinal")
    return shared.select(*ends).unionByName(none.select(*ends)).distinct()


def _counted(df: DataFrame, limit: float) -> DataFrame:
    """(ordinal, pair, length, counts, band): characters by kind; texts that may be so similar are in one band or in neighbouring ones."""
    step = max(math.log((2 - limit) / limit), 0.01) * (1 + _SLACK)  # a ratio of lengths beyond this excludes the limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(256, len(_CHARACTERS), np.int64)
        table[np.frombuffer(_CHARACTERS.encode(), np.uint8)] = np.arange(len(_CHARACTERS))
        for batch in batches:
            norms = [x.encode() for x in batch.column(2).to_pylist()]
            counts = [np.bincount(table[np.frombuffer(x, np.uint8)], minlength=len(_CHARACTERS)).astype(np.int32) for x in norms]
            bands = [int(math.log(max(1, len(x))) / step) for x in norms]
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in norms], pa.int32()), pa.array(counts, pa.list_(pa.int32())), pa.array(bands, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["ordinal", "pair", "length", "counts", "band"])

    return df.select("ordinal", "pair", "norm").mapInArrow(run, "ordinal long, pair string, length int, counts array<int>, band int")


def character_pairs(left: DataFrame, right: DataFrame, limit: float, internal: bool = False) -> DataFrame:
    """(a_ordinal, b_ordinal) of all pairs whose common characters allow the ratio ``limit``, above 0 and up to 1."""
    a = scratch.written(_counted(left, limit), "counts")
    b = a if internal else scratch.written(_counted(right, limit), "counts")
    # a row for each band of lengths: at most a few dozen
    parts = {side: {r["band"]: -(-r["count"] // BLOCK) for r in df.groupBy("band").count().collect()} for side, df in (("a", a), ("b", b))}

    def dealt(df: DataFrame, side: str, other: str) -> DataFrame:
        near = [(band, e, parts[side][band], sub) for band in parts[side] for e in (band - 1, band, band + 1) for sub in range(parts[other].get(e, 0))]
        blocks = df.sparkSession.createDataFrame(near, "band int, other_band int, subs int, other_sub int")
        own = df.join(F.broadcast(blocks), "band").withColumn("sub", F.pmod(F.xxhash64("ordinal"), "subs").cast("int"))
        mine, others = F.struct("band", "sub"), F.struct(F.col("other_band").alias("band"), F.col("other_sub").alias("sub"))
        return own.select((mine if side == "a" else others).alias("a_block"), (others if side == "a" else mine).alias("b_block"), F.lit(side).alias("side"), "ordinal", "pair", "length", "counts")

    def compare(table: pa.Table) -> pa.Table:
        side = np.array(table.column("side").to_pylist())
        ordinal, length = (table.column(c).to_numpy() for c in ("ordinal", "length"))
        pair, counts = np.array(table.column("pair").to_pylist(), object), np.array(table.column("counts").to_pylist(), np.int32).reshape(len(side), -1)
        mine, others = np.flatnonzero(side == "a"), np.flatnonzero(side == "b")
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for i in mine:
            total = length[i] + length[others]
            ok = 2 * np.minimum(counts[i], counts[others]).sum(1) >= limit * total - _SLACK
            if internal:
                ok &= (ordinal[i] < ordinal[others]) & ~((pair[others] == pair[i]) & (pair[i] != ""))
            hit = others[ok]
            out.append((np.full(len(hit), ordinal[i]), ordinal[hit]))
        found = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2
        return pa.table({"a_ordinal": pa.array(found[0], pa.int64()), "b_ordinal": pa.array(found[1], pa.int64())})

    both = dealt(a, "a", "b").unionByName(dealt(b, "b", "a"))
    return both.groupBy("a_block", "b_block").applyInArrow(compare, "a_ordinal long, b_ordinal long")


@F.pandas_udf(DoubleType())
def character_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks; the first text comes first, as it is not symmetric."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _pairs(candidates: DataFrame, references: DataFrame, limits: tuple[float, float, float], internal: bool) -> DataFrame:
    """All labelled pairs with their scores. A limit above 1 gives no label."""
    left = scratch.written(candidates, "candidates")
    right = left if internal else scratch.written(references, "references")
    a, b = _ends(left, right, "norm")
    ends = ("a_ordinal", "b_ordinal")
    met = a.where("a_norm <> ''").join(b, (F.col("a_norm") == F.col("b_norm")) & _allowed(internal)).select(*ends)
    if limits[0] <= 1:
        met = met.unionByName(character_pairs(left, right, limits[0], internal))
    for column, limit in (("tokens", limits[1]), ("grams", limits[2])):
        if limit <= 1:
            met = met.unionByName(set_pairs(left, right, column, limit, internal))
    full = ("norm", "tokens", "grams")
    a, b = (df.drop(f"{side}_pair") for side, df in zip("ab", _ends(left, right, *full), strict=True))
    both = met.distinct().join(a, "a_ordinal").join(b, "b_ordinal")
    scores = both.select(
        F.col("a_ordinal").alias("candidate_ordinal"), F.col("b_ordinal").alias("reference_ordinal"), ((F.col("a_norm") != "") & (F.col("a_norm") == F.col("b_norm"))).alias("exact"),
        character_ratio("a_norm", "b_norm").alias("char_similarity"), text.jaccard(F.col("a_tokens"), F.col("b_tokens")).alias("token_jaccard"), text.jaccard(F.col("a_grams"), F.col("b_grams")).alias("ngram_jaccard"),
    )
    label = text.overlap_label(F.col("exact"), F.col("char_similarity"), F.col("token_jaccard"), F.col("ngram_jaccard"), limits)
    return scores.withColumn("overlap_type", label).where("overlap_type <> ''")


def audit(candidates: DataFrame, references: DataFrame, limits: tuple[float, float, float] = LIMITS) -> DataFrame:
    """The best labelled reference of each candidate; the first reference wins among equals. Both sides are ``prepared``."""
    score = F.greatest("char_similarity", "token_jaccard", "ngram_jaccard")
    w = Window.partitionBy("candidate_ordinal").orderBy(F.desc("_s"), "reference_ordinal")
    return _pairs(candidates, references, limits, False).withColumn("_s", score).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_s", "_k")


def internal(candidates: DataFrame, limits: tuple[float, float, float] = LIMITS) -> DataFrame:
    """Every labelled pair of candidates, the earlier first, but for those of one matched pair."""
    return _pairs(candidates, candidates, limits, True)


def shared_gram_overlap(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, n_common, jaccard) of rows (id, grams) whose sets of n-grams are at least this similar.

    An equi-join on n-grams: pairs without a common one cannot qualify. Grams that a side repeats count once.
    The bytes of the right side's grams are added up first: up to ``GRAM_BYTES`` they are broadcast, so that the left
    side's grams are dropped where they lie. More of them are joined by a shuffle.
    """
    a = left.select(F.col("id").alias("left_id"), F.size("grams").alias("ln"), F.explode("grams").alias("g"))
    b = right.select(F.col("id").alias("right_id"), F.size("grams").alias("rn"), F.explode("grams").alias("g"))
    size = b.agg(F.sum(F.octet_length("g") + 64)).first()[0] or 0
    both = a.join(F.broadcast(b) if size <= GRAM_BYTES else b, "g").groupBy("left_id", "right_id", "ln", "rn").agg(F.count("*").alias("n_common"))
    return both.withColumn("jaccard", F.col("n_common") / (F.col("ln") + F.col("rn") - F.col("n_common"))).where(F.col("jaccard") >= least).select("left_id", "right_id", "n_common", "jaccard")
