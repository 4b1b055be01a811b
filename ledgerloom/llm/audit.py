"""Filter interaction audit: what every filter removes in every order, and its Shapley share of what all remove.

Each document is a bit mask of the filters it fails. The masks' counts of a part make its removal polynomial, the multilinear
extension R(x) = sum over masks of n(mask) * (1 - product over the mask's filters of (1 - x)). At a corner, R is what a set of
filters removes, so corner values give what each order keeps at each step. Along the diagonal, the integral of a filter's
partial derivative is its Shapley value, an exact fraction; times the number of orders it is whole.

Spark reads each text once for its mask; what is shuffled are narrow rows (id, digest, part, mask), by ids or digests. A
group of equal texts is known by its smallest id, found by partial minima, and its members are told from that one by a join on
(digest, id): neither a group of copies nor a part is ever in one task.

Edge cases: a null text is empty, a null part the empty string; a null id is smaller and larger than none; rows that repeat an
id and text are equal, none is smaller; labels count if any row of an id says so; other columns are not read; an empty table
gives no rows. A text has any length; its words are held once in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow

WORDS = "[^\\x20\\x09-\\x0D]+"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
MARKS = "[#$%&*|]"
#: The last filter of the query: it needs the other documents.
COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that is not null: few words, repeated words, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n = F.size(words)
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_UPPER_PERCENT * F.length(text),
        "D": text.rlike(MARKS),
    }


def masks(documents: DataFrame, part: Column) -> DataFrame:
    """(doc_id, part, digest, mask): a bit for each text filter that the document fails, the first filter's is 1."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_filters(text).values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    return documents.select("doc_id", F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """Adds ``bit`` to the mask of each row whose digest a smaller doc_id has."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    late = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(first, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask") + F.when(late, bit).otherwise(0)).drop("_first")


def counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of (doc_id, part, mask): documents, those labelled good, and those labelled toxic."""
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = rows.select("doc_id", "part", "mask").join(said.where("good = 1 or toxic = 1"), "doc_id", "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


class Removal:
    """The removal polynomial of mask counts: its coefficient at a set of filters, a bit mask."""

    def __init__(self, n: Mapping[int, int], filters: int):
        self.filters = filters
        self.coefficient = {s: (1 if s.bit_count() % 2 else -1) * sum(v for m, v in n.items() if m & s == s) for s in range(1, 1 << filters)}

    def at(self, corner: int) -> int:
        """What the set of filters removes."""
        return sum(c for s, c in self.coefficient.items() if s & ~corner == 0)

    def derivative(self, i: int) -> list[int]:
        """Coefficients, by power, of the partial derivative by filter ``i`` on the diagonal."""
        out = [0] * self.filters
        for s, c in self.coefficient.items():
            if s >> i & 1:
                out[s.bit_count() - 1] += c
        return out

    def shapley(self, i: int) -> Fraction:
        """The integral from 0 to 1 of that derivative."""
        return sum((Fraction(c, power + 1) for power, c in enumerate(self.derivative(i))), Fraction(0))


_NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_FIELDS = {"part": pa.string(), "filter_order": pa.string(), "step": pa.int32()} | dict.fromkeys(_NUMBERS, pa.int64())


def order_rows(part: str, cells: list[dict], names: str) -> Iterator[tuple]:
    """The rows of one part: a step of an order each."""
    k, whole = len(names), (1 << len(names)) - 1
    total = sum(c["n"] for c in cells)
    n, good, toxic = (Removal({c["mask"]: c[key] for c in cells}, k) for key in ("n", "good", "toxic"))
    gone = [[p.at(s) for s in range(whole + 1)] for p in (n, good, toxic)]
    alone = [gone[0][whole] - gone[0][whole & ~(1 << i)] for i in range(k)]
    share = [n.shapley(i) * math.factorial(k) for i in range(k)]
    for order in permutations(range(k)):
        name, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good_lost, toxic_lost = (g[after] - g[before] for g in gone)
            yield part, name, step, total - gone[0][after], removed, gone[0][1 << i] - removed, alone[i], good_lost, toxic_lost, int(share[i])
            before = after


def orders(cells: DataFrame, names: str) -> DataFrame:
    """Each part's steps of all orders of the filters, from its at most 2 ** len(names) mask counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield arrow(_FIELDS, dict(zip(_FIELDS, map(list, zip(*order_rows(row["part"], row["cells"], names), strict=True)), strict=True)))

    rows = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _NUMBERS))


def audit(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """All orders of the four text filters and the one for copies, for each value of ``part``."""
    names = "".join(text_filters(F.lit(""))) + COPY
    rows = with_copies(masks(documents, F.col(part)), 1 << names.index(COPY))
    return orders(counts(rows, labels), names)
