from __future__ import annotations

import math
import re
from fractions import Fraction
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import audit

from .helpers import clashing, documents, rows, words

LABELS = "doc_id long, quality int, toxic int"


def fails(text: str) -> str:
    w = re.findall("[^\x20\x09-\x0d]+", text)
    upper = sum("A" <= c <= "Z" for c in text)
    return "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * upper > 2 * len(text)) + "D" * any(c in "#$%&*|" for c in text)


def brute(docs, labels):
    """Each order played through, document by document."""
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    told = [(s or "", i, fails(t or "") + "E" * (i is not None and i > least[t or ""])) for i, t, s in docs]
    out = {}
    for part in {p for p, *_ in told}:
        own = [(i, f) for p, i, f in told if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                n_fail = sum(c in f for _, f in own)
                out[part, "".join(order), step] = [len(left), len(gone), n_fail - len(gone), sum(f == c for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    for (part, order, step), v in out.items():
        c = order[step - 1]
        v.append(sum(w[1] for (p, o, s), w in out.items() if p == part and o[s - 1] == c))
    return sorted((*k, *v) for k, v in out.items())


def case():
    long = " ".join(f"w{i}" for i in range(250))
    rare = "a b " * 150
    texts = [long, long, None, "", "Ab # x", rare, rare, "A" + "b" * 60, " \t\n", long + "\x85\xa0" + "é" * 9, "X" * 300 + " y", long, "tie", "tie"]
    docs = [(i, t, (None, "", "s1", "s2")[i % 4]) for i, t in enumerate(texts)]
    return [*docs, (12, "tie", "s1"), (None, "tie", "s1"), (None, None, None)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, source string")


def test_against_playing_the_orders_through(spark):
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, None), (3, None, 1), (99, 1, 1), (None, 1, 1), (5, 0, 0)]
    got = audit.audit(clashing(frame(spark, case())), spark.createDataFrame(labels, LABELS))
    # a null id has no label: the join compares ids
    assert rows(got) == brute(case(), [x for x in labels if x[0] is not None])


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert not rows(audit.audit(documents(spark, []), none))
    got = audit.audit(documents(spark, ["x", None]), none)
    assert got.count() == 2 * 600 and got.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_repeated_rows_and_a_very_long_text(spark):
    text = " ".join(words(1, 1000)) * 300
    docs = [(0, text, "a"), (0, text, "a"), (1, text, "b"), (2, text + "x", "b")]
    assert rows(audit.audit(frame(spark, docs), spark.createDataFrame([(1, 1, 0)], LABELS))) == brute(docs, [(1, 1, 0)])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 15), st.integers(0, 50)))
def test_polynomial(n):
    """Corners are what sets remove; Shapley values are averages over all orders and add up to what all remove."""
    p = audit.Removal(n, 4)
    removed = lambda s: sum(v for m, v in n.items() if m & s)
    assert all(p.at(s) == removed(s) for s in range(16))
    for i in range(4):
        total = 0
        for order in permutations(range(4)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += removed(before | 1 << i) - removed(before)
        assert p.shapley(i) == Fraction(total, math.factorial(4))
    assert sum(p.shapley(i) for i in range(4)) == removed(15)


def test_copies_are_told_from_the_smallest_id(spark):
    rows_ = audit.with_copies(audit.masks(documents(spark, ["x"] * 500 + ["y"]), F.lit("p")), 16)
    assert {r["doc_id"] for r in rows_.collect() if r["mask"] < 16} == {0, 500}
