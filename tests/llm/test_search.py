from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import search
from ledgerloom.llm.common import Tables

from .helpers import CLASH, documents, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """All scores of all documents."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, c.total()) for i, c in own if c]
    n_docs, length = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in own:
            m = 10 + 90 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i, score))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    bag = [f"w{i}" for i in range(vocabulary)] + ["Été", "ÀB", "x1y", "LOW"]
    weights = [1 / (i + 1) for i in range(len(bag))]
    return [" ".join(rng.choices(bag, weights, k=rng.choice([1, 5, 30, 200]))) for _ in range(n)]


def run(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH if c != "text"})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("term", "weight", "doc_id")})
    return rows(search.search(d, q, k))


@pytest.mark.parametrize("k", [1, 10])
def test_against_all_scores(spark, k):
    docs = list(enumerate(corpus(1, 300)))
    docs += [(1000 + i, t) for i, (_, t) in enumerate(docs[:20])]  # ties
    items = list(enumerate(corpus(2, 25)))
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_edge_cases(spark):
    docs = [(0, None), (1, ""), (2, "..,"), (3, "a"), (4, "A b"), (4, "A b"), (5, "b B b"), (None, "b"), (6, "ç Ç"), (7, "c" * 5000), (8, "z y x " * 50_000 + "a")]
    items = [(0, None), (1, "?"), (2, "a"), (2, "a"), (3, "A,B"), (4, "nowhere"), (5, "Ç"), (6, "c" * 5000), (7, " ".join(t for _, t in docs if t))]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert not run(spark, [], [(0, "a")]) and not run(spark, [(0, "a")], [])


def test_terms_in_every_document_weigh_nothing(spark):
    docs = [(i, "the x" if i < 400 else "the") for i in range(1200)]
    assert run(spark, docs, [(0, "the"), (1, "the x")]) == brute(docs, [(0, "the"), (1, "the x")])


def test_shuffles_and_chunks_change_nothing(spark, monkeypatch):
    docs, items = list(enumerate(corpus(3, 200))), list(enumerate(corpus(4, 12)))
    want = brute(docs, items)
    monkeypatch.setattr(search, "CHUNK_ROWS", (7, 20))
    assert run(spark, docs, items) == want
    monkeypatch.setattr(search, "BROADCAST_IDS", 0)
    assert run(spark, docs, items) == want
    monkeypatch.setattr(search, "BLOCK_TERMS", 60)  # blocks of queries
    assert run(spark, docs, items) == want


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = " ".join(corpus(5, 40)).encode()
    want = Counter(t.encode() for t in terms(text.decode()))
    for size in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(search, "PIECE", size)
        assert search.count_terms(text) == want
    assert search.count_terms("ÉAé٣x²".encode()) == Counter({"Éaé٣x²".encode(): 1})


def test_thresholds_leave_entries_unread(spark):
    """Phase 2 reads fewer entries than the lists have, and phase 3 looks up fewer documents than have a term."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["the", "of", "and", *(f"r{i}" for i in range(300))], [200, 150, 100] + [1] * 300, k=40)) for _ in range(2000)]
    items = spark.createDataFrame([(i, texts[i * 31]) for i in range(10)], "item_id long, text string")
    tables = Tables(spark)
    terms = search.query_terms(items).select(F.col("item_id").alias("_query"), F.explode("terms").alias("term"))
    index = search.Index(documents(spark, texts), terms, tables)
    asked = tables.write(search.bounds(index, 1), "bounds")
    every = index.postings.join(index.queries, "term")
    fetched = index.postings.join(asked, "term").where("part >= least").count()
    looked_up = search.candidates(index, asked, 1).count()
    assert 0 < fetched < 0.6 * every.count() and 0 < looked_up < 0.1 * every.select("_query", "_doc").distinct().count()
