from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from ledgerloom.functions import text
from ledgerloom.operators import overlap

SCHEMA = "o long, prompt_id string, pair_id string, prompt_text string"


def corpus(seed: int, n: int):
    rng = random.Random(seed)
    bag = [f"{a}{b}" for a in ("sto", "mar", "gai", "ris", "pla", "win") for b in ("ck", "ket", "ning", "ky", "yer", "x1")] + ["the", "of", "an"]
    out = ["", "the of", "an", "One", "one."]
    while len(out) < n:
        words = [rng.choice(bag) for _ in range(rng.choice([3, 8, 30, 60]))]
        if len(out) > 8 and rng.random() < 0.6:
            words = rng.choice(out[5:]).split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(bag)
        out.append(" ".join(words))
    return [(i, f"p{i}", rng.choice(["", "", "x", "y"]), t) for i, t in enumerate(out)]


def features(t: str):
    norm = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split())
    kept = [w for w in norm.split() if w not in text.STOPWORDS]
    return norm, {w for w in kept if len(w) > 2}, {tuple(kept[i : i + 5]) for i in range(len(kept) - 4)}


def scores(a: str, b: str, limits):
    (na, ta, ga), (nb, tb, gb) = features(a), features(b)
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    char, token, gram = SequenceMatcher(None, na, nb).ratio(), jaccard(ta, tb), jaccard(ga, gb)
    names = [n for n, v, t in zip(("high_char_similarity", "high_token_overlap", "high_ngram_overlap"), (char, token, gram), limits, strict=True) if v >= t]
    return ("exact_normalized" if na and na == nb else "+".join(names)), max(char, token, gram), round(char, 9)


@pytest.mark.parametrize("limits", [overlap.LIMITS, (0.6, 0.9, 0.7), (1.0, 1.0, 1.0), (2.0, 0.3, 0.2)])
def test_internal_against_all_pairs(spark, monkeypatch, limits):
    monkeypatch.setattr(overlap, "BLOCK", 20)
    rows = corpus(1, 120)
    own = overlap.prepared(spark.createDataFrame(rows, SCHEMA), "o")
    got = {(r["candidate_ordinal"], r["reference_ordinal"]): (r["overlap_type"], round(r["char_similarity"], 9)) for r in overlap.internal(own, limits).collect()}
    want = {}
    for i, _, p, a in rows:
        for j, _, q, b in rows[i + 1 :]:
            label, _, char = scores(a, b, limits)
            if label and not (p and p == q):
                want[i, j] = (label, char)
    assert got == want and len(want) > 20


def test_best_reference_against_all_pairs(spark):
    candidates, references = corpus(2, 40), corpus(3, 60) + [(100 + i, "r", "", t) for i, _, _, t in corpus(2, 20)]
    make = lambda rows: overlap.prepared(spark.createDataFrame(rows, SCHEMA), "o")
    got = {r["candidate_ordinal"]: (r["reference_ordinal"], r["overlap_type"]) for r in overlap.audit(make(candidates), make(references)).collect()}
    want = {}
    for i, _, _, a in candidates:
        best = -1.0
        for j, _, _, b in references:
            label, score, _ = scores(a, b, overlap.LIMITS)
            if label and score > best:
                best, want[i] = score, (j, label)
    assert got == want and len(want) >= 20


def test_empty_tables(spark):
    none, some = (overlap.prepared(spark.createDataFrame(rows, SCHEMA), "o") for rows in ([], corpus(4, 10)))
    assert not overlap.audit(none, some).collect() and not overlap.audit(some, none).collect() and not overlap.internal(none).collect()


def test_far_texts_are_not_compared(spark):
    """Most pairs are excluded before any exact score."""
    own = overlap.prepared(spark.createDataFrame(corpus(5, 150), SCHEMA), "o")
    assert overlap.character_pairs(own, own, 0.82, True).count() < 0.3 * 150 * 149 / 2
    assert overlap.set_pairs(own, own, "grams", 0.3, True).count() < 0.2 * 150 * 149 / 2
