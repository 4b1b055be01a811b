from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerloom.llm import common, neardup

from .helpers import clashing, documents, words


def brute(texts):
    """Smallest index of each text's component under exact similarity of at least 0.8, or equality."""
    sets = [neardup.shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            near = len(sets[i][0]) and len(sets[j][0]) and neardup.similarity(sets[i], sets[j]) >= 0.8
            if texts[i] == texts[j] or near:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng, base, n):
    own = list(base)
    for _ in range(n):
        own[rng.randrange(len(own))] = "edit" + str(rng.randrange(10**6))
    return own


def corpus():
    rng = random.Random(5)
    texts: list[str | None] = []
    for g in range(6):
        base = words(g, 120)
        texts.append(" ".join(base))
        texts += [" ".join(edited(rng, base, k)) for k in (1, 1, 2, 3, 6, 15)]
        texts += [texts[-1]] * 2
    hub = words(77, 150)  # many copies that are near the original and less so each other
    texts += [" ".join(hub)] + [" ".join(edited(rng, hub, 3)) for _ in range(40)]
    texts += [None, None, "", "", "Hello", "hello", "one two three", "!!!", "???", "A b C d e", "a B c D E"]
    return texts


def test_classes_match_brute_force(spark):
    texts = corpus()
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(clashing(documents(spark, texts))).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


@pytest.mark.parametrize("seed", [1])
def test_family_around_the_threshold_matches_brute_force(spark, seed):
    # every copy is edited on its own, so a copy is near some others only, and mostly not near a given pivot
    rng = random.Random(seed)
    base = words(900 + seed, 200)
    texts = [" ".join(edited(rng, base, rng.choice((2, 3, 4, 5)))) for _ in range(120)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def crowd(pairs=200, size=280):
    """Texts of a base with edits of their own, so that any two are just under the threshold, but for partners, which share one of them."""
    rng = random.Random(3)
    base, texts = words(4321, size), []
    spots = list(range(2, size - 2, 5))
    for k in range(2 * pairs):
        own = list(base)
        mine = random.Random(k // 2)  # partners draw the same spots
        for j, at in enumerate(mine.sample(spots, 7)):
            own[at] = f"w{k // 2 if j < 1 else k}x{j}"
        texts.append(" ".join(own))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [texts[i] for i in order]


@pytest.mark.parametrize(("block", "crowd_pairs", "easy"), [(512, 1 << 12, 64), (16, 8, 0), (16, 1 << 30, 0)])
def test_no_link_is_lost_in_a_crowd_around_the_threshold(spark, monkeypatch, block, crowd_pairs, easy):
    for name, value in (("BLOCK", block), ("CROWD", crowd_pairs), ("EASY", easy)):
        monkeypatch.setattr(neardup, name, value)
    texts = crowd(60)
    want = brute(texts)
    assert len(set(want)) < len(texts)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_long_texts_and_ties(spark):
    long = words(5, 30_000)
    texts = [" ".join(long), " ".join([*long[:-3], "x", "y", "z"]), "a b c d e " * 5000, "a b c d e " * 5000, "a b c d e " * 4999]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [0, 0, 2, 2, 2]


def test_shortlist_is_joined_either_way(spark, monkeypatch):
    texts = corpus()
    want = sorted(r["doc_id"] for r in neardup.deduplicated(documents(spark, texts)).collect())
    assert want == sorted(set(brute(texts)))
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert sorted(r["doc_id"] for r in neardup.deduplicated(documents(spark, texts)).collect()) == want


def test_empty_table_and_repeated_rows(spark):
    df = documents(spark, ["a b c d e f", "x"])
    assert not neardup.classes(df.where("false")).collect()
    kept = neardup.deduplicated(df.union(df)).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 1]
    assert neardup.deduplicated(df).columns == df.columns


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    e = rng.integers(1, 2**63, 500).astype(np.uint64)
    wa, wb = rng.integers(0, 4, 500) * 0.75, rng.integers(0, 4, 500) * 0.75
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    a, b = neardup.signatures_of([(e[wa > 0], wa[wa > 0]), (e[wb > 0], wb[wb > 0])], 4000)
    assert (a == b).mean() == pytest.approx(want, abs=4 * np.sqrt(want * (1 - want) / 4000))
    same = neardup.signatures_of([(e[:3], np.ones(3)), (e[:3], np.ones(3)), (e[5:6], np.ones(1))], 160)
    assert np.array_equal(same[0], same[1]) and not np.array_equal(same[0], same[2]) and (same != 0).all()


def test_signatures_do_not_depend_on_the_batch():
    sets = [neardup.shingles(" ".join(words(i, n))) for i, n in enumerate((1, 5, 6, 50, 400))]
    together = neardup.signatures_of(sets)
    for s, row in zip(sets, together, strict=True):
        assert np.array_equal(neardup.signatures_of([s])[0], row)
