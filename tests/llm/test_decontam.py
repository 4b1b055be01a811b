from __future__ import annotations

import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from ledgerloom.llm import decontam

from .helpers import clashing, documents, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items):
    own = WORD.findall(low(text))
    hit, found = set(), set()
    for item_id, t in items:
        w = WORD.findall(low(t))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item_id))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def corpus():
    rng = random.Random(3)
    items = [(i, " ".join(words(500 + i, rng.randint(3, 25)))) for i in range(12)] + [(12, "Ünder É9"), (13, ""), (14, None), (3, "x")] + [(2, " ".join(words(502, 8)))]
    texts: list[str | None] = [None, "", "!?", "under é9 ünder É9", "a x b X"]
    for i in range(30):
        w = words(900 + i, 30)
        _, t = rng.choice(items[:12])
        w[7:7] = t.upper().split() if i % 2 else t.split()[1:]
        texts.append(", ".join(w))
    return texts, items


@pytest.mark.parametrize("block", [decontam.BLOCK_CHARS, 300])
def test_matches_brute_force(spark, block):
    texts, items = corpus()
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: r for r in decontam.contamination(clashing(documents(spark, texts)), bench, block_chars=block).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(t, items), t
        covered = [t[s["start"] : s["end"]] for s in r["spans"]]
        assert sum(len(WORD.findall(low(c))) for c in covered) == r["n_hit"]
    kept = decontam.clean(documents(spark, texts), bench, block_chars=block)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in got if not got[i]["contaminated"])
    assert kept.columns == documents(spark, texts).columns


def test_empty_sides(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    df = documents(spark, ["a b", None])
    assert not decontam.contamination(df.where("false"), bench).collect()
    assert {r["n_hit"] for r in decontam.contamination(df, bench.where("false")).collect()} == {0}
    assert decontam.clean(df, bench.where("false")).count() == 2


def test_rows_of_one_doc_id_keep_their_own_result(spark):
    bench = spark.createDataFrame([(1, "a b c"), (2, "x y z")], "item_id long, text string")
    df = documents(spark, ["a b c", "x y z", "a b c x y z", "q"]).withColumn("doc_id", F.lit(7).cast("long"))
    for block in (100, 3):
        assert sorted(r["n_hit"] for r in decontam.contamination(df, bench, block_chars=block).collect()) == [0, 3, 3, 6]


def test_memory_of_a_block():
    import random
    import tracemalloc

    rng = random.Random(1)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))) for i in range(600)]
    tracemalloc.start()
    decontam.Matcher(items)
    used, chars = tracemalloc.get_traced_memory()[1], sum(len(t) for _, t in items)
    tracemalloc.stop()
    # what Python sees; the automaton's own nodes are as much again
    assert used / chars * decontam.BLOCK_CHARS < 250e6
