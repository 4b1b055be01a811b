from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import linededup

from .helpers import clashing, documents, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def allowed(n, edits):
    return 0 if n < linededup.SHORT else min(1, edits) if n < linededup.LONG else edits


def brute(texts, edits, links=False):
    own = [(i, k, re.sub(r"^\s+|\s+$", "", line)) for i, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))]
    own = [x for x in own if x[2]]
    distinct = list(dict.fromkeys(x[2] for x in own))
    up = {x: x for x in distinct}
    degree = dict.fromkeys(distinct, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            most = allowed(min(len(a), len(b)), edits)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                up[find(a)] = find(b)
                degree[a] += 1
                degree[b] += 1
    first: dict[str, tuple[int, int]] = {}
    for i, k, line in own:
        first[find(line)] = min(first.get(find(line), (i, k)), (i, k))
    if links:
        sizes = Counter(find(line) for _, _, line in own)
        return {(i, k, *first[find(line)], sizes[find(line)], degree[line]) for i, k, line in own if sizes[find(line)] > 1}
    return {(i, k, *first[find(line)]) for i, k, line in own if first[find(line)] != (i, k)}


def corpus():
    rng = random.Random(9)
    letters = "abcdefé "

    def edited(line, n):
        s = list(line)
        for _ in range(n):
            p, kind = rng.randrange(len(s)), rng.randrange(3)
            if kind == 0:
                s[p] = rng.choice(letters)
            elif kind == 1:
                s.insert(p, rng.choice(letters))
            else:
                s.pop(p)
        return "".join(s)

    bases = [" ".join(words(i, rng.randint(4, 14))) for i in range(15)]
    texts: list[str | None] = [None, "", "\n \n\t\n", "short\nshort\nshorx", bases[0] + "\r\n" + bases[0] + "\n"]
    for i in range(60):
        texts.append("\n".join(edited(rng.choice(bases), rng.choice([0, 0, 1, 1, 2, 3, 4])) for _ in range(4)) + "\n" + " ".join(words(5000 + i, 6)))
    # lines around the lengths at which other numbers of edits are allowed, and near ones of them
    for n in (*range(6, 11), *range(22, 28)):
        line = "".join(words(900 + n, 9))[:n]
        texts += [line, line[:-1], line[: n // 2] + "#" + line[n // 2 + 1 :], "?" + line + "!"]
    # a crowded key: one long common part, ends that differ by one word
    texts += ["the very same beginning of a line that goes on, then " + w for w in words(42, 30)]
    return texts


@pytest.mark.parametrize("edits", [1, 2])
def test_matches_brute_force(spark, edits):
    texts = corpus()
    got = {tuple(r) for r in linededup.repeats(clashing(documents(spark, texts)), edits).select("doc_id", "line_no", "first_doc", "first_line").collect()}
    assert got == brute(texts, edits)


def test_classes_and_links_match_brute_force(spark):
    texts = corpus()
    got = {tuple(r) for r in linededup.classes(documents(spark, texts)).drop("n_chars").collect()}
    assert got == brute(texts, linededup.EDITS, links=True)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    rng, pairs = random.Random(edits), [("", ""), ("", "a"), ("abc", ""), ("same", "same")]
    for _ in range(1500):
        a = b = "".join(rng.choice("abé𝄞") for _ in range(rng.randint(1, 30)))
        for _ in range(rng.randint(0, 5)):
            p = rng.randrange(len(b) + 1)
            b = b[:p] + rng.choice(["", "a", "𝄞", "bé"]) + b[p + rng.randint(0, 1) :]
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.within("a", "b", edits).alias("near"))
    assert all(r["near"] == (distance(r["a"], r["b"]) <= edits) for r in df.collect())


@pytest.mark.parametrize("limits", [(1, 10_000), (1, 1)])
def test_places_in_blocks_or_shuffled(spark, monkeypatch, limits):
    texts = corpus()[:25]
    monkeypatch.setattr(linededup, "BLOCK", limits[0])
    monkeypatch.setattr(linededup, "BLOCKS", limits[1])
    got = {tuple(r) for r in linededup.repeats(documents(spark, texts)).select("doc_id", "line_no", "first_doc", "first_line").collect()}
    assert got == brute(texts, linededup.EDITS)


def test_only_jvm_operators(spark):
    plan = linededup.repeats(documents(spark, ["a\nb"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_removal_keeps_first_lines_and_whole_copies(spark):
    boiler, one, two = "All rights are reserved by the owner.", " ".join(words(1, 30)), " ".join(words(2, 30))
    texts = [one + "\n" + boiler, two + "\n" + boiler + "\nend", one + "\n" + boiler, boiler, None, ""]
    df = documents(spark, texts)
    got = {r["doc_id"]: r for r in linededup.deduplicated(clashing(df)).collect()}
    assert got[0]["text"] == texts[0] and got[1]["text"] == two + "\nend" and got[1]["n_chars"] == len(two) + 4
    assert got[2]["text"] == texts[2] and got[3]["text"] == boiler and got[4]["text"] is None and got[5]["text"] == ""
    assert linededup.deduplicated(df).schema.names == df.schema.names and len(got) == 6


def test_removal_of_a_documents_own_repeats(spark):
    chant, one, two = "the same words are sung again and again", " ".join(words(1, 30)), " ".join(words(2, 30))
    whole = one + "\n" + two
    texts = ["\n".join([chant] * 9 + ["end"]), whole, whole + "\n" + one + "\n" + one]
    got = {r["doc_id"]: r for r in linededup.deduplicated(documents(spark, texts)).collect()}
    assert got[0]["text"] == chant + "\nend" and got[0]["n_chars"] == len(chant) + 4
    assert got[1]["text"] == whole and got[2]["text"] == whole


def test_empty_table_and_repeated_rows(spark):
    df = documents(spark, ["x\ny"])
    assert not linededup.repeats(df.where("false")).collect()
    assert not linededup.repeats(df.union(df)).collect()
    assert linededup.deduplicated(df.union(df)).count() == 2


def test_segments_cover_a_line(spark):
    own = spark.range(3, 60).withColumn("n", F.col("id").cast("int"))
    for edits in (1, 2, 3):
        parts = [linededup._segment(F.col("n"), i, edits) for i in range(1, edits + 2)]
        for r in own.select("n", *[F.struct(a.alias("a"), s.alias("s")).alias(f"p{i}") for i, (a, s) in enumerate(parts)]).collect():
            at = 1
            for i in range(edits + 1):
                assert r[f"p{i}"]["a"] == at
                at += r[f"p{i}"]["s"]
            assert at == r["n"] + 1
