from __future__ import annotations

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import chat
from ledgerloom.llm.common import Tables

from .helpers import rows

SCHEMA = "conv_id long, turn long, role string, text string"
#: Pieces of which marks and escapes are made.
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "<\\s>", "[\\INST]", "é", "\n", " ", "a", "", "\U0001f600"]


def said(turns):
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def expected(data):
    by = {}
    for c, t, r, x in data:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    return {c: said([x[1:] for x in sorted(v)]) for c, v in by.items()}


def read(spark, data):
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("x") for c in ("node", "parent", "tree", "score", "leaf", "rank", "position", "head", "body", "loss")})
    return {r["conv_id"]: tuple(r)[1:-1] for r in chat.conversations_read_back(df).collect()}


def test_conversations(spark):
    rng = random.Random(5)
    data = [(c, t, rng.choice(["user", "assistant", "system", None, "<s>", "a\nb"]), rng.choice([None, "", "".join(rng.choices(PIECES, k=12))])) for c in range(30) for t in range(rng.randint(1, 7))]
    data += [(50, t, "user" if t % 2 else "assistant", f"t{t}\\") for t in range(130)]  # deep
    data += [(51, 3, "user", "b"), (51, 3, "assistant", "c"), (51, 3, "user", "b"), (51, None, "system", "first"), (None, 1, "user", "none"), (None, 0, "assistant", "[INST]")]
    data += [(52, -5, "assistant", "x" * 3_000_000 + "é"), (52, 9, "assistant", "</s>" * 1000)]
    assert read(spark, data) == expected(data)


def test_example_and_empty(spark):
    mark = "</s>[INST] ok [/INST]"
    got = chat.conversations_read_back(chat.example(spark)).first()
    assert tuple(got)[:5] == (-1, *said([("user", mark), ("assistant", mark)]))
    assert not rows(chat.conversations_read_back(chat.example(spark).where("false")))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), min_size=1, max_size=6))
def test_escaped_texts_come_back(turns):
    import re

    def escape(x: str) -> str:  # as the column function does
        return re.sub(r"([<\[])(/?(?:s>|INST\]))", r"\1\\\2", x.replace("\\", "\\\\"))

    text = "".join(f"{chat.OPEN}{escape(r)}{chat.BETWEEN}{escape(t)}{chat.CLOSE}" for r, t in turns)
    assert chat.turns(text) == turns


def test_escape_column(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PIECES, k=10)) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect()
    for t, e in got:
        assert chat.unescape(e) == t and not any(m in e for m in ("<s>", "</s>", "[INST]", "[/INST]"))


def forest(seed: int, n: int):
    """(tree, node, parent, score) of some trees, with roots whose parents are missing."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        near = [x for x in out if x[0] == i % 3]
        parent = rng.choice(near)[1] if near and rng.random() < 0.95 else rng.choice([None, "gone"])
        out.append((i % 3, f"n{i:03}", parent, rng.randint(-3, 5)))
    return out


def brute_branches(nodes, keep):
    parent = {n: p for _, n, p, _ in nodes}
    score = {n: s for _, n, _, s in nodes}
    tree = {n: t for t, n, *_ in nodes}
    found = {}
    for leaf in parent.keys() - set(parent.values()):
        path, at = [leaf], leaf
        while (at := parent[at]) in parent:
            path.append(at)
        found.setdefault(tree[leaf], []).append((-sum(score[x] for x in path), leaf, path))
    return sorted((leaf, node, i, rank) for v in found.values() for rank, (_, leaf, path) in enumerate(sorted(v)[:keep], 1) for i, node in enumerate(path))


def test_branches_of_trees(spark):
    for seed, n, keep in ((1, 90, 2), (2, 40, 1), (3, 1, 3)):
        nodes = forest(seed, n)
        df = spark.createDataFrame(nodes, "tree long, node string, parent string, score long")
        assert rows(chat.branches(df, Tables(spark), keep)) == brute_branches(nodes, keep)


def test_circles_have_no_path(spark):
    nodes = [(0, "a", "b", 1), (0, "b", "a", 1), (0, "c", "a", 1), (0, "d", None, 1), (0, "e", "d", 1)]
    df = spark.createDataFrame(nodes, "tree long, node string, parent string, score long")
    assert {r["leaf"] for r in chat.branches(df, Tables(spark), 9).collect()} == {"e"}


def test_many_replies_to_one_message(spark, monkeypatch):
    monkeypatch.setattr(chat, "HOT_ROWS", 10)
    nodes = [(0, "root", None, 0), *((0, f"c{i:03}", "root", i % 7) for i in range(200)), *((0, f"g{i:03}", "c000", 9) for i in range(100))]
    df = spark.createDataFrame(nodes, "tree long, node string, parent string, score long")
    assert rows(chat.branches(df, Tables(spark), 3)) == brute_branches(nodes, 3)


def test_messages_are_joined_alike_by_shuffle(spark, monkeypatch):
    data = [(c, t, "assistant" if t % 2 else "user", f"{c}-{t}") for c in range(5) for t in range(4)]
    one = read(spark, data)
    monkeypatch.setattr(chat, "BROADCAST_IDS", 0)
    assert read(spark, data) == one == expected(data)
