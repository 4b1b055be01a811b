from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing, tokencount, tokens

from .helpers import SMALL, clashing, documents, words


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def samples():
    rng = random.Random(2)
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    mixed = "".join(rng.choice("aB é1٣२ß漢字🙂 \n\t'.!_-ſ") for _ in range(3000))
    anything = "".join(chr(c) for c in rng.sample([*range(1, 0xD800), *range(0xE000, 0x1F000)], 4000))
    return ["", " ", "it's 12 o'clock", spaces, "a" + spaces + "b", mixed, anything, "x<|endoftext|>y", "a" * 3000, " ".join(words(3, 500))]


def test_ids_equal_those_of_the_json_file(reference):
    for t in samples():
        assert tokens.ids(t).tolist() == reference.encode(t, add_special_tokens=False).ids
    if SMALL.exists():
        import pyarrow.parquet as pq

        for t in pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist():
            assert tokens.ids(t or "").tolist() == reference.encode(t or "", add_special_tokens=False).ids


def test_pieces_and_packing(spark, reference):
    texts: list[str | None] = [None, "", *samples()[2:], *[" ".join(words(i, 10 + 37 * i % 900)) for i in range(120)], *[" ".join(words(7, 300))] * 40]
    got = packing.packed(clashing(documents(spark, texts)), with_ids=True).toPandas()
    for i, t in enumerate(texts):
        want = [*reference.encode(t or "", add_special_tokens=False).ids, 2]
        own = got[got["doc_id"] == i].sort_values("piece")
        assert np.concatenate(own["ids"].to_list()).tolist() == want
        assert own["start"].tolist() == np.concatenate([[0], np.cumsum(own["length"])[:-1]]).tolist()
        assert (own["length"].iloc[1:] == 1024).all() and (len(want) <= 1024) == (len(own) == 1)
        assert own["ids_crc32"].tolist() == [zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in own["ids"]]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 1024
    assert not packing.packed(documents(spark, []).where("false")).collect()


@pytest.mark.parametrize("seed", range(30))
def test_plans_hold_every_item_once_and_few_bins(seed):
    rng = random.Random(seed)
    hist: dict[int, int] = {}
    for _ in range(rng.choice([1, 20, 3000])):
        n = rng.choice([rng.randint(1, 1024), rng.randint(1, 60), rng.randint(300, 700), 512])
        hist[n] = hist.get(n, 0) + 1
    found: dict[int, int] = {}
    bins = 0
    for items, k in packing.plan(hist):
        assert k > 0 and sum(items) <= 1024 and sum(3 * n > 1024 for n in items) <= 2
        bins += k
        for n in items:
            found[n] = found.get(n, 0) + k
    assert found == hist
    total, large = sum(n * c for n, c in hist.items()), sum(c for n, c in hist.items() if n > 512)
    assert bins <= 1 + 1.12 * max(-(-total // 1024), large)


def test_ranks_in_many_buckets(spark, monkeypatch):
    rows = [(i, 0, 100) for i in range(997)] + [(i, 1, 1024) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    got = packing.pack(df).toPandas()
    assert len(got) == len(rows) and not got.duplicated(["sequence_id", "offset"]).any()
    assert got["sequence_id"].nunique() == 50 + 100


def test_section_counts_against_offsets(spark, reference):
    texts: list[str | None] = [None, "", "\n", "a\n\nb", *samples()[2:], "x \n y\n\n\n z", "ab\r\ncd\n"]
    got = tokencount.section_counts(clashing(documents(spark, texts))).toPandas()
    for i, t in enumerate(texts):
        t = t or ""
        own = got[got["doc_id"] == i].sort_values("section")
        sections = [x + "\n" for x in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] or not t else [])
        assert [t[a:b] for a, b in zip(own["start"], own["end"], strict=True)] == sections
        ids = reference.encode(t, add_special_tokens=False).ids
        assert own["n_tokens"].sum() == len(ids)
        ends = np.cumsum([0, *(len(s.encode()) for s in sections)])
        want, at = [0] * len(sections), 0
        for k in ids:
            n = int(tokens.byte_lengths()[k])
            over = [max(0, min(at + n, ends[s + 1]) - max(at, ends[s])) for s in range(len(sections))]
            want[over.index(max(over))] += 1
            at += n
        assert own["n_tokens"].tolist() == want


def test_boundary_rules():
    ends, bounds = np.array([2, 6, 9]), np.array([3, 9])
    assert tokencount.attribute(ends, bounds)[0].tolist() == [0, 1, 1]
    assert tokencount.attribute(ends, bounds, "first")[0].tolist() == [0, 0, 1]
    assert tokencount.attribute(np.array([4]), np.array([2, 4]))[0].tolist() == [0]  # a tie goes to the earlier
    with pytest.raises(ValueError, match="rule is one of"):
        tokencount.section_counts(None, "last")
