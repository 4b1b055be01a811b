"""Operators against plainer versions of themselves, and their edge cases: empty tables, very long texts, repeated rows, ties, clashing columns."""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import decontam, langid, ogg, pii, tokencount, tokens, warc

from .helpers import SCHEMA, clashing, documents, rows, words


def plain_shares(text, model):
    """Mixture and choice of the set, word by word in plain Python."""
    low = [0 if not c.isalpha() else ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in f" {text} "]
    k, likely, inside = len(model.languages), [], False
    for i in range(1, len(low) - 1):
        if not low[i]:
            inside = False
            continue
        h = (low[i - 1] * 0x9E3779B1 + low[i] * 0x85EBCA77 + low[i + 1] * 0xC2B2AE3D) % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        if not inside:
            likely.append([0.0] * k)
        likely[-1] = [a + float(b) * langid.TEMPER for a, b in zip(likely[-1], model.log[h >> 16], strict=True)]
        inside = True
    likely = [[math.exp(max(x - max(s), -60)) for x in s] for s in likely]

    def fit(allowed):
        share = [1 / len(allowed) if j in allowed else 0.0 for j in range(k)]
        for _ in range(langid.ROUNDS):
            new = [0.0] * k
            for e in likely:
                total = sum(a * b for a, b in zip(share, e, strict=True))
                new = [n + a * b / total for n, a, b in zip(new, share, e, strict=True)]
            new = [n / len(likely) for n in new]
            moved, share = max(abs(a - b) for a, b in zip(new, share, strict=True)), new
            if moved < 1e-3:
                break
        return share, sum(math.log(sum(a * b for a, b in zip(share, e, strict=True))) for e in likely)

    if not likely:
        return [0.0] * k
    first, _ = fit(range(k))
    order = sorted(range(k), key=lambda j: (-first[j], j))
    best, score = fit(order[:1])
    for m in range(2, k + 1):
        if first[order[m - 1]] * len(likely) < 1:
            break
        share, ll = fit(order[:m])
        if ll - 0.5 * (m - 1) * math.log(len(likely)) > score:
            best, score = share, ll - 0.5 * (m - 1) * math.log(len(likely))
    return best


@pytest.fixture(scope="module")
def languages(spark):
    ends = {"de": "ung", "en": "ing", "es": "dad"}
    texts = {lang: [" ".join(w + end for w in words(700 * k + i, 30)) for i in range(15)] for k, (lang, end) in enumerate(ends.items())}
    return texts, langid.train(documents(spark, sum(texts.values(), []), [lang for lang in ends for _ in range(15)]))


def test_language_mixtures_are_those_of_the_plain_version(languages):
    texts, model = languages
    own = [texts["de"][0], texts["de"][1] + " " + texts["en"][1], " ".join(texts[x][2] for x in texts), texts["es"][3][:25] + " " + texts["en"][4], "1 2", "Été ß Ǆ word", "a"]
    own += [" ".join(words(i, 12)) for i in range(20)]
    got = langid.mixtures(own, model)
    for t, share in zip(own, got, strict=True):
        want = plain_shares(t, model)
        assert [s > 0 for s in share] == [s > 0 for s in want] and np.allclose(share, want, atol=5e-3), t


def test_language_of_a_very_long_text_repeated_rows_and_ties(spark, languages):
    texts, model = languages
    long = " ".join(texts["en"] * 900)
    assert len(long) > 2 * langid.CHUNK_CHARS
    df = documents(spark, [long, texts["de"][0], texts["de"][0]])
    got = {r["doc_id"]: r for r in langid.predict(df.unionByName(df.where("doc_id = 1")), model).collect()}
    assert (got[0]["lang_pred"], got[1]["lang_pred"]) == ("en", "de") and got[1][1:] == got[2][1:]
    assert langid.predict(df.unionByName(df.where("doc_id = 1")), model).where("doc_id = 1").distinct().count() == 1
    even = langid.Model(["aa", "bb"], np.full((langid.BUCKETS, 2), -5.0, np.float32))
    assert {r["lang_pred"] for r in langid.predict(df.where("doc_id > 0"), even).collect()} == {"aa"}


def plain_ogg(data):
    """(packets of the first stream, number of pages) by declared lengths only."""
    at, pages, packets, part, first = 0, 0, [], b"", None
    while at < len(data):
        serial, n = struct.unpack_from("<I", data, at + 14)[0], data[at + 26]
        first = serial if first is None else first
        body = at + 27 + n
        for value in data[at + 27 : at + 27 + n]:
            if serial == first:
                part += data[body : body + value]
                if value < 255:
                    packets.append(part)
                    part = b""
            body += value
        at, pages = body, pages + 1
    return packets, pages


@pytest.mark.parametrize("text", [None, "", "abc", "é" * 500, "OggS " * 30_000, "z" * 255])
def test_ogg_features_against_plain_python(spark, text):
    stored = ogg.media(documents(spark, [text]))
    data = bytes(stored.first()["media"])
    packets, pages = plain_ogg(data)
    sound = b"".join(packets[1:])
    raw = (text or "").encode()
    assert sound == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    x = [b - 128 for b in sound]
    mean = sum(x) / len(x)
    eighth = len(x) // 8
    levels = [math.sqrt(sum(v * v for v in x[k * eighth : (k + 1) * eighth]) / eighth) for k in range(8)]
    want = [len(x) / ogg.RATE, pages, mean, math.sqrt(sum(v * v for v in x) / len(x)), sum((a >= mean) != (b >= mean) for a, b in zip(x, x[1:])), *levels]
    r = ogg.features(stored).first()
    assert np.allclose([float(v) for v in r["feature"].split(";")], want, atol=6e-4)
    assert r["media_bytes"] == len(data) and r["media_sha256"] == hashlib.sha256(data).hexdigest()


def test_added_spans_that_overlap(spark):
    """Of added spans that overlap, the one of the pattern that comes first stays: broken base forms, then wider ones."""
    sure = pii.train({})
    sure.weights[:, 0] = 9.0
    text = "see 212-555-0199 1234 or 212-555-0199"
    base, every = pii.all_spans(text, sure)
    assert not base and every == [(4, 21, 2), (25, 37, 3)]
    df = documents(spark, [text, text, None])
    assert [r["spans"] for r in pii.find(clashing(df), sure).orderBy("doc_id").collect()] == ["card:4:21,phone:25:37"] * 2 + [""]


def test_windows_in_a_very_long_text(spark):
    item = " ".join(words(1, 14))
    filler = " ".join(words(2, 40_000) * 5)
    text = f"{item.upper()}. {filler} {item} {filler}"
    bench = spark.createDataFrame([(7, item), (8, "not there at all"), (9, None)], "item_id long, text string")
    got = decontam.contamination(documents(spark, [text, filler, text]), bench).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in got] == [(400_028, 28, 1), (200_000, 0, 0), (400_028, 28, 1)]
    assert got[0]["items_sha256"] == hashlib.sha256(b"7").hexdigest() and [r["contaminated"] for r in got] == [True, False, True]


def test_token_counts_of_long_texts_repeated_rows_and_no_rows(spark):
    long = "\n".join(" ".join(words(i, 60)) for i in range(400)) * 6
    assert len(long) > 500_000
    df = documents(spark, [long, "one\ntwo", None])
    got = tokencount.section_counts(clashing(df.unionByName(df.where("doc_id = 1")))).toPandas()
    assert got[got["doc_id"] == 0]["n_tokens"].sum() == len(tokens.ids(long)) and got[got["doc_id"] == 0]["end"].max() == len(long)
    twice = got[got["doc_id"] == 1].sort_values("section")
    assert len(twice) == 4 and len(twice.drop_duplicates()) == 2
    assert got[got["doc_id"] == 2]["n_tokens"].tolist() == [0]
    assert not tokencount.section_counts(df.where("false")).collect()


def test_archives_of_pages_of_megabytes(spark):
    big = "<p>é</p>" * 400_000
    html = [big, big, big + "x", "small", None, "y" * 1000, "y" * 1000, "y" * 999, "y" * 999]
    df = spark.createDataFrame([(i, f"http://h.org/{i}", h, "c") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")
    got = {r["page_id"]: r for r in warc.archived(df).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        0: ("revisit", 1), 1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("response", None),
        5: ("revisit", 6), 6: ("response", None), 7: ("response", None), 8: ("response", None),
    }
    for i, h in enumerate(html):
        data = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    bench = [(1, " ".join(words(40, 20))), (2, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), bench[0][1]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_nothing_and_with_nulls(spark, folder, name, stage):
    empty = documents(spark, ["x"]).where("false")
    assert not stage(spark, empty, folder[0]).collect()
    nulls = spark.createDataFrame([(1, None, None, None, None), (2, None, None, None, None)], SCHEMA)
    got = stage(spark, clashing(nulls), folder[0])
    if name == "best_fit_packing":
        assert sorted(r["doc_id"] for r in got.collect()) == [1, 2]
    else:
        assert got.columns == clashing(nulls).columns
        assert {r["doc_id"] for r in got.collect()} <= {1, 2}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_with_repeated_rows_and_clashing_columns(spark, folder, name, stage):
    path, item = folder
    texts = [" ".join(words(60 + i, 80)) for i in range(6)] + [" ".join(words(70, 30)) + " " + item]
    df = documents(spark, texts)
    df = clashing(df.unionByName(df.where("doc_id in (1, 6)")))
    got = stage(spark, df, path)
    assert got.columns == df.columns
    kept = sorted(r["doc_id"] for r in got.collect())
    want = {"near_dedup": [0, 1, 2, 3, 4, 5, 6], "decontaminate": [0, 1, 1, 2, 3, 4, 5]}.get(name, [0, 1, 1, 2, 3, 4, 5, 6, 6])
    assert kept == want
    changed = got.select("doc_id", "text", "source", "n_chars", "key")
    assert set(rows(changed)) <= set(rows(df.select("doc_id", "text", "source", "n_chars", "key")))
