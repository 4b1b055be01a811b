from __future__ import annotations

import zlib

import numpy as np
import pytest

from ledgerloom.llm import langid

from .helpers import SMALL, clashing, documents, words


def texts_of(lang: str, n: int) -> list[str]:
    ends = {"en": "ing", "de": "ung", "fr": "eau"}[lang]
    return [" ".join(w + ends for w in words(1000 * ord(lang[0]) + i, 40)) for i in range(n)]


@pytest.fixture(scope="module")
def labelled():
    texts, langs = [], []
    for lang in ("en", "de", "fr"):
        texts += texts_of(lang, 30)
        langs += [lang] * 30
    return texts, langs


def test_predictions_and_edges(spark, labelled):
    texts, langs = labelled
    extra = [None, "", "123 !?", texts[0] + " " + texts[40] + " " + texts[41], "É" + texts[70]]
    df = documents(spark, texts + extra, langs + [None] * len(extra))
    got = {r["doc_id"]: r for r in langid.languages(clashing(df).drop("n")).collect()}
    assert len(got) == len(texts) + len(extra)
    for i in range(len(texts)):
        assert got[i]["lang_pred"] == langs[i] and 0 <= got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    n = len(texts)
    assert [got[n + k]["lang_pred"] for k in range(3)] == ["und"] * 3 and got[n]["score"] == 0.0
    mixed = dict(x.split(":") for x in got[n + 3]["langs"].split(","))
    assert got[n + 3]["lang_pred"] == "de" and set(mixed) == {"de", "en"} and 0.5 < float(mixed["de"]) < 0.85
    assert not langid.languages(df.where("false")).collect()


def test_nothing_to_learn_from(spark):
    df = documents(spark, ["some text", None, "1"], [None] * 3)
    assert {r["lang_pred"] for r in langid.languages(df).collect()} == {"und"}
    kept = langid.labelled(df, langid.train(langid.training_rows(df))).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_trigrams_match_a_plain_count():
    bucket, word, edge = langid.trigrams(["Ab c", None, "é1é"])
    assert len(bucket) == 5 and word.tolist() == [0, 2, 3, 4] and edge.tolist() == [0, 2, 2, 4]
    again = langid.trigrams(["ab C"])[0]
    assert np.array_equal(bucket[:3], again)


def test_chunks_do_not_change_results(spark, labelled, monkeypatch):
    texts, langs = labelled
    df = documents(spark, texts, langs)
    m = langid.train(df)
    whole = langid.mixtures(texts, m)
    parts = np.concatenate([langid.mixtures(texts[i : i + 7], m) for i in range(0, len(texts), 7)])
    assert np.allclose(whole, parts, atol=2e-2) and (whole.argmax(1) == parts.argmax(1)).all()


def test_more_than_three_languages_and_chunks_of_any_company(spark):
    ends = {"de": "ung", "en": "ing", "es": "dad", "fr": "eau", "it": "zzo"}
    texts = {lang: [" ".join(w + end for w in words(1000 * k + i, 40)) for i in range(20)] for k, (lang, end) in enumerate(ends.items())}
    m = langid.train(documents(spark, sum(texts.values(), []), [lang for lang in ends for _ in range(20)]))
    for n in (4, 5):
        mixed = " ".join(texts[lang][0] for lang in list(ends)[:n])
        share = langid.mixtures([mixed], m)[0]
        assert (share > 0).sum() == n and share[:n].min() > 0.1
    own = [texts[a][1] + " " + texts[b][2][: 20 * k] for k, (a, b) in enumerate((("de", "en"), ("es", "fr"), ("it", "de"), ("en", "it")))]
    whole = langid.mixtures(own, m)
    assert all(np.allclose(whole[i], langid.mixtures([t], m)[0], atol=1e-9) for i, t in enumerate(own))


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.languages(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95
