"""Language identification by mixture inference.

Training counts the letter trigrams (lower-cased, with word edges) of each language over all training texts, in
``BUCKETS`` hash buckets; the table has a bounded size for each language. A document is a bag of words, and a
word's likelihood in a language is the product of its trigrams' smoothed probabilities. Expectation-maximisation
estimates the shares in which the languages generated the document's words. The language set is chosen by penalised
likelihood: among the nested sets of the 1, 2, ... largest shares, up to the last one of at least one word, each
fitted again, the one with the greatest log-likelihood less half a log(words) for every further language. The
prediction is the language with the largest share. A document's fit ends when its own shares settle (no share moves
by 0.001), whatever else is in its chunk, or after ``ROUNDS`` rounds; shares of the few that still move are then approximate.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is everything if there was nothing
to learn from; ties go to the language that sorts first; repeated rows get equal predictions; very long texts
are whole, only the work is cut into chunks of words. Only ``doc_id``, ``text`` and, for training, ``lang`` are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, chunks

BUCKETS = 1 << 16
UNKNOWN = "und"
CHUNK_CHARS = 400_000
ROUNDS = 25
#: Words count as independent evidence only so far: likelihoods are raised to this power, as neighbouring trigrams overlap.
TEMPER = 0.5


@functools.cache
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x323B0):  # no letters beyond
        if (c := chr(i)).isalpha():
            out[i] = ord(low) if len(low := c.lower()) == 1 else i
    return out


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in order: each letter's trigram bucket, each word's first letter, each text's first word (with the end)."""
    codes = np.frombuffer("".join(f" {t or ''} " for t in texts).encode("utf-32-le"), np.uint32)
    size = np.array([len(t or "") + 2 for t in texts])
    low = _letters()[codes]
    at = np.flatnonzero(low)
    with np.errstate(over="ignore"):
        h = low[at - 1] * np.uint32(0x9E3779B1) + low[at] * np.uint32(0x85EBCA77) + low[at + 1] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    word = np.flatnonzero(low[at - 1] == 0)
    edge = np.concatenate([[0], np.cumsum(size)])
    return (h >> np.uint32(16)).astype(np.int64), word, np.searchsorted(at[word], edge)


@dataclass
class Model:
    languages: list[str]
    log: np.ndarray  #: bucket, language: log probability


def _training_counts(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for t, lang in zip(texts, langs, strict=True):
                by.setdefault(lang, []).append(t)
            for lang, own in by.items():
                for a, b in chunks(own, CHUNK_CHARS):
                    n = np.bincount(trigrams(own[a:b])[0], minlength=BUCKETS)
                    total[lang] = total.get(lang, 0) + n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield arrow({"lang": pa.string(), "bucket": pa.int32(), "n": pa.int64()}, {"lang": [lang] * len(at), "bucket": at, "n": n[at]})

    counts = documents.select("text", "lang").where("text is not null and lang is not null").mapInArrow(run, "lang string, bucket int, n long")
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(documents: DataFrame) -> Model:
    """From (text, lang). What comes to the driver is at most ``BUCKETS`` counts for each language."""
    got = _training_counts(documents).toPandas()
    languages = sorted(got["lang"].unique())
    n = np.zeros((BUCKETS, len(languages)))
    for k, lang in enumerate(languages):
        own = got[got["lang"] == lang]
        n[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    seen = max(1, int((n.sum(1) > 0).sum()))
    return Model(languages, np.log((n + 0.1) / (n.sum(0) + 0.1 * seen)).astype(np.float32))


def _fit(e: np.ndarray, first: np.ndarray, words: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (document, language) and log-likelihoods. e: word, language; first: each document's first word; no document is empty."""
    doc = np.repeat(np.arange(len(words)), words)
    share = allowed / allowed.sum(1, keepdims=True)
    todo, part, at = np.arange(len(words)), e, first  # documents that still move, their words
    for _ in range(ROUNDS):
        r = part * np.repeat(share[todo], words[todo], 0)
        r /= r.sum(1, keepdims=True)
        new = np.add.reduceat(r, at, 0) / words[todo][:, None]
        moved = np.abs(new - share[todo]).max(1) >= 1e-3
        share[todo] = new
        if not moved.any():
            break
        if not moved.all():
            part, todo = part[np.repeat(moved, words[todo])], todo[moved]
            at = np.concatenate([[0], np.cumsum(words[todo])[:-1]])
    return share, np.add.reduceat(np.log((e * share[doc]).sum(1)), first)


def mixtures(texts: list[str | None], model: Model) -> np.ndarray:
    """Shares of each text's languages after the choice of the set; rows of zeros for texts without letters."""
    out = np.zeros((len(texts), len(model.languages)))
    bucket, word, edge = trigrams(texts)
    count = np.diff(edge)
    own = np.flatnonzero(count)
    if not len(own) or not model.languages:
        return out
    s = np.add.reduceat(model.log[bucket], word, 0).astype(np.float64) * TEMPER
    e = np.exp(np.maximum(s - s.max(1, keepdims=True), -60))
    first, words = edge[:-1][own], count[own]
    everything = np.ones((len(own), e.shape[1]))
    share, _ = _fit(e, first, words, everything)
    order = np.argsort(-share, 1, kind="stable")
    best = np.zeros_like(share)
    best[np.arange(len(own)), order[:, 0]] = 1
    score = np.add.reduceat(np.log(e), first, 0)[np.arange(len(own)), order[:, 0]]
    for m in range(2, e.shape[1] + 1):
        # a language that has not even one word to itself cannot pay its penalty
        some = np.flatnonzero(np.take_along_axis(share, order[:, m - 1 : m], 1)[:, 0] * words >= 1)
        if not len(some):
            break
        allowed = np.zeros((len(some), e.shape[1]))
        np.put_along_axis(allowed, order[some, :m], 1, 1)
        part = np.concatenate([np.arange(a, a + n) for a, n in zip(first[some], words[some], strict=True)])
        got, ll = _fit(e[part], np.concatenate([[0], np.cumsum(words[some])[:-1]]), words[some], allowed)
        ll -= 0.5 * (m - 1) * np.log(words[some])
        better = ll > score[some]
        best[some[better]], score[some[better]] = got[better], ll[better]
    out[own] = best
    return out


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, langs): the first language, its share, and the chosen set with shares."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        fields = {"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64(), "langs": pa.string()}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in fields}
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, CHUNK_CHARS):
                for share in mixtures(texts[a:b], m):
                    top = [k for k in np.argsort(-share, kind="stable") if share[k] > 0]
                    out["lang_pred"].append(m.languages[top[0]] if top else UNKNOWN)
                    out["score"].append(min(1.0, float(share[top[0]])) if top else 0.0)
                    out["langs"].append(",".join(f"{m.languages[k]}:{share[k]:.3f}" for k in top))
            out["doc_id"] = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], type=t) if isinstance(out[k], list) else out[k] for k, t in fields.items()], names=list(fields))

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, langs string")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def training_rows(documents: DataFrame) -> DataFrame:
    return documents.where(~held_out() & F.col("lang").isNotNull())


def languages(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, langs; learned from the rows that are not held out."""
    found = predict(documents, train(training_rows(documents)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs")


def labelled(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that have a language, in the same columns, ``lang`` being the predicted one. Nothing is joined or shuffled.

    With a model that learned nothing, documents with a letter stay as they are.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at, lang = documents.columns.index("text"), documents.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), []
            for a, b in chunks(texts, CHUNK_CHARS):
                found += [m.languages[int(np.argmax(s))] if s.any() else None for s in mixtures(texts[a:b], m)]
            names = pa.array(found, pa.string())
            if not m.languages:
                yield batch.filter(pa.array([any(c.isalpha() for c in t or "") for t in texts], pa.bool_()))
                continue
            columns = [names if k == lang else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(names.is_valid())

    return documents.mapInArrow(run, documents.schema)
