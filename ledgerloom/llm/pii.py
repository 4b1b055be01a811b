"""Personal data by weak supervision.

Base spans (e-mail, IP, card, phone) come from fixed patterns over the whole text and always stay. On top of them,
wider patterns propose candidates that the base patterns miss: spelled-out addresses (``name [at] host [dot] org``),
phone numbers without a plus sign, card numbers with other separators, and what has a base form but breaks its rule. Labelers
vote on every candidate, or abstain. None of them knows whether a span is a base one; each looks at evidence of its own:

- regex: the form a careful writer gives the kind (a strict address, canonical octets, card or phone grouping), or a broken one;
- gazetteer: top-level domains, card issuer prefixes, country and area codes, reserved address blocks;
- context: words around the span that name the kind, or another kind of number;
- checksum: Luhn, or a plausible number of digits;
- edges: no letter or digit touches the span.

Votes are counted by (kind, votes, shape, hash of the word before) over the whole corpus, a table whose size does not depend
on the corpus. On these counts expectation-maximisation estimates each labeler's reliability for each kind (how often it
votes for or against, given that the span is or is not personal data). Its posteriors are the soft labels of a logistic
regression over votes, shapes and the word before, the span classifier. A candidate that it gives at least ``threshold`` and
that touches no base span is added.

Edge cases: null is the empty text; repeated rows get equal spans; texts without digits and @ are passed over
quickly; a corpus without candidates gives an untrained model, which adds nothing; of added spans that overlap, the one of the
pattern that comes first stays. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "checksum", "edges")
THRESHOLD = 0.9
CONTEXT_CHARS = 40

#: Hash buckets of the word before a span.
NEIGHBOURS = 16

# What the gazetteers and the context labeler know.
_COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_TLDS = frozenset("com org net edu gov io de fr es uk eu info biz us ca au jp cn in it nl se ch example".split())
_CONTEXT = {
    "email": frozenset("email mail e-mail contact write reach courriel correo kontakt".split()),
    "ip": frozenset("ip address host server addr login from client adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit pan payment carte karte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax dial contact telefon téléphone teléfono".split()),
}
_OTHER = frozenset("isbn issn version order invoice id doi sku serial section chapter page ref".split())

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"[\[({]at[\])}]", re.I)
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]{2,63}+){1,4}+", re.IGNORECASE
)
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_WIDE_CARD = re.compile(r"(?<![0-9])[0-9]{4}([./_]|  )[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_STRICT_EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
_TOKEN = re.compile(r"[^\W\d_][\w-]*")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(d * 2 - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run of its characters before an @, so each @ is looked at once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    if any(d in text for d in "0123456789"):
        out += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        out += [(*m.span(), 2) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def wider_spans(text: str) -> list[Span]:
    """Candidates of the wider patterns, and what the base rules drop."""
    out: list[Span] = []
    if any(d in text for d in "0123456789"):  # what the base rules drop is voted on as well: it shows what is not personal data
        out += [(*m.span(), 1) for m in _IP.finditer(text) if not all(map(_byte, m[0].split(".")))]
        out += [(*m.span(), 2) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and not (len(d) > 13 and luhn(d))]
    if _AT.search(text):
        out += [(*m.span(), 0) for m in _SPELLED.finditer(text)]
    if any(d in text for d in "0123456789"):
        out += [(*m.span(), 2) for m in _WIDE_CARD.finditer(text)]
        out += [(*m.span(), 3) for m in _LOCAL_PHONE.finditer(text)]
    return out


def _form(kind: int, own: str) -> int:
    """The regex labeler."""
    groups = [len(g) for g in re.findall("[0-9]+", own)]
    if kind == 0:
        return 0 if "@" not in own else 1 if _STRICT_EMAIL.fullmatch(own) and ".." not in own else -1
    if kind == 1:
        return 1 if all(_byte(p) and (p == "0" or p[0] != "0") for p in own.split(".")) else -1
    if kind == 2:  # a bare run of digits shows nothing
        return 0 if len(groups) == 1 else 1 if groups in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3]) else -1
    if not set(own) & set("+()-"):
        return 0  # groups with blanks or dots may be anything
    paired = own.count("(") == own.count(")") <= 1 and "--" not in own and ".." not in own
    return 1 if paired and len(groups) > 2 and groups[-1] == 4 and groups[-2] == 3 else -1 if not paired or max(groups) < 3 else 0


def _listed(kind: int, own: str, digits: str) -> int:
    """The gazetteer labeler."""
    if kind == 0:
        return 1 if re.split(r"[^A-Za-z0-9-]+", own.rstrip("])} "))[-1].lower() in _TLDS else -1
    if kind == 1:
        first = own.split(".")[0].lstrip("0")
        return -1 if first in ("", "127") or len(first) >= 3 and first >= "224" else 1
    if kind == 2:
        return 1 if digits[0] in "3456" or digits[:2] in ("22", "23", "24", "25", "26", "27") else -1
    if own[0] == "+" and not (digits[0] == "1" and len(digits) == 11):
        return 1 if digits[0] in _COUNTRIES or digits[:2] in _COUNTRIES else -1
    area = digits[-10:]
    return 0 if len(area) < 10 else 1 if area[0] in "23456789" and area[3] in "23456789" else -1


def _before(text: str, start: int) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text[max(0, start - CONTEXT_CHARS) : start])[-4:]]


def votes(text: str, span: Span) -> tuple[int, ...]:
    """One vote for each of ``LABELERS``: 1 for, -1 against, 0 abstains."""
    start, end, kind = span
    own, digits = text[start:end], _digits(text[start:end])
    around = _before(text, start) + [w.lower() for w in _TOKEN.findall(text[end : end + CONTEXT_CHARS])[:2]]
    context = 1 if any(w in _CONTEXT[KINDS[kind]] for w in around) else -1 if any(w in _OTHER for w in around) else 0
    check = 0 if kind < 2 else (1 if luhn(digits) else -1) if kind == 2 else 1 if 10 <= len(digits) <= 15 else -1
    touched = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return _form(kind, own), _listed(kind, own, digits), context, check, (-1 if touched else 1)


def shape(text: str, span: Span) -> int:
    """Which of eight shapes a span has (separators, brackets, more than 16 characters), and the bucket of the word before it."""
    own = text[span[0] : span[1]]
    form = (" " in own) + 2 * any(c in own for c in "()[]{}") + 4 * (len(own) > 16)
    before = _before(text, span[0])
    return form + 8 * (zlib.crc32(before[-1].encode()) % NEIGHBOURS if before else 0)


def _key(kind: int, v: tuple[int, ...], form: int) -> int:
    out = kind
    for x in v:
        out = out * 3 + x + 1
    return out * 8 * NEIGHBOURS + form


def _unkey(key: int) -> tuple[int, tuple[int, ...], int]:
    key, form = divmod(key, 8 * NEIGHBOURS)
    v = []
    for _ in LABELERS:
        key, x = divmod(key, 3)
        v.append(x - 1)
    return key, tuple(reversed(v)), form


@dataclass
class Model:
    """Classifier weights of each kind, and the estimates behind them."""

    weights: np.ndarray  #: kind, feature
    reliability: np.ndarray  #: kind, labeler: share of its votes that the estimates agree with
    prior: np.ndarray  #: kind

    def probability(self, kind: int, v: tuple[int, ...], form: int) -> float:
        return float(1 / (1 + np.exp(-self.weights[kind] @ _features(np.array([v]), np.array([form]))[0])))


def _features(v: np.ndarray, form: np.ndarray) -> np.ndarray:
    """Constant, votes for and against of each labeler, bits of the shape, bucket of the word before."""
    bits = np.stack([form >> k & 1 for k in range(3)], 1)
    return np.concatenate([np.ones((len(v), 1)), v == 1, v == -1, bits, (form >> 3)[:, None] == np.arange(NEIGHBOURS)], 1).astype(float)


def estimate(v: np.ndarray, c: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability that each row of votes ``v``, which occurs ``c`` times, is personal data, by expectation-maximisation.

    A labeler votes for, against or not at all with probabilities that depend on the truth only.
    """
    post = 1 / (1 + np.exp(-2.0 * ((v == 1).sum(1) - 3 * (v == -1).sum(1))))  # begins with the majority, a vote against weighing as much as three
    for _ in range(rounds):
        p = (c @ post + 1) / (c.sum() + 2)
        log = [np.log(p), np.log1p(-p)]
        for y, w in enumerate((c * post, c * (1 - post))):
            for j in range(v.shape[1]):
                # smoothed towards a labeler that is right twice as often as wrong, which also names the two classes
                seen = np.array([w[v[:, j] == x].sum() for x in (-1, 0, 1)]) + ([1.0, 1.0, 2.0] if y == 0 else [2.0, 1.0, 1.0])
                log[y] = log[y] + np.log(seen / seen.sum())[v[:, j] + 1]
        post = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    return post


def vote_shares(counts: dict[int, int]) -> dict[str, dict[str, float]]:
    """For each kind, on what share of its candidates each labeler votes."""
    out: dict[str, dict[str, float]] = {}
    for k, kind in enumerate(KINDS):
        rows = [(v, c) for key, c in counts.items() for own, v, _ in [_unkey(key)] if own == k]
        if rows:
            total = sum(c for _, c in rows)
            out[kind] = {name: sum(c for v, c in rows if v[j]) / total for j, name in enumerate(LABELERS)}
    return out


def train(counts: dict[int, int], rounds: int = 100) -> Model:
    """Estimates from the corpus' counts of (kind, votes, shape)."""
    k, n = len(KINDS), len(LABELERS)
    size = 4 + 2 * n + NEIGHBOURS
    weights, reliability, prior = np.zeros((k, size)), np.full((k, n), np.nan), np.full(k, np.nan)
    weights[:, 0] = -5.0  # a kind without candidates accepts nothing
    for kind in range(k):
        rows = [(v, form, c) for key, c in sorted(counts.items()) for own, v, form in [_unkey(key)] if own == kind]
        if not rows:
            continue
        v, form, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
        post = estimate(v, c, rounds)
        prior[kind] = c @ post / c.sum()
        for j in range(n):
            if (voted := c[v[:, j] != 0].sum()) > 0:
                reliability[kind, j] = (c @ np.where(v[:, j] == 1, post, np.where(v[:, j] == -1, 1 - post, 0))) / voted
        x, w = _features(v, form), np.zeros(size)
        for _ in range(50):  # Newton steps with a small ridge
            q = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (c * q * (1 - q))[:, None]).T @ x + np.eye(len(w)), x.T @ (c * (post - q)) - w)
            w = w + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        weights[kind] = w
    return Model(weights, reliability, prior)


def _candidates(text: str) -> Iterator[tuple[Span, bool]]:
    own = base_spans(text)
    yield from ((s, True) for s in own)
    for s in wider_spans(text):
        if all(s[1] <= b[0] or b[1] <= s[0] for b in own):
            yield s, False


def vote_counts(documents: DataFrame) -> dict[int, int]:
    """Counts of (kind, votes, shape) over all candidates of all documents; at most 4 x 243 x 128 of them, fewer as most votes never meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for s, _ in _candidates(text or ""):
                    key = _key(s[2], votes(text, s), shape(text, s))
                    found[key] = found.get(key, 0) + 1
        yield arrow({"key": pa.int64(), "n": pa.int64()}, {"key": list(found), "n": list(found.values())})

    got = documents.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: r["n"] for r in got.collect()}


def all_spans(text: str, model: Model, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """Base spans, and base with added spans, both by start and kind."""
    base, added = [], []
    for s, is_base in _candidates(text):
        if is_base:
            base.append(s)
        elif model.probability(s[2], votes(text, s), shape(text, s)) >= threshold and all(s[1] <= o[0] or o[1] <= s[0] for o in added):
            added.append(s)
    return base, sorted(base + added, key=lambda s: (s[0], s[2]))


def line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


_FIELDS = {"doc_id": pa.int64(), **{f"n_{k}": pa.int64() for k in KINDS}, "base_sha256": pa.string(), "spans": pa.string(), "n_added": pa.int64()}


def find(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, base counts by kind, digest of the base spans, all spans, number of added ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _FIELDS}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, every = all_spans(text or "", model, threshold)
                out["doc_id"].append(doc_id)
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(line(base).encode()).hexdigest())
                out["spans"].append(line(every))
                out["n_added"].append(len(every) - len(base))
            yield arrow(_FIELDS, out)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def personal_data(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Two scans of the documents: the votes train the model, then the model picks the spans."""
    return find(documents, train(vote_counts(documents)), threshold)
