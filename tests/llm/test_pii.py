from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import pii

from .helpers import clashing, documents


def plain(text):
    """The base rules as plain patterns."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    )
    return sorted(((*m.span(), k) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])), key=lambda s: (s[0], s[2]))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aZ0192.@-+_ ()%é\n", max_size=60))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 (555) 010-4455 x", "4111 1111 1111 1111", "x@y", "999.1.1.1", "4047054433953522", "+1 2", "a.b@c..d"])
def test_base_cases(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("at", ["[at]", "[AT]", "(At)", "{aT}"])
def test_spelled_out_addresses_in_any_case(at):
    text = f"write to jane {at} host [DOT] org at noon"
    assert [text[a:b] for a, b, kind in pii.wider_spans(text) if kind == 0] == [f"jane {at} host [DOT] org"]


def test_long_runs_are_linear():
    for c in ("a", "1", "1.", "+1", "a@", "1 "):
        pii.base_spans(c * 100_000)


def test_query_contract_and_edges(spark):
    texts = ["mail a.b@example.com or +1 (212) 555-0123", None, "", "call (212) 555-0199 now", "no data", "é 10.0.0.1", "x" * 50_000] * 2
    got = {r["doc_id"]: r for r in pii.personal_data(clashing(documents(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = plain(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == j for s in base) for j in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(pii.line(base).encode()).hexdigest()
        assert set(filter(None, pii.line(base).split(","))) <= set(got[i]["spans"].split(","))
    assert got[0]["spans"] == "email:5:20,phone:24:41"
    assert not pii.personal_data(documents(spark, texts).where("false")).collect()
    for i in range(7):  # repeated texts
        assert got[i]["spans"] == got[i + 7]["spans"] and got[i]["base_sha256"] == got[i + 7]["base_sha256"]


def test_labelers_do_not_know_the_base_spans():
    # the same evidence gives the same votes, whether the base rules take the span or not
    one, two = "ring (212) 555-0123 now", "ring +1 (212) 555-0123 now"
    assert pii.votes(one, (5, 19, 3))[0] == pii.votes(two, (5, 22, 3))[0] == 1
    assert pii.votes("card 4111/1111/1111/1111", (5, 24, 2)) == (1, 1, 1, 1, 1)
    assert pii.votes("order 1234567890123456", (6, 22, 2))[1:4] == (-1, -1, -1)


def planted(n=400):
    """Documents with spans beyond the base rules, and with numbers that are none. (text, added spans that are right)"""
    import random

    rng = random.Random(11)
    digit = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        head = "4" + digit(14)
        return next(head + d for d in "0123456789" if pii.luhn(head + d))

    out = []
    for i in range(n):
        name, noun = "".join(rng.choice("abcdefghij") for _ in range(6)), rng.choice("lorem ipsum dolor amet".split())
        good = (
            ("contact", f"{name} [at] {noun}mail [dot] org", 0),
            ("call", f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{digit(4)}", 3),
            ("card", "/".join(c[k : k + 4] for c in [card()] for k in (0, 4, 8, 12)), 2),
        )
        bad = (("order", "1" + digit(15)), ("version", f"{rng.randrange(300, 999)}.{digit(2)}.{digit(2)}.{digit(2)}"), ("serial", f"{digit(3)} {digit(3)} 0{digit(3)}"), ("page", f"9{digit(3)}/{digit(4)}/{digit(4)}/{digit(4)}"))
        word, span, kind = good[i % 3]
        other, number = bad[i % 4]
        plain = (f"write {name}@{noun}.com", f"phone +1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{digit(4)}", f"pay {card()}", f"host {rng.randrange(1, 200)}.{rng.randrange(255)}.1.{rng.randrange(255)}")[i % 4]
        text = f"{noun} {word} {span} and {other} {number} then {plain} {noun}"
        start = text.index(span)
        out.append((text, f"{pii.KINDS[kind]}:{start}:{start + len(span)}"))
    return out


def test_planted_spans_beyond_the_base(spark):
    cases = planted()
    docs = documents(spark, [t for t, _ in cases])
    shares = pii.vote_shares(pii.vote_counts(docs))
    assert all(shares[k]["context"] > 0.2 for k in pii.KINDS)
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    added = {(i, x) for i, (t, _) in enumerate(cases) for x in got[i]["spans"].split(",") if x and x not in pii.line(pii.base_spans(t)).split(",")}
    want = {(i, x) for i, (_, x) in enumerate(cases)}
    print(f"added {len(added)}, right {len(added & want)}, planted {len(want)}, votes {shares}")
    assert len(added & want) >= 0.9 * len(added) and len(added & want) >= 0.9 * len(want)


def test_estimates_are_those_of_plain_expectation_maximisation():
    """The same model, one candidate after the other instead of counted rows."""
    import itertools
    import random

    import numpy as np

    rng = random.Random(2)
    table = [v for v in itertools.product((-1, 0, 1), repeat=3) for _ in range(rng.randrange(4))]
    post = [1 / (1 + np.exp(-2.0 * (v.count(1) - 3 * v.count(-1)))) for v in table]
    for _ in range(30):
        p = (sum(post) + 1) / (len(post) + 2)
        chance = {}
        for true in (1, 0):
            for j in range(3):
                w = {x: sum(q if true else 1 - q for q, v in zip(post, table, strict=True) if v[j] == x) + (2.0 if x == (1 if true else -1) else 1.0) for x in (-1, 0, 1)}
                for x in w:
                    chance[true, j, x] = w[x] / sum(w.values())
        joint = [[(p if true else 1 - p) * np.prod([chance[true, j, v[j]] for j in range(3)]) for true in (1, 0)] for v in table]
        post = [a / (a + b) for a, b in joint]
    rows = sorted(set(table))
    got = pii.estimate(np.array(rows), np.array([table.count(v) for v in rows], float), 30)
    for v, q in zip(rows, got, strict=True):
        assert q == pytest.approx(post[table.index(v)], abs=1e-9)


def test_training_tells_good_from_bad_candidates():
    good, bad = (0, 1, 1, 1, 1), (-1, -1, -1, -1, -1)
    counts = {pii._key(3, (1, 1, 0, 1, 1), 3): 500, pii._key(3, good, 3): 60, pii._key(3, bad, 3): 200, pii._key(3, (0, -1, -1, -1, -1), 3): 100}
    m = pii.train(counts)
    assert m.probability(3, good, 3) > 0.9 > 0.1 > m.probability(3, bad, 3)
    assert m.reliability[3, 1] > 0.9
    none = pii.train({})
    assert none.probability(0, good, 0) < 0.9  # nothing learned, nothing added


def test_keys_round_trip():
    for k in range(4):
        assert pii._unkey(pii._key(k, (1, -1, 0, 1, -1), 77)) == (k, (1, -1, 0, 1, -1), 77)
