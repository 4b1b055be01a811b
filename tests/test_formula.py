from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from ledgerloom.operators import formula

SCHEMA = "y double, x double, z double, a string, b string, g long"


def data(seed: int, n: int):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, x, z = rng.choice(["u", "v", "w", None]), rng.choice(["p", "q"]), rng.gauss(0, 1), rng.gauss(0, 1)
        out.append((2 + x - 0.5 * z + {"u": 0, "v": 1, "w": -1, None: 0}[a] + (b == "q") * x + rng.gauss(0, 1 + abs(x)), x if rng.random() > 0.05 else None, z, a, b, rng.randint(1, 3)))
    return out


def dense(rows, y, terms, intercept=True, cov="HC3"):
    """The same by a dense design matrix in memory; terms: products of (column, level or None)."""
    names = ("y", "x", "z", "a", "b", "g")
    used = {c for t in terms for c, _ in t} | {y}
    kept = [dict(zip(names, r, strict=True)) for r in rows]
    kept = [r for r in kept if all(r[c] is not None for c in used)]
    columns = [np.ones(len(kept))] if intercept else []
    for t in terms:
        columns.append(np.prod([[float(str(r[c]) == v) if v is not None else float(r[c]) for r in kept] for c, v in t], axis=0))
    m, v = np.stack(columns, 1), np.array([r[y] for r in kept])
    bread = np.linalg.pinv(m.T @ m)
    coef = bread @ m.T @ v
    e, h = v - m @ coef, np.einsum("ij,jk,ik->i", m, bread, m)
    w = {"HC0": e**2, "HC2": e**2 / (1 - h), "HC3": e**2 / (1 - h) ** 2}[cov]
    se = np.sqrt(np.diag(bread @ (m.T * w) @ m @ bread))
    return coef, se, len(kept), 1 - (e @ e) / (((v - v.mean()) ** 2).sum() if intercept else v @ v)


C = lambda c, *levels: [[(c, v)] for v in levels]
CASES = [
    ("y ~ x", [[("x", None)]], True),
    ("y ~ x + C(a) + C(b) + C(g)", [[("x", None)], *C("a", "v", "w"), *C("b", "q"), *C("g", "2", "3")], True),
    ("y ~ x * z", [[("x", None)], [("z", None)], [("x", None), ("z", None)]], True),
    ("y ~ x + C(a) + x:C(a)", [[("x", None)], *C("a", "v", "w"), [("x", None), ("a", "v")], [("x", None), ("a", "w")]], True),
    ("y ~ C(a)*C(b) + z", [*C("a", "v", "w"), *C("b", "q"), [("a", "v"), ("b", "q")], [("a", "w"), ("b", "q")], [("z", None)]], True),
    ("y ~ x + z - 1", [[("x", None)], [("z", None)]], False),
]


@pytest.mark.parametrize(("text", "terms", "intercept"), CASES)
def test_against_a_dense_design(spark, text, terms, intercept):
    rows = data(1, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for cov in ("HC3", "HC2", "HC0"):
        f = formula.fit(df, text, cov)
        coef, se, n, r2 = dense(rows, "y", terms, intercept, cov)
        assert f.n == n and np.allclose(f.coef, coef) and np.allclose(f.se(), se) and np.isclose(f.r_squared, r2)


def test_names_and_the_rows_of_models(spark):
    df = spark.createDataFrame(data(2, 200), SCHEMA)
    f = formula.fit(df, "y ~ x:C(b) + C(a)")
    assert f.names == ["Intercept", "x:C(b)[T.q]", "C(a)[T.v]", "C(a)[T.w]"]
    controls = " + C(a) + C(b)"
    models = [(name, df, f"{y} ~ {x}{more}", x) for (name, more), (y, x) in itertools.product((("no_controls", ""), ("with_controls", controls)), (("y", "x"), ("z", "x"), ("y", "z"), ("x", "z")))]
    got = formula.model_rows(spark, models).collect()
    assert len(got) == 8 and [(r["analysis"], r["outcome"], r["term"]) for r in got][0] == ("no_controls", "y", "x") and all(0 <= r["p"] <= 1 and r["n"] > 100 for r in got)


def test_malformed_formulas_and_no_rows(spark):
    for bad in ("y", "~ x", "y ~", "y ~ log(x)", "y ~ x - z", "y ~ a:b*c"):
        with pytest.raises(ValueError, match="no formula|no term"):
            formula.parse(bad)
    with pytest.raises(ValueError, match="no rows"):
        formula.fit(spark.createDataFrame([(1.0, None, 1.0, "a", "b", 1)], SCHEMA), "y ~ x")


def test_too_many_levels(spark, monkeypatch):
    monkeypatch.setattr(formula, "MAX_COLUMNS", 5)
    with pytest.raises(ValueError, match="more than 5"):
        formula.fit(spark.range(20).selectExpr("double(id) y", "string(id) a"), "y ~ C(a)")
