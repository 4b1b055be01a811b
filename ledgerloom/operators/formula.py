"""Least squares by formula: ``y ~ x + C(a) + x:C(a)``, with robust errors, in two passes of partial sums.

A term is a product of columns, and of indicators of the levels of ``C()`` columns, of which the first in order is the
baseline. Each row has one column of the design for each term, so the normal equations are added up from terms times
terms entries a row, whatever the number of levels. ``*`` stands for both columns and their product, ``- 1`` or ``0 +``
for no constant. Rows with a null in a column of the formula are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .regression import Fit

#: Columns of a design, and levels of all its categories; more raise.
MAX_COLUMNS = 2000
INTERCEPT = "Intercept"
_CATEGORY = re.compile(r"^C\((\w+)\)$")


@dataclass
class Model:
    outcome: str
    terms: list[tuple[str, ...]]
    intercept: bool = True
    levels: dict[str, list[str]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        """Columns of the data, the outcome first."""
        return list(dict.fromkeys([self.outcome, *(_name(f) for t in self.terms for f in t)]))

    @property
    def categories(self) -> list[str]:
        return list(dict.fromkeys(_name(f) for t in self.terms for f in t if _CATEGORY.match(f)))


def _name(factor: str) -> str:
    m = _CATEGORY.match(factor)
    return m[1] if m else factor


def parse(formula: str) -> Model:
    """Outcome and terms; a malformed formula raises."""
    outcome, gap, right = (x.strip() for x in formula.partition("~"))
    if not gap or not re.fullmatch(r"\w+", outcome) or not right:
        raise ValueError(f"no formula: {formula}")
    terms: list[tuple[str, ...]] = []
    intercept = True
    for sign, part in re.findall(r"([+-]?)\s*([^+-]+)", right):
        part = part.strip()
        if part in ("0", "1"):
            intercept = (part == "1") != (sign == "-")
            continue
        factors = [x.strip() for x in re.split(r"[:*]", part)]
        if sign == "-" or not all(re.fullmatch(r"\w+", x) or _CATEGORY.match(x) for x in factors) or ":" in part and "*" in part:
            raise ValueError(f"no term: {sign}{part}")
        single = [(x,) for x in factors] if "*" in part else []
        terms += [t for t in dict.fromkeys([*single, tuple(factors)]) if t not in terms]
    return Model(outcome, terms, intercept)


def with_levels(df: DataFrame, model: Model) -> Model:
    """The levels of all categories, in order, from one pass in which tasks pass on distinct ones only."""
    if not model.categories:
        return model
    own = df.select(*model.columns).dropna()
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in model.categories])
    found = own.select(F.explode(pairs).alias("p")).distinct().limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} levels")
    model.levels = {c: sorted(r["p"]["v"] for r in found if r["p"]["c"] == c) for c in model.categories}
    return model


def names(model: Model) -> list[str]:
    """Names of the design's columns, term by term; a term's last category runs fastest."""
    out = [INTERCEPT] if model.intercept else []
    for t in model.terms:
        own = [""]
        for f in t:
            labels = [f"{f}[T.{v}]" for v in model.levels[_name(f)][1:]] if _CATEGORY.match(f) else [f]
            own = [f"{a}:{b}" if a else b for a in own for b in labels]
        out += own
    if len(out) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    return out


def _design(model: Model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, values, outcome): one design column a row and term, the number of columns where the row is at a baseline."""
    n, k = batch.num_rows, len(names(model))
    codes = {}
    for c in model.categories:
        place = {v: i - 1 for i, v in enumerate(model.levels[c])}
        codes[c] = np.array([place[v] for v in batch.column(c).to_pylist()], np.int64)
    at, value = [], []
    first = 0
    if model.intercept:
        at.append(np.zeros(n, np.int64))
        value.append(np.ones(n))
        first = 1
    for t in model.terms:
        code, size, v, base = np.zeros(n, np.int64), 1, np.ones(n), np.zeros(n, bool)
        for f in t:
            if _CATEGORY.match(f):
                more = len(model.levels[_name(f)]) - 1
                code, size, base = code * more + codes[_name(f)], size * more, base | (codes[_name(f)] < 0)
            else:
                v = v * batch.column(f).to_numpy(zero_copy_only=False).astype(float)
        at.append(np.where(base, k, first + code))
        value.append(np.where(base, 0.0, v))
        first += size
    empty = np.zeros((0, n))
    return (np.stack(at) if at else empty.astype(np.int64)), (np.stack(value) if value else empty), batch.column(model.outcome).to_numpy(zero_copy_only=False).astype(float)


def _products(at: np.ndarray, value: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Sum over rows of weight times the outer product of the design row with itself; the place for baselines is cut off."""
    out = np.zeros((k + 1, k + 1))
    for i in range(len(at)):
        for j in range(len(at)):
            np.add.at(out, (at[i], at[j]), value[i] * value[j] * weight)
    return out[:k, :k]


def _total(own: DataFrame, model: Model, size: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums of ``part`` over all rows: each task gives the entries that are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(size)
        for b in batches:
            if b.num_rows:
                s += part(*_design(model, b))
        i = np.flatnonzero(s)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s[i])], names=["i", "v"])

    out = np.zeros(size)
    for r in own.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():  # at most ``size`` rows
        out[r["i"]] = r["v"]
    return out


def fit(df: DataFrame, formula: str, cov_type: str = "HC3") -> Fit:
    """Coefficients and their covariance; no rows without nulls raise."""
    model = with_levels(df, parse(formula))
    label = names(model)
    k = len(label)
    own = df.select(*[F.col(c).cast("string") if c in model.categories else F.col(c).cast("double").alias(c) for c in model.columns]).dropna()

    def normal(at: np.ndarray, value: np.ndarray, y: np.ndarray) -> np.ndarray:
        xy = np.zeros(k + 1)
        for i in range(len(at)):
            np.add.at(xy, at[i], value[i] * y)
        return np.concatenate([_products(at, value, np.ones(len(y)), k).ravel(), xy[:k], [y @ y, y.sum(), len(y)]])

    first = _total(own, model, k * k + k + 3, normal)
    gram, n = first[: k * k].reshape(k, k), int(first[-1])
    if not n:
        raise ValueError("no rows are left")
    bread, rank = np.linalg.pinv(gram), int(np.linalg.matrix_rank(gram))
    coef = bread @ first[k * k : k * k + k]
    padded, padded_coef = np.zeros((k + 1, k + 1)), np.append(coef, 0.0)
    padded[:k, :k] = bread

    def meat(at: np.ndarray, value: np.ndarray, y: np.ndarray) -> np.ndarray:
        e2 = (y - (padded_coef[at] * value).sum(0)) ** 2
        h = sum(padded[at[i], at[j]] * value[i] * value[j] for i in range(len(at)) for j in range(len(at)))
        free = np.maximum(1 - h, 1e-10)
        w = e2 * {"HC0": 1.0, "HC1": n / max(n - rank, 1), "HC2": 1 / free, "HC3": 1 / free**2}.get(cov_type, 1.0)
        return np.concatenate([_products(at, value, w, k).ravel(), [e2.sum(), (h > 1 - 1e-10).sum()]])

    second = _total(own, model, k * k + 2, meat)
    cov = bread * second[-2] / max(n - rank, 1) if cov_type == "nonrobust" else bread @ second[: k * k].reshape(k, k) @ bread
    around = first[-3] - (first[-2] ** 2 / n if model.intercept else 0.0)
    return Fit(label, coef, cov, n, rank, 1 - second[-2] / around if around else math.nan, bool(second[-1]))


ROWS = "analysis string, outcome string, n long, formula string, term string, coef double, se double, p double, r_squared double"


def model_rows(spark: SparkSession, models: list[tuple[str, DataFrame, str, str]], cov_type: str = "HC3") -> DataFrame:
    """One row for each (analysis, data, formula, term): the term's coefficient, robust error and p-value."""
    out = []
    for analysis, df, formula, term in models:
        f = fit(df, formula, cov_type)
        i = f.names.index(term)
        null = lambda v: None if v != v else float(v)
        out.append((analysis, parse(formula).outcome, f.n, formula, term, float(f.coef[i]), null(f.se()[i]), null(f.p()[i]), null(f.r_squared)))
    return spark.createDataFrame(out, ROWS)
