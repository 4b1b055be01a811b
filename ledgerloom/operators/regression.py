"""Least squares with heteroscedasticity-robust errors from sufficient statistics.

All regressors of the fixed-effect models are categories, so rows of one combination (a cell) share a design row. One
grouping by cell gives count, mean and variance of the outcome, from which coefficients and HC0-HC3 covariances
follow exactly; what comes to the driver is one row for each cell of the design, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tails

#: Cells of a design; more are no categories any more.
MAX_CELLS = 200_000


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    rank: int
    r_squared: float
    leverage_one: bool

    @property
    def df_resid(self) -> int:
        return self.n - self.rank

    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def p(self) -> np.ndarray:
        """Two-sided and normal, as usual with robust errors."""
        return np.array([tails.normal_two_sided(c / s) if s > 0 else math.nan for c, s in zip(self.coef, self.se(), strict=True)])

    def wald(self, a: str, b: str) -> tuple[float, float]:
        """F and p of the equality of two coefficients; NaN if one is absent."""
        if a not in self.names or b not in self.names:
            return math.nan, math.nan
        i, j = self.names.index(a), self.names.index(b)
        var = self.cov[i, i] + self.cov[j, j] - 2 * self.cov[i, j]
        f = float((self.coef[i] - self.coef[j]) ** 2 / var) if var > 0 else math.nan
        return f, tails.f_upper(f, 1, self.df_resid)


def cells(df: DataFrame, categories: list[str], y: str) -> pd.DataFrame:
    """Count, mean and population variance of ``y`` in each combination of categories."""
    out = df.where(F.col(y).isNotNull()).groupBy(*categories).agg(F.count("*").alias("_n"), F.avg(y).alias("_mean"), F.var_pop(y).alias("_var"))
    got = out.limit(MAX_CELLS + 1).toPandas()
    if len(got) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    return got


def design(table: pd.DataFrame, factor: str, levels: list[str], reference: str, effects: list[str]) -> tuple[list[str], np.ndarray]:
    """Constant, an indicator of each level present but the reference, and of each level of the effects but their first in order.

    Levels outside the list fall to the baseline. A reference that does not occur raises.
    """
    seen = set(table[factor])
    if reference not in seen:
        raise ValueError(f"the reference {reference!r} does not occur")
    names, columns = ["const"], [np.ones(len(table))]
    for level in levels:
        if level in seen and level != reference:
            names.append(level)
            columns.append((table[factor] == level).to_numpy(float))
    for e in effects:
        for level in sorted(table[e].dropna().astype(str).unique())[1:]:
            names.append(f"{e}_{level}")
            columns.append((table[e].astype(str) == level).to_numpy(float))
    return names, np.stack(columns, 1)


def solve(names: list[str], x: np.ndarray, table: pd.DataFrame, cov_type: str = "HC3") -> Fit:
    n, mean, var = table["_n"].to_numpy(float), table["_mean"].to_numpy(float), table["_var"].to_numpy(float)
    bread = np.linalg.pinv((x * n[:, None]).T @ x)
    coef = bread @ (x.T @ (n * mean))
    fitted = x @ coef
    squares = n * (var + (mean - fitted) ** 2)
    leverage = np.einsum("ij,jk,ik->i", x, bread, x)
    free = 1 - leverage
    rank, total = int(np.linalg.matrix_rank(x[n > 0])), int(n.sum())
    one = bool((free < 1e-10).any())
    if cov_type == "nonrobust":
        cov = bread * squares.sum() / max(total - rank, 1)
    else:
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = {"HC0": 1.0, "HC1": total / max(total - rank, 1), "HC2": 1 / free, "HC3": 1 / free**2}[cov_type]
            w = np.broadcast_to(squares * scale, squares.shape)
            w = np.where(free < 1e-10, np.nan, w) if cov_type in ("HC2", "HC3") else w
        cov = bread @ ((x * w[:, None]).T @ x) @ bread
    grand = (n @ mean) / total
    around = (n * (var + (mean - grand) ** 2)).sum()
    return Fit(names, coef, cov, total, rank, 1 - squares.sum() / around if around else math.nan, one)


def fit(df: DataFrame, y: str, factor: str, levels: list[str], reference: str, effects: list[str], cov_type: str = "HC3") -> Fit:
    table = cells(df, [factor, *effects], y)
    return solve(*design(table, factor, levels, reference, effects), table, cov_type)


def fit_by(df: DataFrame, by: str, y: str, factor: str, levels: list[str], reference: str, effects: list[str], cov_type: str = "HC3") -> dict[str, Fit]:
    """A fit for each value of ``by`` from one grouping; values without the reference are left out."""
    table = cells(df, [by, factor, *effects], y)
    out = {}
    for value, own in table.groupby(by):
        if (own[factor] == reference).any():
            own = own.reset_index(drop=True)
            out[str(value)] = solve(*design(own, factor, levels, reference, effects), own, cov_type)
    return out


def stars(p: float) -> str:
    return "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.10 else ""


def one_sided(coef: float, p: float, direction: str = "positive") -> float:
    return p / 2 if (coef > 0 if direction == "positive" else coef < 0) else 1 - p / 2


def coefficient_rows(f: Fit) -> list[tuple]:
    """(term, coef, se, p, stars, significant_05, n, r_squared, leverage_one), numbers null where they do not exist."""
    null = lambda v: None if v != v else float(v)
    return [(t, float(c), null(s), null(p), stars(p), bool(p < 0.05), f.n, null(f.r_squared), f.leverage_one) for t, c, s, p in zip(f.names, f.coef, f.se(), f.p(), strict=True)]


COEFFICIENTS = "term string, coef double, se double, p double, stars string, significant_05 boolean, n long, r_squared double, leverage_one boolean"


def coefficient_table(spark: SparkSession, f: Fit) -> DataFrame:
    return spark.createDataFrame(coefficient_rows(f), COEFFICIENTS)


#: (hypothesis, kind, terms, direction); fixed values of the study.
HYPOTHESES = (
    ("H1a", "coef", ("paper_loss_small",), "positive"), ("H1a", "coef", ("paper_loss_medium",), "positive"), ("H1a", "coef", ("paper_loss_large",), "positive"),
    ("H1b", "diff", ("paper_loss_large", "paper_loss_medium"), "positive"), ("H1b", "diff", ("paper_loss_medium", "paper_loss_small"), "positive"),
    ("H2a", "coef", ("paper_gain_small",), "positive"), ("H2a", "coef", ("paper_gain_large",), "positive"),
    ("H2b", "diff", ("paper_gain_large", "paper_gain_small"), "positive"),
    ("H3a", "coef", ("realized_medium_loss",), "negative"), ("H3a", "coef", ("realized_large_loss",), "negative"), ("H3a", "coef", ("realized_extreme_loss",), "negative"),
    ("H3b", "diff", ("realized_extreme_loss", "realized_large_loss"), "negative"), ("H3b", "diff", ("realized_large_loss", "realized_medium_loss"), "negative"),
    ("H4", "none", ("realized_gain",), "two-sided"),
)


def hypotheses(paper: Fit | None, realized: Fit | None, battery: tuple = HYPOTHESES) -> list[tuple]:
    """(hypothesis, term, estimate, statistic, p, verdict) for every test whose terms exist; a missing fit gives no rows."""
    out = []
    for name, kind, terms, direction in battery:
        f = realized if name in ("H3a", "H3b", "H4") else paper
        if f is None or any(t not in f.names for t in terms):
            continue
        at = [f.names.index(t) for t in terms]
        if kind == "diff":
            diff = float(f.coef[at[0]] - f.coef[at[1]])
            stat, p2 = f.wald(*terms)
            p = one_sided(diff, p2, direction)
            out.append((name, " - ".join(terms), diff, stat, p, stars(p)))
        else:
            coef, p2 = float(f.coef[at[0]]), float(f.p()[at[0]])
            stat = coef / float(f.se()[at[0]]) if f.se()[at[0]] > 0 else math.nan
            p = p2 if kind == "none" else one_sided(coef, p2, direction)
            out.append((name, terms[0], coef, stat, p, ("SUPPORTED" if p >= 0.10 else "REJECTED") if kind == "none" else stars(p)))
    return out


def zscore(df: DataFrame, x: str, name: str) -> DataFrame:
    """Adds (x - mean) / population standard deviation; null if that is 0. The two numbers come from one partial aggregate."""
    stats = df.agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    return df.join(F.broadcast(stats), F.lit(True)).withColumn(name, F.try_divide(F.col(x) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def fit_continuous(df: DataFrame, y: str, terms: list[str], categories: dict[str, list[str]] | None = None, cov_type: str = "HC3") -> Fit:
    """Least squares on continuous terms and indicator controls in two passes of partial sums; rows with a null are left out.

    categories: for each control its levels, the first being the baseline. Each batch of rows becomes one small matrix.
    """
    categories = categories or {}
    names = ["const", *terms, *[f"{c}_{v}" for c, levels in categories.items() for v in levels[1:]]]
    k = len(names)
    own = df.select(y, *terms, *categories).dropna()

    def matrix(b: pd.DataFrame) -> np.ndarray:
        parts = [np.ones(len(b)), *[b[t].to_numpy(float) for t in terms]]
        parts += [(b[c].astype(str) == v).to_numpy(float) for c, levels in categories.items() for v in map(str, levels[1:])]
        return np.stack(parts, 1)

    def total(f, size: int) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = np.zeros(size)
            for b in batches:
                s += f(matrix(b), b[y].to_numpy(float))
            yield pd.DataFrame({"i": np.arange(size), "v": s})

        got = own.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # size rows
        out = np.zeros(size)
        for r in got:
            out[r["i"]] = r["v"]
        return out

    first = total(lambda x, v: np.concatenate([(x.T @ x).ravel(), x.T @ v, [v @ v, v.sum(), len(v)]]), k * k + k + 3)
    bread = np.linalg.pinv(first[: k * k].reshape(k, k))
    coef = bread @ first[k * k : k * k + k]
    rank, n = int(np.linalg.matrix_rank(first[: k * k].reshape(k, k))), int(first[-1])

    def meat(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        e2, h = (v - x @ coef) ** 2, np.einsum("ij,jk,ik->i", x, bread, x)
        free = np.maximum(1 - h, 1e-10)
        w = e2 * {"HC0": 1.0, "HC1": n / max(n - rank, 1), "HC2": 1 / free, "HC3": 1 / free**2}.get(cov_type, 1.0)
        return np.concatenate([((x * w[:, None]).T @ x).ravel(), [e2.sum(), (h > 1 - 1e-10).sum()]])

    second = total(meat, k * k + 2)
    cov = bread @ second[: k * k].reshape(k, k) @ bread if cov_type != "nonrobust" else bread * second[-2] / max(n - rank, 1)
    around = first[-3] - first[-2] ** 2 / max(n, 1)
    return Fit(names, coef, cov, n, rank, 1 - second[-2] / around if around else math.nan, bool(second[-1]))
