from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import queries
from ledgerloom.functions import rewrites, text
from ledgerloom.operators import checks

DATA = Path("/root/testdata/sf0.001")


def one(spark, x, f):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]


def test_rewrites(spark):
    base = text.PROMPT_PREFIX + "It is open."
    full = base + text.PROMPT_SUFFIX
    assert one(spark, full, rewrites.scoring) == base + "\n\nAnswer:\n" and one(spark, base, rewrites.scoring) == base + "\n\nAnswer:\n"
    assert one(spark, full, rewrites.generation).startswith(base + "\n\nAnswer now. Return only") and one(spark, full, lambda x: rewrites.generation(x, "plain")) == base + "\n\nAnswer now.\n"
    with pytest.raises(ValueError, match="the contract is one of"):
        rewrites.generation(F.lit(""), "other")
    asked = one(spark, base + "\n\nAnswer now.\nReturn only the two requested integers.\n", rewrites.classification)
    assert asked == f"{base}\n\n{rewrites.LABEL_TASK}\n"
    again = one(spark, asked, lambda x: rewrites.classification(x, True))
    assert again == asked.strip() and again.count("Task: Determine whether") == 1
    assert one(spark, base + "\n\n\n\nANSWER with exactly two integers on separate lines: 1\n2. " + text.PROMPT_SUFFIX, rewrites.classification) == f"{base}\n\n{rewrites.LABEL_TASK}\n"
    rows = spark.createDataFrame([(full, " Realized_Closed "), (None, "paper_open"), ("x", None)], "prompt_text string, pair_role string")
    got = rewrites.classification_rows(rows).collect()
    assert [r["classification_label_expected"] for r in got] == ["REALIZED", "PAPER", ""] and {r["behavior_target"] for r in got} == {"realization_classification"}


def test_pair_issues(spark):
    fine = text.PROMPT_PREFIX + "She waits. Give two integers: 1 to 1000 and 1-5." + text.PROMPT_SUFFIX
    long = fine.replace("She waits", "She waits " + "so " * 30)
    rows = [
        ("a", fine, "p1", "paper_open", "casino"), ("b", fine, "p1", "realized_closed", "casino"), ("c", fine, "p2", "paper_open", "casino"), ("d", long, "p2", "realized_closed", "stocks"),
        ("e", fine, "p3", "paper_open", "casino"), ("e", fine, "p3", "paper_open", "casino"), ("f", "bad I", None, None, None),
    ]
    df = spark.createDataFrame(rows, "prompt_id string, prompt_text string, pair_id string, pair_role string, domain string").withColumns(dict.fromkeys(("outcome_valence", "amount_bucket", "source_llm"), F.lit("")))
    got = sorted((r["prompt_id"], r["issue"], r["detail"]) for r in checks.prompt_issues(df).collect())
    assert got == sorted([
        *(("c", i, d) for i, d in (("pair_metadata_mismatch", "domain"), ("pair_word_delta", "30"))), *(("d", i, d) for i, d in (("pair_metadata_mismatch", "domain"), ("pair_word_delta", "30"))),
        ("e", "bad_pair_roles", '{"paper_open": 2}'), ("e", "bad_pair_roles", '{"paper_open": 2}'), ("e", "duplicate_prompt_id", ""),
        ("f", "bad_pair_roles", '{"": 1}'), *(("f", i, "") for i in ("bad_prefix", "bad_suffix", "missing_behavior_instruction", "first_person")),
    ])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_fixed_effects_against_a_dense_design(spark):
    """The query of fixed effects against a design matrix of all rows in memory."""
    rows = duckdb.sql(f"SELECT ln(o_totalprice) AS y, o_orderpriority AS p, o_orderstatus AS s, c_mktsegment AS m FROM '{DATA}/orders.parquet' JOIN '{DATA}/customer.parquet' ON o_custkey = c_custkey").df()
    names, columns = ["const"], [np.ones(len(rows))]
    for c, prefix in (("p", ""), ("s", "o_orderstatus_"), ("m", "c_mktsegment_")):
        for level in sorted(rows[c].unique())[1:]:
            names.append(prefix + level)
            columns.append((rows[c] == level).to_numpy(float))
    x, y = np.stack(columns, 1), rows["y"].to_numpy()
    bread = np.linalg.inv(x.T @ x)
    coef = bread @ x.T @ y
    e, h = y - x @ coef, np.einsum("ij,jk,ik->i", x, bread, x)
    se = np.sqrt(np.diag(bread @ (x.T * (e / (1 - h)) ** 2) @ x @ bread))
    got = {r["term"]: r for r in queries.queries()["q23_ols_fixed_effects"](spark, str(DATA)).collect()}
    assert list(got) == names
    for n, b, s in zip(names, coef, se, strict=True):
        p = math.erfc(abs(b / s) / math.sqrt(2))
        assert np.allclose([got[n]["coef"], got[n]["se"], got[n]["p"]], [b, s, p]) and got[n]["stars"] == ("***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else "")
    assert np.isclose(got["const"]["r_squared"], 1 - (e @ e) / ((y - y.mean()) ** 2).sum())


def test_result_datasets_and_standard_output(spark, tmp_path, capsys):
    from ledgerloom.sources import sinks, tables

    root = str(tmp_path)
    assert tables.datasets(spark, root) == []
    (tmp_path / "results/a").mkdir(parents=True)
    (tmp_path / "results/a/x.csv").write_text("c\n1\n2\n")
    (tmp_path / "results/b.csv").write_text("c\n3\n")
    (tmp_path / "results/b.txt").write_text("c\n3\n")
    (tmp_path / "other.csv").write_text("c\n")
    assert [n.split(root)[1] for n in tables.datasets(spark, root)] == ["/results/a/x.csv", "/results/b.csv"]
    assert tables.dataset(spark, root, "results/a/x.csv").count() == 2 and tables.dataset(spark, root, f"{root}/results/b.csv").first()["c"] == "3"
    for bad in ("", "other.csv", "results/../other.csv", "results/b.txt"):
        with pytest.raises(ValueError, match="none of the results"):
            tables.dataset(spark, root, bad)
    sinks.print_csv(spark.createDataFrame([('a "b"', True, None), ("c,d", None, 1.5)], "s string, t boolean, n double").coalesce(1))
    assert capsys.readouterr().out == 's,t,n\n"a ""b""",True,\n"c,d",,1.5\n'


def test_steered_positions_and_empty_regression_frames(spark):
    from ledgerloom.operators import predicates, summaries
    from ledgerloom.operators.trials import FIELDS

    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1.0, 0.0])], "t array<array<double>>, d array<double>")
    got = df.select(summaries.steered_tokens("t", "d", 2.0).alias("a"), summaries.steered_tokens("t", "d", 2.0, "last").alias("l")).first()
    assert got["a"] == [[3.0, 2.0], [5.0, 4.0]] and got["l"] == [[1.0, 2.0], [5.0, 4.0]]
    with pytest.raises(ValueError, match="all or last"):
        summaries.steered_tokens("t", "d", 1.0, "first")
    trials = spark.createDataFrame([("x",) * len(FIELDS)], ", ".join(f"{c} string" for c in FIELDS))
    with pytest.raises(ValueError, match="no valid rows"):
        predicates.regression_frame(trials, "log_wager")
    with pytest.raises(ValueError, match="missing columns: temperature"):
        predicates.regression_frame(trials.drop("temperature"), "log_wager")
