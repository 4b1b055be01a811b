"""Operators on small worked inputs and against NumPy."""

from __future__ import annotations

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import overlap, pairs, partitioning, progress, ranks, regression, reorganize, robust, trials, vectors
from ledgerloom.plans import generation
from ledgerloom.sources import sinks, tables
from ledgerloom.streaming import progress as live

FIELDS = ", ".join(f"{c} string" for c in trials.FIELDS)


def trial(**kw):
    base = dict.fromkeys(trials.FIELDS, "") | {"condition": "paper_even", "run_number": "1", "model": "m", "temperature": "1", "prompt_version": "absolute", "outcome_type": "paper", "amount": "0"}
    return base | kw


def frame(spark, rows):
    data = [tuple(r[c] for c in trials.FIELDS) + (r.get("_file", 1), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, FIELDS + ", _file int, _row int")


def test_dedupe_by_quality_then_order(spark):
    rows = [trial(response_text="a"), trial(request_id="r1"), trial(run_number="2", response_text="x"), trial(run_number="2", response_text="y"), trial(run_number="0", request_id="r9"), trial(run_number="0", request_id="r9"), trial(temperature="1.0")]
    got = trials.dedupe(frame(spark, rows), ["_file", "_row"]).collect()
    assert sorted((r["run_number"], r["request_id"], r["response_text"]) for r in got) == [("0", "r9", ""), ("1", "r1", ""), ("2", "", "x")]


def test_merge_replaces_blocks_keeps_the_rest_and_is_idempotent(spark):
    old = frame(spark, [trial(run_number=str(i), response_text="old") for i in range(1, 6)] + [trial(model="", request_id="r0")])
    new = frame(spark, [trial(run_number=str(i), response_text="new") for i in range(1, 4)] + [trial(model="", request_id="lost")])
    out = trials.merge(new, old)
    got = out.orderBy(F.col("trial_id").cast("int")).collect()
    assert [(r["trial_id"], r["request_id"], r["response_text"]) for r in got] == [("1", "r0", ""), ("2", "", "new"), ("3", "", "new"), ("4", "", "new")]
    again = trials.merge(new, frame(spark, [r.asDict() for r in got]))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize("step, counts, want", [(25, (60, 52), 50), (25, (60, 10), 10), (1, (3, 2), None)])
def test_balance(spark, step, counts, want):
    rows = [trial(condition=c, run_number=str(i)) for c, n in zip("ab", counts, strict=True) for i in range(1, n + 1)] + [trial(condition="", run_number="3")]
    df = frame(spark, rows).withColumns({"n": F.col("run_number").cast("long")})
    got = {r["condition"]: r["count"] for r in trials.balanced(df, ["model"], "condition", "n", step).groupBy("condition").count().collect()}
    assert got == {"": 1, "a": want or counts[0], "b": want or counts[1]}


def test_missing_runs_and_resume_state(spark):
    conditions = spark.createDataFrame([("a",), ("b",)], "condition string")
    done = spark.createDataFrame([("a", 1), ("a", 3), ("c", 2)], "condition string, run_number int")
    assert sorted(map(tuple, trials.missing_runs(conditions, 3, done).collect())) == [("a", 2), ("b", 1), ("b", 2), ("b", 3)]
    state = trials.resume_state(frame(spark, [trial(trial_id="7"), trial(trial_id="x"), trial(run_number="2", temperature="1.0")])).first()
    assert tuple(state) == (2, 7)


def test_partition_by_conditions_and_prompts(spark):
    from ledgerloom.functions import prompts

    conditions = spark.createDataFrame([("e", "paper", 0), ("w", "paper", 5)], "condition string, outcome_type string, amount int")
    text = {r["condition"]: r["p"] for r in conditions.select("condition", prompts.prompt_text(F.col("outcome_type"), F.col("amount"), F.lit("absolute")).alias("p")).collect()}
    block = lambda m, **kw: [trial(model=m, condition=c, prompt_text=text[c] + "  ", **kw) for c in text]
    rows = block("good") + [trial(model="short", condition="e", prompt_text=text["e"])] + block("drift")[:1] + [trial(model="drift", condition="w", prompt_text="other")] + block("good", temperature="1.0")[:1]
    got = {(r["model"], r["temperature"], r["condition"]): r["is_legacy"] for r in partitioning.classify(frame(spark, rows), conditions).collect()}
    assert [k for k, v in got.items() if not v] and {k[:2] for k, v in got.items() if not v} == {("good", "1")}
    assert len(got) == 6
    with pytest.raises(ValueError, match="unknown prompt versions: new"):
        partitioning.classify(frame(spark, [trial(prompt_version="new")]), conditions)


def test_progress(spark):
    rows = spark.createDataFrame([("f", "a", 1), ("f", "a", 2), ("f", "a", 2), ("f", "b", 0), ("f", "", 4)], "f string, c string, n int")
    got = progress.block_progress(rows, ["f"], "c", "n", ["a", "b", "d"], 2).first()
    assert got["n_rows"] == 5 and got["total_unique_runs"] == 2 and got["covered_conditions"] == 1 and got["remaining_to_target"] == 4
    assert got["missing_conditions"] == "b,d" and got["top_deficits"] == "b:2,d:2" and not got["schema_ok"]
    assert progress.by_group(progress.block_progress(rows, ["f"], "c", "n", ["a"], 2), "f").first()["complete_blocks"] == 1


def test_running_sums_match_pandas(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aaaab"), rng.randrange(50)) for i in range(500)]
    got = ranks.running(spark.createDataFrame(rows, "i int, g string, v int"), ["g"], [F.col("i")], F.col("v"), "s").toPandas().sort_values("i")
    assert (got["s"].to_numpy() == got.groupby("g")["v"].cumsum().to_numpy()).all()


def test_reorder(spark):
    rows = [("b", "10", 0), ("B", "9", 1), ("a", "", 2), ("a", "x", 3), ("a", "true", 4)]
    df = spark.createDataFrame(rows, "k string, v string, _row int")
    assert [r["_row"] for r in reorganize.reorder(df, ["k"], ["v"]).collect()] == [4, 3, 2, 1, 0]
    assert [r["_row"] for r in reorganize.reorder(df, ["k"], ["v"], ["v"]).collect()] == [2, 3, 4, 0, 1]
    with pytest.raises(ValueError, match="unknown columns: z"):
        reorganize.reorder(df, ["z"], [])


def test_pairs(spark):
    rows = [("p", "paper_open", 1.0, 0), ("p", "paper_open", 2.0, 1), ("p", "realized_closed", 5.0, 2), ("q", "paper_open", 1.0, 3)]
    df = spark.createDataFrame(rows, "pair string, role string, v double, o int")
    assert [tuple(r) for r in pairs.pivot_pairs(df, "pair", "role", ("paper_open", "realized_closed"), ["v"], "o").collect()] == [("p", 2.0, 5.0, 3.0)]
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert pairs.correlation(same, "x", "y").first()["r"] is None
    with pytest.raises(ValueError, match="no rows at the base scale"):
        pairs.matched_deltas(df.withColumns({"scale": F.lit(1.0), "valid": F.lit(True)}), "pair", "scale", 0.0, ["v"])
    with pytest.raises(ValueError, match="repeated pair: p"):
        pairs.assert_unique(df, "pair")


def test_robust(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 4, 8, 16])], "i int, x double")
    q = robust.quantiles(df, [], "x").first()
    assert (round(q["p01"], 9), q["p25"], round(q["p90"], 9)) == (1.04, 2.0, 12.8)
    t = robust.trimmed_and_winsorized(df, [], "x").first()
    assert t["trim_20"] == pytest.approx(14 / 3) and t["winsor_20"] == pytest.approx((2 + 2 + 4 + 8 + 8) / 5)
    s = robust.signs(df, [], "x").first()
    assert (s["positive"], s["negative"], s["two_sided_p"]) == (5, 0, 0.0625)
    values, rng = [1.0, 2.0, 4.0, 8.0, 16.0], random.Random(7)
    means = sorted(sum(values[rng.randrange(5)] for _ in range(5)) / 5 for _ in range(200))
    assert tuple(robust.bootstrap(df, "x", "i", 200).first()) == (means[5], means[100], means[195])
    wide = robust.bootstrap_parallel(df, [], "x", "i", 200).first()
    assert wide["lower_95"] < wide["median"] < wide["upper_95"]


def test_bootstrap_query_has_the_replicates_of_the_reference(spark, monkeypatch):
    from ledgerloom import queries

    called = []
    monkeypatch.setattr(queries, "_pairs", lambda *_: None)
    monkeypatch.setattr(robust, "bootstrap_parallel", lambda *a: called.append(a[4]))
    queries.q21_bootstrap_ci(spark, "")
    assert called == [20_000]


def test_bootstrap_in_blocks_is_near_the_normal_interval(spark):
    df = spark.createDataFrame([(i % 2, i, float(i % 7)) for i in range(700)], "g int, i int, x double")
    half = 1.96 * 2 / 350**0.5
    for r in robust.bootstrap_parallel(df, ["g"], "x", "i", 5000).collect():
        assert r["median"] == pytest.approx(3, abs=0.02) and r["lower_95"] == pytest.approx(3 - half, abs=0.03) and r["upper_95"] == pytest.approx(3 + half, abs=0.03)


def reference_ols(x, y, kind):
    bread = np.linalg.pinv(x.T @ x)
    beta = bread @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, bread, x)
    n, k = x.shape
    w = {"HC0": e**2, "HC1": e**2 * n / (n - k), "HC2": e**2 / (1 - h), "HC3": e**2 / (1 - h) ** 2}[kind]
    return beta, bread @ (x.T * w) @ x @ bread


@pytest.mark.parametrize("kind", ["HC0", "HC1", "HC2", "HC3"])
def test_cell_and_row_regressions_agree_with_numpy(spark, kind):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"c": rng.choice(list("abc"), 400), "m": rng.choice(["m1", "m2"], 400), "z": rng.normal(size=400)})
    pdf["y"] = (pdf["c"] == "b") * 0.5 + (pdf["m"] == "m2") * 0.2 + 0.3 * pdf["z"] + rng.normal(size=400) * (1 + (pdf["c"] == "c"))
    df = spark.createDataFrame(pdf)
    one = np.ones(400)
    x = np.stack([one, pdf["c"] == "b", pdf["c"] == "c", pdf["m"] == "m2"], 1).astype(float)
    beta, cov = reference_ols(x, pdf["y"].to_numpy(), kind)
    f = regression.fit(df, "y", "c", ["a", "b", "c"], "a", ["m"], kind)
    assert np.allclose(f.coef, beta) and np.allclose(f.cov, cov)
    x = np.column_stack([one, pdf["z"], pdf["m"] == "m2"]).astype(float)
    beta, cov = reference_ols(x, pdf["y"].to_numpy(), kind)
    g = regression.fit_continuous(df, "y", ["z"], {"m": ["m1", "m2"]}, kind)
    assert np.allclose(g.coef, beta) and np.allclose(g.cov, cov)
    assert set(regression.fit_by(df, "m", "y", "c", ["a", "b", "c"], "a", [], kind)) == {"m1", "m2"}


def test_regression_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "c string, y double")
    f = regression.fit(df, "y", "c", ["b"], "a", [])
    assert f.leverage_one and regression.coefficient_rows(f)[1][2] is None
    with pytest.raises(ValueError, match="reference 'z'"):
        regression.fit(df, "y", "c", ["b"], "z", [])
    assert regression.hypotheses(None, None) == []
    assert regression.one_sided(-1.0, 0.2, "negative") == 0.1 and regression.one_sided(0.0, 0.2) == 0.9
    assert [regression.stars(p) for p in (0.009, 0.01, 0.05, 0.1, float("nan"))] == ["***", "**", "*", "", ""]


def test_vectors(spark):
    df = spark.createDataFrame([("p", [float(v) for v in range(8)]), ("p", [float(v) for v in range(8, 16)]), ("q", None)], "k string, vector array<float>")
    got = vectors.mean_vector(df, ["k"], "vector").collect()
    assert [(r["k"], r["vector"], r["n"]) for r in got] == [("p", [float(v) for v in range(4, 12)], 2)]
    rows = [(f"{i}", r, [float(i), float(i) * 2 + (r == "pos")], 0) for i in range(3) for r in ("pos", "neg")]
    own = spark.createDataFrame(rows, "pair string, role string, vector array<double>, o int")
    d = vectors.pair_directions(own, "pair", "role", "pos", "neg", "o")
    mean = vectors.mean_vector(d, [], "direction").select("vector")
    p = vectors.project(own, mean).groupBy("role").agg(F.avg("projection").alias("m")).toPandas().set_index("role")["m"]
    assert p["pos"] - p["neg"] == pytest.approx(1.0)  # the direction's length
    with pytest.raises(Exception, match="length 0"):
        vectors.project(own, spark.createDataFrame([([0.0, 0.0],)], "vector array<double>")).collect()
    x = spark.createDataFrame([([1.0, -2.0, 3.0],)], "v array<double>")
    enc = vectors.encode(x, "v", np.eye(3), np.zeros(3), np.zeros(3), 1.0, top=1).first()["features"]
    assert enc == [0.0, 0.0, 3.0]


def test_overlap_audit(spark):
    rows = [(0, "a", "", "Scenario: the man won money today at night"), (1, "b", "x", "Scenario: the man won money today at night"), (2, "c", "x", "the man won money today at night"), (3, "d", "", "something else entirely different from all")]
    df = spark.createDataFrame(rows, "o long, prompt_id string, pair_id string, prompt_text string")
    own = overlap.prepared(df, "o")
    got = sorted((r["candidate_ordinal"], r["reference_ordinal"], r["overlap_type"]) for r in overlap.internal(own).collect())
    assert got == [(0, 1, "exact_normalized"), (0, 2, "exact_normalized")]
    best = overlap.audit(own.where("ordinal = 2"), own.where("ordinal <> 2")).first()
    assert best["reference_ordinal"] == 0


def test_plans(spark):
    plan = {"name": "P", "models": [{"alias": "x", "model": "v/x"}], "cells": [{"cell_id": "c", "domains": ["a", "b"], "count_per_model": 5}]}
    jobs = generation.jobs(generation.cells(spark, plan))
    got = [(r["batch_id"][-8:], r["request_count"]) for r in generation.requests(jobs, 2).orderBy("place", "part").collect()]
    assert got == [("part_001", 2), ("part_002", 2), ("part_003", 1)] * 2
    assert tuple(generation.estimate(jobs, 2).first()) == (2, 10, 6)
    first = jobs.orderBy("place").first()["batch_id"]
    ids = spark.createDataFrame([(f"{first}__variant_{i}",) for i in range(3)], "prompt_id string")
    assert sorted(r["remaining"] for r in generation.remaining(jobs, ids).collect()) == [2, 5]
    with pytest.raises(ValueError, match="models and cells"):
        generation.cells(spark, {"models": []})
    assert generation.jobs(generation.cells(spark, generation.one_per_cell(plan))).count() == 1
    config = {"template": "<{scenario}>", "emotions": [{"emotion": "joy", "cluster": "up", "expected_behavior_effect": "more", "variants": [{"positive_prompt": "p", "control_prompt": "c"}]}]}
    assert sorted((r["prompt_id"], r["prompt_text"]) for r in generation.emotion_prompts(spark, config).collect()) == [("joy__01__control", "<c>"), ("joy__01__positive", "<p>")]


def test_csv_round_trip_and_discovery(spark, tmp_path):
    rows = [trial(response_text='two\nlines, "quoted"', valid="True"), trial(run_number="2")]
    frame(spark, rows).select(*trials.FIELDS).coalesce(1).write.options(header=True, quote='"', escape='"').csv(str(tmp_path / "t"))
    part = next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".csv")
    (tmp_path / "blocks").mkdir()
    part.rename(tmp_path / "blocks" / "block__b.csv")
    (tmp_path / "blocks" / "block__a.csv").write_text("condition,run_number\nonly,9\n")
    (tmp_path / "blocks" / "other.csv").write_text("condition\nno\n")
    got = tables.blocks(spark, str(tmp_path / "blocks")).orderBy("_file", "_row").collect()
    assert [(r["condition"], r["run_number"], r["response_text"]) for r in got] == [("only", "9", ""), ("paper_even", "1", 'two\nlines, "quoted"'), ("paper_even", "2", "")]
    seen = []
    q = live.start(live.counts(live.block_stream(spark, str(tmp_path / "blocks"))), lambda df, i: seen.append(df.count()), str(tmp_path / "ck"), once=True)
    q.awaitTermination()
    assert seen


def test_conditions_and_prompts(spark, tmp_path):
    (tmp_path / "c.csv").write_text("condition,outcome_type,amount\ne,Paper,0\n")
    assert [tuple(r) for r in tables.conditions(spark, str(tmp_path / "c.csv")).collect()] == [("e", "paper", 0)]
    (tmp_path / "bad.csv").write_text("condition,outcome_type,amount\ne,paper,many\n")
    with pytest.raises(ValueError, match="bad condition 'e'"):
        tables.conditions(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "p.csv").write_text("prompt_id,prompt_text,domain\n,hello,x\nid7,there,y\n")
    got = tables.prompts(spark, str(tmp_path / "p.csv")).orderBy("_row").collect()
    assert [(r["prompt_id"], r["metadata"]["domain"]) for r in got] == [("prompt_00000", "x"), ("id7", "y")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x y", True), ("z", False), ("z", None)], "g string, ok boolean")
    m = sinks.write_split(df, str(tmp_path / "s"), ["g"])
    assert sorted((r["file"], r["n_rows"]) for r in m.collect()) == [("g-x-y.csv", 1), ("g-z.csv", 2)]
    sinks.write_csv(df, str(tmp_path / "c"), single=True)
    back = tables.csv(spark, str(tmp_path / "c"))
    assert sorted(r["ok"] for r in back.collect()) == ["", "False", "True"]
    sinks.replace_csv(back.select("g", "ok").where("ok = 'True'"), str(tmp_path / "c"))
    assert tables.csv(spark, str(tmp_path / "c")).count() == 1 and (tmp_path / "c.bak").exists()


def test_exact_quantiles(spark):
    rows = [("a", float(v * v % 7)) for v in range(11)] + [(None, 3.0), (None, 5.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["low"], r["mid"]) for r in robust.exact_quantiles(df, ["g"], "x", {"low": 0.1, "mid": 0.5}).collect()}
    want = {r["g"]: (r["low"], r["mid"]) for r in df.where("x is not null").groupBy("g").agg(F.percentile("x", F.lit(0.1)).alias("low"), F.percentile("x", F.lit(0.5)).alias("mid")).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    assert {r["g"]: (r["n"], r["p50"]) for r in robust.quantiles(df, ["g"], "x").collect()} == {"a": (11, want["a"][1]), None: (2, 4.0), "c": (0, None)}


def test_matched_deltas_against_medians(spark):
    rows = [(k, s, True, float(k * s % 5)) for k in range(9) for s in (0, 1, 2)]
    df = spark.createDataFrame(rows, "k long, s int, valid boolean, v double")
    got = sorted(tuple(r) for r in pairs.matched_deltas(df, "k", "s", 0, ["v"]).collect())
    want = [(s, 9, float(np.mean(d)), float(np.median(d))) for s in (1, 2) if (d := [k * s % 5 for k in range(9)])]
    assert [(a, b) for a, b, *_ in got] == [(a, b) for a, b, *_ in want] and np.allclose([r[2:] for r in got], [r[2:] for r in want])
