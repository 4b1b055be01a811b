from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import coerce
from ledgerloom.operators import orders, ranks
from ledgerloom.operators.trials import FIELDS
from ledgerloom.plans import generation
from ledgerloom.sources import commits, sinks, tables
from ledgerloom.streaming import progress


def test_seeded_order_is_a_bijection_for_any_partitioning(spark):
    for n in (0, 1, 2, 3, 10, 97, 1000):
        one, two = ({r["id"]: r["place"] for r in orders.shuffled(spark.range(0, n, 1, k), "id", 3).collect()} for k in (1, 7))
        assert one == two and sorted(one.values()) == list(range(n))
    other = {r["id"]: r["place"] for r in orders.shuffled(spark.range(1000), "id", 4).collect()}
    assert other != one and sum(one[i] == i for i in one) < 20
    # a resumed plan takes the same places: they depend on the seed, the size and the number only
    assert {r["id"]: r["p"] for r in spark.range(500, 1000).select("id", orders.place(F.col("id"), 1000, 3).alias("p")).collect()} == {i: one[i] for i in range(500, 1000)}


def test_block_order(spark):
    rows = [(0, "b", "/x/2.csv"), (1, "a", "/x/9.csv"), (2, "a", "/x/1.csv"), (3, "c", "/x/2.csv")]
    got = orders.block_order(spark.createDataFrame(rows, "i int, model string, path string"), "path", ["model"], "i").collect()
    assert [r["i"] for r in got] == [2, 1, 0]


PLAN = {
    "name": "Big plan", "default_count_per_cell_per_model": 2, "models": [{"alias": "s", "model": "v/s"}, {"alias": "l", "model": "v/l"}],
    "cells": [{"cell_id": "c1", "domains": ["x", "y"], "splits": ["t", "v", "w"], "emotions": ["joy"]}, {"cell_id": "c2", "domain": "z", "contrast_roles": ["positive", "control"], "count_per_model": 7}],
}


def test_plan_documents_and_first_jobs(spark):
    docs = spark.createDataFrame([(json.dumps(PLAN),)], "content string")
    one, two = generation.cells(spark, PLAN), generation.cells_of(docs)
    assert one.columns == two.columns and sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)
    every = generation.jobs(one).orderBy("place").collect()
    for k in (0, 1, 5, 7, 9, 16, 100):
        assert [(r["batch_id"], tuple(r["place"])) for r in generation.first_jobs(two, k).orderBy("place").collect()] == [(r["batch_id"], tuple(r["place"])) for r in every[:k]]
    axes = {many: [f"v{i}" for i in range(50)] for many, *_ in generation.AXES}
    huge = generation.cells(spark, {"models": PLAN["models"], "cells": [axes]})  # 50 ** 9 jobs a model
    assert generation.first_jobs(huge, 3).count() == 3
    for bad in ("{}", '{"models": [], "cells": [{}]}', "no json"):
        with pytest.raises(Exception, match="a plan has models and cells"):
            generation.cells_of(spark.createDataFrame([(bad,)], "content string")).collect()


def test_documents_of_plans_are_parsed_once(spark):
    values = ["Real  Estate", "a_b", "a__b", "ok", "ok\n", " \t", "-", "", "\u00c9t\u00e9"]
    docs = spark.createDataFrame([(json.dumps({"name": "P", "models": [{"alias": "s", "model": "m"}], "cells": [{"domains": values, "splits": ["t"]}, {"domains": []}]}),)], "content string")
    got = generation.jobs(generation.cells_of(docs))
    rest = "none__neutral__none__none__none__positive"
    parts = ["real_estate", "a_b", "a_b", "ok", "ok", "none", "none", None, "t"]
    assert [r["batch_id"] for r in got.orderBy("place").collect()] == ["__".join(x for x in ("p__s__t", p, rest) if x) for p in parts]
    # filters that Spark derived from the lists parsed every document again, for each list
    plan = generation.requests(got, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(name") == 1 and not [x for x in plan.splitlines() if "Filter" in x and "from_json" in x]


def response(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def test_contents_of_responses(spark):
    rows = [response("hi"), response([{"type": "text", "text": "a"}, {"type": "image"}, {"text": "b"}]), response(None), json.dumps({"choices": []}), "no json", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").select("i", generation.answer_content(F.col("r")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == ["hi", "ab", None, None, None, None]


def test_answers_and_their_reasons(spark):
    rows = [
        json.dumps({"prompts": [{"variant_id": "v", "prompt_text": " x ", "notes": "n"}, {"prompt_text": "y"}]}), 'Sure.\n```json\n{"prompts": [{"prompt_text": "z"}]}\n```', None, "sorry", '{"prompts": {}}',
        '{"prompts": ["text"]}', '{"prompts": [{"prompt_text": "fine"}, {"prompt_text": " "}]}', '{"prompts": []}', '{"prompts": [{"prompt_text": 7}]}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, content string")
    got = sorted(map(tuple, generation.decode_answers(df).drop("content").collect()), key=repr)
    nothing = (None, None, None, None)
    assert got == sorted([
        (0, 1, "v", "x", "n", None), (0, 2, "variant_002", "y", "", None), (1, 1, "variant_001", "z", "", None), (2, *nothing, "no_content"), (3, *nothing, "no_json"), (4, *nothing, "no_list"),
        (5, *nothing, "no_object"), (6, *nothing, "empty_text"), (8, 1, "variant_001", "7", "", None),
    ], key=repr)
    pairs = json.dumps({"pairs": [{"paper_open_prompt_text": "o", "realized_closed_prompt_text": "c"}]})
    assert generation.decode_answers(spark.createDataFrame([(pairs,)], "content string"), form="pairs").first()["pair_id"] == "pair_001"


def blocks(spark, rows):
    fields = ", ".join(f"{c} string" for c in FIELDS)
    full = [tuple({"model": m, "temperature": "1", "prompt_version": "v", "condition": c, "run_number": str(n), "response_text": t}.get(f, "") for f in FIELDS) + (1, i) for i, (m, c, n, t) in enumerate(rows)]
    return spark.createDataFrame(full, f"{fields}, _file int, _row long")


def seen(df):
    return sorted((r["trial_id"], r["model"], r["condition"], r["response_text"]) for r in df.collect())


def test_tables_change_in_one_commit(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert commits.reconcile(blocks(spark, []), folder) == (0, 0) and commits.current(spark, folder, "merged") is None
    assert commits.reconcile(blocks(spark, [("m", "c", 1, "old"), ("k", "c", 1, "kept")]), folder) == (1, 2)
    assert commits.reconcile(blocks(spark, [("m", "c", 1, "new"), ("m", "c", 2, "more")]), folder) == (1, 3)
    want = [("1", "k", "c", "kept"), ("2", "m", "c", "new"), ("3", "m", "c", "more")]
    assert seen(commits.current(spark, folder, "merged")) == want == seen(commits.current(spark, folder, "grouped"))
    assert seen(commits.current(spark, folder, "merged", 1)) == [("1", "k", "c", "kept"), ("2", "m", "c", "old")]
    assert commits.reconcile(blocks(spark, []), folder) == (0, 0) and seen(commits.current(spark, folder, "merged")) == want


def test_a_table_is_made_from_one_of_its_version(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame(spark.sparkContext.parallelize(range(50), 2).map(lambda i: (runs.add(1), (i % 7, i))[1]), "k int, v int")
    commits.publish(spark, str(tmp_path), {"a": rows, "b": lambda done: done["a"].repartitionByRange("k").sortWithinPartitions("k")})
    assert runs.value == 50 and sorted(commits.current(spark, str(tmp_path), "b").collect()) == sorted(commits.current(spark, str(tmp_path), "a").collect())


def test_numbers_need_no_window_over_the_rows(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v"))
    got = ranks.numbered(df, [F.col("v").desc()], "n", 5)
    assert {r["v"]: r["n"] for r in got.collect()} == {v: 999 - v + 5 for v in range(1000)}
    assert "windowspecdefinition(_p" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert ranks.numbered(df.where("v < 0"), [F.col("v")], "n").count() == 0


def test_short_temperatures(spark):
    texts = ["0", "00", "0.0", "0.", "1", "1.", "1.0", "1.50", "10", "100.00", "1234567", "12345670", "12345678.5", "0.7", ".7", "0.0001", "0.00010", "0.00012", "0.00001", "1234567.1234", "1234567.12345", "999999999999.5", "-0", "-1.0", "+1", "1e3", " 0.70 ", "1\n", "07", "x", ""]

    def want(t):
        try:
            return f"{float(t):.12g}"
        except ValueError:
            return ""

    got = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", coerce.temperature_key("t").alias("k")).collect()}
    assert got == {t: want(t) for t in texts}


@pytest.mark.parametrize("step", ["second table", "before the commit"])
def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path / "out")
    small = spark.range(3)
    commits.publish(spark, folder, {"a": small, "b": small})
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("planted")).cast("long")).otherwise(F.col("id")).alias("id"))

    def stop(*_):
        raise RuntimeError("planted")

    if step == "before the commit":
        monkeypatch.setattr(commits, "_put", stop)
    with pytest.raises(Exception, match="planted"):
        commits.publish(spark, folder, {"a": spark.range(9), "b": broken if step == "second table" else small})
    assert commits.current(spark, folder, "a").count() == 3 == commits.current(spark, folder, "b").count()
    monkeypatch.undo()
    for n in (4, 5, 6):
        commits.publish(spark, folder, {"a": spark.range(n)})
    assert commits.current(spark, folder, "a").count() == 6 and commits.current(spark, folder, "a", 1).count() == 5 and commits.current(spark, folder, "a", 2) is None


def test_two_writers_of_one_number(spark, tmp_path):
    commits.publish(spark, str(tmp_path), {"a": spark.range(1)})
    with pytest.raises(RuntimeError, match="another writer"):
        commits._put(spark, str(tmp_path), 1, "{}")


def test_runs_are_bitmaps(spark):
    changed = datetime.datetime(2026, 1, 1)
    rows = [("m", "1.0", "v", "c", n, changed) for n in ("1", "1", "32768", "32769", "100000", "0", "x")] + [("m", "1", "v", "d", "1", changed + datetime.timedelta(minutes=5)), ("k", "1", "v", "c", "2", changed)]
    counted = progress.counts(spark.createDataFrame(rows, "model string, temperature string, prompt_version string, condition string, run_number string, _changed timestamp"))
    assert counted.where("model = 'm' and condition = 'c'").count() == 4 and {len(r["runs"]) for r in counted.collect()} == {4096}
    got = sorted(tuple(r) for r in progress.totals(counted, 60, F.lit(changed + datetime.timedelta(minutes=5, seconds=30)).cast("timestamp")).collect())
    assert got == [("k", "1", "v", "c", 1, 1, False), ("m", "1", "v", "c", 7, 4, True), ("m", "1", "v", "d", 1, 1, True)]


def test_large_blocks_have_several_files(spark, tmp_path):
    few = blocks(spark, [("k", "c", 1, "x"), ("k", "c", 2, "y")]).unionByName(blocks(spark, [("k", "c", 3, "z")]).withColumn("temperature", F.lit("1.0"))).drop("_file", "_row")
    one = spark.range(0, 4000, 1, 3).select(*[F.col("id").cast("string").alias(f) if f in ("run_number", "response_text") else F.lit({"model": "m", "temperature": "1", "prompt_version": "v", "condition": "c"}.get(f, "")).alias(f) for f in FIELDS])
    sinks.write_blocks(one.unionByName(few), str(tmp_path / "b"), 200_000)
    found = {p.name: sum(1 for _ in p.open()) - 1 for p in (tmp_path / "b").glob("block__*.csv")}
    large = [n for name, n in found.items() if "model-m" in name]
    assert [n for name, n in found.items() if "model-k" in name] == [3]
    assert sum(large) == 4000 and len(large) == 7 and max(large) < 800
    own = tables.blocks(spark, str(tmp_path / "b"))
    assert own.where("model = 'm'").select("run_number", "response_text").distinct().count() == 4000
    # a block is replaced with all of its files
    sinks.write_blocks(one.limit(5), str(tmp_path / "x"))
    got = tables.overlay(*[tables.csv(spark, str(tmp_path / x), glob="block__*.csv") for x in "bx"])
    assert sorted((r["model"], r["count"]) for r in got.groupBy("model").count().collect()) == [("k", 3), ("m", 5)]
    sinks.write_blocks(one.where("model = ''"), str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("block__*"))
