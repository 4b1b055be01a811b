from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from ledgerloom.llm import decontam, neardup, packing, queries

from .helpers import SMALL

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def shown(frame):
    fine = lambda v: None if v is None or v is pd.NA or v != v else round(v, 4) if isinstance(v, float) else v
    return sorted((tuple(fine(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    assert shown(queries.queries()[name](spark, str(SMALL)).toPandas()) == shown(duck.execute(queries.oracle_sql()[name]).df())


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    matcher = decontam.Matcher(bench)
    before = {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(SMALL)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert out.columns == docs.columns
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "language_id":
            assert gone == {i for i, r in before.items() if not any(c.isalpha() for c in r["text"] or "")}
        if name == "line_dedup":
            assert not gone and all(set(r["text"].split("\n")) <= set(before[i]["text"].split("\n")) for i, r in after.items())
        if name == "near_dedup":
            sets = {i: neardup.shingles(r["text"]) for i, r in before.items()}
            near = lambda i, j: before[i]["text"] == before[j]["text"] or neardup.similarity(sets[i], sets[j]) >= 0.8
            kept = sorted(after)
            assert not any(near(i, j) for i in kept for j in kept if i < j)
            assert all(any(near(i, j) for j in before if j != i) for i in gone)
        if name == "decontaminate":
            assert gone == {i for i, r in before.items() if matcher.scan(r["text"])[1]}
        docs, before = out, after
    name, stage = corpus_pipeline.STAGES[-1]
    got = stage(spark, docs, str(SMALL)).toPandas()
    assert set(got["doc_id"]) == set(before) and got.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, str(SMALL)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None
