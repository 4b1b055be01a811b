"""JSON lines by number, prompt texts of several runs, merged prompt tables, subsets of matched deltas, replicates of the bootstrap by hand."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import pairs, predicates, robust
from ledgerloom.sources import tables


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_line_numbers_over_blocks_of_files(spark, tmp_path, small_blocks):
    rng, want = random.Random(5), {}
    for f, n in (("a.jsonl", 400), ("b.jsonl", 3), ("c.jsonl", 150), ("empty.jsonl", 0)):
        lines = [rng.choice(["", "  ", "x" * rng.randint(1, 40)]) for _ in range(n)]
        (tmp_path / f).write_text("".join(f"{x}\n" for x in lines))
        want[f] = lines
    df = tables.numbered_lines(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 1
    got = {}
    for r in df.collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["line"]] = r["value"]
    assert got == {f: dict(enumerate(lines, 1)) for f, lines in want.items() if lines}


def test_faults_are_named_by_file_and_line(spark, tmp_path, small_blocks):
    good = [json.dumps({"k": i, "text": "é" * (i % 9)}) for i in range(200)]
    (tmp_path / "a.jsonl").write_text("\r\n".join([*good, "", "[1]", *good, '{"k": ', "7", "null", "\t"]))
    (tmp_path / "b.jsonl").write_text("\n".join(["", *good]))
    got = [(r["path"].rsplit("/", 1)[1], r["line"], r["fault"]) for r in tables.json_faults(spark, str(tmp_path)).orderBy("path", "line").collect()]
    assert got == [("a.jsonl", 202, "not_an_object"), ("a.jsonl", 403, "not_json"), ("a.jsonl", 404, "not_an_object"), ("a.jsonl", 405, "not_an_object")]
    with pytest.raises(ValueError, match=r"a\.jsonl:202: not an object"):
        tables.json_lines(spark, str(tmp_path), "k int", strict=True)
    assert tables.json_lines(spark, str(tmp_path / "b.jsonl"), "k int, text string", strict=True).count() == 200


def test_texts_of_runs(spark, tmp_path):
    runs = {"one": [{"prompt_id": "a", "prompt_text": "1"}, {"prompt_id": "a", "prompt_text": "2"}, {"prompt_id": "b", "prompt_text": None}, {"prompt_id": 7, "prompt_text": "n"}], "three": [{"prompt_id": "b"}, {"prompt_id": ""}, {"prompt_id": None}, {"prompt_id": "c", "prompt_text": "x\ny"}]}
    for name, rows in runs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "prompts.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    paths = [str(tmp_path / n) for n in ("one", "two", "three")]
    assert dict(map(tuple, tables.prompt_texts(spark, paths).collect())) == {"a": "2", "b": "", "7": "n", "c": "x\ny"}
    assert tables.prompt_texts(spark, paths[1:2]).collect() == [] == tables.prompt_texts(spark, []).collect()
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "prompts.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        tables.prompt_texts(spark, paths).collect()


def test_merged_prompt_tables(spark):
    a = spark.createDataFrame([("p1", "x", "s"), ("", "gone", "s"), ("", "gone too", "s")], "prompt_id string, prompt_text string, split string")
    b = spark.createDataFrame([("y", "p2")], "prompt_text string, prompt_id string")
    assert sorted(map(tuple, tables.merged_prompts([a, b]).collect())) == [("p1", "x", "s"), ("p2", "y", "")]
    with pytest.raises(ValueError, match="repeated prompt_id: p1, p2$"):
        tables.merged_prompts([a, b, b, a])
    with pytest.raises(ValueError, match="missing columns: prompt_text"):
        tables.merged_prompts([a, b.drop("prompt_text")])


def test_subsets_of_matched_deltas(spark):
    rows = [("k", 0.0, 1.0, True, True), ("k", 1.0, 4.0, True, False), ("m", 0.0, 2.0, True, True), ("m", 1.0, 3.0, True, True), ("m", 2.0, 9.0, False, True), ("n", 1.0, 5.0, True, True)]
    df = spark.createDataFrame(rows, "key string, scale double, v double, valid boolean, strict boolean")
    got = {(r["scale"], r["subset"]): tuple(r)[2:] for r in pairs.matched_delta_subsets(df, "key", "scale", 0.0, ["v"], {"all": "valid", "strict": "strict"}).collect()}
    assert got[1.0, "all"] == (2, 2.0, 2.0) and got[1.0, "strict"] == (1, 1.0, 1.0) and got[2.0, "strict"] == (1, 7.0, 7.0)
    n, *rest = got[2.0, "all"]
    assert len(got) == 4 and n == 0 and all(math.isnan(x) for x in rest)


def test_percent(spark):
    assert [r[0] for r in spark.createDataFrame([(0.25,), (None,)], "r double").select(predicates.percent("r")).collect()] == [25.0, None]


def test_replicates_of_the_bootstrap_by_hand(spark):
    """The same weights in plain Python: a row's hash, mixed with the replicate's number, read off the Poisson distribution."""
    mask, replicates = (1 << 64) - 1, 60

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def weight(x):
        u, k, term = (x >> 11) / 2.0**53, 0, math.exp(-1)
        total = term
        while u > total and k < 19:
            k += 1
            term /= k
            total += term
        return k

    rows = [("a" if i % 3 else "b", i, float(i * i % 23)) for i in range(400)] + [("a", 999, None)]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    hashes = {r["i"]: r["h"] & mask for r in df.select("i", F.xxhash64("i", F.lit(7)).alias("h")).collect()}
    for r in robust.bootstrap_parallel(df, ["g"], "x", "i", replicates).collect():
        means = []
        for k in range(1, replicates + 1):
            own = [(weight(mixed((hashes[i] + k * 0x9E3779B97F4A7C15) & mask)), x) for g, i, x in rows if g == r["g"] and x is not None]
            means.append(sum(w * x for w, x in own) / sum(w for w, _ in own))
        means.sort()

        def at(q, means=means):
            place = q * (len(means) - 1)
            low = math.floor(place)
            return means[low] + (place - low) * (means[min(low + 1, len(means) - 1)] - means[low])

        assert tuple(r)[1:] == pytest.approx([at(0.025), at(0.5), at(0.975)])
