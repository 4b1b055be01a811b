from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import checks
from ledgerloom.operators import vectors as ops
from ledgerloom.sources import activations

ROWS = "layer int, position int, prompt_id string, activation_site string, token_mode string, token_ids array<long>, token_positions array<int>, token_regions array<string>, metadata map<string,string>, vectors array<array<float>>"
REGIONS = ("scenario", "question", "answer")


def value(layer: int, position: int, token: int) -> list[float]:
    return [float(1000 * layer + 10 * position + token), float(position), 0.5, -float(token)]


def run_rows(layers=(1, 2), prompts=7):
    return [
        (layer, p, f"p{p}", "resid_post", "all", [100 + t for t in range(1 + p % 3)], list(range(1 + p % 3)), list(REGIONS[: 1 + p % 3]), {"family": f" f{p % 2} "}, [value(layer, p, t) for t in range(1 + p % 3)])
        for layer in layers for p in range(prompts)
    ]


@pytest.fixture
def run(spark, tmp_path):
    path = str(tmp_path / "run")
    activations.write_run(spark.createDataFrame(run_rows(), ROWS), path, 3, manifest={"extraction": {"token_mode": "all", "activation_site": "resid_post"}})
    return path


def found(df):
    return sorted((r["layer"], r["prompt_id"], r["token_index"], r["token_region"], tuple(r["vector"])) for r in df.collect())


def expected(layers=(1, 2), regions=REGIONS, family=(0, 1)):
    return sorted((layer, f"p{p}", t, REGIONS[t], tuple(value(layer, p, t))) for layer in layers for p in range(7) if p % 2 in family for t in range(1 + p % 3) if REGIONS[t] in regions)


def test_layers_with_equal_file_names(spark, run):
    names = {s["tensor_file"] for s in activations.load_manifest(run)["shards"]}
    assert {"activations/layer_01/batch_000000.npy", "activations/layer_02/batch_000000.npy"} <= names
    assert found(activations.vectors(spark, run)) == expected()
    assert found(activations.vectors(spark, run, layers=[2], regions=["scenario", "answer"])) == expected((2,), ("scenario", "answer"))
    assert found(activations.vectors(spark, run, metadata={"family": ["f1"]})) == expected(family=(1,))
    assert not found(activations.vectors(spark, run, metadata={"family": ["f1"], "other": ["x"]})) and found(activations.vectors(spark, run, metadata={"other": [""]})) == expected()
    first = activations.vectors(spark, run, max_vectors=4).collect()
    assert [(r["shard"], r["batch_row"], r["token_index"]) for r in sorted(first, key=lambda r: (r["shard"], r["batch_row"], r["token_index"]))] == [(0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 2, 0)]
    with pytest.raises(ValueError, match="no shards of layers"):
        activations.vectors(spark, run, layers=[9])


def test_unread_layers_are_not_opened(spark, run, tmp_path):
    for f in (tmp_path / "run/activations/layer_01").iterdir():
        f.write_bytes(b"broken")
    assert found(activations.vectors(spark, run, layers=[2])) == expected((2,))
    activations.register(spark)
    source = spark.read.format("activation_run").load(run)
    assert found(source.where("layer = 2 and token_region in ('question') and prompt_id = 'p5'")) == [(2, "p5", 1, "question", tuple(value(2, 5, 1)))]


def test_missing_site_regions_and_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(activations, "BATCH_BYTES", 1)
    np.save(tmp_path / "t.npy", np.arange(24, dtype=np.float16).reshape(1, 3, 8))
    (tmp_path / "i.jsonl").write_text(json.dumps({"prompt_id": "x", "token_ids": [1, 2]}) + "\n\n")
    (tmp_path / "manifest.json").write_text(json.dumps({"shards": [{"layer": 12, "tensor_file": "t.npy", "index_file": "i.jsonl", "shape": [1, 3, 8]}]}))
    got = activations.vectors(spark, str(tmp_path)).collect()
    assert [(r["token_region"], r["activation_site"], r["token_position"]) for r in got] == [("unknown", None, None)] * 2
    mean = ops.mean_vector(activations.vectors(spark, str(tmp_path)), ["prompt_id"], "vector").first()
    assert mean["vector"] == [float(v) for v in range(4, 12)] and mean["n"] == 2
    (tmp_path / "i.jsonl").write_text(json.dumps({"token_ids": [1, 2], "num_tokens": 9}))
    with pytest.raises(Exception, match="row 1 has 9 tokens"):
        activations.vectors(spark, str(tmp_path)).collect()


def test_half_precision_and_regions(spark, tmp_path):
    path = str(tmp_path / "half")
    activations.write_run(spark.createDataFrame(run_rows((3,)), ROWS), path, 2, dtype="float16", regions=["answer"])
    got = found(activations.vectors(spark, path))
    assert [(p, r) for _, p, _, r, _ in got] == [("p2", "answer"), ("p5", "answer")] and np.allclose(got[1][4], value(3, 5, 2), rtol=1e-3)
    assert activations.load_manifest(path)["shards"][0]["dtype"] == "float16"
    with pytest.raises(ValueError, match="has a manifest"):
        activations.write_run(spark.createDataFrame(run_rows((3,)), ROWS), path, 2)


def test_failed_write_leaves_no_run(spark, tmp_path):
    path = str(tmp_path / "failed")
    rows = spark.createDataFrame(run_rows(), ROWS)
    broken = rows.withColumn("prompt_id", F.when(F.col("prompt_id") == "p6", F.raise_error(F.lit("planted")).cast("string")).otherwise(F.col("prompt_id")))
    with pytest.raises(Exception, match="planted"):
        activations.write_run(broken, path, 3)
    assert not (tmp_path / "failed/manifest.json").exists()


def prompts(spark, n=7):
    return spark.createDataFrame([(f"p{i}",) for i in range(n)], "prompt_id string")


def test_a_right_run_has_no_violations(spark, run):
    assert spark.read.json(f"{run}/prompts.jsonl").count() == 7
    assert not activations.validate(spark, run, prompts(spark)).collect()


def test_each_kind_of_violation(spark, run, tmp_path):
    folder = tmp_path / "run"
    m = activations.load_manifest(run)
    m["stats"] |= {"total_prompts": 8, "total_shards": 5}
    m["extraction"]["layers"] = [1]
    names = [(s["tensor_file"], s["index_file"]) for s in m["shards"]]  # by batch, then layer
    (folder / names[0][0]).unlink()
    (folder / names[1][1]).unlink()
    (folder / names[2][0]).write_bytes(b"no array")
    np.save(folder / names[3][0], np.zeros((2, 3, 5), np.float16))
    lines = [json.loads(x) for x in (folder / names[4][1]).read_text().splitlines()]
    wrong = lines[0]
    wrong |= {"token_mode": None, "activation_site": "mlp", "token_positions": [0] * 9, "token_regions": ["a"], "token_ids": [1, 2, 3, 4], "num_tokens": 2}
    (folder / names[4][1]).write_text("\n".join(map(json.dumps, [wrong])) + "\n")
    (folder / "manifest.json").write_text(json.dumps(m))
    got = {r["kind"]: (r["n"], r["places"]) for r in activations.validate(spark, run, prompts(spark)).collect()}
    tensors = [t for t, _ in names]
    assert got == {
        "total_prompts": (1, ["manifest.json"]), "total_shards": (1, ["manifest.json"]), "layers_outside_extraction": (1, ["manifest.json"]),
        "missing_tensor": (1, [tensors[0]]), "missing_index": (1, [tensors[1]]), "unreadable_tensor": (1, [tensors[2]]),
        "shape": (1, [tensors[3]]), "dtype_of_shard": (1, [tensors[3]]), "dtype_of_run": (1, [tensors[3]]), "hidden_size": (1, [tensors[3]]), "index_rows": (1, [tensors[3]]),
        **{k: (1, [f"{names[4][1]}:000001"]) for k in ("token_mode", "activation_site", "token_positions", "token_regions", "num_tokens", "tokens_beyond_tensor")},
    } and len(got) == 17


def test_sample_of_places_is_bounded(spark):
    df = spark.range(1000)
    got = checks.counted(checks.violations(df, {"even": F.col("id") % 2 == 0, "never": F.col("id") < 0}, F.format_string("%04d", "id")), 3).collect()
    assert [tuple(r) for r in got] == [("even", 500, ["0000", "0002", "0004"])]


def test_single_arrays(spark, tmp_path):
    activations.write_arrays(str(tmp_path / "d.npy"), array=np.array([3.0, 4.0]))
    activations.write_arrays(str(tmp_path / "s.npz"), mean=np.array([1, 2], np.float16), scale=np.float64(2))
    assert activations.direction(spark, str(tmp_path / "d.npy")) == [0.6, 0.8] and activations.direction(spark, str(tmp_path / "d.npy"), False) == [3.0, 4.0]
    assert {(r["name"], tuple(r["shape"]), tuple(r["values"])) for r in activations.arrays(spark, str(tmp_path / "s.npz")).collect()} == {("mean", (2,), (1.0, 2.0)), ("scale", (), (2.0,))}
    activations.write_arrays(str(tmp_path / "z.npy"), array=np.zeros(3))
    activations.write_arrays(str(tmp_path / "m.npy"), array=np.zeros((2, 2)))
    for name, words in (("z", "zeros"), ("m", "2 dimensions")):
        with pytest.raises(ValueError, match=words):
            activations.direction(spark, str(tmp_path / f"{name}.npy"))
