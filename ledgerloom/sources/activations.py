"""Activation runs: a folder of tensors by layer and batch, an index line for each of their rows, and a manifest.

``activation_run`` is a Spark data source for them. Read, a shard is a partition; filters on layer, prompt, site, mode and region
reach the source, so shards of other layers are not opened and only the bytes of wanted tokens are read. Written,
every task writes whole shards, and the manifest comes last, on commit, so a run that failed is no run. Files are
opened by Arrow's file systems (local paths, hdfs, s3, gs and others), a tensor never as a whole.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..operators.checks import counted, violations

MANIFEST = "manifest.json"
SCHEMA = (
    "shard int, layer int, tensor_file string, index_file string, batch_row int, token_index int, prompt_id string, activation_site string, token_mode string, "
    "token_id long, token_position int, token_region string, prompt_metadata map<string,string>, vector array<float>"
)
#: Columns whose filters the source takes.
PUSHED = ("layer", "prompt_id", "activation_site", "token_mode", "token_region")
#: Bytes of vectors in a batch that a task gives to Spark, about.
BATCH_BYTES = 1 << 24
UNKNOWN = "unknown"
STORED = ("float16", "float32")


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    fs, root = pafs.FileSystem.from_uri(path)
    return fs, root.rstrip("/")


def _exists(fs: pafs.FileSystem, root: str, name: str) -> bool:
    return fs.get_file_info(f"{root}/{name}").type == pafs.FileType.File


def load_manifest(run: str) -> dict:
    fs, root = located(run)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def shard_list(manifest: dict) -> list[dict]:
    """The shards of a manifest. A missing key, or a shape without three dimensions, raises."""
    out = []
    for k, s in enumerate(manifest.get("shards", [])):
        if missing := [key for key in ("layer", "tensor_file", "index_file", "shape") if key not in s]:
            raise ValueError(f"a shard lacks {missing[0]}")
        if len(s["shape"]) != 3:
            raise ValueError(f"shape {s['shape']} has not three dimensions")
        out.append({"shard": k, "layer": int(s["layer"]), "tensor_file": str(s["tensor_file"]), "index_file": str(s["index_file"]), "shape": [int(x) for x in s["shape"]], "dtype": s.get("dtype")})
    return out


def shards(spark: SparkSession, run: str) -> DataFrame:
    """(shard, layer, tensor_file, index_file, shape, dtype) of a run's manifest, in its order."""
    rows = [tuple(s.values()) for s in shard_list(load_manifest(run))]
    return spark.createDataFrame(rows, "shard int, layer int, tensor_file string, index_file string, shape array<int>, dtype string")


def header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, place of the first element) of an open ``.npy`` file in row order; reads no more than its header."""
    version = np.lib.format.read_magic(f)
    shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if by_columns and len(shape) > 1:
        raise ValueError("the array is in column order")
    return shape, dtype, f.tell()


def _lines(fs: pafs.FileSystem, path: str) -> Iterator[dict]:
    with fs.open_input_stream(path) as f:
        for line in io.TextIOWrapper(f, "utf-8"):
            if line.strip():
                yield json.loads(line)


@dataclass
class Shard(InputPartition):
    shard: int
    layer: int
    tensor_file: str
    index_file: str


class RunReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.run = options["path"]
        self.site = options.get("site")
        self.metadata = {k: set(v) for k, v in json.loads(options.get("metadata", "{}")).items()}
        self.most = int(options["max_vectors"]) if options.get("max_vectors") else None
        self.keep: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.keep[f.attribute[0]] = self.keep.get(f.attribute[0], values) & values
            else:
                yield f

    def _wanted(self, column: str, value: object) -> bool:
        return column not in self.keep or value in self.keep[column]

    def partitions(self) -> list[Shard]:
        found = [s for s in shard_list(load_manifest(self.run)) if self._wanted("layer", s["layer"])]
        return [Shard(s["shard"], s["layer"], s["tensor_file"], s["index_file"]) for s in found]

    def _tokens(self, part: Shard, rows: Iterable[dict], shape: tuple[int, ...]) -> Iterator[tuple]:
        """The wanted tokens of a shard, with the columns of ``SCHEMA`` but for the vector."""
        for at, row in enumerate(rows):
            if at >= shape[0]:
                raise ValueError(f"{part.index_file} has more rows than {part.tensor_file}: {shape[0]}")
            site, mode, own = row.get("activation_site"), row.get("token_mode"), row.get("metadata") or {}
            if self.site is not None and row.get("activation_site", self.site) != self.site:
                continue
            if any(str(own.get(k, "")).strip() not in values for k, values in self.metadata.items()):
                continue
            if not (self._wanted("prompt_id", row.get("prompt_id")) and self._wanted("activation_site", site) and self._wanted("token_mode", mode)):
                continue
            ids, places = row.get("token_ids") or [], row.get("token_positions") or []
            regions = row.get("token_regions") or [UNKNOWN] * len(ids)
            n = int(row.get("num_tokens", len(ids)))
            if n > shape[1] or len(regions) < n:
                raise ValueError(f"{part.index_file} row {at + 1} has {n} tokens, {len(regions)} regions and a tensor of {shape[1]}")
            meta = [(k, None if v is None else v if isinstance(v, str) else json.dumps(v)) for k, v in own.items()]
            for i in range(n):
                if self._wanted("token_region", str(regions[i])):
                    yield part.shard, part.layer, part.tensor_file, part.index_file, at, i, row.get("prompt_id"), site, mode, ids[i] if i < len(ids) else None, places[i] if i < len(places) else None, str(regions[i]), meta

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        fs, root = located(self.run)
        given = 0
        with fs.open_input_file(f"{root}/{partition.tensor_file}") as f:
            shape, dtype, start = header(f)
            if len(shape) != 3:
                raise ValueError(f"{partition.tensor_file} has not three dimensions")
            width = shape[2] * dtype.itemsize
            most = max(1, BATCH_BYTES // max(1, 4 * shape[2]))
            pending: list[tuple] = []
            for token in self._tokens(partition, _lines(fs, f"{root}/{partition.index_file}"), shape):
                if self.most is not None and given + len(pending) >= self.most:
                    break
                pending.append(token)
                if len(pending) >= most:
                    yield _batch(pending, _gathered(f, pending, shape, dtype, start, width))
                    given, pending = given + len(pending), []
            if pending:
                yield _batch(pending, _gathered(f, pending, shape, dtype, start, width))


def _gathered(f, tokens: list[tuple], shape: tuple[int, ...], dtype: np.dtype, start: int, width: int) -> np.ndarray:
    """The vectors of tokens in order; neighbours are read at once."""
    at = np.array([t[4] * shape[1] + t[5] for t in tokens], np.int64)
    out = np.empty((len(at), shape[2]), np.float32)
    edges = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        data = f.read_at((b - a) * width, start + int(at[a]) * width)
        if len(data) < (b - a) * width:
            raise ValueError("the tensor is shorter than its header says")
        out[a:b] = np.frombuffer(data, dtype).reshape(b - a, shape[2])
    return out


_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _batch(tokens: list[tuple], vectors: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(list(c), t) for c, t in zip(zip(*tokens, strict=True), _TYPES, strict=True)]
    places = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(places, pa.array(vectors.ravel()))], names=_NAMES)


@dataclass
class Written(WriterCommitMessage):
    shards: list[dict]


class RunWriter(DataSourceArrowWriter):
    """Rows (layer, batch, row, prompt_id, activation_site, token_mode, token_ids, token_positions, token_regions, metadata, vectors), sorted by the first three, a shard in one task."""

    def __init__(self, options: dict[str, str]):
        self.run = options["path"]
        self.dtype = options.get("storage_dtype", "float32")
        self.about = json.loads(options.get("manifest", "{}"))
        if self.dtype not in STORED:
            raise ValueError(f"storage_dtype is one of {', '.join(STORED)}")
        fs, root = located(self.run)
        if _exists(fs, root, MANIFEST):
            raise ValueError(f"{self.run} has a manifest")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = located(self.run)
        out: list[dict] = []
        key, rows = None, []
        for batch in iterator:
            for row in batch.to_pylist():
                if (row["layer"], row["batch"]) != key:
                    if rows:
                        out.append(self._shard(fs, root, rows))
                    key, rows = (row["layer"], row["batch"]), []
                rows.append(row)
        if rows:
            out.append(self._shard(fs, root, rows))
        return Written(out)

    def _shard(self, fs: pafs.FileSystem, root: str, rows: list[dict]) -> dict:
        layer, batch = rows[0]["layer"], rows[0]["batch"]
        longest = max(len(r["vectors"]) for r in rows)
        width = max((len(v) for r in rows for v in r["vectors"]), default=0)
        tensor = np.zeros((len(rows), longest, width), self.dtype)
        for k, r in enumerate(rows):
            if r["vectors"]:
                tensor[k, : len(r["vectors"])] = r["vectors"]
        keys = ("prompt_id", "activation_site", "token_mode", "token_ids", "token_positions", "token_regions")
        lines = [json.dumps({k: r[k] for k in keys} | {"num_tokens": len(r["vectors"]), "metadata": dict(r["metadata"] or [])}) + "\n" for r in rows]
        name = f"activations/layer_{layer:02d}/batch_{batch:06d}"
        data = io.BytesIO()
        np.lib.format.write_array(data, tensor, allow_pickle=False)
        fs.create_dir(f"{root}/activations/layer_{layer:02d}", recursive=True)
        for suffix, content in ((".npy", data.getvalue()), (".jsonl", "".join(lines).encode())):
            work = f"{root}/{name}{suffix}.{uuid.uuid4().hex}"  # another attempt of the task may write the same shard
            with fs.open_output_stream(work) as f:
                f.write(content)
            fs.move(work, f"{root}/{name}{suffix}")
        return {"layer": layer, "batch": batch, "tensor_file": f"{name}.npy", "index_file": f"{name}.jsonl", "shape": list(tensor.shape), "dtype": self.dtype}

    def commit(self, messages: list[Written | None]) -> None:
        found = sorted((s for m in messages if m for s in m.shards), key=lambda s: (s["batch"], s["layer"]))
        about = {k: dict(v) for k, v in self.about.items()}
        about.setdefault("extraction", {}).update(layers=sorted({s["layer"] for s in found}), storage_dtype=self.dtype)
        about.setdefault("model", {}).setdefault("d_model", max((s["shape"][2] for s in found), default=0))
        about.setdefault("stats", {}).update(total_shards=len(found))
        about["shards"] = [{k: v for k, v in s.items() if k != "batch"} for s in found]
        fs, root = located(self.run)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(work := f"{root}/{MANIFEST}.{uuid.uuid4().hex}") as f:
            f.write(json.dumps(about, indent=1).encode())
        fs.move(work, f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = located(self.run)
        for s in (s for m in messages if m for s in m.shards):
            for name in (s["tensor_file"], s["index_file"]):
                if _exists(fs, root, name):
                    fs.delete_file(f"{root}/{name}")


class ActivationRun(DataSource):
    @classmethod
    def name(cls) -> str:
        return "activation_run"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RunReader:
        return RunReader(self.options)

    def writer(self, schema, overwrite: bool) -> RunWriter:
        return RunWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.dataSource.register(ActivationRun)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def vectors(
    spark: SparkSession, run: str, layers: list[int] | None = None, regions: list[str] | None = None, metadata: dict[str, list[str]] | None = None,
    site: str | None = "resid_post", max_vectors: int | None = None,
) -> DataFrame:
    """One row for each token, with its vector in single precision; columns as in ``SCHEMA``, and run_dir.

    ``site`` also takes rows that name none, ``metadata`` compares trimmed texts, with a blank for a missing one. ``max_vectors`` keeps
    the first in order of the manifest. No shard of ``layers`` raises.
    """
    register(spark)
    if layers is not None and not any(s["layer"] in layers for s in shard_list(load_manifest(run))):
        raise ValueError(f"no shards of layers {layers} in {run}")
    options = {"metadata": json.dumps(metadata or {})} | ({"site": site} if site is not None else {}) | ({"max_vectors": str(max_vectors)} if max_vectors is not None else {})
    df = spark.read.format("activation_run").options(**options).load(run)
    for column, values in (("layer", layers), ("token_region", regions)):
        if values is not None:
            df = df.where(F.col(column).isin(list(values)))
    if max_vectors is not None:
        df = df.orderBy("shard", "batch_row", "token_index").limit(max_vectors)
    return df.withColumn("run_dir", F.lit(run))


def write_run(rows: DataFrame, run: str, batch_size: int, dtype: str = "float32", regions: list[str] | None = None, manifest: dict | None = None) -> None:
    """Rows (layer, position, prompt_id, activation_site, token_mode, token_ids, token_positions, token_regions, metadata, vectors) as a run, and its prompts.

    position: of the prompt in the run, from 0; a shard has the prompts of ``batch_size`` positions. ``regions``: tokens of others are left out.
    """
    register(rows.sparkSession)
    if dtype not in STORED:
        raise ValueError(f"storage_dtype is one of {', '.join(STORED)}")
    if _exists(*located(run), MANIFEST):
        raise ValueError(f"{run} has a manifest")
    if regions is not None:
        keep = F.filter(F.sequence(F.lit(0), F.size("token_regions") - 1), lambda i: F.get("token_regions", i).isin(list(regions)))
        keep = F.when(F.size("token_regions") > 0, keep).otherwise(F.array().cast("array<int>"))
        rows = rows.withColumn("_keep", keep)
        kept = lambda c: F.transform("_keep", lambda i: F.get(c, i))
        rows = rows.withColumns({c: kept(c) for c in ("token_ids", "token_positions", "token_regions", "vectors")})
    named = rows.withColumn("batch", F.floor(F.col("position") / batch_size).cast("int"))
    columns = ("layer", "batch", "prompt_id", "activation_site", "token_mode", "token_ids", "token_positions", "token_regions", "metadata", "vectors")
    prompts = rows.select("position", "prompt_id", "metadata").distinct() if "map" not in dict(rows.dtypes)["metadata"] else rows.groupBy("position", "prompt_id").agg(F.any_value("metadata").alias("metadata"))
    prompts.sort("position").write.json(f"{run}/prompts.jsonl")
    about = manifest or {}
    about = about | {"stats": about.get("stats", {}) | {"total_prompts": prompts.count()}}
    dealt = named.repartition("layer", "batch").sortWithinPartitions("layer", "batch", "position").select(*columns)
    dealt.write.format("activation_run").mode("append").options(storage_dtype=dtype, manifest=json.dumps(about)).save(run)


# ---- validation

_INDEX = "prompt_id string, num_tokens int, token_ids array<long>, token_positions array<int>, token_regions array<string>, activation_site string, token_mode string"
_HEADERS = "shard int, tensor_found boolean, index_found boolean, problem string, found_shape array<int>, found_dtype string"


def headers(spark: SparkSession, run: str) -> DataFrame:
    """The shards of a run and what their files' headers say: tensor_found, index_found, problem, found_shape, found_dtype."""
    listed = shards(spark, run)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = located(run)
        for batch in batches:
            rows = []
            for s in batch.to_pylist():
                tensor, index = (_exists(fs, root, s[k]) for k in ("tensor_file", "index_file"))
                shape = dtype = problem = None
                if tensor:
                    try:
                        with fs.open_input_file(f"{root}/{s['tensor_file']}") as f:
                            shape, kind, start = header(f)
                            if f.size() < start + int(np.prod(shape)) * kind.itemsize:
                                raise ValueError("the file is shorter than its header says")
                            shape, dtype = list(shape), str(kind)
                    except (ValueError, OSError, EOFError) as e:
                        shape, problem = None, str(e)
                rows.append((s["shard"], tensor, index, problem, shape, dtype))
            types = [pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _HEADERS.split(", ")])

    spread = listed.repartition(max(1, min(1000, listed.count() // 50)), "shard")
    return listed.join(spread.mapInArrow(look, _HEADERS), "shard")


def index_rows(spark: SparkSession, run: str, found: DataFrame) -> DataFrame:
    """(shard, batch_row, and the index columns) of the shards in ``found`` whose index file is there; batch_row from 1."""
    files = [(r["shard"], r["index_file"]) for r in found.where("index_found").select("shard", "index_file").collect()]  # entries of a manifest
    if not files:
        return spark.createDataFrame([], f"shard int, batch_row int, {_INDEX}")
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run)
    start = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().toString()
    # the file's path below the run, as the manifest has it
    one_slash = lambda x: F.regexp_replace(x, "^([A-Za-z0-9+.-]+:)/+", "$1/")
    path, size = one_slash(F.col("_metadata.file_path")), F.length(one_slash(F.lit(start)))
    inner = F.url_decode(F.replace(F.substr(path, size + 2), F.lit("+"), F.lit("%2B")))
    text = spark.read.text([f"{run}/{f}" for _, f in files], wholetext=True).select(inner.alias("index_file"), F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    known = spark.createDataFrame(files, "shard int, index_file string")
    lines = text.join(known, "index_file").select("shard", F.posexplode("lines").alias("at", "line"))
    return lines.select("shard", (F.col("at") + 1).alias("batch_row"), F.from_json("line", _INDEX).alias("r")).select("shard", "batch_row", "r.*")


def validate(spark: SparkSession, run: str, prompts: DataFrame, rows: DataFrame | None = None, sample: int = 25) -> DataFrame:
    """(kind, n, places) of 17 kinds of error in a run, all found in one pass over headers and one over index rows.

    prompts: the run's. rows: its index rows, if they are at hand.
    """
    manifest = load_manifest(run)
    told, model, stats = (manifest.get(k, {}) for k in ("extraction", "model", "stats"))
    listed = shard_list(manifest)
    dtype, site = told.get("storage_dtype", "float32"), told.get("activation_site", "resid_post")
    mode, width = told.get("token_mode"), model.get("d_model")
    n_prompts = prompts.count()
    whole = {
        "total_prompts": stats.get("total_prompts") != n_prompts,
        "total_shards": stats.get("total_shards") != len(listed),
        "layers_outside_extraction": bool(told.get("layers")) and bool({s["layer"] for s in listed} - set(told["layers"])),
    }
    of_run = spark.createDataFrame([(k, MANIFEST) for k, bad in whole.items() if bad], "kind string, place string")
    found = headers(spark, run)
    heads = spark.createDataFrame(found.collect(), found.schema)  # entries of a manifest
    rows = index_rows(spark, run, heads) if rows is None else rows
    sizes = rows.groupBy("shard").agg(F.count("*").alias("_rows"))
    own = heads.join(sizes, "shard", "left").withColumn("_rows", F.coalesce("_rows", F.lit(0)))
    tensor, loaded = F.col("tensor_found") & F.col("index_found"), F.col("found_shape").isNotNull() & F.col("index_found")
    of_shards = violations(own, {
        "missing_tensor": ~F.col("tensor_found"),
        "missing_index": F.col("tensor_found") & ~F.col("index_found"),
        "unreadable_tensor": tensor & F.col("problem").isNotNull(),
        "shape": loaded & (F.col("found_shape") != F.col("shape")),
        "dtype_of_shard": loaded & (F.col("found_dtype") != F.coalesce("dtype", F.lit(dtype))),
        "dtype_of_run": loaded & (F.col("found_dtype") != dtype),
        "hidden_size": loaded & (F.get("found_shape", F.lit(2)) != F.lit(width)) if width is not None else F.lit(False),
        "index_rows": loaded & (F.get("found_shape", F.lit(0)) != F.col("_rows")),
    }, F.col("tensor_file"))
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    known = heads.where(loaded).select("shard", "index_file", F.get("found_shape", F.lit(1)).alias("_tokens"))
    of_rows = violations(rows.join(F.broadcast(known), "shard"), {
        "token_mode": ~F.col("token_mode").eqNullSafe(F.lit(mode)),
        "activation_site": F.coalesce("activation_site", F.lit(site)) != site,
        "token_positions": size("token_ids") != size("token_positions"),
        "token_regions": F.col("token_regions").isNotNull() & (size("token_regions") != size("token_ids")),
        "num_tokens": ~F.col("num_tokens").eqNullSafe(size("token_ids")),
        "tokens_beyond_tensor": size("token_ids") > F.col("_tokens"),
    }, F.concat_ws(":", "index_file", F.format_string("%06d", "batch_row")))
    return counted(of_run.unionByName(of_shards).unionByName(of_rows), sample)


# ---- single arrays


def arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, name, shape, values) of ``.npy`` files (name is blank) and of the arrays in ``.npz`` files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                found = {"": got} if isinstance(got, np.ndarray) else dict(got)
                rows += [(file, k, list(v.shape), v.astype(np.float64).ravel().tolist()) for k, v in found.items()]
            types = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "name", "shape", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, name string, shape array<int>, values array<double>")


def direction(spark: SparkSession, path: str, normalize: bool = True) -> list[float]:
    """A vector of one dimension, of length one if wanted; another number of dimensions, or a vector of zeros, raises."""
    found = arrays(spark, path).first()
    if len(found["shape"]) != 1:
        raise ValueError(f"{path} has {len(found['shape'])} dimensions")
    size = float(np.linalg.norm(found["values"]))
    if not size:
        raise ValueError(f"{path} is a vector of zeros")
    return [x / size for x in found["values"]] if normalize else found["values"]


def write_arrays(path: str, **named: np.ndarray) -> None:
    """A ``.npz`` file of several arrays, or a ``.npy`` file of one that is called ``array``."""
    fs, root = located(path)
    data = io.BytesIO()
    if path.endswith(".npz"):
        np.savez(data, **named)
    else:
        np.save(data, named["array"])
    with fs.open_output_stream(root) as f:
        f.write(data.getvalue())
