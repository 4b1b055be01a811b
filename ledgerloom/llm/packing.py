"""Best-fit packing of token sequences by large-item matching.

Documents become token pieces of at most ``CAPACITY`` tokens. Only lengths matter for packing, and there are at
most ``CAPACITY`` of them, so the plan is made from the histogram of lengths, exactly and at any corpus size:

1. Large items, above a third of the capacity, fit at most twice in a bin. Largest first, each is paired with the
   longest other large item that still fits, else it stands alone.
2. Smaller items, longest first, go to the bin with the least gap that holds them, else to a new bin.

The plan is a bounded list of patterns (lengths in one bin, number of such bins). Every piece then finds its slot
from its length and its rank among the pieces of that length; ranks are counted in hash buckets, so a length that
a third of all rows share is ranked by many tasks.

Edge cases: a null or empty text is the end token alone; equal rows are separate pieces; an empty table gives no
rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import arrow, staged

CAPACITY = 1024
END = 2
#: Rows of one rank bucket, on average.
BUCKET_ROWS = 20_000
#: Rows that are encoded at once, and characters of texts whose ids a worker keeps for copies: both bound its memory.
SLICE_ROWS = 256
SAME_CHARS = 2_000_000

_PIECE = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` ids: full pieces, and what is left over comes first."""
    first = n if n <= capacity else n % capacity or capacity
    yield 0, first
    for a in range(first, n, capacity):
        yield a, a + capacity


def pieces(documents: DataFrame, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, each text encoded once as a whole."""
    fields = {k: t for k, t in _PIECE.items() if with_ids or k != "ids"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same: dict[str, np.ndarray] = {}  # texts that came before, of ``SAME_CHARS`` at most
        held = 0
        for part in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            out: dict[str, list] = {k: [] for k in fields}
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                text = text or ""
                if (ids := same.get(text)) is None:
                    ids = np.append(tokens.ids(text), np.uint32(end)).astype("<u4")
                    if held + len(text) > SAME_CHARS:
                        same, held = {}, 0
                    if len(text) <= SAME_CHARS:
                        same[text], held = ids, held + len(text)
                for k, (a, b) in enumerate(cuts(len(ids), capacity)):
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        out["ids"].append(ids[a:b].astype(np.int32))
            yield arrow(fields, out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a bin, in order; number of bins) that hold every item of a histogram of lengths once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    assert all(0 < n <= capacity for n in left)
    by_gap: dict[int, list[tuple[list[int], int]]] = {}
    gaps: list[int] = []  # sorted, of the non-empty lists

    def put(items: list[int], bins: int) -> None:
        if bins:
            gap = capacity - sum(items)
            if gap not in by_gap:
                by_gap[gap] = []
                bisect.insort(gaps, gap)
            by_gap[gap].append((items, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        k = bisect.bisect_right(large, capacity - n) - 1
        if k < 0:
            put([n], left[n])
            large.pop()
            continue
        m = large[k]
        if m == n:
            put([n, n], left[n] // 2)
            left[n] %= 2
            if not left[n]:
                large.pop()
                continue
            large.pop()
            other = large[bisect.bisect_right(large, capacity - n) - 1] if large and large[0] <= capacity - n else 0
            put([n, other] if other else [n], 1)
            if other:
                left[other] -= 1
                if not left[other]:
                    large.remove(other)
            continue
        bins = min(left[n], left[m])
        put([n, m], bins)
        for x in (n, m):
            left[x] -= bins
            if not left[x]:
                large.remove(x)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            k = bisect.bisect_left(gaps, n)
            if k == len(gaps):
                most = capacity // n
                put([n] * most, todo // most)
                put([n] * (todo % most), 1 if todo % most else 0)
                break
            gap = gaps[k]
            items, bins = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(k)
            each = gap // n
            full = min(bins, todo // each)
            put(items + [n] * each, full)
            todo -= full * each
            if full < bins:
                put(items + [n] * todo, 1 if todo else 0)
                put(items, bins - full - (1 if todo else 0))
                todo = 0
    return [x for group in by_gap.values() for x in group]


def slots(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """The slots of all patterns by length: first rank, sequence and offset of each run, and each length's first rank."""
    runs: list[tuple[int, int, int, int]] = []
    first = 0
    for items, bins in patterns:
        offset = 0
        for n in items:
            runs.append((n, first, offset, bins))
            offset += n
        first += bins
    runs.sort()
    size = np.array([r[3] for r in runs], np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) if runs else np.zeros(0, np.int64)
    begin: dict[int, int] = {}
    for r, s in zip(runs, start, strict=True):
        begin.setdefault(r[0], int(s))
    return start, np.array([r[1] for r in runs], np.int64), np.array([r[2] for r in runs], np.int64), begin


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...). ``items`` is read twice: give a written table."""
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    start, sequence, offset, begin = slots(plan(counts, capacity))
    total = sum(counts.values())
    buckets = max(256, total // BUCKET_ROWS)
    own = items.withColumn("_b", F.expr(f"pmod(xxhash64(doc_id, piece), {buckets})"))
    before = own.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece"))
    ranked = own.withColumn("_local", local).join(before, ["length", "_b"]).withColumn("_rank", F.col("_local") - 1 + F.col("_before"))
    columns = [*items.columns]
    extra = "sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(capacity + 1, np.int64)
        for n, s in begin.items():
            table[n] = s
        for batch in batches:
            at = table[batch.column("length").to_numpy()] + batch.column("_rank").to_numpy()
            k = np.searchsorted(start, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence[k] + at - start[k]), pa.array(offset[k])], names=[*columns, "sequence_id", "offset"]
            )

    from pyspark.sql.types import StructType

    schema = StructType(items.schema.fields + StructType.fromDDL(extra).fields)
    return ranked.select(*columns, "_rank").mapInArrow(run, schema)


def packed(documents: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    Texts are encoded once; the pieces, a few numbers each, are written to the shared folder before they are counted.
    """
    return pack(staged(pieces(documents, capacity, with_ids=with_ids), "pieces"), capacity)
