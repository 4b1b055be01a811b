"""Benchmark decontamination by one Aho-Corasick automaton over word sequences.

Items and documents are lower-cased (A-Z only) and cut into words, runs of ASCII letters, digits and
non-ASCII characters. Every window of ten consecutive item words (an item of fewer words: all of them) is a
pattern of the automaton; its alphabet is the benchmark's vocabulary, any other word resets the scan. A
document is scanned once from end to end; hits are mapped back to code points of the original text.

Edge cases: null and empty texts have no words and no hits; rows of one doc_id with different texts each get their own result; items without words give no pattern; repeated
items and item ids count once; an empty benchmark leaves every document clean. Only ``doc_id`` and ``text`` (of
documents), ``item_id`` and ``text`` (of the benchmark) are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, arrow

WINDOW = 10
#: Items are sent to the executors in blocks of about so many characters, one scan of the documents for each block. An automaton
#: takes about 110 MB for each million characters in every Python worker.
BLOCK_CHARS = 1_000_000

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    # bytes.lower() touches A-Z only, and every byte of a non-ASCII character is a word byte
    return _WORD.findall((text or "").encode().lower())


class Matcher:
    """The automaton over the windows of ``items`` (pairs of id and text)."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[i : i + window]), set()).add(str(item_id))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in found.items():
            self.automaton.add_word(key, (len(key), ids))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def scan(self, text: str | None) -> tuple[int, list[list[int]], set[str]]:
        """Number of words, merged hit ranges of word positions (end exclusive), ids of the items that occur."""
        own = words(text)
        ranges: list[list[int]] = []
        items: set[str] = set()
        if self.any and own:
            get = self.vocabulary.get
            ids = tuple([get(w, 0) for w in own])
            for last, (n, who) in self.automaton.iter(ids):
                first = last - n + 1
                while ranges and ranges[-1][0] >= first:
                    ranges.pop()
                if ranges and first <= ranges[-1][1]:
                    ranges[-1][1] = last + 1
                else:
                    ranges.append([first, last + 1])
                items |= who
        return len(own), ranges, items

    @staticmethod
    def offsets(text: str, ranges: list[list[int]]) -> list[dict[str, int]]:
        """Code point spans of ranges of word positions."""
        data = text.encode()
        at = [m.span() for m in _WORD.finditer(data.lower())]
        out, seen, chars = [], 0, 0
        for first, end in ranges:
            a, b = at[first][0], at[end - 1][1]
            chars += len(data[seen:a].decode())
            span = len(data[a:b].decode())
            out.append({"start": chars, "end": chars + span})
            chars, seen = chars + span, b
        return out


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FIELDS = {"doc_id": pa.int64(), "n_words": pa.int64(), "ranges": _SPAN, "items": pa.list_(pa.string()), "spans": _SPAN}
_SCHEMA = (
    "doc_id long, n_words long, ranges array<struct<start:int,end:int>>, items array<string>, spans array<struct<start:int,end:int>>"
)
_built: dict[str, Matcher] = {}


def _matcher(key: str, sent: Broadcast, window: int) -> Matcher:
    """The automaton of a block, built once in each Python worker. key: a name for the block that is used once."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(sent.value, window)
    return _built[key]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about ``block_chars`` characters, dealt by a hash of the item."""
    bench = benchmark.select("item_id", "text").where("text is not null").distinct()
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    for k in range(n):
        part = bench if n == 1 else bench.where(F.expr(f"pmod(xxhash64(item_id, text), {n}) = {k}"))
        yield [tuple(r) for r in part.collect()]


def scan(documents: DataFrame, items: list[tuple[object, str | None]], window: int = WINDOW, named: bool = False) -> DataFrame:
    """(doc_id, n_words, ranges, items, spans) of every document against items that fit one block; if ``named``, also a 128-bit hash of the text."""
    spark = documents.sparkSession
    sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    fields, schema = (_FIELDS | {"name": pa.binary()}, f"{_SCHEMA}, name binary") if named else (_FIELDS, _SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, sent, window)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in fields}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, ranges, found = matcher.scan(text)
                out["doc_id"].append(doc_id)
                out["n_words"].append(n)
                out["ranges"].append([{"start": a, "end": b} for a, b in ranges])
                out["items"].append(sorted(found))
                out["spans"].append(matcher.offsets(text, ranges) if ranges else [])
                if named:
                    out["name"].append(hashlib.md5((text or "").encode(), usedforsecurity=False).digest())
            yield arrow(fields, out)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _merged(spans: str) -> F.Column:
    """Union of the ranges in an array that is sorted by start."""
    return F.expr(
        f"""aggregate({spans}, cast(array() as array<struct<start:int,end:int>>), (acc, x) ->
            case when size(acc) > 0 and element_at(acc, -1).end >= x.start
                 then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))
                 else concat(acc, array(x)) end)"""
    )


def _scans(documents: DataFrame, benchmark: DataFrame, window: int, block_chars: int) -> DataFrame:
    """(doc_id, n_words, ranges, items, spans) of every document against the whole benchmark.

    Of several blocks one is held at a time. Each block's scan writes what it finds, named by the text's hash, as what is
    found depends on the text alone; the last join is on narrow rows.
    """
    blocks = _blocks(benchmark, block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return scan(documents, first, window)
    tables = Tables(documents.sparkSession)
    own = documents.select("doc_id", "text")
    every = tables.write(scan(own, [], window, named=True).select("doc_id", "name", "n_words"), "words")
    found = None
    for k, items in enumerate(itertools.chain([first, second], blocks)):
        hits = scan(own, items, window, named=True).where("size(ranges) > 0").dropDuplicates(["name"])
        part = tables.write(hits.select("name", "ranges", "items", "spans"), f"hits{k}")
        found = part if found is None else found.unionByName(part)
    united = found.groupBy("name").agg(
        F.array_sort(F.flatten(F.collect_list("ranges"))).alias("r"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
    )
    united = united.select("name", _merged("r").alias("ranges"), "items", _merged("s").alias("spans"))
    none = {c: F.coalesce(c, F.array().cast(united.schema[c].dataType)).alias(c) for c in ("ranges", "items", "spans")}
    return every.join(united, "name", "left").select("doc_id", "n_words", *none.values())


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    A benchmark of up to ``block_chars`` characters is one automaton in each worker. A larger one is dealt into
    blocks by a hash of the item; every block is one scan, and the ranges of all scans are united per text.
    """
    return _scans(documents, benchmark, window, block_chars).select(
        "doc_id",
        "n_words",
        F.expr("aggregate(ranges, 0L, (a, x) -> a + (x.end - x.start))").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
        "items",
        "spans",
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns.

    A filter of the scan itself: no join and no shuffle. What a block leaves is written before the next block's scan, so
    that one automaton is held at a time.
    """
    at = documents.columns.index("text")
    tables, blocks = Tables(documents.sparkSession), _blocks(benchmark, block_chars)
    items = next(blocks)
    for k in itertools.count():
        sent, key = documents.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, sent, window)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.scan(t)[1] for t in batch.column(at).to_pylist()], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
        if (items := next(blocks, None)) is None:
            return documents
        documents = tables.write(documents, f"clean{k}")
        if k:
            tables.drop(f"clean{k - 1}")
