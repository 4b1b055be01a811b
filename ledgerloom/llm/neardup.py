"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is the weighted set of its shingles, five consecutive lower-cased words, each weighted by how often it
occurs; a text of fewer words is one shingle. Each unit of an element's weight is a region of its own, into
which hashed darts fall as a Poisson process over ranks. Darts up to a rank that yields about ``k (ln k + 2)`` of
them for the whole document are thrown, each dart belongs to one of ``k`` coordinates, and a coordinate keeps its
earliest dart; if a coordinate has none, the rank limit doubles. Two documents agree on a coordinate with
probability equal to their weighted Jaccard similarity, and the work grows with the text plus ``k ln k``.

Equal texts collapse to their smallest doc_id first. The rest meet in ``BANDS`` bands of ``ROWS`` coordinates; a
pair of similarity 0.8 misses every band with probability 3e-6. Buckets are compared in blocks of about ``BLOCK``
members by a sketch, one byte of each coordinate, which travels instead of the text:

1. Linking rounds. One member of each class of a bucket takes part, in the first round every text. In its block, each one
   is paired with the most similar member before it, so a bucket gives at most one pair a member. Pairs are verified
   exactly on the texts and classes are the connected components of the true links.
2. Exact step. In every bucket that still holds several classes, members outside its largest class meet all members, block by
   block. Every pair of different classes whose sketches agree in at least ``AGREE`` coordinates, and that was not
   verified before, is verified. A pair of similarity 0.8 agrees in fewer with a probability of 4e-5. Buckets of more than
   ``CROWD`` pairs take their texts along and all pairs get their exact similarity in the task, one text against a block at once,
   so that they never give out pairs but true links.

So a link between different texts can only be missed by the two probabilities above, whatever the sizes of groups. Rounds
are repeated while they at least halve the pairs that the exact step would compare.

Edge cases: a null text is a class of its own; texts that are equal are one class, also empty ones and ones
without words; words beyond that follow ``\\w+``; very long texts are whole; an empty table gives no rows; a
doc_id that occurs in several rows stands for all of them, with the text of any. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, arrow, chunks, components, only

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
#: Members of a bucket that are compared with each other in one task at once.
BLOCK = 512
#: Coordinates of 160 in which a pair's sketches agree at least to be verified: four standard deviations below similarity 0.8.
AGREE = 108
#: Words of a block at most, about, where texts travel.
BLOCK_WEIGHT = 400_000
#: Pairs from which on a bucket is compared with its texts in the task instead of giving pairs to verify.
CROWD = 1 << 12
#: The exact step follows at once if it compares at most so many pairs for each member of a bucket.
EASY = 64
#: Bytes that one comparison of sketches may take.
CELLS = 1 << 22
#: Words whose hashes a Python worker keeps.
WORDS = 100_000
CHUNK_CHARS = 500_000
CHUNK_DOCS = 1000

_WORD = re.compile(r"\w+")
_U = np.uint64


class _WordHashes(dict):
    """Hash of every word seen; forgotten from time to time, so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, in order, and their numbers of occurrences."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.array([_hash[w] for w in words], _U)
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, _U)
    for j in range(n):
        total = _mix(total + h[j : len(h) - n + 1 + j])
    return np.unique(total, return_counts=True)


def signatures_of(sets: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * ROWS) -> np.ndarray:
    """Earliest dart of each of ``k`` coordinates, a row for each weighted set (elements, positive weights), all sets at once.

    A fraction of a unit region takes its share of the darts.
    """
    out = np.zeros((len(sets), k), _U)
    todo, factor = np.arange(len(sets)), 1.0
    while len(todo):
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([np.asarray(sets[i][1], float) for i in todo])
        sizes = np.array([len(sets[i][0]) for i in todo])
        units = np.ceil(weights).astype(np.int64)
        own = np.repeat(np.repeat(np.arange(len(todo)), sizes), units)
        slab = np.arange(len(own)) - np.repeat(np.cumsum(units) - units, units)
        share = np.minimum(np.repeat(weights, units) - slab, 1.0)
        region = _mix(np.repeat(elements, units) + _mix(slab.astype(_U) + _U(1)))
        total = np.bincount(np.repeat(np.arange(len(todo)), sizes), weights, len(todo))
        limit = factor * k * (np.log(k) + 2) / total
        best, found = np.full(len(todo) * k, np.inf), np.zeros(len(todo) * k, _U)
        rank, dart = np.zeros(len(region)), 0
        while len(region):
            dart += 1
            u = _mix(region + _U(dart * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            rank = rank - np.log(((u >> _U(11)).astype(np.float64) + 0.5) / 2.0**53)
            on = rank <= limit[own]
            own, share, rank, region, u = own[on], share[on], rank[on], region[on], u[on]
            name = _mix(u ^ _U(0xD1B54A32D192ED03))
            hit = slice(None) if (share >= 1).all() else (_mix(name + _U(1)) >> _U(11)).astype(np.float64) / 2.0**53 < share
            at, r, name = own[hit] * k + (name[hit] % _U(k)).astype(np.int64), rank[hit], name[hit]
            np.minimum.at(best, at, r)
            first = r == best[at]
            found[at[first]] = name[first]
        full = np.isfinite(best).reshape(-1, k).all(1)
        out[todo[full]] = found.reshape(-1, k)[full]
        todo, factor = todo[~full], factor * 2  # a set with an empty coordinate gets twice as many darts
    return out


def bands(sig: np.ndarray, count: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    rows = sig.reshape(len(sig), count, sig.shape[1] // count)  # also of no signatures
    key = np.repeat(_mix(np.arange(1, count + 1).astype(_U))[None], len(sig), 0)
    for j in range(rows.shape[2]):
        key = _mix(key + rows[:, :, j])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common) if total else 1.0


def signatures(documents: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n, bands, sketch): a 128-bit hash of the text, its total weight, band keys and sketch; none of the last two for texts without words."""
    fields = {"doc_id": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "n": pa.int64(), "bands": pa.list_(pa.int64()), "sketch": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, end in chunks(texts, CHUNK_CHARS):
                for c in range(first, end, CHUNK_DOCS):
                    part = slice(c, min(end, c + CHUNK_DOCS))
                    hashes = [xxhash.xxh3_128_intdigest(f"null {i}" if t is None else f"text {t}") for i, t in zip(ids[part], texts[part], strict=True)]
                    place = {h: k for k, h in reversed(list(enumerate(hashes)))}  # equal texts are signed once
                    sets = {h: s for h, k in place.items() if len((s := shingles(texts[c + k]))[0])}
                    sig = signatures_of(list(sets.values())) if sets else np.zeros((0, BANDS * ROWS), _U)
                    sketch = (sig >> _U(40)).astype(np.uint8)
                    signed = {h: (int(s[1].sum()), b, x.tobytes()) for (h, s), b, x in zip(sets.items(), bands(sig), sketch, strict=True)}
                    nothing = (0, [], None)
                    rows = [((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), *signed.get(h, nothing)) for h in hashes]
                    yield arrow(fields, dict(zip(fields, (ids[part], *map(list, zip(*rows, strict=True))), strict=True)))

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, h1 long, h2 long, n long, bands array<long>, sketch binary")


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Those of the (u, v) pairs whose texts have at least this similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # texts that come again and again are cut once
        size = 0

        def cut(name: int, text: str | None) -> tuple[np.ndarray, np.ndarray]:
            nonlocal size
            if name not in last:
                if size > 4 * CHUNK_CHARS:
                    last.clear()
                    size = 0
                last[name] = shingles(text)
                size += len(text or "")
            return last[name]

        for batch in batches:
            u, v, a, b = (c.to_pylist() for c in batch.columns)
            keep = [similarity(cut(i, x), cut(j, y)) >= least for i, j, x, y in zip(u, v, a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u")
    both = left.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _whole(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by the columns ``by``, in portions of whole groups, and where the groups of a portion begin (with its end)."""
    kept: pa.Table | None = None

    def cuts(part: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(part.num_rows, bool)
        for c in by:
            x = part.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        part = pa.Table.from_batches([batch])
        kept = part if kept is None else pa.concat_tables([kept, part])
        whole = kept.combine_chunks().to_batches()[0] if kept.num_rows else None
        if whole is None or not len(at := cuts(whole)):
            continue
        yield whole.slice(0, at[-1]), np.concatenate([[0], at])
        kept = pa.Table.from_batches([whole.slice(at[-1])])
    if kept is not None and kept.num_rows:
        whole = kept.combine_chunks().to_batches()[0]
        yield whole, np.concatenate([[0], cuts(whole), [whole.num_rows]])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _close(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the total weights allow a similarity of 0.8."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each member of a group with the most similar one before it, if any is similar enough. Groups of one size are compared together."""
    for part, edge in _whole(batches, ["key", "block"]):
        rep, n, sketch = part.column("rep").to_numpy(), part.column("n").to_numpy(), _sketches(part.column("sketch"))
        first, size = edge[:-1], np.diff(edge)
        for s in np.unique(size[size > 1]):
            group = first[size == s]
            step = max(1, CELLS // int(s * s * sketch.shape[1]))
            for g in range(0, len(group), step):
                at = group[g : g + step, None] + np.arange(s)
                # a row at a time, so that a large block takes no more than its own size
                for i in range(1, s) if s > 16 else [slice(None)]:
                    mine, others = (at[:, i, None], at[:, :i]) if s > 16 else (at[:, :, None], at[:, None, :])
                    agree = (sketch[mine] == sketch[others]).sum(-1, dtype=np.int32)
                    agree = np.where(_close(n[mine], n[others]) & (rep[mine] > rep[others]), agree, 0)
                    best = agree.argmax(-1)
                    on = np.take_along_axis(agree, best[..., None], -1)[..., 0] >= AGREE
                    rows = at[:, i] if s > 16 else at
                    partner = at[np.arange(len(at)).reshape(-1, *[1] * (best.ndim - 1)), best]
                    yield pa.RecordBatch.from_arrays([pa.array(rep[partner[on]]), pa.array(rep[rows[on]])], names=["u", "v"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): all similar enough pairs of different classes between the two sides of each group; pairs within the left side once."""
    for part, edge in _whole(batches, ["key", "block", "other"]):
        rep, cls, n = (part.column(c).to_numpy() for c in ("rep", "class", "n"))
        left, of_top, sketch = part.column("left").to_numpy(zero_copy_only=False), part.column("of_top").to_numpy(zero_copy_only=False), _sketches(part.column("sketch"))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            rows, others = a + np.flatnonzero(left[a:b]), a + np.flatnonzero(~left[a:b])
            found: list[np.ndarray] = []
            step = max(1, CELLS // max(1, len(others) * sketch.shape[1]))
            for g in range(0, len(rows), step):
                mine = rows[g : g + step, None]
                ok = (cls[mine] != cls[others]) & (of_top[others] | (rep[mine] < rep[others])) & _close(n[mine], n[others])
                i, j = np.nonzero(ok)
                for k in range(0, len(i), CELLS // sketch.shape[1]):
                    x, y = mine[i[k : k + CELLS // sketch.shape[1]], 0], others[j[k : k + CELLS // sketch.shape[1]]]
                    on = (sketch[x] == sketch[y]).sum(1, dtype=np.int32) >= AGREE
                    found.append(np.sort(np.stack([rep[x[on]], rep[y[on]]]), 0))
            if found:
                u, v = np.concatenate(found, 1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _linking(members: DataFrame, seed: int) -> DataFrame:
    """Pairs of a linking round. members: key, rep, class, n, sketch; one member of each class of a bucket takes part."""
    if seed:
        pick = F.struct(F.xxhash64("rep", F.lit(seed)).alias("p"), "rep", "n", "sketch")
        members = members.groupBy("key", "class").agg(F.min(pick).alias("m")).select("key", "m.rep", "m.n", "m.sketch")
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "key").select("key", F.pmod(F.xxhash64("rep", F.lit(seed)), "blocks").alias("block"), "rep", "n", "sketch")
    return dealt.repartition("key", "block").sortWithinPartitions("key", "block", "rep").mapInArrow(_best, "u long, v long").distinct()


def _common(sets: list[tuple[np.ndarray, np.ndarray]]) -> Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For one weighted set, the weight it has in common with each of ``sets``, none of which is empty: one pass over their elements."""
    names, code = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
    weights = np.concatenate([s[1] for s in sets])
    first = np.cumsum([0, *(len(s[0]) for s in sets[:-1])])
    own = np.zeros(len(names), np.int64)

    def common(one: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at = np.minimum(np.searchsorted(names, one[0]), len(names) - 1)
        known = names[at] == one[0]
        own[at[known]] = one[1][known]
        out = np.add.reduceat(np.minimum(own[code], weights), first)
        own[at[known]] = 0
        return out

    return common


def _forest(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(u, v): true links that connect the classes of each group as far as any of its pairs do. All pairs get their exact similarity."""
    for part, edge in _whole(batches, ["key", "block", "other"]):
        rep, cls, n = (part.column(c).to_numpy() for c in ("rep", "class", "n"))
        left, text = part.column("left").to_numpy(zero_copy_only=False), part.column("text")
        out: list[tuple[int, int]] = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            rows, others = a + np.flatnonzero(left[a:b]), a + np.flatnonzero(~left[a:b])
            if not len(rows) or not len(others):
                continue
            above: dict[int, int] = {}

            def root(x: int, above: dict[int, int] = above) -> int:
                while (y := above.get(x, x)) != x:
                    above[x] = above.get(y, y)
                    x = y
                return x

            common = _common([shingles(text[int(z)].as_py()) for z in others])
            for x in rows:
                same = common(shingles(text[int(x)].as_py()))
                for y in others[(same / (n[x] + n[others] - same) >= least) & (cls[others] != cls[x])]:
                    one, two = root(int(cls[x])), root(int(cls[y]))
                    if one != two:
                        above[one] = two
                        out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])


def _mixed(members: DataFrame) -> DataFrame:
    """(key, m, top, most, blocks, left_blocks) of the buckets of several classes: members, the largest class, its members, and the blocks of all members and of the others.

    Blocks have about ``BLOCK`` members and ``BLOCK_WEIGHT`` words at most.
    """
    sizes = members.groupBy("key", "class").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    stats = sizes.groupBy("key").agg(F.sum("k").alias("m"), F.sum("w").alias("w"), F.max(F.struct("k", "class", "w")).alias("x"))

    def blocks(count: Column, weight: Column) -> Column:
        return F.ceil(F.greatest(count / BLOCK, weight / BLOCK_WEIGHT))

    found = stats.where("x.k < m").select("key", "m", F.col("x.class").alias("top"), F.col("x.k").alias("most"), blocks(F.col("m"), F.col("w")).alias("blocks"), blocks(F.col("m") - F.col("x.k"), F.col("w") - F.col("x.w")).alias("left_blocks"))
    return found


def _sides(members: DataFrame, mixed: DataFrame, *more: str) -> DataFrame:
    """Members of mixed buckets dealt to pairs of blocks: those outside the largest class on the left, all on the right, sorted by pair of blocks."""
    own = members.join(mixed, "key").withColumn("of_top", F.col("class") == F.col("top"))
    deal, fields, zero = F.xxhash64("rep"), ("rep", "class", "n", "sketch", "of_top", *more), F.lit(0).cast("long")
    left = own.where(~F.col("of_top")).select("key", F.pmod(deal, "left_blocks").alias("block"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("other"), F.lit(True).alias("left"), *fields)
    right = own.select("key", F.explode(F.sequence(zero, F.col("left_blocks") - 1)).alias("block"), F.pmod(deal, "blocks").alias("other"), F.lit(False).alias("left"), *fields)
    return left.unionByName(right).repartition("key", "block", "other").sortWithinPartitions("key", "block", "other")


def _crowd_links(members: DataFrame, keys: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(u, v) true links within the large mixed buckets ``keys``. Buckets with common members are one crowd, so that each pair of blocks is compared once."""
    inside = members.join(keys, "key", "left_semi")
    hubs = inside.groupBy("key").agg(F.min("rep").alias("hub"))
    met = inside.join(hubs, "key").select("rep", "hub").distinct()
    # a member's buckets are one crowd: their first members are linked with the smallest of them
    low = met.groupBy("rep").agg(F.min("hub").alias("low"))
    crowds = components(met.join(low, "rep").where("hub <> low").select(F.col("hub").alias("src"), F.col("low").alias("dst")).distinct())
    named = low.join(crowds.withColumnRenamed("node", "low"), "low", "left").select("rep", F.coalesce("component", "low").alias("key"))
    own = inside.select("rep", "class", "n", "sketch").dropDuplicates(["rep"]).join(named, "rep")
    full = own.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    return _sides(full, _mixed(own), "text").mapInArrow(lambda batches: _forest(batches, least), "u long, v long").distinct()


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after new links (u, v). Only classes that the new links touch are put together, old links are not walked again."""
    if labels is None:
        return components(links.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    ends = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    every = ends.join(labels, "node", "full_outer").select("node", F.coalesce("component", "node").alias("component"))
    one, two = (every.select(F.col("node").alias(x), F.col("component").alias(y)) for x, y in (("u", "src"), ("v", "dst")))
    joined = components(links.join(one, "u").join(two, "v").select("src", "dst")).select(F.col("node").alias("component"), F.col("component").alias("top"))
    return every.join(joined, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def classes(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every document; class_id is the smallest doc_id of the class."""
    tables = Tables(documents.sparkSession)
    sig = tables.write(signatures(documents), "signatures")
    # a text's copies become one row already on the map side
    own = F.min(F.struct("doc_id", "n", "bands", "sketch")).alias("m")
    groups = tables.write(sig.groupBy("h1", "h2").agg(own).select("h1", "h2", F.col("m.doc_id").alias("rep"), "m.n", "m.bands", "m.sketch"), "groups")
    keyed = groups.select(F.explode("bands").alias("key"), "rep")
    # only buckets of several texts matter from here on
    shared = keyed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key")
    met = tables.write(keyed.join(shared, "key"), "buckets")
    compared = tables.write(met.select(F.col("rep").alias("doc_id")).distinct(), "compared")
    sketches = tables.write(only(groups.select(F.col("rep").alias("doc_id"), "n", "sketch"), compared), "sketches").withColumnRenamed("doc_id", "rep")
    texts = tables.write(only(documents.select("doc_id", "text"), compared), "compared_texts")
    if texts.groupBy("doc_id").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id"])
    members = met.join(sketches, "rep")
    few = EASY * met.count()
    tested = labels = crowds = None
    turn, before, last = 0, None, False
    while not last:
        if labels is None:
            classed = members.withColumn("class", F.col("rep"))
        else:
            known = labels.select(F.col("node").alias("rep"), F.col("component").alias("label"))
            classed = members.join(known, "rep", "left").withColumn("class", F.coalesce("label", "rep"))
        if turn == 0:
            pairs = _linking(classed, turn)
        else:
            mixed = tables.write(_mixed(classed), f"mixed{turn}")
            work = mixed.agg(F.sum((F.col("m") - F.col("most")) * F.col("m"))).first()[0]
            if not work:
                break
            last = work <= few or before is not None and 2 * work > before
            before = work
            if last:
                large = (F.col("m") - F.col("most")) * F.col("m") > CROWD
                pairs = _sides(classed, mixed.where(~large)).mapInArrow(_across, "u long, v long").distinct()
                crowds = mixed.where(large).select("key")
            else:
                pairs = _linking(classed.join(mixed.select("key"), "key", "left_semi"), turn)
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = tables.write(pairs, f"pairs{turn}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = verified(pairs, texts, least)
        if crowds is not None and crowds.limit(1).count():
            new = new.unionByName(_crowd_links(classed, crowds, texts, least))
        new = tables.write(new, f"links{turn}")
        if new.limit(1).count():
            labels = tables.write(_merged(labels, new), f"classes{turn}")
        turn += 1
    tables.drop("buckets", "compared", "sketches", "compared_texts", *(f"{name}{k}" for k in range(turn + 1) for name in ("mixed", "pairs", "links")))
    named = groups.select("h1", "h2", "rep")
    if labels is None:
        named = named.withColumn("class_id", F.col("rep"))
    else:
        named = named.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class_id", F.coalesce("component", "rep"))
    return sig.select("doc_id", "h1", "h2").join(named.select("h1", "h2", "class_id"), ["h1", "h2"]).select("doc_id", "class_id")


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all its columns; one row of repeated ones."""
    found = Tables(documents.sparkSession).write(classes(documents), "classes")
    out = only(documents, found.where("doc_id <> class_id").select("doc_id"), keep=False)
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return out.dropDuplicates(["doc_id"]) if repeated else out
