"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations only.

Lines are trimmed; blank ones do not count. Equal lines are one class by a 128-bit hash. Different lines are linked when
few enough insertions, deletions or substitutions apart. How many are few follows the shorter line's code points: none
below ``SHORT``, where one edit makes another word, one below ``LONG``, and ``EDITS`` from there on.

1. A line that may have e edits is cut into e + 1 segments, so a line within e edits keeps one of them whole.
   Each segment is an index key (length, segment number, hash).
2. A line probes the lengths from its own down to e less, and for each only the substrings at which the first
   kept segment can stand, given the edits left for the parts before and after it.
3. An index key of one or two lines gives its candidates directly, one row for a probe. Keys of more lines are
   joined with their texts, and pairs are dropped inside the join by a letter sketch and the edit distance, so
   only true links come out of it.
4. Every candidate is verified by a bit-parallel edit distance within a band of ``EDITS`` diagonals to either side.

Classes are the connected components of exact and near links; the first line of a class in order of (doc_id,
line number) is its representative and the others are repeats.

Edge cases: null and empty texts have no lines; repeated rows of a document repeat its lines; long texts and
lines are whole; ties cannot occur, as positions are unique but for repeated rows, which are then all first; an
empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, staged

EDITS = 2
SHORT = 8
LONG = 24
#: A document keeps its repeats of other documents if they are more than this share of its characters: it is a copy, not a text with boilerplate.
MAX_SHARE = 0.5
#: Documents whose needed lines are broadcast in one block (about 100 bytes each), and the most such blocks; beyond that the texts are shuffled.
BLOCK = 500_000
BLOCKS = 8


def _trimmed(raw: Column) -> Column:
    # the characters of \s, without a regular expression
    return F.btrim(raw, F.lit(" \t\n\x0b\f\r"))


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): non-blank lines, trimmed, numbered from 0 by their place in the text."""
    own = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return own.select("doc_id", "line_no", _trimmed(F.col("raw")).alias("line")).where("line <> ''")


def _hashes(line: str = "line") -> list[Column]:
    return [F.xxhash64(F.col(line)).alias("h"), F.xxhash64(F.lit("second"), F.col(line)).alias("g")]


def _segment(n: Column, i: int, edits: int) -> tuple[Column, Column]:
    """First position (from 1) and length of segment ``i`` (from 1) of a line of ``n`` code points; later segments are the longer ones."""
    short = F.floor(n / (edits + 1)).cast("int")
    longer = n - short * (edits + 1)  # so many segments at the end have one more
    extra = F.greatest(F.lit(0), longer - (edits + 1 - (i - 1)))  # of those before i
    size = short + F.when(F.lit(i) > edits + 1 - longer, 1).otherwise(0)
    return (i - 1) * short + extra + 1, size


def tiers(edits: int) -> list[tuple[int, int, int]]:
    """(edits, first length, length after the last) of the lengths that may have any."""
    return [(edits, SHORT, 1 << 31)] if edits == 1 else [(1, SHORT, LONG), (edits, LONG, 1 << 31)]


def _keys(edits: int) -> tuple[list[Column], list[Column]]:
    """Index keys, and the further probe keys, of the columns ``line`` and ``n``."""
    index, probe = [], []
    for few, least, end in tiers(edits):
        for less in range(few + 1):
            n = F.col("n") - less
            for i in range(1, few + 2):
                start, size = _segment(n, i, few)
                low, high = max(-(i - 1), less - (few + 1 - i)), min(i - 1, less + (few + 1 - i))
                for shift in range(low, high + 1):
                    at = start + shift
                    # an index length of another tier has other segments; a substring that reaches outside is none
                    fits = (n >= least) & (n < end) & (at >= 1) & (at + size - 1 <= F.col("n"))
                    key = F.when(fits, F.xxhash64(n, F.lit(i), F.substring(F.col("line"), at, size)))
                    (index if less == 0 and shift == 0 else probe).append(key)
    return index, probe


def within(a: str, b: str, edits: int, tiered: bool = False) -> Column:
    """Whether the lines in columns ``a`` and ``b`` are at most ``edits`` apart; with ``tiered``, at most what their length allows.

    A banded bit-parallel edit distance: one step for each code point of the shorter line. Its state are two bit sets
    over the 2 * edits + 1 cells around the diagonal, those one above and those one below the cell over them. The distance
    is followed along the diagonal that ends in the last cell; once it is above ``edits``, the rest is passed over.
    """
    width = 2 * edits + 1
    band = (1 << width) - 1
    # bit i is row j + i - edits of column j; rows outside the line equal nothing
    equal = " | ".join(f"if(get(x.longer, s.j + {i - edits}) <=> c, {1 << i}L, 0L)" for i in range(width))
    kept = f"((((m & s.up) + s.up) ^ s.up) | m | s.down) & {band}L"  # cells equal to the one at their upper left
    up = f"((z & s.up) | ~(shiftright(z, 1) | s.down | ~(z | s.up))) & {band}L"
    down = f"shiftright(z, 1) & (s.down | ~(z | s.up)) & {band}L"
    after = f"named_struct('j', s.j + 1, 'n', s.n + if(z & shiftleft(1L, {edits} + x.d) = 0, 1, 0), 'up', {up}, 'down', {down})"
    step = f"get(transform(transform(array({equal}), m -> {kept}), z -> {after}), 0)"  # arrays of one element name a value
    start = f"named_struct('j', 0, 'n', x.d, 'up', {band & ~((1 << edits) - 1)}L, 'down', 0L)"
    longer, shorter = (f"split(if((length({a}) < length({b})) = {swap}, {b}, {a}), '')" for swap in ("true", "false"))
    # the slice, as splitting the empty line gives an empty string
    most = f"case when size(x.shorter) >= {LONG} then {edits} when size(x.shorter) >= {SHORT} then 1 else 0 end" if tiered else edits
    x = f"named_struct('longer', {longer}, 'shorter', slice({shorter}, 1, least(length({a}), length({b}))), 'd', abs(length({a}) - length({b})))"
    return F.expr(f"get(transform(array({x}), x -> aggregate(x.shorter, {start}, (s, c) -> if(s.n > {edits}, s, {step})).n <= {most}), 0)")


def _texts(documents: DataFrame, firsts: DataFrame, needed: DataFrame) -> DataFrame:
    """(h, line) of the needed hashes, each from the place where its line stands first, so only documents with such a line are cut.

    The places of needed lines are counted: up to ``BLOCKS`` blocks of ``BLOCK`` documents are broadcast, each for a
    scan of the documents, so that their texts are not shuffled. Spark may hold all blocks at once, so the bound is
    ``BLOCKS * BLOCK`` documents. More of them are joined by a shuffle.
    Rows of one doc_id may have different texts; the hash tells.
    """
    places = firsts.select("h", "doc_id", "line_no").join(needed, "h", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("h", "line_no")).alias("at"))
    places = staged(places, "places")
    blocks = -(-places.count() // BLOCK)
    own = documents.select("doc_id", "text").alias("docs")
    same = F.col("docs.doc_id").eqNullSafe(F.col("places.doc_id"))
    if 0 < blocks <= BLOCKS:
        parts = [places.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == i) for i in range(blocks)]
        joined = functools.reduce(DataFrame.union, [own.join(F.broadcast(part).alias("places"), same) for part in parts])
    else:
        joined = own.join(places.alias("places"), same)
    joined = joined.select("text", "at")
    # the text is split once, as the variable of the outer lambda
    found = F.transform(F.array(F.split("text", "\n")), lambda raw: F.transform("at", lambda p: F.struct(p["h"].alias("h"), _trimmed(F.get(raw, p["line_no"])).alias("line"))))
    return joined.select(F.explode(found[0]).alias("x")).select("x.h", "x.line").where(F.col("h") == _hashes()[0]).distinct()


def near_links(documents: DataFrame, firsts: DataFrame, edits: int) -> DataFrame:
    """(src, dst) hashes of different lines within ``edits``. firsts: h, doc_id, line_no, index, probe of each distinct line."""
    index = firsts.select(F.explode("index").alias("key"), "h").where("key is not null")
    probe = firsts.select(F.explode("probe").alias("key"), "h").where("key is not null")
    bucket = index.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n"))
    pairs_of = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("dst")
    met = staged(probe.join(bucket, "key").where("n > 2 or h <> lo or h <> hi"), "probes")
    full = staged(bucket.where("n > 1"), "buckets")
    few = met.where("n <= 2").select(F.col("h").alias("src"), pairs_of).union(full.where("n = 2").select(F.col("lo").alias("src"), F.col("hi").alias("dst")))
    few = staged(few.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "few")
    # keys of many lines: who stands in them and who probes them
    many = full.where("n > 2").select("key")
    inside = staged(index.join(many, "key"), "inside")
    asking = met.where("n > 2").select("key", "h").unionByName(inside)
    needed = few.select(F.col("src").alias("h")).union(few.select("dst")).union(asking.select("h")).union(inside.select("h"))
    texts = staged(_texts(documents, firsts, staged(needed.distinct(), "needed")), "line_texts")
    a, b = (texts.select(F.col("h").alias(x), F.col("line").alias(f"{x}_line")) for x in ("src", "dst"))
    linked = few.join(a, "src").join(b, "dst").where(within("src_line", "dst_line", edits, True)).select("src", "dst")
    # each edit changes at most two letter counts, so at most two bits of their parities
    bit = "aggregate(split(line, ''), 0L, (s, c) -> s ^ shiftleft(1L, cast(pmod(hash(c), 64) as int)))"
    sketched = texts.select("h", "line", F.expr(bit).alias("bits"))
    inside = inside.join(sketched, "h").select("key", F.col("h").alias("dst"), F.col("line").alias("dst_line"), F.col("bits").alias("dst_bits"))
    asking = asking.join(sketched, "h").select(F.col("key").alias("own"), F.col("h").alias("src"), F.col("line").alias("src_line"), F.col("bits").alias("src_bits"))
    close = F.bit_count(F.col("src_bits").bitwiseXOR(F.col("dst_bits"))) <= 2 * edits
    crowded = asking.join(inside, (F.col("own") == F.col("key")) & (F.col("src") != F.col("dst")) & close & within("src_line", "dst_line", edits, True))
    return linked.union(crowded.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))).distinct()


def classes(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, line_no, n_chars, first_doc, first_line, class_size, n_links) of every line of a class of several lines.

    The first line names the class. n_links: how many different lines are linked to the line's text. A line that
    has no row is a class of its own, without links.
    """
    index, probe = _keys(edits)
    every = lines(documents).withColumn("n", F.length("line"))
    place = F.struct("doc_id", "line_no", F.array(*index).alias("index"), F.array(*probe).alias("probe"))
    firsts = every.select(*_hashes(), place.alias("at")).groupBy("h", "g").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    firsts = staged(firsts.select("h", "g", "n", "at.*"), "firsts")
    links = staged(near_links(documents, firsts, edits), "line_links")
    degree = links.select(F.col("src").alias("h")).union(links.select("dst")).groupBy("h").agg(F.count("*").alias("n_links"))
    labels = components(links).withColumnRenamed("node", "h").join(degree, "h")
    named = firsts.select("h", "g", "n", F.struct("doc_id", "line_no").alias("at")).join(labels, "h", "left")
    named = named.select("h", "g", "n", "at", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "h").alias("c"), F.when(F.col("component").isNull(), F.col("g")).otherwise(F.lit(0)).alias("d"))
    grouped = named.groupBy("c", "d").agg(F.min("at").alias("first"), F.sum("n").alias("class_size")).where("class_size > 1")
    found = named.select("h", "g", "c", "d", "n_links").join(grouped, ["c", "d"]).select("h", "g", "first", "class_size", "n_links")
    own = every.select("doc_id", "line_no", F.col("n").alias("n_chars"), *_hashes())
    out = own.join(found, ["h", "g"])
    return out.select("doc_id", "line_no", "n_chars", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"), "class_size", "n_links")


def repeats(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """The rows of ``classes`` of every line that repeats an earlier one of its class."""
    return classes(documents, edits).where("struct(doc_id, line_no) <> struct(first_doc, first_line)")


def by_document(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, n_repeats, repeat_chars, repeats) of documents with repeats; repeats: (line_no, first_doc, first_line) in order."""
    found = repeats(documents, edits).distinct()
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_repeats"), F.sum("n_chars").alias("repeat_chars"), F.array_sort(F.collect_list(F.struct("line_no", "first_doc", "first_line"))).alias("repeats")
    )


def deduplicated(documents: DataFrame, edits: int = EDITS, max_share: float = MAX_SHARE) -> DataFrame:
    """The documents without their repeated lines, in the same columns; ``n_chars``, if there, follows the text.

    Lines that repeat a line of their own document always go. If more than ``max_share`` of the characters left are
    repeats of other documents' lines, those stay: the document is a copy of whole texts, which near-duplicate
    detection handles better than what would be left of it.
    """
    same = F.col("first_doc").eqNullSafe(F.col("doc_id"))
    met = repeats(documents, edits).distinct().groupBy("doc_id", "first_doc", "first_line").agg(
        F.min(F.struct("line_no", "n_chars")).alias("lead"), F.sum("n_chars").alias("chars"), F.collect_list("line_no").alias("all")
    )
    # the first line of a class that started in another document repeats that one, the class's further lines repeat their own document's
    split = met.select(
        "doc_id", "lead", (F.col("chars") - F.when(same, 0).otherwise(F.col("lead.n_chars"))).alias("own_chars"), F.when(~same, F.col("lead.n_chars")).otherwise(0).alias("other_chars"),
        F.when(same, F.col("all")).otherwise(F.array_remove("all", F.col("lead.line_no"))).alias("own"), F.when(~same, F.col("lead.line_no")).alias("other"),
    )
    found = split.groupBy("doc_id").agg(F.sum("own_chars").alias("own_chars"), F.sum("other_chars").alias("other_chars"), F.flatten(F.collect_list("own")).alias("own"), F.collect_list("other").alias("other"))
    found = staged(found, "repeats")
    # names are qualified, so the documents' own columns cannot clash with those of the repeats
    text = F.col("docs.text")
    few = f"reps.other_chars <= {max_share} * (length(docs.text) - reps.own_chars)"
    # the places that stay are a difference of sets, so the work grows with a document's lines and not with their square; the text is split once
    stay = f"array_except(sequence(0, size(raw) - 1), if({few}, concat(reps.own, reps.other), reps.own))"
    cut = F.expr(f"if(({few}) is null, null, array_join(get(transform(array(split(docs.text, '\n')), raw -> transform({stay}, i -> get(raw, i))), 0), '\n'))")
    new = {"text": F.coalesce("cut.text", text)}
    if "n_chars" in documents.columns:
        size = F.coalesce(F.length("cut.text"), F.length(text), F.col("docs.n_chars"))
        new["n_chars"] = size.cast(documents.schema["n_chars"].dataType)
    # the lists grow with the documents, so they are joined by a shuffle at any size
    own = documents.alias("docs").join(found.hint("shuffle_hash").alias("reps"), F.col("docs.doc_id").eqNullSafe(F.col("reps.doc_id")), "left")
    # the new text is a column of its own first, so that its length does not cut the text again
    own = own.select(F.struct(*[F.col(f"docs.`{c}`").alias(c) for c in documents.columns]).alias("docs"), F.struct(cut.alias("text")).alias("cut"))
    return own.select(*[new.get(c, F.col(f"docs.`{c}`")).alias(c) for c in documents.columns])
