"""Ranked lexical search: the best documents of many queries by TPUT over postings that are partitioned by term.

One scan of the texts writes each document's counts of the queries' terms. Those give the collection's figures (documents,
terms, document frequencies), with which the postings (term, document, weight times saturation) are written, each list in
descending order. Then, for each query that asks for k documents:

1. The heads, the first k of each of its lists, are fetched. The k-th best exact score among their documents is a lower bound.
2. Each list gives its entries of at least one uniform threshold, the largest for which what no list gives stays below that
   bound: the bound over the number of lists, or more where heads are lower. What a document has in these lists, with the
   threshold minus one (or the list's head, if that is less) for each other list, bounds its score. Documents below the
   k-th best sum are out.
3. The candidates left get exact scores from the documents' counts.

Lists are cut into chunks of at most about 1 / ``CHUNKS`` of all postings, so no term is in one task. Fetched entries are
dealt by document, where all sums are taken, so what is shuffled are entries, not entries times queries. Queries are taken in
blocks of at most ``BLOCK_TERMS`` terms, by measure; that bounds all that is broadcast or held by a task beside its rows. Each
block scans the documents once.

Edge cases: a null text has no terms; rows with one id, or none, are documents of their own, ranked by score, then id, then the
order in which they were written; the same holds for queries; a query without terms, or none of whose terms occurs with a
positive weight, gives no rows; ties at the last rank go to smaller ids; other columns are not read; texts have any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Tables, arrow, chunks

TOP = 10
#: Parts of all postings that a chunk of a list has at most, about, if it has over ``CHUNK_ROWS``[0]; never over [1].
CHUNKS = 1000
CHUNK_ROWS = (1000, 1_000_000)
#: Most (query, term) rows of a block of queries, but for a query that has more of its own: about 64 MB as a hash table.
BLOCK_TERMS = 500_000
#: Bytes of one text whose words are held at once.
PIECE = 1 << 22
BATCH_CHARS = 1 << 22
_SEPARATORS = b"".join(bytes(range(a, b + 1)) for a, b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)))
_TABLE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS)).lower()


def count_terms(data: bytes) -> Counter[bytes]:
    """Occurrences of each term of a text in UTF-8."""
    words, at, found = data.translate(_TABLE), 0, Counter()
    while at < len(words):
        end = words.find(b" ", at + PIECE) if at + PIECE < len(words) else len(words)
        end = len(words) if end < 0 else end
        found.update(words[at:end].split())
        at = end
    return found


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, terms) of each row: its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            terms = [[t.decode() for t in count_terms(x or b"")] for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["item_id", "terms"])

    return queries.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms array<string>")


def term_counts(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs): the number of all terms of each text, and its counts of ``terms``, by their places in that list."""
    place = {t.encode(): i for i, t in enumerate(terms)}
    fields = {"doc_id": pa.int64(), "n": pa.int64(), "terms": pa.list_(pa.int32()), "tfs": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts, BATCH_CHARS):
                out: dict[str, list] = {k: [] for k in fields}
                out["doc_id"] = ids[a:b].to_pylist()
                for data in texts[a:b]:
                    found = count_terms(data or b"")
                    mine = [(place[t], c) for t, c in found.items() if t in place]
                    out["n"].append(found.total())
                    out["terms"].append([i for i, _ in mine])
                    out["tfs"].append([c for _, c in mine])
                yield arrow(fields, out)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _weight(df: Column, documents: int) -> Column:
    return F.floor(1000 * F.log((2 * documents + 2) / (2 * df + 1).cast("double"))).cast("long")


def _part(documents: int, length: int) -> Column:
    """A term's part of a document's score. The length's share is taken in decimals of 38 digits, the rest in 64-bit integers."""
    m = f"(10 + ((cast(90 * n as decimal(38, 0)) * {documents}L) div {max(1, length)}L))"
    return F.expr(f"weight * ((1000000000L * tf) div (1000 * tf + 8 * {m}))")


def _kth(df: DataFrame, value: str, k: int) -> DataFrame:
    """(_query, kth): the k-th largest ``value`` of each query, 0 if it has fewer. Tasks pass on k rows a query."""
    best = Window.partitionBy("_query").orderBy(F.desc(value))
    top = df.withColumn("_i", F.row_number().over(best)).where(F.col("_i") <= k)
    return top.groupBy("_query").agg(F.coalesce(F.max(F.when(F.col("_i") == k, F.col(value))), F.lit(0)).alias("kth"))


class Index:
    """Postings of a block of queries in written tables.

    queries: (_query, term), each term once a query, of at most about ``BLOCK_TERMS`` rows. documents: (_doc, doc_id, n, terms,
    tfs). postings: (term, chunk, place, _doc, part). A term is its place in the sorted list of the block's terms.
    """

    def __init__(self, documents: DataFrame, queries: DataFrame, tables: Tables):
        self.tables = tables
        names = sorted(r[0] for r in queries.select("term").distinct().collect())
        ids = tables.spark.createDataFrame(list(enumerate(names)), "id int, term string")
        self.queries = tables.write(queries.join(F.broadcast(ids), "term").select("_query", F.col("id").alias("term")), "queries")
        counted = term_counts(documents, names).withColumn("_doc", F.monotonically_increasing_id())
        self.documents = tables.write(counted.where("n > 0"), "documents")
        n, length = self.documents.agg(F.count("*"), F.sum("n")).first()
        self.n, self.length = n, length or 0
        entries = self.documents.select("_doc", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("_doc", "n", F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))
        found = entries.groupBy("term").agg(F.count("*").alias("df")).withColumn("weight", _weight(F.col("df"), n)).collect()  # at most one a term
        per = min(max(sum(r["df"] for r in found) // CHUNKS, CHUNK_ROWS[0]), CHUNK_ROWS[1])
        self.weights = [(r["term"], r["weight"]) for r in found if r["weight"] > 0]
        known = tables.spark.createDataFrame([(r["term"], r["weight"], -(-r["df"] // per)) for r in found if r["weight"] > 0], "term int, weight long, chunks long")
        parts = entries.join(F.broadcast(known), "term").select("term", F.pmod(F.xxhash64("_doc"), F.col("chunks")).alias("chunk"), "_doc", _part(self.n, self.length).alias("part"))
        descending = Window.partitionBy("term", "chunk").orderBy(F.desc("part"), "_doc")
        self.postings = tables.write(parts.where("part > 0").withColumn("place", F.row_number().over(descending)), "postings")
        self.scored = self._scorer()

    def heads(self, k: int) -> DataFrame:
        """(term, place, _doc, part): the first k of each list, from the first k of its chunks."""
        best = Window.partitionBy("term").orderBy(F.desc("part"), "_doc")
        return self.postings.where(F.col("place") <= k).select("term", "_doc", "part", F.row_number().over(best).alias("place")).where(F.col("place") <= k)

    def _scorer(self):
        """Reads (_doc, doc_id, n, terms, tfs, queries) and gives (_query, _doc, doc_id, score) for the queries of each row."""
        weight = np.zeros(max((t for t, _ in self.weights), default=0) + 2, np.int64)
        for t, w in self.weights:
            weight[t] = w
        asked = sorted((r["term"], r["_query"]) for r in self.queries.collect() if r["term"] < len(weight))
        terms, names = (np.array([r[i] for r in asked], np.int64) for i in (0, 1))
        names, code = np.unique(names, return_inverse=True)
        begin = np.searchsorted(terms, np.arange(len(weight) + 1))
        n_docs, length = self.n, self.length
        fields = {"_query": pa.int64(), "_doc": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}

        def score(n: int, own: np.ndarray, tf: np.ndarray) -> np.ndarray:
            own, tf = own[own < len(weight)], tf[own < len(weight)]
            part = weight[own] * (1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * n * n_docs // length)))
            sizes = begin[own + 1] - begin[own]
            at = np.repeat(begin[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            out = np.zeros(len(names), np.int64)
            np.add.at(out, code[at], np.repeat(part, sizes))
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    doc, doc_id, n, own, tf, queries = (batch.column(c)[i] for c in range(6))
                    wanted = np.searchsorted(names, queries.values.to_numpy())
                    found = score(n.as_py(), own.values.to_numpy(), tf.values.to_numpy())[wanted]
                    rows = len(wanted)
                    yield pa.RecordBatch.from_arrays([queries.values, pa.array([doc.as_py()] * rows, pa.int64()), pa.array([doc_id.as_py()] * rows, pa.int64()), pa.array(found)], names=list(fields))

        return run

    def exact(self, pairs: DataFrame) -> DataFrame:
        """(_query, _doc, doc_id, score) of distinct (_query, _doc): a look-up in each document's counts. Up to ``BROADCAST_IDS`` documents are joined by broadcast."""
        wanted = self.tables.write(pairs.groupBy("_doc").agg(F.collect_list("_query").alias("queries")), f"wanted{len(self.tables.names)}")
        small = wanted.agg(F.sum(1 + F.size("queries"))).first()[0] or 0
        joined = self.documents.join(F.broadcast(wanted) if small <= BROADCAST_IDS else wanted, "_doc")
        return joined.select("_doc", "doc_id", "n", "terms", "tfs", "queries").mapInArrow(self.scored, "_query long, _doc long, doc_id long, score long")


def bounds(index: Index, k: int) -> DataFrame:
    """(_query, term, kth, least, other): phase 1. Entries of at least ``least`` are fetched from a list; others are at most ``other``.

    Lists by ascending heads: if the first i give their heads and the others t each, that is below kth for t up to
    (kth - 1 - those heads) div the number of others; the largest such t is the threshold minus one.
    """
    heads = index.tables.write(index.heads(k), "heads")
    asked = F.broadcast(index.queries)
    lower = _kth(index.exact(heads.join(asked, "term").select("_query", "_doc").distinct()), "score", k)
    tops = heads.where("place = 1").select("term", F.col("part").alias("top"))
    lists = tops.join(asked, "term").join(lower, "_query")
    up = Window.partitionBy("_query").orderBy("top", "term")
    lower_heads = F.coalesce(F.sum("top").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.count("*").over(Window.partitionBy("_query")) - F.row_number().over(up) + 1
    each = lists.withColumn("_heads", lower_heads).withColumn("_others", others).withColumn("_t", F.expr("(kth - 1 - _heads) div _others"))
    least = F.greatest(F.lit(1), 1 + F.max("_t").over(Window.partitionBy("_query")))
    return each.withColumn("least", least).select("_query", "term", "kth", "least", F.least(F.col("least") - 1, F.col("top")).alias("other"))


def candidates(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(_query, _doc): phase 2. asked: what ``bounds`` gives, a written table.

    A list's entries are fetched from its least threshold of all queries on, then for each query that has the term.
    """
    least = asked.groupBy("term").agg(F.min("least").alias("_least"))
    fetched = index.postings.join(F.broadcast(least), "term").where(F.col("part") >= F.col("_least")).select("term", "_doc", "part").repartition("_doc")
    # sums of a document are taken where its entries are
    mine = fetched.join(F.broadcast(asked.select("term", "_query", "least", "other")), "term").where(F.col("part") >= F.col("least"))
    sums = mine.groupBy("_query", "_doc").agg(F.sum("part").alias("sum"), F.sum(F.col("part") - F.col("other")).alias("above"))
    rest = index.tables.write(asked.groupBy("_query").agg(F.sum("other").alias("rest"), F.max("kth").alias("kth")), "rest")
    bounded = sums.join(F.broadcast(rest), "_query").withColumn("most", F.col("above") + F.col("rest"))
    able = index.tables.write(bounded.where(F.col("most") >= F.col("kth")).select("_query", "_doc", "sum", "most"), "able")
    better = index.tables.write(_kth(able, "sum", k), "better")
    return able.join(F.broadcast(better), "_query").where(F.col("most") >= F.col("kth")).select("_query", "_doc")


def _blocks(terms: DataFrame) -> list[DataFrame]:
    """The queries dealt to blocks of at most ``BLOCK_TERMS`` rows, if no query alone has more."""
    total, largest = terms.count(), terms.groupBy("_query").count().agg(F.max("count")).first()[0] or 0
    n = -(-total // BLOCK_TERMS)
    while n:
        block = F.pmod(F.xxhash64("_query"), F.lit(n))
        if terms.groupBy(block.alias("b")).count().agg(F.max("count")).first()[0] <= max(BLOCK_TERMS, largest):
            return [terms.where(block == b) for b in range(n)]
        n *= 2
    return []


def search(documents: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query with a score above 0. documents: doc_id, text; queries: item_id, text."""
    shared = Tables(documents.sparkSession)
    items = shared.write(query_terms(queries).withColumn("_query", F.monotonically_increasing_id()), "items")
    terms = shared.write(items.select("_query", F.explode("terms").alias("term")), "terms")
    out = []
    for number, block in enumerate(_blocks(terms)):
        tables = Tables(documents.sparkSession)
        index = Index(documents, block, tables)
        asked = tables.write(bounds(index, k), "bounds")
        pairs = tables.write(candidates(index, asked, k), "candidates")
        best = Window.partitionBy("_query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "_doc")
        top = index.exact(pairs).where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out.append(shared.write(top.join(items.select("_query", "item_id"), "_query").select("item_id", "rank", "doc_id", "score"), f"result{number}"))
        tables.keep()
    shared.keep(*(f"result{i}" for i in range(len(out))))
    if not out:
        return documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
