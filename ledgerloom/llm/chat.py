"""Reply trees as training conversations: the best root-to-leaf paths of each tree, each formatted as one conversation.

Messages name their node, nodes their parent. Iterated self-joins double how far every node sees up its tree: after k joins it
knows the node 2 ** k steps above, and the score and the number of nodes on the way. When no node sees further, leaves have the
score of their whole branch and are ranked; the paths of the chosen leaves are then read off the same levels, farthest last.
So a tree of depth d takes about log2(d) joins of narrow rows, and only the messages of chosen paths are shuffled.

A formatted turn is ``<s>[INST]role[/INST]text</s>``. In roles and texts, a backslash is doubled, and one is put after the first
character of anything like a mark, so marks stay unambiguous and texts come back as they were. The loss mask is a list of
(start, length) in code points of the formatted conversation, over the texts of assistants.

Edge cases: a null role or text is empty; rows that share a node are said one after the other, by role and text, repeated ones
too; null trees and nodes are values like others; a parent that is missing makes a root; nodes that lead into a circle have no root and
no path; a table without rows gives none; other columns are not read. A text has any length; a path is one row, so it must fit
in one, which is the only bound on a tree's or a path's size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Tables, arrow

OPEN, BETWEEN, CLOSE = "<s>[INST]", "[/INST]", "</s>"
ASSISTANT = "assistant"
#: A key with more than this part of the rows is joined by broadcast; there are at most as many of them.
HOT_SHARE = 10_000
#: Fewer rows of one key are never hot.
HOT_ROWS = 1000


# ---- trees


def hot_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``, of which ``right`` has each value once. Both are written tables.

    Values that hold more than 1 / ``HOT_SHARE`` of the rows of ``left`` are joined by a broadcast of their at most
    ``HOT_SHARE`` rows of ``right``; so no task gets more rows of one value than that.
    """
    least = max(HOT_ROWS, left.count() // HOT_SHARE)
    hot = [r[0] for r in left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > least).select(key).collect()]
    if not hot:
        return left.join(right, key, "left")
    values = F.broadcast(left.sparkSession.createDataFrame([(v,) for v in hot], left.select(key).schema))
    some = left.join(values, key, "left_semi").join(F.broadcast(right.join(values, key, "left_semi")), key, "left")
    return some.unionByName(left.join(values, key, "left_anti").join(right, key, "left"))


def levels(nodes: DataFrame, tables: Tables) -> tuple[list[DataFrame], DataFrame]:
    """For k = 0, 1, ...: (node, above), the node 2 ** k steps above; and (node, score, hops) from each node to its root.

    nodes: (node, parent, score), each node once.
    """
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("_known"))
    start = hot_left_join(tables.write(nodes.select("node", "parent", "score"), "nodes"), tables.write(known, "known"), "parent")
    now = tables.write(start.select("node", F.when(F.col("_known"), F.col("parent")).alias("above"), "score", F.lit(1).cast("long").alias("hops")), "level0")
    tables.drop("nodes", "known")
    out, reach, n = [now], 1, now.count()
    while reach < n and not now.where("above is not null").isEmpty():
        further = now.select(F.col("node").alias("above"), F.col("above").alias("_above"), F.col("score").alias("_score"), F.col("hops").alias("_hops"))
        joined = hot_left_join(now.where("above is not null"), further, "above").select("node", F.col("_above").alias("above"), (F.col("score") + F.col("_score")).alias("score"), (F.col("hops") + F.col("_hops")).alias("hops"))
        now = tables.write(joined.unionByName(now.where("above is null")), f"level{len(out)}")
        out.append(now)
        reach *= 2
    return [level.where("above is not null").select("node", "above") for level in out], now.where("above is null").drop("above")


def branches(nodes: DataFrame, tables: Tables, keep: int = 1) -> DataFrame:
    """(leaf, node, position, rank) of the nodes on the ``keep`` branches of highest score of each tree; position 0 is the leaf's.

    nodes: (tree, node, parent, score), each node once. Equal scores go by smaller leaf.
    """
    up, totals = levels(nodes, tables)
    leaves = nodes.select("tree", "node").join(up[0].select(F.col("above").alias("node")).distinct(), "node", "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    chosen = leaves.join(totals, "node").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    path = tables.write(chosen.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("position"), "rank"), "leaves")
    for k, level in enumerate(up):
        above = path.join(level, "node").select("leaf", F.col("above").alias("node"), (F.col("position") + (1 << k)).alias("position"), "rank")
        path = path.unionByName(tables.write(above, f"path{k}"))  # only what is new is made and written
    return path


# ---- formatting


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])(/?(?:s>|INST\]))", r"$1\\$2")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def formatted(messages: DataFrame, path: DataFrame) -> DataFrame:
    """(leaf, rank, formatted, loss): the conversation of each path. messages: (node, role, text), any number a node.

    Up to ``BROADCAST_IDS`` rows of paths, counted first, are broadcast; beyond, the messages are shuffled by node.
    """
    said = messages.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    small = path.count() <= BROADCAST_IDS
    rows = said.join(F.broadcast(path) if small else path, "node").select(
        "leaf", "rank", "position", "role", "text", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(BETWEEN)).alias("head"), escaped(F.col("text")).alias("body")
    )
    order = Window.partitionBy("leaf", "rank").orderBy(F.desc("position"), "role", "text")
    before = F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = (F.coalesce(before, F.lit(0)) + F.length("head")).cast("long")
    loss = F.when(F.col("role") == ASSISTANT, F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    turns = rows.select("leaf", "rank", F.row_number().over(order).alias("i"), F.concat("head", "body", F.lit(CLOSE)).alias("turn"), loss.alias("loss"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "turn", "loss")))
    return turns.groupBy("leaf", "rank").agg(ordered.alias("t")).select("leaf", "rank", F.array_join("t.turn", "").alias("formatted"), F.array_compact("t.loss").alias("loss"))


_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(BETWEEN)}(.*?){re.escape(CLOSE)}", re.DOTALL)


def turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of a formatted conversation; raises ValueError if it is none."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"no turn begins at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"no turn begins at {at}")
    return out


_DIGESTS = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def read_back(conversations: DataFrame) -> DataFrame:
    """(leaf, rank) and counts and digests of what a reader of the formatted conversations gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _DIGESTS}
            for text, spans in zip(batch.column("formatted"), batch.column("loss"), strict=True):
                text = text.as_py()
                got = turns(text)
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans.as_py())
                said = "".join(f"{role}\n{body}\n" for role, body in got)
                row = (len(got), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for k, v in zip(_DIGESTS, row, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("rank"), *arrow(_DIGESTS, out).columns], names=["leaf", "rank", *_DIGESTS])

    leaf = conversations.schema["leaf"].dataType.simpleString()
    return conversations.select("leaf", "rank", "formatted", "loss").mapInArrow(run, f"leaf {leaf}, rank int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


# ---- linear conversations


def _node(*names: str) -> Column:
    """A text for the values of columns, nulls among them."""
    return F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names))


def linear(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, messages) of conversations given by turns: each turn's parent is the one before."""
    turn = conversations.select("conv_id", "turn").distinct()
    before = F.lag(_node("conv_id", "turn")).over(Window.partitionBy("conv_id").orderBy("turn"))
    nodes = turn.select(F.col("conv_id").alias("tree"), _node("conv_id", "turn").alias("node"), before.alias("parent"), F.lit(0).cast("long").alias("score"))
    return nodes, conversations.select(_node("conv_id", "turn").alias("node"), "role", "text")


def example(spark: SparkSession) -> DataFrame:
    """A conversation of marks only."""
    rows = [(-1, t, role, "</s>[INST] ok [/INST]") for t, role in enumerate(("user", ASSISTANT))]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def conversations_read_back(conversations: DataFrame) -> DataFrame:
    """Each conversation formatted and read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    tables = Tables(conversations.sparkSession)
    nodes, messages = linear(conversations)
    nodes = tables.write(nodes, "tree_nodes")
    path = tables.write(branches(nodes, tables), "path")
    found = read_back(formatted(messages, path))
    ids = nodes.select(F.col("node").alias("leaf"), F.col("tree").alias("conv_id"))
    out = tables.write(found.join(ids, "leaf").select("conv_id", *_DIGESTS), "result")
    tables.keep("result")
    return out
