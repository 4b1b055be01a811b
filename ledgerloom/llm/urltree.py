"""URL verdicts by a path-template tree, in DataFrame operations only.

Fixed rules come first. For the rest, each host's paths form a tree of templates:

1. A segment with a digit, or of ``LONG`` and more characters, is a wildcard ``*``. All further work is on the
   counts of (host, template), not on pages.
2. Level by level, a node with at least ``MANY`` different literal children that have fewer than two pages each on
   average gets one wildcard child instead.
3. Templates of a host that differ in literals only have one shape (literals as ``+``). A branch whose share
   of blocked labels lies within ``Z`` standard errors of its shape's is merged into the shape.
4. A template's purity is its unit's share of blocked labels, smoothed towards its shape's share on the host, which is
   smoothed towards the same template's share on all hosts, and that towards none blocked. A branch without labels thus
   backs off to its siblings and, on hosts without labels, to its namesakes elsewhere; without any evidence it is allowed.
   Templates of at least ``REJECT`` are blocked.

Labels are the rules' own verdicts unless a table of labels is given.

Edge cases: a null url, or one without ``://``, has empty host and path and the empty template; without any label
everything is allowed; equal urls get equal verdicts; an empty table gives no
rows; urls of any length and depth are whole. Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
LONG = 24
MANY = 20
Z = 1.96
WEIGHT = 5.0
#: On hosts whose labels were held out this rejected nothing wrongly; lower values are often more accurate and reject wrongly, see the README.
REJECT = 0.7

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every page."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    own = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    host = F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return own.select("page_id", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def _ruled(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict. A rule list is a parameter, so it becomes one expression."""
    name = verdict = F.lit(None).cast("string")
    for host, path, say in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, say).otherwise(verdict)
    return name, verdict


def _template() -> Column:
    return F.array_join(F.transform(F.split("path", "/"), lambda s: F.when(s.rlike("[0-9]") | (F.length(s) >= LONG), "*").otherwise(s)), "/")


def _levels(own: DataFrame) -> list[int]:
    """Levels of the tree, from 2, at which a node can have ``MANY`` different literal children."""
    segments = own.select(F.posexplode("now").alias("at", "seg")).where("at > 0 and seg <> '*'").distinct()
    return sorted(r["at"] + 1 for r in segments.groupBy("at").count().where(F.col("count") >= MANY).collect())


def tree(counts: DataFrame) -> DataFrame:
    """(host, template, unit, purity) of templates given as (host, template, n, labelled, blocked)."""
    own = staged(counts.withColumn("now", F.split("template", "/")), "templates")
    for d in _levels(own):  # the first segment is what stands before the first slash
        deep = own.withColumn("node", F.array_join(F.slice("now", 1, d - 1), "/")).withColumn("seg", F.when(F.size("now") >= d, F.get("now", F.lit(d - 1))))
        nodes = deep.where("seg <> '*'").groupBy("host", "node", "seg").agg(F.sum("n").alias("n")).groupBy("host", "node").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
        wide = staged(nodes.where((F.col("k") >= MANY) & (F.col("k") * 2 > F.col("n"))).select("host", "node", F.lit(True).alias("wide")), "wide")
        if not wide.limit(1).count():
            continue
        now = F.when(F.col("wide") & F.col("seg").isNotNull(), F.concat(F.slice("now", 1, d - 1), F.array(F.lit("*")), F.expr(f"slice(now, {d + 1}, greatest(size(now) - {d}, 0))"))).otherwise(F.col("now"))
        own = staged(deep.join(wide, ["host", "node"], "left").withColumn("now", now).drop("node", "seg", "wide"), "templates")
    shape = F.array_join(F.transform("now", lambda s: F.when((s == "*") | (s == ""), s).otherwise("+")), "/")
    own = own.select("host", "template", F.array_join("now", "/").alias("branch"), shape.alias("shape"), "labelled", "blocked")

    def sums(n: str, x: str, to: str) -> list[Column]:
        return [F.sum(n).alias(f"{to}n"), F.sum(x).alias(f"{to}x")]

    branches = own.groupBy("host", "shape", "branch").agg(*sums("labelled", "blocked", "b"))
    shapes = branches.groupBy("host", "shape").agg(*sums("bn", "bx", "s"))
    namesakes = branches.groupBy("branch").agg(*sums("bn", "bx", "t"))
    share, pooled = F.try_divide("bx", "bn"), F.try_divide("sx", "sn")
    near = F.coalesce(F.abs(share - pooled) <= Z * F.sqrt(pooled * (1 - pooled) / F.col("bn")), F.lit(False))
    units = branches.join(shapes, ["host", "shape"]).withColumn("unit", F.when(near, F.col("shape")).otherwise(F.col("branch")))
    merged = units.groupBy("host", "shape", "unit").agg(*sums("bn", "bx", "u"))
    everywhere = F.col("tx") / (F.col("tn") + 2.0)
    siblings = (F.col("sx") + WEIGHT * everywhere) / (F.col("sn") + WEIGHT)
    purity = (F.col("ux") + WEIGHT * siblings) / (F.col("un") + WEIGHT)
    judged = units.join(merged, ["host", "shape", "unit"]).join(namesakes, "branch").select("host", "shape", "branch", "unit", purity.alias("purity"))
    named = own.select("host", "template", "shape", "branch").join(judged, ["host", "shape", "branch"])
    return named.select("host", "template", "unit", "purity")


def verdicts(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    labels: (page_id, blocked boolean); by default what the rules say. Pages meet the templates in one join on (host,
    template); the template side has one row for each, so a host with a third of all pages is split by Spark's
    skew handling without copying anything large.
    """
    name, say = _ruled(rules)
    own = parts(pages).select("page_id", "host", "path", name.alias("rule"), say.alias("said"), _template().alias("template"))
    if labels is None:
        seen = own.select("host", "template", F.when(F.col("said").isNotNull(), F.col("said") == "block").alias("bad"))
    else:
        given = labels.where("blocked is not null").groupBy("page_id").agg(F.bool_or("blocked").alias("bad"))
        seen = own.join(given, "page_id", "left").select("host", "template", "bad")
    counts = seen.groupBy("host", "template").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("blocked"))
    out = own.join(tree(counts), ["host", "template"])
    verdict = F.coalesce("said", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("unit").alias("template"), F.round("purity", 6).alias("purity"))
