"""The registered queries of the analytics operators over the driver's tables, each with equivalent SQL where SQL can say it.

The tables stand in for trial data: a block is an order status, a user or a conversation, a condition an event type or a
priority, a run an order, a steering scale a line number, a pair's roles two statuses or two speakers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import answers, coerce, prompts, text
from .operators import overlap, pairs, partitioning, progress, ranks, regression, reorganize, robust, trials, vectors
from .plans import generation

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(x: str, digits: int = 4) -> F.Column:
    return F.round(F.col(x).cast("double"), digits).alias(x)


@_query("""
SELECT user_id, event_type, event_id, value, props, CAST(row_number() OVER (ORDER BY user_id, event_type) AS BIGINT) AS trial_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value IS NOT NULL) DESC, length(coalesce(props, '')) DESC, event_id) AS k FROM events
) WHERE k = 1
""")
def q01_best_row_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best event of each user and type, renumbered."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "props")
    quality = [F.col("value").isNotNull().cast("int"), F.length(F.coalesce("props", F.lit("")))]
    best = trials.best_rows(e, ["user_id", "event_type"], quality, ["event_id"])
    return ranks.numbered(best, [F.col("user_id"), F.col("event_type")], "trial_id")


@_query("""
WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY ALL),
t AS (SELECT s, min(n) AS least, CASE WHEN min(n) < 25 THEN min(n) ELSE CAST(floor(min(n) / 25) AS BIGINT) * 25 END AS target FROM c GROUP BY s),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS i FROM orders)
SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS kept, CAST(max(o_orderkey) AS BIGINT) AS last_run, round(sum(o_totalprice), 2) AS total
FROM k JOIN t ON o_orderstatus = s WHERE i <= target GROUP BY ALL
""")
def q02_balanced_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal numbers of first runs per condition of a block, rounded down to a step."""
    o = _read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_orderkey") + 1).alias("run"), "o_totalprice")
    kept = trials.balanced(o, ["o_orderstatus"], "o_orderpriority", "run", 25)
    total = F.round(F.sum("o_totalprice"), 2).alias("total")
    return kept.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("kept"), (F.max("run") - 1).alias("last_run"), total)


@_query("""
WITH b AS (
  SELECT o_custkey, count(*) AS n_rows, count(DISTINCT o_orderpriority) AS n, bool_or(o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) AS other,
    bool_or(o_totalprice > 450000) AS drift FROM orders GROUP BY o_custkey
)
SELECT o_custkey, CAST(n_rows AS BIGINT) AS n_rows, CAST(n AS BIGINT) AS n_conditions, n <> 5 OR other AS schema_legacy, drift AS prompt_legacy FROM b
""")
def q03_block_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders do not cover all priorities, or contain a drifted row."""
    o = _read(spark, sf_dir, "orders").withColumn("drift", F.col("o_totalprice") > 450000)
    return partitioning.block_flags(o, ["o_custkey"], "o_orderpriority", list(PRIORITIES), "drift")


@_query("""
SELECT p.o_orderpriority AS condition, CAST(r AS BIGINT) AS run_number FROM (SELECT DISTINCT o_orderpriority FROM orders) p, range(1, 201) t(r)
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = p.o_orderpriority AND o.o_orderkey = r)
""")
def q04_resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs 1 to 200 of every condition that are not done."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("condition"), F.col("o_orderkey").alias("run_number"))
    return trials.missing_runs(o, 200, o)


_PROGRESS = """
WITH per AS (SELECT user_id, event_type, count(*) AS n_rows, count(DISTINCT CASE WHEN event_id > 0 THEN event_id END) AS have FROM events GROUP BY ALL),
grid AS (SELECT u.user_id, e.c, coalesce(per.have, 0) AS have FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) e(c)
  LEFT JOIN per ON per.user_id = u.user_id AND per.event_type = e.c),
short AS (SELECT *, 14 - have AS d, row_number() OVER (PARTITION BY user_id ORDER BY have, c) AS k FROM grid WHERE have < 14),
top AS (SELECT user_id, string_agg(c || ':' || d, ',' ORDER BY k) AS top_deficits FROM short WHERE k <= 3 GROUP BY user_id),
g AS (SELECT user_id, sum(least(have, 14)) AS done, coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE have = 0), '') AS missing FROM grid GROUP BY user_id),
p AS (SELECT user_id, sum(n_rows) AS n_rows, sum(have) AS runs, count(*) FILTER (WHERE have > 0) AS covered, min(have) FILTER (WHERE have > 0) AS lo, max(have) AS hi FROM per GROUP BY user_id),
progress AS (SELECT user_id, CAST(n_rows AS BIGINT) AS n_rows, CAST(runs AS BIGINT) AS total_unique_runs, CAST(covered AS BIGINT) AS covered_conditions, CAST(coalesce(lo, 0) AS BIGINT) AS per_condition_min,
  CAST(hi AS BIGINT) AS per_condition_max, CAST(70 - done AS BIGINT) AS remaining_to_target, round(done * 100.0 / 70, 4) AS progress_pct, missing = '' AND covered = 5 AS schema_ok,
  missing AS missing_conditions, coalesce(top_deficits, '') AS top_deficits FROM p JOIN g USING (user_id) LEFT JOIN top USING (user_id))
"""


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.block_progress(_read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", list(EVENT_TYPES), 14)


@_query(_PROGRESS + "SELECT * FROM progress")
def q05_block_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of each block towards the target per condition."""
    return _progress(spark, sf_dir).withColumn("progress_pct", F.round("progress_pct", 4))


@_query(_PROGRESS + """SELECT user_id % 10 AS model, CAST(count(*) AS BIGINT) AS blocks, CAST(count(*) FILTER (WHERE remaining_to_target = 0 AND schema_ok) AS BIGINT) AS complete_blocks,
CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(total_unique_runs) AS BIGINT) AS runs, CAST(sum(remaining_to_target) AS BIGINT) AS remaining FROM progress GROUP BY ALL""")
def q06_progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollup of block progress by model (A10)."""
    return progress.by_group(_progress(spark, sf_dir).withColumn("model", F.col("user_id") % 10), "model")


@_query("""
SELECT c_custkey, c_mktsegment, c_acctbal, CAST(row_number() OVER (ORDER BY lower(c_mktsegment), c_acctbal DESC, c_custkey) AS BIGINT) AS row_id FROM customer
""")
def q07_multi_key_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable reordering by segment and falling balance, renumbered."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    cells = c.withColumns({"segment": F.col("c_mktsegment"), "balance": F.col("c_acctbal").cast("string")})
    return reorganize.reorder(cells, ["segment"], ["balance"], ["balance"], "c_custkey", "row_id").select("c_custkey", "c_mktsegment", "c_acctbal", "row_id")


@_query("""
SELECT CAST(l_linenumber AS INTEGER) AS scale, CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'scale' END AS group_type,
  CASE WHEN grouping(l_returnflag) = 0 THEN l_returnflag WHEN grouping(l_linestatus) = 0 THEN l_linestatus ELSE 'all' END AS group_value,
  CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE l_discount < 0.05) AS BIGINT) AS compliant, round(1 - count(*) FILTER (WHERE l_discount < 0.05) / count(*), 6) AS noncompliance_rate
FROM lineitem GROUP BY GROUPING SETS ((l_linenumber), (l_linenumber, l_returnflag), (l_linenumber, l_linestatus))
""")
def q08_compliance_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compliance by scale and by two groups within it."""
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("scale"), "l_returnflag", "l_linestatus", (F.col("l_discount") < 0.05).alias("ok"))
    return pairs.compliance(li, "scale", ["l_returnflag", "l_linestatus"], "ok").withColumn("noncompliance_rate", F.round("noncompliance_rate", 6))


@_query("""
SELECT event_type AS condition, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE value > 10) AS BIGINT) AS wager_rows, round(avg(value) FILTER (WHERE value > 10), 4) AS mean_wager,
  array_to_string(list_sort(list(DISTINCT CAST(user_id % 7 AS VARCHAR))), ',') AS models FROM events GROUP BY event_type
""")
def q09_condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts and means with the sorted distinct models of each condition."""
    e = _read(spark, sf_dir, "events")
    ok = F.col("value") > 10
    models = F.array_join(F.sort_array(F.collect_set((F.col("user_id") % 7).cast("string"))), ",")
    return e.groupBy(F.col("event_type").alias("condition")).agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("wager_rows"), F.round(F.avg(F.when(ok, F.col("value"))), 4).alias("mean_wager"), models.alias("models"))


_PAIRS = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderstatus IN ('F', 'O')),
pair AS (SELECT a.o_custkey, a.o_orderpriority, a.o_totalprice AS pf, b.o_totalprice AS po, b.o_totalprice - a.o_totalprice AS delta
  FROM r a JOIN r b ON a.o_custkey = b.o_custkey WHERE a.k = 1 AND b.k = 1 AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O')
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return pairs.pivot_pairs(o, "o_custkey", "o_orderstatus", ("F", "O"), ["o_totalprice"], "o_orderkey", ["o_orderpriority"]).withColumnRenamed("o_totalprice_delta", "delta")


@_query(_PAIRS + "SELECT o_custkey, o_orderpriority, pf AS o_totalprice_F, po AS o_totalprice_O, round(delta, 4) AS delta FROM pair")
def q10_pair_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of complete pairs, the last row of a role counting."""
    return _pairs(spark, sf_dir).withColumn("delta", F.round("delta", 4))


@_query(_PAIRS + """
SELECT 'o_orderpriority' AS key, o_orderpriority AS value, CAST(count(*) AS BIGINT) AS pairs, round(avg(delta), 4) AS mean_delta FROM pair GROUP BY o_orderpriority
UNION ALL SELECT 'bucket', CAST(o_custkey % 3 AS VARCHAR), CAST(count(*) AS BIGINT), round(avg(delta), 4) FROM pair GROUP BY o_custkey % 3
""")
def q11_pair_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean deltas by several grouping columns in one pass."""
    own = _pairs(spark, sf_dir).withColumn("bucket", F.col("o_custkey") % 3)
    return pairs.group_means(own, ["o_orderpriority", "bucket"], ["delta"]).withColumn("mean_delta", F.round("mean_delta", 4))


@_query(_PAIRS + "SELECT CAST(count(*) AS BIGINT) AS n, round(corr(pf, po), 6) AS r FROM pair")
def q12_pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation of the two roles."""
    return pairs.correlation(_pairs(spark, sf_dir), "o_totalprice_F", "o_totalprice_O").withColumn("r", F.round("r", 6))


@_query("""
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT CAST(count(*) AS BIGINT) AS n, round(corr(a, b), 6) AS r FROM r
""")
def q13_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman correlation by average ranks."""
    return pairs.spearman(_read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 6))


@_query("""
WITH d AS (SELECT b.l_linenumber AS scale, b.l_quantity - a.l_quantity AS q, b.l_extendedprice - a.l_extendedprice AS e
  FROM (SELECT l_orderkey, any_value(l_quantity) AS l_quantity, any_value(l_extendedprice) AS l_extendedprice, any_value(l_discount) AS l_discount FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey HAVING count(*) = 1) a
  JOIN (SELECT * FROM lineitem WHERE l_linenumber > 1) b USING (l_orderkey) WHERE a.l_discount < 0.09 AND b.l_discount < 0.09)
SELECT CAST(scale AS INTEGER) AS scale, CAST(count(*) AS BIGINT) AS n, round(avg(q), 4) AS mean_l_quantity_delta, round(median(q), 4) AS median_l_quantity_delta, round(avg(e), 4) AS mean_l_extendedprice_delta, round(median(e), 4) AS median_l_extendedprice_delta
FROM d GROUP BY scale
""")
def q14_matched_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas to the base scale of the same key (J7, A18); keys with several base rows are left out here, as their order is undefined."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("scale"), "l_quantity", "l_extendedprice", (F.col("l_discount") < 0.09).alias("valid"))
    one = li.where("scale = 1").groupBy("l_orderkey").count().where("count = 1").select("l_orderkey")
    out = pairs.matched_deltas(li.join(one, "l_orderkey", "left_semi"), "l_orderkey", "scale", 1, ["l_quantity", "l_extendedprice"])
    return out.select("scale", "n", *[_r(c) for c in out.columns if c.endswith("_delta")])


@_query("""
SELECT CAST(l_linenumber AS INTEGER) AS scale, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE l_discount < 0.05) AS BIGINT) AS valid_rows, CAST(count(*) FILTER (WHERE l_discount < 0.05 AND l_tax < 0.04) AS BIGINT) AS strict_rows,
  round(avg(l_quantity) FILTER (WHERE l_discount < 0.05), 4) AS mean_l_quantity_valid, round(avg(l_quantity) FILTER (WHERE l_discount < 0.05 AND l_tax < 0.04), 4) AS mean_l_quantity_strict
FROM lineitem GROUP BY l_linenumber
""")
def q15_scale_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and strictly valid rows and means of each scale."""
    ok = F.col("l_discount") < 0.05
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("scale"), "l_quantity", ok.alias("ok"), (ok & (F.col("l_tax") < 0.04)).alias("strict"))
    out = pairs.scale_summary(li, "scale", "ok", "strict", ["l_quantity"])
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.startswith("mean_")})


_DELTA = "WITH d AS (SELECT o_orderkey, o_orderstatus, o_totalprice - 250000 AS x FROM orders)"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") - 250000).alias("x"))


@_query(_DELTA + "SELECT o_orderstatus, CAST(count(x) AS BIGINT) AS n, round(avg(x), 4) AS mean, min(x) AS min, max(x) AS max, " + ", ".join(f"round(quantile_cont(x, {q}), 4) AS p{round(q * 100):02d}" for q in robust.QUANTILES) + ", " + ", ".join(f"CAST(count(*) FILTER (WHERE abs(x) >= {k}) AS BIGINT) AS abs_ge_{k}" for k in robust.LARGE) + " FROM d GROUP BY o_orderstatus")
def q16_robust_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles and counts of large values."""
    out = robust.quantiles(_deltas(spark, sf_dir), ["o_orderstatus"], "x")
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c == "mean" or c[0] == "p"})


def _trim_sql() -> str:
    parts = []
    for f in robust.FRACTIONS:
        n = f"{round(f * 100):02d}"
        cut = f"CAST(floor(n * {f}) AS BIGINT)"
        parts.append(f"round(avg(x) FILTER (WHERE k > {cut} AND k <= n - {cut}), 4) AS trim_{n}")
        low, high = f"(min(x) FILTER (WHERE k > {cut}))", f"(max(x) FILTER (WHERE k <= n - {cut}))"
        parts.append(f"round((sum(x) FILTER (WHERE k > {cut} AND k <= n - {cut}) + any_value({cut}) * ({low} + {high})) / count(*), 4) AS winsor_{n}")
    return _DELTA + ", r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY x) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM d) SELECT o_orderstatus, " + ", ".join(parts) + " FROM r GROUP BY o_orderstatus"


@_query(_trim_sql())
def q17_trimmed_winsorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed and winsorised means."""
    out = robust.trimmed_and_winsorized(_deltas(spark, sf_dir), ["o_orderstatus"], "x")
    return out.select("o_orderstatus", *[_r(c) for c in out.columns if c != "o_orderstatus"])


def _without_sql() -> str:
    parts = [f"round(avg(x) FILTER (WHERE {r} > {k}), 4) AS without_{k}_{n}" for k in robust.EXTREMES for r, n in (("up", "positive"), ("ab", "absolute"))]
    return (
        _DELTA + ", r AS (SELECT *, row_number() OVER (ORDER BY x DESC, o_orderkey) AS up, row_number() OVER (ORDER BY abs(x) DESC, o_orderkey) AS ab FROM d) SELECT " + ", ".join(parts)
        + ", round(sum(x) FILTER (WHERE x > 0), 2) AS sum_positive, round(sum(x) FILTER (WHERE x < 0), 2) AS sum_negative, round(sum(x), 2) AS net, round(sum(x) FILTER (WHERE up <= 10 AND x > 0) / sum(x), 6) AS top_10_share FROM r"
    )


@_query(_without_sql())
def q18_outlier_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means without extremes and the share of the ten largest."""
    out = robust.without_extremes(_deltas(spark, sf_dir), [], "x", "o_orderkey")
    digits = {"top_10_share": 6} | {c: 2 for c in ("sum_positive", "sum_negative", "net")}
    return out.select(*[_r(c, digits.get(c, 4)) for c in out.columns])


@_query(_DELTA + ", lo AS (SELECT *, 'low' AS side FROM d ORDER BY x, o_orderkey LIMIT 20), hi AS (SELECT *, 'high' AS side FROM d ORDER BY x DESC, o_orderkey DESC LIMIT 20) SELECT * FROM lo UNION ALL SELECT * FROM hi")
def q19_extreme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 smallest and 20 largest rows."""
    return robust.extremes(_deltas(spark, sf_dir), "x", "o_orderkey")


@_query(_PAIRS + """, c AS (SELECT o_orderpriority, count(*) FILTER (WHERE delta > 0) AS positive, count(*) FILTER (WHERE delta < 0) AS negative, count(*) FILTER (WHERE delta = 0) AS zero FROM pair GROUP BY 1),
t AS (SELECT *, unnest(range(0, least(positive, negative) + 1)) AS k, positive + negative AS n FROM c)
SELECT o_orderpriority, positive, negative, zero, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END - CASE WHEN k = n THEN 0 ELSE lgamma(n - k + 1) END - n * ln(2)))), 6) AS two_sided_p
FROM t WHERE n > 0 GROUP BY ALL""")
def q20_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign test by group."""
    return robust.signs(_pairs(spark, sf_dir), ["o_orderpriority"], "delta").withColumn("two_sided_p", F.round("two_sided_p", 6))


@_query()
def q21_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the mean delta by replicates in parallel."""
    return robust.bootstrap_parallel(_pairs(spark, sf_dir), ["o_orderpriority"], "delta", "o_custkey", 20_000)


@_query("""
WITH g AS (SELECT o_orderpriority AS c, count(*) AS n, avg(ln(o_totalprice)) AS m, var_pop(ln(o_totalprice)) AS v FROM orders GROUP BY 1),
w AS (SELECT *, v / (n * (1 - 1.0 / n) * (1 - 1.0 / n)) AS vg FROM g), ref AS (SELECT m, vg FROM w WHERE c = '1-URGENT')
SELECT c AS term, round(w.m - ref.m, 8) AS coef, round(sqrt(w.vg + ref.vg), 8) AS se FROM w, ref WHERE c <> '1-URGENT' UNION ALL SELECT 'const', round(m, 8), round(sqrt(vg), 8) FROM ref
""")
def q22_ols_one_factor_hc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-factor least squares with HC3 errors from cell statistics."""
    o = _read(spark, sf_dir, "orders").withColumn("y", F.ln("o_totalprice"))
    f = regression.fit(o, "y", "o_orderpriority", list(PRIORITIES), PRIORITIES[0], [])
    return regression.coefficient_table(spark, f).select("term", F.round("coef", 8).alias("coef"), F.round("se", 8).alias("se"))


@_query()
def q23_ols_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities with status and segment effects, with p-values and stars."""
    o = _read(spark, sf_dir, "orders").withColumn("y", F.ln("o_totalprice"))
    own = o.join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    f = regression.fit(own, "y", "o_orderpriority", list(PRIORITIES), PRIORITIES[0], ["o_orderstatus", "c_mktsegment"])
    return regression.coefficient_table(spark, f)


#: Two-sided p of a normal value by the series of the error function, and of F(1, n) by a normal value of the same tail.
_P = "1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(greatest({0}, 1e-12) / sqrt(2)) - lgamma(k + 1)) / (2 * k + 1)))"


@_query(f"""
WITH g AS (SELECT o_orderstatus AS s, o_orderpriority AS c, count(*) AS n, avg(ln(o_totalprice)) AS m, var_pop(ln(o_totalprice)) AS v FROM orders GROUP BY 1, 2),
w AS (SELECT s, c, m, v / (n * (1 - 1.0 / n) * (1 - 1.0 / n)) AS v, sum(n) OVER (PARTITION BY s) - 5 AS df FROM g),
t AS (SELECT h, kind, sign, a.c || CASE WHEN kind = 'diff' THEN ' - ' || b.c ELSE '' END AS term, a.m - b.m AS estimate, a.v + b.v AS v, a.df
  FROM (VALUES ('H1a', 'coef', 1, 'F', '2-HIGH', '1-URGENT'), ('H1b', 'diff', 1, 'F', '3-MEDIUM', '2-HIGH'), ('H3a', 'coef', -1, 'O', '5-LOW', '1-URGENT'), ('H4', 'none', 0, 'O', '4-NOT SPECIFIED', '1-URGENT')) x(h, kind, sign, s, ca, cb)
  JOIN w a ON a.s = x.s AND a.c = ca JOIN w b ON b.s = x.s AND b.c = cb),
z AS (SELECT *, CASE WHEN kind = 'diff' THEN estimate * estimate / v ELSE estimate / sqrt(v) END AS statistic, abs(estimate) / sqrt(v) AS z FROM t),
q AS (SELECT *, CASE WHEN kind = 'diff' THEN z * (1 - 1.0 / (4 * df)) / sqrt(1 + z * z / (2 * df)) ELSE z END AS y FROM z), p2 AS (SELECT *, {_P.format("y")} AS p2 FROM q),
p AS (SELECT *, CASE WHEN sign = 0 THEN p2 WHEN sign * estimate > 0 THEN p2 / 2 ELSE 1 - p2 / 2 END AS p FROM p2)
SELECT h AS hypothesis, term, round(estimate, 8) AS estimate, round(statistic, 6) AS statistic, round(p, 5) AS p,
  CASE WHEN kind = 'none' THEN CASE WHEN p >= 0.1 THEN 'SUPPORTED' ELSE 'REJECTED' END WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS verdict FROM p
""")
def q24_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A battery of one-sided, difference and two-sided tests."""
    o = _read(spark, sf_dir, "orders").withColumn("y", F.ln("o_totalprice"))
    fits = regression.fit_by(o.where("o_orderstatus in ('F', 'O')"), "o_orderstatus", "y", "o_orderpriority", list(PRIORITIES), PRIORITIES[0], [])
    battery = (("H1a", "coef", ("2-HIGH",), "positive"), ("H1b", "diff", ("3-MEDIUM", "2-HIGH"), "positive"), ("H3a", "coef", ("5-LOW",), "negative"), ("H4", "none", ("4-NOT SPECIFIED",), "two-sided"))
    rows = regression.hypotheses(fits.get("F"), fits.get("O"), battery)
    got = spark.createDataFrame(rows, "hypothesis string, term string, estimate double, statistic double, p double, verdict string")
    return got.withColumns({"estimate": F.round("estimate", 8), "statistic": F.round("statistic", 6), "p": F.round("p", 5)})


@_query("""
WITH z AS (SELECT l_extendedprice AS y, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x FROM lineitem),
s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM z),
b AS (SELECT n, mx, sxx, (SELECT sum((x - mx) * (y - my)) FROM z, s) / sxx AS b1, my FROM s),
e AS (SELECT x - mx AS d, y - (my + b1 * (x - mx)) AS u, 1.0 / n + (x - mx) * (x - mx) / sxx AS h FROM z, b),
v AS (SELECT sum(d * d * u * u / ((1 - h) * (1 - h))) AS m FROM e)
SELECT 'z_quantity' AS term, round(b1, 4) AS coef, round(sqrt(m) / sxx, 4) AS se FROM b, v
""")
def q25_ols_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on a z-scored continuous term with HC3 errors in two passes of partial sums."""
    li = regression.zscore(_read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "z_quantity")
    f = regression.fit_continuous(li, "l_extendedprice", ["z_quantity"])
    return regression.coefficient_table(spark, f).where("term = 'z_quantity'").select("term", F.round("coef", 4).alias("coef"), F.round("se", 4).alias("se"))


@_query("""
WITH a AS (SELECT event_id, event_id % 8 AS m, CAST(floor(value * 10) AS BIGINT) AS w, event_id % 7 AS r FROM events),
p AS (SELECT event_id, m, CASE WHEN m NOT IN (5, 6) AND w BETWEEN 1 AND 1000 THEN w END AS w, CASE WHEN m NOT IN (2, 5, 6) AND r BETWEEN 1 AND 5 THEN r END AS r FROM a)
SELECT event_id, CAST(w AS INTEGER) AS wager, CAST(r AS INTEGER) AS risk, w IS NOT NULL AS valid, r IS NOT NULL AS valid_risk, m IN (5, 7) AS refusal,
  CASE WHEN m = 6 THEN 'empty_response' WHEN m IN (5, 7) THEN 'refusal_language' WHEN w IS NULL THEN 'no_number' ELSE '' END AS error FROM p
""")
def q26_parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of answers by lines, by labels in either order, by one label only, loose, with notes in brackets, refused, missing, and refused with numbers."""
    m, w, r = F.col("event_id") % 8, F.floor(F.col("value") * 10).cast("string"), (F.col("event_id") % 7).cast("string")
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    t = F.when(m == 0, say("Line 1: ", w, "\nLine 2: ", r)).when(m == 1, say("My risk is ", r, " and my wager = ", w)).when(m == 2, say("I would bet ", w, " and no more"))
    t = t.when(m == 3, say(w, " then ", r)).when(m == 4, say("Wager (1-1000): ", w, "\r\n\r\nRisk (1 to 5) - ", r)).when(m == 5, "As an AI I cannot say").when(m == 7, say("I am unable, but\n", w, "\n", r))
    return _read(spark, sf_dir, "events").select("event_id", answers.parse_answer(t).alias("a")).select("event_id", "a.*")


@_query("""
WITH t AS (SELECT user_id, event_id, CASE event_id % 6 WHEN 0 THEN 'Realized.' WHEN 1 THEN 'I say PAPER_OPEN' WHEN 2 THEN 'open or realized?' WHEN 3 THEN '1' WHEN 4 THEN 'maybe' ELSE ' ' END AS x FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'REALIZED' WHEN 1 THEN 'PAPER' WHEN 3 THEN 'REALIZED' ELSE '' END AS label, event_id % 6 IN (0, 1, 3) AS valid,
  CASE event_id % 6 WHEN 2 THEN 'ambiguous_label' WHEN 4 THEN 'invalid_label' WHEN 5 THEN 'empty_response' ELSE '' END AS error FROM t
""")
def q27_parse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label, several, or none in an answer."""
    said = ("Realized.", "I say PAPER_OPEN", "open or realized?", "1", "maybe", " ")
    x = F.element_at(F.array(*[F.lit(s) for s in said]), (F.col("event_id") % 6 + 1).cast("int"))
    return _read(spark, sf_dir, "events").select("event_id", answers.parse_label(x).alias("a")).select("event_id", "a.*")


@_query("""
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS s FROM documents),
w AS (SELECT doc_id, list_filter(string_split(s, ' '), lambda x: x <> '') AS l FROM n),
k AS (SELECT doc_id, l, list_filter(l, lambda x: x NOT IN ('a','an','and','are','as','at','be','by','for','from','has','have','he','her','his','in','is','it','of','on','or','she','that','the','their','they','to','with')) AS c FROM w)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(list_distinct(list_filter(c, lambda x: length(x) > 2))) AS BIGINT) AS n_tokens,
  CAST(CASE WHEN len(c) >= 5 THEN len(list_distinct(list_transform(range(1, len(c) - 3), lambda i: array_to_string(c[i : i + 4], ' ')))) ELSE 0 END AS BIGINT) AS n_grams FROM k
""")
def q28_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, distinct content tokens and distinct five-grams of every text."""
    d = _read(spark, sf_dir, "documents").select("doc_id", text.normalized(F.coalesce("text", F.lit(""))).alias("s"))
    n = lambda c: F.size(c).cast("long")
    return d.select("doc_id", n(text.words(F.col("s"))).alias("n_words"), n(text.content_tokens(F.col("s"))).alias("n_tokens"), n(text.ngrams(F.col("s"))).alias("n_grams"))


@_query("""
WITH n AS (SELECT 'd' AS side, doc_id AS id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS s FROM documents UNION ALL SELECT 'b', item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) FROM benchmark),
k AS (SELECT side, id, list_filter(string_split(s, ' '), lambda x: x <> '' AND x NOT IN ('a','an','and','are','as','at','be','by','for','from','has','have','he','her','his','in','is','it','of','on','or','she','that','the','their','they','to','with')) AS c FROM n),
g AS (SELECT side, id, list_distinct(list_transform(range(1, len(c) - 3), lambda i: array_to_string(c[i : i + 4], ' '))) AS grams FROM k WHERE len(c) >= 5),
u AS (SELECT side, id, len(grams) AS n, unnest(grams) AS gram FROM g),
j AS (SELECT a.id AS left_id, b.id AS right_id, a.n AS an, b.n AS bn, count(*) AS c FROM u a JOIN u b ON a.gram = b.gram WHERE a.side = 'd' AND b.side = 'b' GROUP BY ALL)
SELECT left_id, right_id, CAST(c AS BIGINT) AS n_common, round(c / (an + bn - c), 6) AS jaccard FROM j WHERE c / (an + bn - c) >= 0.01
""")
def q29_ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that share five-grams."""
    grams = lambda t, i: _read(spark, sf_dir, t).select(F.col(i).alias("id"), text.ngrams(text.normalized(F.coalesce("text", F.lit("")))).alias("grams"))
    return overlap.shared_gram_overlap(grams("documents", "doc_id"), grams("benchmark", "item_id"), 0.01).withColumn("jaccard", F.round("jaccard", 6))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four altered texts of each benchmark item: in brackets, without its end, backwards by words, and its first half."""
    w = F.split("text", " ")
    size = F.size(w)
    texts = F.array(F.concat(F.lit("("), "text", F.lit(")")), F.array_join(F.slice(w, F.lit(1), F.greatest(size - 5, F.lit(0))), " "), F.array_join(F.reverse(w), " "), F.array_join(F.slice(w, F.lit(1), F.floor(size / 2).cast("int")), " "))
    own = _read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(texts).alias("k", "prompt_text"))
    return own.select((F.col("item_id") * 4 + F.col("k")).alias("ordinal"), F.concat_ws("-", "item_id", "k").alias("prompt_id"), F.lit("").alias("pair_id"), "prompt_text")


@_query()
def q30_prompt_overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best labelled benchmark item of each altered one, by exact character ratio, tokens and n-grams."""
    b = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ordinal"), F.col("item_id").cast("string").alias("prompt_id"), F.lit("").alias("pair_id"), F.col("text").alias("prompt_text"))
    return overlap.audit(overlap.prepared(_variants(spark, sf_dir), "ordinal"), overlap.prepared(b, "ordinal"))


@_query(r"""
WITH v AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark),
x AS (SELECT item_id * 4 AS o, '(' || text || ')' AS s FROM v UNION ALL SELECT item_id * 4 + 1, array_to_string(w[1 : greatest(len(w) - 5, 0)], ' ') FROM v
  UNION ALL SELECT item_id * 4 + 2, array_to_string(list_reverse(w), ' ') FROM v UNION ALL SELECT item_id * 4 + 3, array_to_string(w[1 : len(w) // 2], ' ') FROM v),
n AS (SELECT o, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM x),
k AS (SELECT o, s, list_filter(string_split(s, ' '), lambda x: x <> '' AND x NOT IN ('a','an','and','are','as','at','be','by','for','from','has','have','he','her','his','in','is','it','of','on','or','she','that','the','their','they','to','with')) AS c FROM n),
f AS (SELECT o, s, list_distinct(list_filter(c, lambda x: length(x) > 2)) AS t, list_distinct(list_transform(range(1, len(c) - 3), lambda i: array_to_string(c[i : i + 4], ' '))) AS g FROM k),
p AS (SELECT a.o AS candidate_ordinal, b.o AS reference_ordinal, a.s <> '' AND a.s = b.s AS exact,
  CASE WHEN len(a.t) + len(b.t) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END AS t,
  CASE WHEN len(a.g) + len(b.g) = 0 THEN 1.0 ELSE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) END AS g FROM f a JOIN f b ON a.o < b.o),
l AS (SELECT *, CASE WHEN exact THEN 'exact_normalized' ELSE concat_ws('+', CASE WHEN t >= 0.55 THEN 'high_token_overlap' END, CASE WHEN g >= 0.3 THEN 'high_ngram_overlap' END) END AS overlap_type FROM p)
SELECT candidate_ordinal, reference_ordinal, exact, round(t, 6) AS token_jaccard, round(g, 6) AS ngram_jaccard, overlap_type FROM l WHERE overlap_type <> ''
""")
def q83_internal_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled pairs of altered items by tokens and n-grams, met by prefixes of their rarest elements."""
    got = overlap.internal(overlap.prepared(_variants(spark, sf_dir), "ordinal"), (2.0, 0.55, 0.30))
    return got.select("candidate_ordinal", "reference_ordinal", "exact", F.round("token_jaccard", 6).alias("token_jaccard"), F.round("ngram_jaccard", 6).alias("ngram_jaccard"), "overlap_type")


@_query("""
WITH e AS (SELECT label % 2 AS role, label // 2 AS pair, embedding, vec_id FROM embeddings),
u AS (SELECT pair, role, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM e),
m AS (SELECT pair, role, i, avg(CAST(v AS DOUBLE)) AS v FROM u GROUP BY ALL),
d AS (SELECT a.i, avg(a.v - b.v) AS d FROM m a JOIN m b ON a.pair = b.pair AND a.i = b.i WHERE a.role = 1 AND b.role = 0 GROUP BY a.i),
n AS (SELECT sqrt(sum(d * d)) AS n FROM d),
x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings),
p AS (SELECT vec_id, any_value(label) AS label, sum(CAST(v AS DOUBLE) * d) / any_value(n) AS projection FROM x JOIN d USING (i), n GROUP BY vec_id)
SELECT field, value, CAST(count(*) AS BIGINT) AS n, round(avg(projection), 5) AS mean, round(stddev_pop(projection), 5) AS std
FROM (SELECT 'label' AS field, CAST(label AS VARCHAR) AS value, projection FROM p UNION ALL SELECT 'role', CAST(label % 2 AS VARCHAR), projection FROM p) GROUP BY field, value
""")
def q31_direction_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-pooled roles, pair directions, their mean, and projections by group."""
    e = _read(spark, sf_dir, "embeddings").withColumns({"role": (F.col("label") % 2).cast("string"), "pair": F.floor(F.col("label") / 2)})
    pooled = vectors.mean_vector(e, ["pair", "role"], "embedding").withColumn("o", F.lit(0))
    direction = vectors.mean_vector(vectors.pair_directions(pooled, "pair", "role", "1", "0", "o"), [], "direction")
    projected = vectors.project(e.withColumnRenamed("embedding", "vector"), direction.select("vector"))
    out = vectors.group_summary(projected, ["label", "role"], "projection")
    return out.select("field", "value", "n", _r("mean", 5), _r("std", 5))


@_query("""
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT i, avg(v) AS m FROM x GROUP BY i),
d AS (SELECT vec_id, sqrt(sum((v - m) * (v - m))) AS d FROM x JOIN m USING (i) GROUP BY vec_id)
SELECT CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS n, round((SELECT sqrt(sum(m * m)) FROM m), 6) AS mean_norm, round((SELECT avg(d) FROM d), 6) AS scale
""")
def q32_normalization_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector and mean distance from it in two passes."""
    return vectors.normalization(_read(spark, sf_dir, "embeddings"), "embedding").select("n", F.round(vectors.norm("mean"), 6).alias("mean_norm"), F.round("scale", 6).alias("scale"))


_EFFECT = """
WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS f, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
g AS (SELECT label, f, count(*) AS n, avg(v) AS m, var_pop(v) AS q FROM x GROUP BY ALL), t AS (SELECT f, count(*) AS n, sum(v) AS s, sum(v * v) AS ss FROM x GROUP BY f),
r AS (SELECT g.*, t.n - g.n AS rn, (t.s - g.n * g.m) / (t.n - g.n) AS rm, (t.ss - g.n * (g.q + g.m * g.m)) / (t.n - g.n) AS rq FROM g JOIN t USING (f)),
e AS (SELECT CAST(label AS VARCHAR) AS value, CAST(f - 1 AS INTEGER) AS feature, n, rn, (m - rm) / (sqrt((q + greatest(rq - rm * rm, 0)) / 2) + 1e-12) AS effect FROM r WHERE n >= 2 AND rn >= 2)
"""


def _effects(spark: SparkSession, sf_dir: str, top: int | None) -> tuple[DataFrame, DataFrame]:
    e = _read(spark, sf_dir, "embeddings")
    groups = e.select("vec_id", F.lit("label").alias("field"), F.col("label").cast("string").alias("value"))
    return e, vectors.effects(e, "vec_id", "embedding", groups, 2, top)


@_query(_EFFECT + "SELECT 'label' AS field, value, feature, CAST(n AS BIGINT) AS group_count, CAST(rn AS BIGINT) AS rest_count, round(effect, 6) AS effect_size, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY effect DESC, feature) AS k FROM e) WHERE k <= 10")
def q33_one_vs_rest_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised effects of each group against the rest, the top ten features of each."""
    return _effects(spark, sf_dir, 10)[1].select("field", "value", "feature", "group_count", "rest_count", _r("effect_size", 6), "rank")


@_query(_EFFECT + ", b AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY abs(effect) DESC, feature) AS k FROM e) SELECT value, feature, round(effect, 6) AS effect_size FROM b WHERE k = 1")
def q34_best_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest effect in size of each group."""
    return vectors.best_effects(_effects(spark, sf_dir, None)[1]).select("value", "feature", _r("effect_size", 6))


@_query(_EFFECT + """, fe AS (SELECT feature, max(abs(effect)) AS a FROM e GROUP BY feature ORDER BY a DESC, feature LIMIT 5),
k AS (SELECT vec_id, f - 1 AS feature, v, row_number() OVER (PARTITION BY f ORDER BY v DESC, vec_id) AS k FROM x WHERE f - 1 IN (SELECT feature FROM fe))
SELECT CAST(feature AS INTEGER) AS feature, vec_id, round(v, 5) AS activation, CAST(k AS INTEGER) AS rank FROM k WHERE k <= 3""")
def q35_top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest examples of the features with the largest effects."""
    e, found = _effects(spark, sf_dir, None)
    return vectors.top_examples(e, "vec_id", "embedding", found, 5, 3).select("feature", "vec_id", _r("activation", 5), "rank")


@_query("""
WITH a AS (SELECT vec_id, count(*) AS n FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) WHERE v > 0 GROUP BY vec_id)
SELECT round(avg(coalesce(n, 0)), 6) AS mean_active, CAST(median(coalesce(n, 0)) AS DOUBLE) AS median_active, CAST(max(n) AS BIGINT) AS max_active FROM embeddings LEFT JOIN a USING (vec_id)
""")
def q36_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active features of each vector."""
    long = _read(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("x"))
    return vectors.sparsity(long, "vec_id", "x").withColumn("mean_active", F.round("mean_active", 6))


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generation plan for each customer, as a JSON document: lists, single texts and defaults."""
    k = F.col("c_custkey")
    model = lambda x: F.struct(F.lit(x).alias("alias"), F.lit(f"vendor/{x}").alias("model"))
    one = F.to_json(F.struct(F.lit("c1").alias("cell_id"), (1 + k % 5).alias("count_per_model"), F.array(F.lit("casino"), F.col("c_mktsegment")).alias("domains"), F.array(F.lit("paper"), F.lit("realized")).alias("realization_frames")))
    two = F.to_json(F.struct(F.lit("c2").alias("cell_id"), F.lit("real estate").alias("domain"), F.array(F.lit("positive"), F.lit("control")).alias("contrast_roles"), F.lit("low").alias("amount_buckets")))
    head = F.to_json(F.struct(F.concat(F.lit("Plan "), k.cast("string")).alias("name"), F.array(model("small"), model("large")).alias("models")))
    # a small file is one split, but each of its rows becomes a document of many jobs
    own = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return own.select(F.concat(F.rtrim(head, F.lit("}")), F.lit(', "cells": ['), one, F.lit(", "), two, F.lit("]}")).alias("content"))


_PLANS = """
WITH m AS (SELECT unnest(['small', 'large']) AS alias),
j AS (SELECT 'plan_' || c_custkey || '__' || alias || '__c1__' || d || '__none__neutral__' || f || '__none__none__positive' AS batch_id, 1 + c_custkey % 5 AS n
  FROM (SELECT c_custkey, unnest(['casino', lower(c_mktsegment)]) AS d FROM customer), m, (SELECT unnest(['paper', 'realized']) AS f)
  UNION ALL SELECT 'plan_' || c_custkey || '__' || alias || '__c2__real_estate__none__neutral__none__none__low__none__' || r, 3 FROM customer, m, (SELECT unnest(['positive', 'control']) AS r))
"""


@_query(_PLANS + "SELECT batch_id || CASE WHEN n > 2 THEN '__part_00' || p ELSE '' END AS batch_id, CAST(least(2, n - (p - 1) * 2) AS INTEGER) AS request_count FROM j, range(1, 4) t(p) WHERE (p - 1) * 2 < n")
def q37_plan_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of nested plans, one for each customer, cut into requests."""
    return generation.requests(generation.jobs(generation.cells_of(_plans(spark, sf_dir))), 2).select("batch_id", F.col("request_count").cast("int").alias("request_count"))


@_query(_PLANS + "SELECT count(*) AS jobs, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(ceil(n / 2)) AS BIGINT) AS requests FROM j")
def q38_plan_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, rows and requests of the customers' plans."""
    return generation.estimate(generation.jobs(generation.cells_of(_plans(spark, sf_dir))), 2)


@_query("""
SELECT doc_id, CAST(n AS BIGINT) AS copies, doc_id = first AS keep FROM (SELECT doc_id, count(*) OVER w AS n, min(doc_id) OVER w AS first FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text)) WHERE n > 1
""")
def q39_duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text occurs more than once, the first being kept (A30, U2). A text's count comes from partial sums, not from a window over its copies."""
    d = _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    n = d.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")
    return d.join(n, "h").select("doc_id", "copies", (F.col("doc_id") == F.col("first")).alias("keep"))


@_query("""
WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'Read.' || chr(10) || chr(10) || 'Scenario:' || chr(10) || props || chr(10) || chr(10) || 'Do not answer yet. Go on.' WHEN event_id % 3 = 1 THEN props || ' How much do you want?' || chr(10) || 'Respond with one' ELSE props END AS x FROM events),
p AS (SELECT event_id, x, length(x) AS n, instr(x, 'Scenario:' || chr(10)) - 1 AS s, instr(x, chr(10) || chr(10) || 'Do not answer yet.') - 1 AS e, instr(x, 'How much do you want') - 1 AS d, instr(x, chr(10) || 'Respond with') - 1 AS r FROM t)
SELECT event_id, CASE WHEN s >= 0 THEN 'wrapper:0:' || (s + 10) || ',scenario:' || (s + 10) || ':' || e || ',processing_instruction:' || e || ':' || n
  WHEN d >= 0 THEN 'scenario:0:' || d || ',decision_question:' || d || ':' || r || ',response_instruction:' || r || ':' || n ELSE 'prompt:0:' || n END AS regions,
  CASE WHEN s >= 0 THEN 'wrapper' WHEN d >= 0 THEN 'scenario' ELSE 'prompt' END AS first_label FROM p
""")
def q40_span_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of prompts by markers, and the region of a token by overlap."""
    e, m = _read(spark, sf_dir, "events"), F.col("event_id") % 3
    story = F.concat(F.lit("Read.\n\nScenario:\n"), "props", F.lit("\n\nDo not answer yet. Go on."))
    x = F.when(m == 0, story).when(m == 1, F.concat("props", F.lit(" How much do you want?\nRespond with one"))).otherwise(F.col("props"))
    own = e.select("event_id", x.alias("x")).withColumn("r", text.regions(F.col("x"), F.lit("")))
    shown = F.array_join(F.transform("r", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return own.select("event_id", shown.alias("regions"), text.span_label(F.lit(0), F.lit(4), F.col("r")).alias("first_label"))


@_query("""
SELECT event_id, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS temp_key,
  'block__model-user-' || user_id || '__temp-' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || '__prompt-' || event_type || '__' ||
  substr(sha1('user ' || user_id || '|' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || '|' || event_type), 1, 10) || '.csv' AS file FROM events
""")
def q41_block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature keys and block file names."""
    e = _read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("m"), F.col("value").cast("string").alias("t"), F.col("event_type").alias("v"))
    return e.select("event_id", coerce.temperature_key("t").alias("temp_key"), coerce.block_file("m", "t", "v").alias("file"))


@_query("""
WITH c AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'paper' ELSE 'realized' END AS kind, (n_nationkey - 12) * 30 AS a FROM nation)
SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, v AS version, CASE
  WHEN v = 'qualitative' AND kind = 'paper' THEN 'So far during this visit you ' || CASE WHEN a >= 81 THEN 'have won a substantial amount.' WHEN a >= 1 THEN 'have won a modest amount.' WHEN a = 0 THEN 'are exactly even and have neither won nor lost.'
    WHEN a >= -96 THEN 'have lost a small amount.' WHEN a >= -309 THEN 'have lost a moderate amount.' ELSE 'have lost a substantial amount.' END
  WHEN v = 'qualitative' THEN CASE WHEN a >= 1 THEN 'you came out ahead.' WHEN a >= -62 THEN 'you lost a small amount.' ELSE 'you lost a moderate amount.' END
  WHEN kind = 'paper' AND v = 'balance' THEN CASE WHEN a > 0 THEN 'your current balance on your playing card is ' || a || ' CHF above where you began.' WHEN a < 0 THEN 'your current balance on your playing card is ' || -a || ' CHF below where you began.' ELSE 'your current balance on your playing card is exactly the same as where you began.' END
  WHEN kind = 'paper' THEN CASE WHEN a > 0 THEN 'So far during this visit you have won ' || a || ' CHF across previous sessions.' WHEN a < 0 THEN 'So far during this visit you have lost ' || -a || ' CHF across previous sessions.' ELSE 'So far during this visit you are even and have neither won nor lost.' END
  WHEN v = 'balance' THEN CASE WHEN a > 0 THEN 'your final result was ' || a || ' CHF above where you started.' ELSE 'your final result was ' || -a || ' CHF below where you started.' END
  WHEN abs(a) <= 50 THEN CASE WHEN a > 0 THEN 'you finished roughly even, with a small gain of ' || a || ' CHF.' ELSE 'you finished roughly even, with a small loss of ' || -a || ' CHF.' END
  WHEN a > 0 THEN 'you received ' || a || ' CHF.' ELSE 'you paid ' || -a || ' CHF.' END AS sentence
FROM c, (VALUES ('absolute'), ('balance'), ('qualitative')) t(v)
""")
def q42_prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history sentence of rendered prompts."""
    n = _read(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "paper").otherwise("realized").alias("kind"), ((F.col("n_nationkey") - 12) * 30).alias("a"))
    own = n.select("*", F.explode(F.array(F.lit("absolute"), F.lit("balance"), F.lit("qualitative"))).alias("version"))
    own = own.withColumn("p", prompts.prompt_text(F.col("kind"), F.col("a"), F.col("version")))
    sentence = F.regexp_extract("p", r"((?:So far during|your current balance on your playing card is|your final result|you finished|you received|you paid|you came out|you lost)[^.]*\.)", 1)
    return own.select("n_nationkey", "version", sentence.alias("sentence"))


from . import report_queries, source_queries  # noqa: E402,F401  register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
