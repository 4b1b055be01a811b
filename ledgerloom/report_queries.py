"""Registered queries of sources, sinks, predicates, report tables and orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coerce
from .operators import partitioning, predicates, regression, summaries, trials
from .queries import EVENT_TYPES, PRIORITIES, _query, _read
from .sources import scratch, sinks, tables


def _trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trial records of text cells; a priority is a condition, a status a model."""
    o = _read(spark, sf_dir, "orders")
    cells = {
        "trial_id": F.col("o_orderkey").cast("string"), "condition": F.col("o_orderpriority"), "model": F.concat(F.lit("model-"), "o_orderstatus"), "prompt_version": F.lit("absolute"),
        "temperature": F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("1.0"), "run_number": F.col("o_custkey").cast("string"), "request_id": F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("r"), F.col("o_orderkey").cast("string"))).otherwise(""),
        "response_text": F.concat(F.lit('say "'), "o_orderpriority", F.lit('",\nthen ')), "valid": F.when(F.col("o_orderkey") % 5 != 0, "True").otherwise("False"),
        "parsed_wager": F.round("o_totalprice", 2).cast("string"), "log_wager": F.when(F.col("o_orderkey") % 7 == 0, "inf").when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.round("o_totalprice", 2).cast("string")),
    }
    return o.select(*[cells.get(c, F.lit("")).alias(c) for c in trials.FIELDS])


def _written(spark: SparkSession, sf_dir: str) -> str:
    path = scratch.folder(spark, "trials")
    sinks.write_csv(_trial_rows(spark, sf_dir), path)
    return path


@_query("""
SELECT o_orderpriority AS condition, 'model-' || o_orderstatus AS model, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '1.0' END AS temperature, count(*) AS n_rows,
  count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_requests, CAST(sum(length('say "' || o_orderpriority || '",' || chr(10) || 'then ')) AS BIGINT) AS n_chars, round(sum(round(o_totalprice, 2)), 2) AS total
FROM orders GROUP BY ALL
""")
def q43_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials written as CSV, with quotes and line ends in cells, and read back as text with required columns."""
    own = tables.require(tables.trials(spark, _written(spark, sf_dir)), ["condition", "model", "response_text"])
    return own.groupBy("condition", "model", "temperature").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("request_id") != "").alias("n_requests"), F.sum(F.length("response_text")).alias("n_chars"), F.round(F.sum(coerce.number("parsed_wager")), 2).alias("total")
    )


@_query("""
SELECT o_orderpriority AS condition, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders
WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderstatus = 'O' GROUP BY 1
""")
def q44_regression_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a written CSV to the rows of a regression: valid, finite, of one model and version."""
    own = predicates.regression_frame(tables.trials(spark, _written(spark, sf_dir)), "log_wager", "model-O", "absolute")
    return own.groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg("log_wager"), 2).alias("mean"))


@_query("""
WITH f AS (SELECT o_orderpriority AS c, o_totalprice AS y FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0),
g AS (SELECT c, avg(y) AS m FROM f GROUP BY c)
SELECT 'condition_' || a.c AS term, round(a.m - b.m, 2) AS coef FROM g a, g b WHERE b.c = '1-URGENT' AND a.c <> '1-URGENT'
""")
def q45_csv_to_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from a CSV to a coefficient table."""
    own = predicates.regression_frame(tables.trials(spark, _written(spark, sf_dir)), "log_wager")
    f = regression.fit(own, "log_wager", "condition", list(PRIORITIES), PRIORITIES[0], [])
    rows = [(n, float(c)) for n, c in zip(f.names, f.coef, strict=True) if n != "const"]
    named = [(n if n.startswith("condition_") else f"condition_{n}", round(c, 2)) for n, c in rows]
    return spark.createDataFrame(named, "term string, coef double")


_CONDITION = "CASE event_type WHEN 'click' THEN 'paper_gain_small' WHEN 'error' THEN 'realized_large_loss' WHEN 'purchase' THEN 'realized_gain' WHEN 'signup' THEN 'paper_even' ELSE 'paper_neutral' END"


@_query(f"""
WITH e AS (SELECT {_CONDITION} AS condition, value FROM events)
SELECT condition, CASE WHEN starts_with(condition, 'realized') THEN 'realized' ELSE 'paper' END AS domain,
  CASE WHEN contains(condition, 'gain') THEN 'gain' WHEN contains(condition, 'neutral') THEN 'neutral' ELSE 'loss' END AS valence, CASE condition WHEN 'paper_even' THEN 'Even' WHEN 'realized_gain' THEN 'Gain' END AS shown,
  CAST(sum(CAST(contains(condition, 'loss') AS INT)) AS BIGINT) AS losses, CAST(sum(CAST(contains(condition, 'gain') AS INT) * CAST(starts_with(condition, 'realized') AS INT)) AS BIGINT) AS realized_gains,
  round(avg(ln(abs(value) + 1)), 4) AS log_amount, round(avg(value) - 1.96 * stddev_samp(value), 3) AS low, round(avg(value) + 1.96 * stddev_samp(value), 3) AS high
FROM e GROUP BY condition
""")
def q46_condition_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators, domain and valence of conditions, report names and intervals."""
    own = predicates.indicators(_read(spark, sf_dir, "events").select(F.expr(_CONDITION).alias("condition"), F.col("value").alias("amount")))
    got = own.groupBy("condition").agg(
        F.sum("is_loss").alias("losses"), F.sum("is_gain_realized").alias("realized_gains"), F.round(F.avg("log_abs_amount"), 4).alias("log_amount"), F.avg("amount").alias("m"), F.stddev_samp("amount").alias("s")
    )
    low, high = predicates.interval("m", "s")
    shown = predicates.mapped("condition", {"paper_even": "Even", "realized_gain": "Gain"})
    return got.select("condition", predicates.domain_of("condition").alias("domain"), predicates.valence_of("condition").alias("valence"), shown.alias("shown"), "losses", "realized_gains", "log_amount", F.round(low, 3).alias("low"), F.round(high, 3).alias("high"))


@_query("""
SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 2) AS std FROM orders GROUP BY ALL
""")
def q47_group_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, mean, exact median and sample deviation by keys."""
    got = summaries.group_table(_read(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return got.select("o_orderpriority", "o_orderstatus", "n", F.round("mean", 2).alias("mean"), F.round("median", 4).alias("median"), F.round("std", 2).alias("std"))


@_query("""
SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 2) AS centred,
  CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS category_rank, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders
""")
def q48_centred_and_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-centred values, ranks in an explicit order, and batches of fixed size in order."""
    own = summaries.centred(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", "centred")
    own = summaries.batches(summaries.by_category(own, "o_orderpriority", ["5-LOW", "1-URGENT"]), [F.col("o_orderkey")], 64)
    return own.select("o_orderkey", F.round("centred", 2).alias("centred"), "category_rank", "batch")


@_query("""
SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_returnflag IN ('A', 'N') AND l_linestatus NOT IN ('F')
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderkey % 2 = 0)
""")
def q49_resume_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of some splits that the output lacks; keys are compared as text."""
    own = predicates.among(_read(spark, sf_dir, "lineitem"), "l_returnflag", predicates.list_argument("A, N,,A"))
    own = predicates.among(own, "l_linestatus", exclude=predicates.list_argument("F"))
    done = _read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return summaries.not_done(own, done, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@_query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN c_name ELSE o_orderpriority END AS named, CASE WHEN o_custkey % 3 = 0 THEN 'positive' WHEN o_custkey % 3 = 1 THEN 'negative' ELSE 'baseline' END AS side
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def q50_rows_with_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its prompt's columns; a row without one raises; blanks fall through to the prompt; sign labels."""
    own = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("own"))
    got = summaries.matched(own, _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")
    scale = F.when(F.col("id") % 3 == 0, 1.5).when(F.col("id") % 3 == 1, -1.5).otherwise(0.0)
    return got.select("o_orderkey", predicates.first_filled("own", "prompt_name").alias("named"), predicates.sign_label(scale).alias("side"))


@_query("""
WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM nation WHERE n_regionkey < 4 GROUP BY 1), b AS (SELECT r_regionkey AS k, r_name AS name FROM region WHERE r_regionkey > 0)
SELECT coalesce(a.k, b.k) AS k, coalesce(CAST(n AS VARCHAR), '') AS own_n, coalesce(name, '') AS external_name FROM a FULL JOIN b ON a.k = b.k
""")
def q51_full_outer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of either side, blank where a side lacks one."""
    a = _read(spark, sf_dir, "nation").where("n_regionkey < 4").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"))
    b = _read(spark, sf_dir, "region").where("r_regionkey > 0").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return summaries.compared(a, b, ["k"], ("own", "external"))


@_query("""
SELECT 'all' AS kind, '' AS value, count(*) AS count FROM lineitem UNION ALL SELECT 'layer', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'region', l_returnflag, count(*) FROM lineitem GROUP BY 2
""")
def q52_layer_region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in all, by layer and by region in one pass."""
    return summaries.layer_region_counts(_read(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag")


@_query("""
WITH r AS (SELECT *, user_id % 4 AS f, CAST(1 + event_id % 900 AS BIGINT) AS w, CAST(1 + event_id % 5 AS BIGINT) AS k, event_id % 6 = 0 AS wrong FROM events)
SELECT CASE WHEN grouping(f) = 1 THEN 'total' ELSE 'file' || CAST(f AS VARCHAR) END AS file, count(*) AS rows, count(*) FILTER (WHERE wrong) AS changed, count(*) AS valid FROM r GROUP BY ROLLUP (f)
""")
def q53_repair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed columns made anew from responses, changed rows by file and in all."""
    w, k = (1 + F.col("event_id") % 900), (1 + F.col("event_id") % 5)
    e = _read(spark, sf_dir, "events").select(
        F.concat(F.lit("file"), (F.col("user_id") % 4).cast("string")).alias("file"), F.concat(F.lit("Line 1: "), w.cast("string"), F.lit("\nLine 2: "), k.cast("string")).alias("response_text"),
        F.when(F.col("event_id") % 6 == 0, "1").otherwise(F.concat(w.cast("string"), F.lit(".0"))).alias("parsed_wager"), F.log(w.cast("double")).cast("string").alias("log_wager"), k.cast("string").alias("risk_profile"),
        F.lit("True").alias("valid"), F.lit("True").alias("valid_risk_profile"), F.lit("False").alias("refusal_flag"), F.when(F.col("event_id") % 6 == 0, "no_number").otherwise("").alias("parse_error_type"),
    )
    return summaries.repair_totals(summaries.reparsed(e), "file")


@_query("""
WITH s AS (SELECT *, l_quantity / l_linenumber AS a, (l_quantity - l_discount) / l_linenumber AS b FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem)
SELECT s.l_orderkey, c.l_linenumber AS chosen, CAST(count(*) FILTER (WHERE a <= b) AS BIGINT) AS realized, round(sum(b - a), 6) AS calibrated
FROM s JOIN c ON s.l_orderkey = c.l_orderkey AND k = 1 GROUP BY ALL
""")
def q54_scores_and_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores for each token, calibrated ones, decisions with ties, and the best choice of each group."""
    li = _read(spark, sf_dir, "lineitem")
    own = li.withColumns({"a": summaries.token_score("l_quantity", "l_linenumber"), "b": summaries.token_score(F.col("l_quantity") - F.col("l_discount"), "l_linenumber"), "c": summaries.token_score(F.col("l_quantity") - F.col("l_discount"), "l_linenumber", "l_quantity")})
    scores = own.groupBy("l_orderkey").agg(F.count_if(summaries.decided("b", "a") == "REALIZED").alias("realized"), F.round(F.sum("c"), 6).alias("calibrated"))
    best = summaries.best_choice(li.select("l_orderkey", "l_extendedprice", "l_linenumber"), ["l_orderkey"], "l_extendedprice", "l_linenumber")
    return scores.join(best.select("l_orderkey", F.col("l_linenumber").alias("chosen")), "l_orderkey")


@_query("""
SELECT 'role' AS "column", role AS value, count(*) AS count FROM conversations GROUP BY 2 UNION ALL
SELECT 'label', CASE WHEN role = 'assistant' THEN 'REALIZED' WHEN role = 'user' THEN 'PAPER' ELSE '' END, count(*) FROM conversations GROUP BY 2
""")
def q55_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of several columns in one pass, and the labels that roles stand for."""
    c = _read(spark, sf_dir, "conversations").select("role", predicates.expected_label(F.when(F.col("role") == "assistant", " Closed").when(F.col("role") == "user", "paper").otherwise("other")).alias("label"))
    return summaries.counters(c, ["role", "label"])


@_query("""
SELECT conv_id, arg_min(role, turn) FILTER (WHERE role <> 'user') AS role, arg_min(text, turn) FILTER (WHERE text <> '') AS text FROM conversations GROUP BY conv_id
""")
def q56_first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of each column that is not blank."""
    c = _read(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "user", "").otherwise(F.col("role")))
    return summaries.first_filled_by(c, ["conv_id"], "turn", ["role", "text"])


@_query("""
WITH b AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY 1)
SELECT user_id, n, k FROM b WHERE contains('user ' || CAST(user_id AS VARCHAR), 'r 1') AND k = 5 AND n >= 10 ORDER BY n DESC, user_id LIMIT 25
""")
def q57_dashboard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by search words and status, in order, the first 25 as the table shows them."""
    b = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("k"))
    b = b.select("*", F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"), F.greatest(F.lit(0), 10 - F.col("n")).alias("remaining"), (F.col("k") == len(EVENT_TYPES)).alias("schema_ok"), F.lit("").alias("error"))
    return predicates.searched(b, "R 1", ["name"], "complete").orderBy(F.desc("n"), "user_id").limit(25).select("user_id", "n", "k")


@_query("""
WITH t AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag, l_linestatus) AS f, list(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END ORDER BY l_linenumber, l_returnflag, l_linestatus) AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(len(list_filter(range(1, len(f) + 1), lambda i: m[i] = 1)) AS INT) AS n_masked, CAST(coalesce(list_max(list_filter(range(1, len(f) + 1), lambda i: m[i] = 1)) - 1, -1) AS INT) AS last,
  CAST(len(list_filter(f, lambda x: x = 'N')) AS INT) AS n_region FROM t
""")
def q58_token_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a mode keeps: those of the mask, its last one, those of a region."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("on"))))
    t = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("x")).select("l_orderkey", F.col("x.l_returnflag").alias("f"), F.col("x.on").alias("m"))
    last = F.coalesce(F.get(summaries.kept_tokens("f", "m", "final"), F.lit(0)), F.lit(-1))
    return t.select("l_orderkey", F.size(summaries.kept_tokens("f", "m", "nonpad")).alias("n_masked"), last.alias("last"), F.size(summaries.kept_tokens("f", "m", "all", ["N"])).alias("n_region"))


@_query("""
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) + 2.5 * (i % 3))), 3) AS total, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE))), 3) + CAST(0 AS DOUBLE) AS first_token,
  round(list_sum(list_transform(range(1, 65), lambda i: 2 * CAST(embedding[i] AS DOUBLE) + 2.5 * (i % 3))), 3) AS last_token FROM embeddings
""")
def q59_steering_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors moved along a direction, all or the last of a prompt's tokens."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("h"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 3).cast("double")).alias("d"))
    own = e.withColumn("tokens", F.array("h", F.transform("h", lambda x: 2 * x))).select("vec_id", summaries.steered("h", "d", 2.5).alias("all"), summaries.steered_tokens("tokens", "d", 2.5, "last").alias("last"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 3) + F.lit(0.0)  # noqa: E731  no negative zeros
    return own.select("vec_id", total(F.col("all")).alias("total"), total(F.get("last", F.lit(0))).alias("first_token"), total(F.get("last", F.lit(1))).alias("last_token"))


@_query("""
WITH x AS (SELECT CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS a, CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS b, l_quantity AS y FROM lineitem), m AS (SELECT a, b, avg(y) AS y FROM x GROUP BY ALL)
SELECT 'a_b' AS term, round((SELECT y FROM m WHERE a = 1 AND b = 1) - (SELECT y FROM m WHERE a = 1 AND b = 0) - (SELECT y FROM m WHERE a = 0 AND b = 1) + (SELECT y FROM m WHERE a = 0 AND b = 0), 5) AS coef
UNION ALL SELECT 'const', round((SELECT y FROM m WHERE a = 0 AND b = 0), 5)
""")
def q60_interaction_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indicators and their product with classical errors; the product's coefficient is the difference of differences."""
    own = _read(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "N").cast("double").alias("a"), (F.col("l_linenumber") > 3).cast("double").alias("b"), "l_quantity")
    f = regression.fit_continuous(own.withColumn("a_b", F.col("a") * F.col("b")), "l_quantity", ["a", "b", "a_b"], cov_type="nonrobust")
    return regression.coefficient_table(spark, f).where("term in ('a_b', 'const')").select("term", F.round("coef", 5).alias("coef"))


@_query("""
SELECT kind, name, coalesce(amount, -1) AS amount FROM (SELECT 'region' AS kind, r_name AS name, NULL::BIGINT AS amount FROM region UNION ALL SELECT 'nation', n_name, n_regionkey FROM nation)
""")
def q61_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of different columns, null where one lacks a column."""
    a = _read(spark, sf_dir, "region").select(F.lit("region").alias("kind"), F.col("r_name").alias("name"))
    b = _read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("amount"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True).fillna(-1, ["amount"])


@_query("SELECT DISTINCT 'model-' || o_orderstatus AS model FROM orders WHERE o_orderkey % 2 = 0")
def q62_models_of_a_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct models of a version and temperature, which is compared as a number."""
    rows = _trial_rows(spark, sf_dir).withColumn("temperature", F.when(F.col("temperature") == "1", "1.00").otherwise("0.5"))
    return predicates.of_block(rows, temperature=1, version="absolute").select("model").distinct().orderBy("model")


@_query("""
SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_prompts, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS BIGINT) AS low FROM orders
""")
def q63_json_and_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written and read with a schema; a CSV written, appended to, and rewritten beside its backup."""
    o = _read(spark, sf_dir, "orders")
    base = scratch.folder(spark, "json")
    sinks.write_json(o.select("o_orderkey", "o_custkey"), f"{base}/json")
    js = tables.json_lines(spark, f"{base}/json", "o_orderkey long, o_custkey long")
    cut = o.select("o_orderkey", "o_orderpriority")
    sinks.write_csv(cut.where("o_orderkey % 2 = 0"), f"{base}/csv")
    sinks.append_csv(cut.where("o_orderkey % 2 = 1"), f"{base}/csv")
    sinks.replace_csv(tables.csv(spark, f"{base}/csv").select("o_orderkey", "o_orderpriority"), f"{base}/csv")
    back = tables.csv(spark, f"{base}/csv")
    a = js.agg(F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_prompts"))
    b = back.agg(F.sum(F.col("o_orderkey").cast("long")).alias("keys"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"))
    return a.crossJoin(b)  # one row each


@_query("""
SELECT 'o_orderstatus-' || o_orderstatus || '.csv' AS file, count(*) AS n_rows FROM orders GROUP BY 1
""")
def q64_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file folder for each group, counted from the files read back (K4)."""
    path = scratch.folder(spark, "split")
    sinks.write_split(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    back = tables.csv(spark, path, recursive=True)
    return back.groupBy(F.regexp_extract("_path", "(o_orderstatus-[^/]*)/", 1).alias("file")).agg(F.count("*").alias("n_rows"))


@_query("""
WITH o AS (
  SELECT *, CASE WHEN o_orderkey % 50 = 7 THEN '' ELSE 'model-' || o_orderstatus END AS old_model FROM orders
), row_ AS (
  SELECT 1 AS old, 1 AS file, o_orderkey AS k, o_orderpriority AS c, o_custkey AS n, 'model-' || o_orderstatus AS m FROM o WHERE o_orderkey % 4 <> 3 AND o_orderstatus <> 'P'
  UNION ALL SELECT 0, 0, o_orderkey, o_orderpriority, o_custkey, old_model FROM o WHERE old_model IN ('', 'model-P')
), best AS (
  SELECT * FROM row_ QUALIFY row_number() OVER (PARTITION BY m, c, n ORDER BY old, file, k) = 1
)
SELECT CAST(row_number() OVER (ORDER BY m, c, n, file, k) AS VARCHAR) AS trial_id, c AS condition, m AS model, CAST(n AS VARCHAR) AS run_number, CAST(k AS VARCHAR) AS origin FROM best
""")
def q65_merge_blocks_and_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block rows over an older output that they supersede, one row each, with new ids in order; rows without a block stay."""
    own = _trial_rows(spark, sf_dir).withColumns({"request_id": F.lit(""), "prompt_text": F.col("trial_id")})
    key = F.col("trial_id").cast("long")
    places = {"_file": F.lit(1), "_row": key}
    blocks = own.where((key % 4 != 3) & (F.col("model") != "model-P")).withColumns(places)
    old = own.withColumn("model", F.when(key % 50 == 7, "").otherwise(F.col("model"))).withColumns(places)
    return trials.merge(blocks, old).select("trial_id", "condition", "model", "run_number", F.col("prompt_text").alias("origin"))
