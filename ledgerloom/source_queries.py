"""Registered queries of prompt and condition sources, partition and resume reports, prompt checks and streams, with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import prompts, rewrites, text
from .operators import checks, formula, orders, pairs, partitioning, predicates, ranks, regression, summaries, trials, vectors
from .plans import generation
from .queries import PRIORITIES, _query, _read
from .report_queries import _trial_rows
from .sources import activations, commits, scratch, sinks, tables
from .streaming import progress as stream


@_query("""
SELECT 'c' || n_nationkey AS condition, CASE WHEN n_nationkey % 2 = 0 THEN 'paper' ELSE 'realized' END AS outcome_type, CAST((n_nationkey - 12) * 30 AS INTEGER) AS amount FROM nation
""")
def q66_condition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions written as CSV and read back: trimmed, types in lower case, whole amounts, wrong ones raise."""
    n, path = _read(spark, sf_dir, "nation"), scratch.folder(spark, "conditions")
    kind = F.when(F.col("n_nationkey") % 2 == 0, "Paper").otherwise(" REALIZED ")
    sinks.write_csv(n.select(F.concat(F.lit(" c"), F.col("n_nationkey").cast("string")).alias("condition"), kind.alias("outcome_type"), ((F.col("n_nationkey") - 12) * 30).alias("amount")), path)
    return tables.conditions(spark, path)


@_query("""
SELECT c_mktsegment AS segment, count(*) AS n_prompts, count(*) FILTER (WHERE c_custkey % 5 = 0) AS n_numbered, CAST(sum(length('Read ' || c_name || ', "twice".' || chr(10) || 'Go.')) AS BIGINT) AS n_chars
FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1
""")
def q67_prompt_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with ids of their own or numbered ones, other columns as metadata, of one split."""
    c, path = _read(spark, sf_dir, "customer"), scratch.folder(spark, "prompts")
    own = c.select(
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("id"), F.col("c_custkey").cast("string"))).otherwise(" ").alias("prompt_id"), F.concat(F.lit("Read "), "c_name", F.lit(', "twice".\nGo.')).alias("prompt_text"),
        F.when(F.col("c_custkey") % 2 == 0, "behavior_eval").otherwise("train").alias("split"), F.col("c_mktsegment").alias("segment"),
    )
    sinks.write_csv(own, path)
    got = tables.split_rows(tables.prompts(spark, path).withColumn("split", F.col("metadata")["split"]))
    return got.groupBy(F.col("metadata")["segment"].alias("segment")).agg(F.count("*").alias("n_prompts"), F.count_if(F.col("prompt_id").startswith("prompt_")).alias("n_numbered"), F.sum(F.length("prompt_text")).alias("n_chars"))


@_query("""
SELECT CAST(o_custkey AS VARCHAR) AS prompt_id, CAST(max(o_orderkey) AS BIGINT) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1
""")
def q68_last_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key that is not blank."""
    key = F.when(F.col("o_custkey") % 7 == 0, " ").otherwise(F.col("o_custkey").cast("string"))
    return tables.last_by_key(_read(spark, sf_dir, "orders").select(key.alias("prompt_id"), "o_orderkey", "o_orderpriority"), "prompt_id", "o_orderkey")


@_query("""
WITH t AS (SELECT o_custkey % 50 AS b, CASE WHEN o_orderkey % 997 = 5 THEN 9 ELSE o_orderkey % 6 END AS c, o_orderkey % 991 = 7 AS other FROM orders),
f AS (SELECT b, count(DISTINCT c) <> 6 OR bool_or(c = 9) OR bool_or(other) AS legacy FROM t GROUP BY b)
SELECT 'm' || b AS model, count(*) AS n_rows, count(*) FILTER (WHERE legacy) AS n_legacy FROM t JOIN f USING (b) GROUP BY b
""")
def q69_partition_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of blocks with other conditions or prompts than expected; white space in prompts does not count."""
    six = _read(spark, sf_dir, "nation").where("n_nationkey < 6").select(F.col("n_nationkey").cast("long").alias("k"))
    kind, amount = F.when(F.col("k") % 2 == 0, "paper").otherwise("realized"), (F.col("k") - 3) * 30
    expected = six.select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("condition"), kind.alias("outcome_type"), amount.cast("int").alias("amount"))
    own = _read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 6)
    shown = F.regexp_replace(prompts.prompt_text(kind, amount, F.lit("absolute")), " ", "  ")
    own = own.select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 50).cast("string")).alias("model"), F.lit("1").alias("temperature"), F.lit("absolute").alias("prompt_version"),
        F.when(F.col("o_orderkey") % 997 == 5, "c9").otherwise(F.concat(F.lit("c"), F.col("k").cast("string"))).alias("condition"), F.when(F.col("o_orderkey") % 991 == 7, "another text").otherwise(shown).alias("prompt_text"),
    )
    return partitioning.classify(own, expected).groupBy("model").agg(F.count("*").alias("n_rows"), F.count_if("is_legacy").alias("n_legacy"))


@_query("""
WITH b AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) <> 5 AS s, bool_or(o_totalprice > 450000) AS p FROM orders GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS blocks, count(*) FILTER (WHERE s) AS schema_blocks, count(*) FILTER (WHERE p) AS prompt_blocks, count(*) FILTER (WHERE s OR p) AS legacy_blocks FROM b
""")
def q70_partition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rows and blocks by kind of difference."""
    o = _read(spark, sf_dir, "orders").withColumn("drift", F.col("o_totalprice") > 450000)
    return partitioning.report(partitioning.block_flags(o, ["o_custkey"], "o_orderpriority", list(PRIORITIES), "drift"))


@_query("SELECT count(DISTINCT o_orderpriority || '|' || o_custkey || '|' || o_orderstatus) FILTER (WHERE o_custkey > 0) AS completed, CAST(max(o_orderkey) AS BIGINT) AS max_trial_id FROM orders")
def q71_resume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed keys and the largest trial id; temperatures 1 and 1.0 are one."""
    return trials.resume_state(_trial_rows(spark, sf_dir))


@_query("""
SELECT 'plan__c' || c_custkey AS batch_id, count(o_orderkey) AS done, greatest(0, 12 - count(o_orderkey)) AS remaining FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def q72_remaining_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each job that existing ids with the job's prefix leave open."""
    jobs = _read(spark, sf_dir, "customer").select(F.concat(F.lit("plan__c"), F.col("c_custkey").cast("string")).alias("batch_id"), F.lit(12).cast("long").alias("count"))
    ids = _read(spark, sf_dir, "orders").select(F.concat_ws("__", F.lit("plan"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderkey").cast("string")).alias("prompt_id"))
    return generation.remaining(jobs, ids).select("batch_id", "done", "remaining")


@_query("""
WITH t AS (SELECT event_id, event_id % 4 AS m, CASE event_id % 4 WHEN 0 THEN 'The trader waits for a ' || event_type || ', 12 times.' WHEN 1 THEN 'Then I keep my ' || event_type || '.'
  WHEN 2 THEN 'They feel regret about a vector of ' || event_type || '.' ELSE 'Give two integers: 1 to 1000 and 1-5.' END AS s FROM events)
SELECT event_id, len(regexp_extract_all(s, '\\b\\w+\\b')) AS words, s AS core, concat_ws(',', CASE WHEN m <> 3 THEN 'missing_behavior_instruction' END, CASE WHEN m = 1 THEN 'first_person' END, CASE WHEN m = 2 THEN 'internal_label_leak' END) AS issues,
  CASE m WHEN 1 THEN 'first_person' WHEN 2 THEN 'emotion_label' END AS issue, m <> 3 AS completed FROM t
""")
def q73_prompt_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of prompts, their scenario's words and core text, the first failed rule of a generated one, and added answer forms."""
    m = F.col("event_id") % 4
    s = F.when(m == 0, F.concat(F.lit("The trader waits for a "), "event_type", F.lit(", 12 times."))).when(m == 1, F.concat(F.lit("Then I keep my "), "event_type", F.lit(".")))
    s = s.when(m == 2, F.concat(F.lit("They feel regret about a vector of "), "event_type", F.lit("."))).otherwise("Give two integers: 1 to 1000 and 1-5.")
    own = _read(spark, sf_dir, "events").select("event_id", F.concat(F.lit(text.PROMPT_PREFIX), s, F.lit(text.PROMPT_SUFFIX)).alias("x"))
    x, yes = F.col("x"), F.lit(True)
    full = text.with_instruction(x, yes, F.lit("wager"), F.lit("casino"))
    return own.select(
        "event_id", text.word_count(x).cast("long").alias("words"), text.core(x).alias("core"), F.array_join(text.prompt_issues(x), ",").alias("issues"),
        text.generated_issue(x, F.lit("none"), ~yes, F.lit("none")).alias("issue"), (full.contains(text.CASINO_FORM) & text.has_instruction(full)).alias("completed"),
    )


@_query("""
SELECT o_orderkey, 'a' AS variant_id, 'Text "' || o_orderpriority || '"' AS prompt_text FROM orders UNION ALL SELECT o_orderkey, 'variant_002', 'more' FROM orders WHERE o_orderkey % 2 = 0
""")
def q74_decoded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts out of JSON answers, with numbered ids where an answer gives none."""
    one, two = F.struct(F.lit("a").alias("variant_id"), F.concat(F.lit('Text "'), "o_orderpriority", F.lit('"')).alias("prompt_text")), F.struct(F.lit(" ").alias("variant_id"), F.lit("more").alias("prompt_text"))
    answer = F.to_json(F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.array(one, two)).otherwise(F.array(one)).alias("prompts")))
    return generation.decode_prompts(_read(spark, sf_dir, "orders").select("o_orderkey", answer.alias("content"))).drop("content")


@_query("SELECT l_orderkey, l_linenumber % 3 AS feature, greatest(max(l_quantity - 25), 0.0) AS activation FROM lineitem GROUP BY ALL")
def q75_max_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest activation of each feature of a prompt, at least 0."""
    own = _read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("feature"), (F.col("l_quantity") - 25).alias("activation"))
    return vectors.max_pool(own, "l_orderkey", "feature", "activation")


@_query("""
WITH g AS (SELECT o_orderstatus AS s, o_orderpriority AS c, avg(o_totalprice) AS m FROM orders GROUP BY ALL)
SELECT a.s AS model, 'condition_' || a.c AS term, round(a.m - b.m, 2) AS coef FROM g a JOIN g b ON a.s = b.s WHERE b.c = '1-URGENT' AND a.c <> '1-URGENT'
""")
def q76_coefficients_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One regression for each model from one grouping."""
    fits = regression.fit_by(_read(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "o_orderpriority", list(PRIORITIES), PRIORITIES[0], [])
    rows = [(model, f"condition_{n.removeprefix('condition_')}", round(float(c), 2)) for model, f in fits.items() for n, c in zip(f.names, f.coef, strict=True) if n != "const"]
    return spark.createDataFrame(rows, "model string, term string, coef double")


@_query("""
SELECT o_orderpriority, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') OR o_orderstatus = 'F' GROUP BY 1
""")
def q77_file_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a second folder take the place of those of the same name."""
    o = _read(spark, sf_dir, "orders")
    at = lambda folder: F.concat(F.lit(f"/{folder}/block__"), "o_orderpriority", F.lit(".csv"))
    extra = o.where("o_orderpriority in ('1-URGENT', '5-LOW') and o_orderstatus = 'F'").withColumn("_path", at("extra"))
    return tables.overlay(o.withColumn("_path", at("blocks")), extra).groupBy("o_orderpriority").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys"))


@_query("""
SELECT user_id % 5 AS model, CASE WHEN grouping(t) = 1 THEN 'version' ELSE 'temperature' END AS level, t AS temperature, event_type AS prompt_version, count(*) AS n_rows, count(*) FILTER (WHERE value > 10) AS n_valid,
  count(DISTINCT event_id % 9) AS n_conditions, round(avg(value) FILTER (WHERE value > 10), 4) AS mean FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS t FROM events)
GROUP BY GROUPING SETS ((user_id % 5, event_type), (user_id % 5, t, event_type))
""")
def q78_robustness_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows, distinct conditions and means by version, and by temperature within it; null temperatures are a group."""
    e = _read(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("model"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3).alias("temperature"), F.col("event_type").alias("prompt_version"),
        (F.col("event_id") % 9).alias("condition"), (F.col("value") > 10).alias("valid"), "value",
    )
    return summaries.robustness(e, "valid", "value", "condition").withColumn("mean", F.round("mean", 4))


@_query("""
SELECT c_custkey, coalesce(c_mktsegment, '') AS segment, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(last, '') AS last_text FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderpriority, o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def q79_attached_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with their condition's summary as a struct, and with texts that are blank where there is none."""
    o = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max_by("o_orderpriority", "o_orderkey").alias("last"))
    got = summaries.attached(_read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), o, "c_custkey", "summary")
    return got.select("c_custkey", F.coalesce("segment", F.lit("")).alias("segment"), F.coalesce("summary.n", F.lit(0)).alias("n"), F.coalesce("summary.last", F.lit("")).alias("last_text"))


@_query("""
SELECT 'model-' || o_orderstatus AS model, '1' AS temperature, 'absolute' AS prompt_version, o_orderpriority AS condition, count(*) AS n_rows, count(DISTINCT o_custkey) FILTER (WHERE o_custkey > 0) AS runs, true AS active FROM orders GROUP BY ALL
""")
def q80_streamed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block files, one for each block, counted as a stream that ends when all are read; runs are bitmaps (S8, K4, A9, streaming progress)."""
    base = scratch.folder(spark, "stream")
    sinks.write_blocks(_trial_rows(spark, sf_dir), f"{base}/blocks")
    query = stream.start(stream.counts(stream.block_stream(spark, f"{base}/blocks")), lambda df, _: df.write.mode("overwrite").parquet(f"{base}/counts"), f"{base}/checkpoint", once=True)
    query.awaitTermination()
    return stream.totals(spark.read.parquet(f"{base}/counts"), 86_400)


def _activation_run(spark: SparkSession, sf_dir: str) -> str:
    """Vectors as a run of three layers: a vector's prompt has one to three tokens, each half of the one before."""
    e = _read(spark, sf_dir, "embeddings").withColumn("n", (1 + F.col("vec_id") % 3).cast("int"))
    places = F.sequence(F.lit(0), F.col("n") - 1)
    scaled = F.transform(places, lambda i: F.transform("embedding", lambda x: (x * F.col("layer") / F.pow(F.lit(2.0), i)).cast("float")))
    rows = e.withColumn("layer", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).select(
        "layer", F.col("vec_id").cast("int").alias("position"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("prompt_id"), F.lit("resid_post").alias("activation_site"), F.lit("all").alias("token_mode"),
        F.transform(places, lambda i: (i + 100).cast("long")).alias("token_ids"), places.alias("token_positions"), F.slice(F.array(F.lit("scenario"), F.lit("question"), F.lit("answer")), 1, F.col("n")).alias("token_regions"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), scaled.alias("vectors"),
    )
    path = scratch.folder(spark, "activations")
    activations.write_run(rows, path, 64, manifest={"extraction": {"token_mode": "all", "activation_site": "resid_post"}})
    return path


@_query("""
WITH t AS (SELECT *, unnest(range(0, 1 + vec_id % 3)) AS i FROM embeddings), k AS (SELECT unnest([2, 4]) AS layer)
SELECT layer, 'v' || vec_id AS prompt_id, CAST(i AS INTEGER) AS token_index, 100 + i AS token_id, CASE i WHEN 0 THEN 'scenario' ELSE 'answer' END AS token_region,
  round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * layer / power(2, i))), 4) AS total
FROM t, k WHERE label IN (1, 2, 3) AND i <> 1
""")
def q81_activation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of several layers with equal file names, written and read by layer, region and metadata."""
    got = activations.vectors(spark, _activation_run(spark, sf_dir), [2, 4], ["scenario", "answer"], {"label": ["1", "2", "3"]})
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return got.select("layer", "prompt_id", "token_index", "token_id", "token_region", F.round(total, 4).alias("total"))


@_query("""
WITH r AS (SELECT vec_id % 7 AS k, 1 + vec_id % 3 AS n FROM embeddings, range(0, 3)),
v AS (SELECT unnest(list_filter([CASE WHEN k = 1 THEN 'token_mode' END, CASE WHEN k = 2 THEN 'activation_site' END, CASE WHEN k IN (3, 6) THEN 'token_positions' END,
  CASE WHEN k = 4 AND n <> 1 OR k = 6 THEN 'token_regions' END, CASE WHEN k IN (5, 6) THEN 'num_tokens' END, CASE WHEN k = 6 THEN 'tokens_beyond_tensor' END], lambda x: x IS NOT NULL)) AS kind FROM r
  UNION ALL SELECT 'total_prompts')
SELECT kind, count(*) AS n, CAST(least(count(*), 25) AS INTEGER) AS shown FROM v GROUP BY kind
""")
def q82_activation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of error in a run, with the first places of each; index rows are altered by their prompts' numbers."""
    run = _activation_run(spark, sf_dir)
    k = F.substring("prompt_id", 2, 20).cast("long") % 7
    rows = activations.index_rows(spark, run, activations.headers(spark, run)).withColumns({
        "token_mode": F.when(k == 1, "last").otherwise(F.col("token_mode")), "activation_site": F.when(k == 2, "mlp").otherwise(F.col("activation_site")),
        "token_positions": F.when(k == 3, F.array().cast("array<int>")).otherwise(F.col("token_positions")), "token_regions": F.when(k == 4, F.array(F.lit("x"))).otherwise(F.col("token_regions")),
        "num_tokens": F.when(k == 5, 99).otherwise(F.col("num_tokens")), "token_ids": F.when(k == 6, F.array_repeat(F.lit(7).cast("long"), 99)).otherwise(F.col("token_ids")),
    })
    found = activations.validate(spark, run, _read(spark, sf_dir, "embeddings").where("vec_id > 0"), rows)
    return found.select("kind", "n", F.size("places").alias("shown"))


@_query("""
WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x, l_returnflag || l_linenumber AS a FROM lineitem),
g AS (SELECT y, x, 'all' AS a, 'no_controls' AS analysis FROM d UNION ALL SELECT y, x, a, 'with_controls' FROM d),
c AS (SELECT *, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, 1.0 / count(*) OVER w AS h0, y - avg(y) OVER (PARTITION BY analysis) AS t FROM g WINDOW w AS (PARTITION BY analysis, a)),
b AS (SELECT analysis, sum(u * v) / sum(u * u) AS coef, sum(u * u) AS s, count(*) AS n, sum(t * t) AS total FROM c GROUP BY 1),
e AS (SELECT c.analysis, u, v - coef * u AS e, h0 + u * u / s AS h, coef, s, n, total FROM c JOIN b USING (analysis))
SELECT analysis, 'y' AS outcome, n, 'x' AS term, round(coef, 6) AS coef, round(sqrt(sum(u * u * e * e / ((1 - h) * (1 - h)))) / s, 6) AS se, round(1 - sum(e * e) / total, 6) AS r_squared FROM e GROUP BY analysis, n, coef, s, total
""")
def q84_formula_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by formula without and with categorical controls, with HC3 errors."""
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("a"))
    got = formula.model_rows(spark, [("no_controls", li, "y ~ x", "x"), ("with_controls", li, "y ~ x + C(a)", "x")])
    return got.select("analysis", "outcome", "n", "term", *[F.round(c, 6).alias(c) for c in ("coef", "se", "r_squared")])


_ORDER_SEED = 7


@_query(f"""
WITH RECURSIVE n AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM orders), d AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM n),
x0 AS (SELECT x, x % a AS l, x // a AS h, a, b, n FROM (SELECT n, a, b, unnest(range(0, a * b)) AS x FROM d)),
x1 AS (SELECT x, (l + CAST('0x' || substr(md5('{_ORDER_SEED}:0:' || h), 1, 8) AS BIGINT) % a) % a AS l, h, a, b, n FROM x0),
x2 AS (SELECT x, l, (h + CAST('0x' || substr(md5('{_ORDER_SEED}:1:' || l), 1, 8) AS BIGINT) % b) % b AS h, a, b, n FROM x1),
x3 AS (SELECT x, (l + CAST('0x' || substr(md5('{_ORDER_SEED}:2:' || h), 1, 8) AS BIGINT) % a) % a AS l, h, a, b, n FROM x2),
x4 AS (SELECT x, l + a * ((h + CAST('0x' || substr(md5('{_ORDER_SEED}:3:' || l), 1, 8) AS BIGINT) % b) % b) AS y, n FROM x3),
w AS (SELECT x, y, n FROM x4 WHERE x < n UNION ALL SELECT w.x, x4.y, w.n FROM w JOIN x4 ON w.y = x4.x WHERE w.y >= w.n),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS x FROM orders)
SELECT o_orderkey, y AS place FROM o JOIN w USING (x) WHERE y < n
""")
def q85_seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial plan in a seeded order: a keyed bijection of row numbers, without a sort."""
    o = ranks.numbered(_read(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], "i", 0)
    return orders.shuffled(o, "i", _ORDER_SEED).select("o_orderkey", "place")


@_query("""
SELECT t, model, count(*) AS n_rows, count(DISTINCT id) AS ids FROM (
  SELECT unnest(['merged', 'grouped']) AS t, 'model-' || o_orderstatus AS model, o_orderpriority || o_custkey AS id FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0)
) GROUP BY ALL
""")
def q86_committed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of block rows merged into a table and its grouped copy, both in one commit (A5, K3)."""
    own = _trial_rows(spark, sf_dir).withColumn("request_id", F.lit(""))
    key = F.col("trial_id").cast("long")
    rows = own.withColumns({"_file": F.lit(1), "_row": key}).where((F.col("model") != "model-P") | (key % 2 == 0))
    folder = scratch.folder(spark, "committed")
    commits.reconcile(rows.where("model <> 'model-F'"), folder)
    commits.reconcile(rows.where("model = 'model-F'"), folder)
    both = [commits.current(spark, folder, t).withColumn("t", F.lit(t)) for t in ("merged", "grouped")]
    return both[0].unionByName(both[1]).groupBy("t", "model").agg(F.count("*").alias("n_rows"), F.countDistinct(F.concat("condition", "run_number")).alias("ids"))


@_query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'no_json' WHEN 2 THEN 'no_list' WHEN 3 THEN 'empty_text' END AS error,
  CASE WHEN o_orderkey % 5 IN (0, 4) THEN CAST(i AS INTEGER) ELSE 0 END AS "at", CASE WHEN o_orderkey % 5 IN (0, 4) THEN CASE i WHEN 1 THEN 'p-' || o_orderstatus ELSE 'pair_002' END END AS pair_id,
  CASE WHEN o_orderkey % 5 IN (0, 4) THEN CASE i WHEN 1 THEN 'open ' || o_orderpriority ELSE 'more' END END AS paper_open_prompt_text,
  CASE WHEN o_orderkey % 5 IN (0, 4) THEN CASE i WHEN 1 THEN 'closed "x"' ELSE 'end' END END AS realized_closed_prompt_text
FROM orders, range(1, 3) t(i) WHERE i = 1 OR o_orderkey % 5 IN (0, 4)
""")
def q87_decoded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs out of chat responses: nested or in parts, fenced or not, with a reason for each that gives none."""
    o = _read(spark, sf_dir, "orders")
    text = lambda x: F.lit(x)
    one = F.struct(F.concat(text("p-"), "o_orderstatus").alias("pair_id"), F.concat(text(" open "), "o_orderpriority").alias("paper_open_prompt_text"), text('closed "x"').alias("realized_closed_prompt_text"))
    two = F.struct(text("  ").alias("pair_id"), text("more").alias("paper_open_prompt_text"), F.when(F.col("o_orderkey") % 5 == 3, " ").otherwise("end").alias("realized_closed_prompt_text"))
    pairs = F.to_json(F.struct(F.array(one, two).alias("pairs")))
    answer = F.when(F.col("o_orderkey") % 5 == 1, "sorry, no").when(F.col("o_orderkey") % 5 == 2, '{"prompts": []}').when(F.col("o_orderkey") % 5 == 4, F.concat(text("Here:\n```json\n"), pairs, text("\n```\n"))).otherwise(pairs)
    part = lambda x: F.struct(text("text").alias("type"), x.alias("text"))
    whole = F.to_json(F.struct(F.array(F.struct(F.struct(answer.alias("content")).alias("message"))).alias("choices")))
    cut = F.array(part(F.substring(answer, 1, 5)), part(F.substring(answer, F.lit(6), F.length(answer))))
    parts = F.to_json(F.struct(F.array(F.struct(F.struct(cut.alias("content")).alias("message"))).alias("choices")))
    own = o.select("o_orderkey", generation.answer_content(F.when(F.col("o_orderkey") % 2 == 0, whole).otherwise(parts)).alias("content"))
    return generation.decode_answers(own, "content", "pairs").drop("content", "notes").withColumn("at", F.coalesce("at", F.lit(0)))


_CLASSIFIED = r"E'\n\nTask: Determine whether the described outcome is already realized (cashed out or position closed) or still paper (open/unrealized).\nAnswer now.\nReturn exactly one label: REALIZED or PAPER.\nLabel:'"


@_query(rf"""
WITH e AS (SELECT event_id, event_id % 5 AS m, E'Read the following short scenario.\n\nScenario:\nA ' || event_type || ' in session ' || user_id || ' stays open' AS base, {_CLASSIFIED} AS c, E'\n\nDo not answer yet. Continue processing the scenario.' AS s FROM events),
x AS (SELECT *, CASE m WHEN 0 THEN base || s WHEN 1 THEN base || E'\n\nAnswer now.\nReturn.' WHEN 2 THEN base || c || E'\n' WHEN 3 THEN base || ' answer with exactly two integers on separate lines: a, b.' || s ELSE base || E'\n\n\n\nend' || s END AS x FROM e),
k AS (SELECT *, CASE WHEN suffix(x, s) THEN rtrim(substr(x, 1, length(x) - length(s)), E' \n') ELSE x END AS cut,
  CASE m WHEN 2 THEN base || E'\n\nTask: Determine whether the described outcome is already realized (cashed out or position closed) or still paper (open/unrealized).' WHEN 4 THEN base || E'\n\nend' ELSE base END AS own FROM x)
SELECT event_id, sha256(cut || E'\n\nAnswer now. Return only the two requested integers on separate lines, with no labels and no explanation.\n') AS two_line, sha256(cut || E'\n\nAnswer now.\n') AS plain, sha256(cut || E'\n\nAnswer:\n') AS scoring,
  sha256(own || c || E'\n') AS classification, sha256(CASE WHEN m = 2 THEN base || c ELSE own || c END) AS kept FROM k
""")
def q88_prompt_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with other endings made into prompts for generation, scoring and classification."""
    m = F.col("event_id") % 5
    base = F.concat(F.lit(text.PROMPT_PREFIX), F.lit("A "), "event_type", F.lit(" in session "), F.col("user_id").cast("string"), F.lit(" stays open"))
    shown = F.when(m == 0, F.concat("b", F.lit(text.PROMPT_SUFFIX))).when(m == 1, F.concat("b", F.lit("\n\nAnswer now.\nReturn."))).when(m == 2, rewrites.classification(F.col("b")))
    shown = shown.when(m == 3, F.concat("b", F.lit(" answer with exactly two integers on separate lines: a, b."), F.lit(text.PROMPT_SUFFIX))).otherwise(F.concat("b", F.lit("\n\n\n\nend"), F.lit(text.PROMPT_SUFFIX)))
    own = _read(spark, sf_dir, "events").select("event_id", m.alias("m"), base.alias("b")).select("event_id", shown.alias("x"))
    x = F.col("x")
    new = {"two_line": rewrites.generation(x), "plain": rewrites.generation(x, "plain"), "scoring": rewrites.scoring(x), "classification": rewrites.classification(x), "kept": rewrites.classification(x, True)}
    return own.select("event_id", *[F.sha2(v, 256).alias(k) for k, v in new.items()])


@_query("""
WITH r AS (SELECT o_orderkey AS k, o_custkey AS pair, CASE o_orderstatus WHEN 'O' THEN 'paper_open' WHEN 'F' THEN 'realized_closed' ELSE 'other' END AS role, o_orderpriority AS domain, 2 + o_orderkey % 40 AS words FROM orders),
g AS (SELECT pair, count(*) AS n, count(DISTINCT role) FILTER (WHERE role <> 'other') AS roles, count(DISTINCT domain) AS domains, max(words) - min(words) AS delta FROM r GROUP BY 1)
SELECT pair_id, issue, count(*) AS n FROM (
  SELECT CAST(pair AS VARCHAR) AS pair_id, unnest(CASE WHEN n <> 2 OR roles <> 2 THEN ['bad_pair_roles'] WHEN domains > 1 AND delta > 25 THEN ['pair_metadata_mismatch', 'pair_word_delta'] WHEN domains > 1 THEN ['pair_metadata_mismatch'] WHEN delta > 25 THEN ['pair_word_delta'] ELSE [] END) AS issue FROM r JOIN g USING (pair)
  UNION ALL SELECT CAST(pair AS VARCHAR), 'missing_behavior_instruction' FROM r UNION ALL SELECT '', 'duplicate_prompt_id' FROM (SELECT 1 FROM r GROUP BY k // 3 HAVING count(*) > 1)
) GROUP BY ALL
""")
def q89_pair_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of prompts, repeated ids and pairs: roles, shared fields and lengths."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    story = F.array_join(F.array_repeat(F.lit("word"), (2 + k % 40).cast("int")), " ")
    rows = _read(spark, sf_dir, "orders").select(
        F.floor(k / 3).cast("string").alias("prompt_id"), F.concat(F.lit(text.PROMPT_PREFIX), story, F.lit(text.PROMPT_SUFFIX)).alias("prompt_text"), F.col("o_custkey").cast("string").alias("pair_id"),
        F.when(status == "O", "paper_open").when(status == "F", "realized_closed").otherwise("other").alias("pair_role"), F.col("o_orderpriority").alias("domain"), *[F.lit("").alias(c) for c in ("outcome_valence", "amount_bucket", "source_llm")],
    )
    return checks.prompt_issues(rows).groupBy("pair_id", "issue").agg(F.count("*").alias("n"))


@_query("SELECT o_orderpriority AS priority, count(*) AS n_rows FROM orders GROUP BY 1")
def q90_result_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result files of a project, found and read by name."""
    root = scratch.folder(spark, "project")
    sinks.write_split(_read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_orderpriority").alias("priority")), f"{root}/results/by_priority", ["p"])
    parts = [tables.dataset(spark, root, name) for name in tables.datasets(spark, root)]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("priority").agg(F.count("*").alias("n_rows"))


#: Lines of a JSON file in the query of faults.
_JSON_LINES = 4000


@_query(f"""
WITH n AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT CAST(i // {_JSON_LINES} AS INTEGER) AS file, CAST(i % {_JSON_LINES} + 1 AS BIGINT) AS line, CASE WHEN k % 4 = 1 THEN 'not_json' ELSE 'not_an_object' END AS fault FROM n WHERE k % 4 IN (1, 2)
""")
def q91_json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of JSON lines with blank, broken and other lines: each fault with its file and line, no line being sorted when read."""
    k = F.col("o_orderkey")
    o = ranks.numbered(_read(spark, sf_dir, "orders").select("o_orderkey"), [k], "i", 0)
    line = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit('{"k": '), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise(F.to_json(F.struct(k.alias("k"))))
    path = scratch.folder(spark, "json-lines")
    rows = o.select(F.floor(F.col("i") / _JSON_LINES).cast("int").alias("file"), "i", line.alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "i").select("file", "value").write.partitionBy("file").text(path)
    return tables.json_faults(spark, path).select(F.regexp_extract("path", "/file=([0-9]+)/", 1).cast("int").alias("file"), "line", "fault")


@_query("""
SELECT CAST(o_custkey AS VARCHAR) AS prompt_id, coalesce('second ' || max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0), 'first ' || max(o_orderkey)) AS prompt_text FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_custkey
""")
def q92_prompt_texts_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of prompts of two runs and one without the file; the last line of the last run counts."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("prompt_id"))
    root = scratch.folder(spark, "runs")
    for name, rows in (("first", o), ("second", o.where("o_orderkey % 2 = 0"))):
        own = rows.withColumn("prompt_text", F.concat_ws(" ", F.lit(name), "o_orderkey"))
        own.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").drop("o_orderkey").write.json(f"{root}/{name}/prompts.jsonl")
    return tables.prompt_texts(spark, [f"{root}/{name}" for name in ("first", "missing", "second")])


@_query("""
WITH b AS (SELECT l_orderkey, any_value(l_quantity) AS q, any_value(l_discount) AS d FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(*) = 1),
m AS (SELECT l_linenumber AS scale, l.l_quantity - b.q AS x, greatest(l.l_discount, b.d) AS d FROM lineitem l JOIN b USING (l_orderkey) WHERE l_linenumber > 1),
s AS (SELECT DISTINCT scale, subset FROM m, (VALUES ('all_valid'), ('strict_valid')) t(subset))
SELECT CAST(s.scale AS INTEGER) AS scale, s.subset, count(x) AS n, round(avg(x), 4) AS mean_l_quantity_delta, round(median(x), 4) AS median_l_quantity_delta
FROM s LEFT JOIN m ON m.scale = s.scale AND m.d < CASE s.subset WHEN 'all_valid' THEN 0.09 ELSE 0.05 END AND (s.subset = 'all_valid' OR s.scale < 7) GROUP BY ALL
""")
def q93_matched_delta_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas to the base scale over all valid and strictly valid pairs, with a row for what has none."""
    discount, scale = F.col("l_discount"), F.col("l_linenumber")
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", scale.alias("scale"), "l_quantity", (discount < 0.09).alias("valid"), ((discount < 0.05) & (scale < 7)).alias("strict"))
    one = li.where("scale = 1").groupBy("l_orderkey").count().where("count = 1").select("l_orderkey")
    out = pairs.matched_delta_subsets(li.join(one, "l_orderkey", "left_semi"), "l_orderkey", "scale", 1, ["l_quantity"], {"all_valid": "valid", "strict_valid": "strict"})
    return out.select("scale", "subset", "n", *[F.round(F.nullif(c, F.lit(float("nan"))), 4).alias(c) for c in out.columns if c.endswith("_delta")])


@_query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n_rows, CAST(sum(o_custkey) AS BIGINT) AS texts FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2")
def q94_merged_prompt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt files of three models as one, blank ids left out and repeated ones refused."""
    base, k = scratch.folder(spark, "prompt-files"), F.col("o_orderkey")
    own = _read(spark, sf_dir, "orders").select(F.when(k % 5 == 0, "").otherwise(k.cast("string")).alias("prompt_id"), F.col("o_custkey").cast("string").alias("prompt_text"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    for status in ("O", "F", "P"):
        sinks.write_csv(own.where(F.col("status") == status), f"{base}/{status}")
    got = tables.merged_prompts([tables.csv(spark, f"{base}/{status}").drop("_path", "_row") for status in ("O", "F", "P")])
    return got.groupBy("status", "priority").agg(F.count("*").alias("n_rows"), F.sum(F.col("prompt_text").cast("long")).alias("texts"))


@_query("""
SELECT CAST(l_linenumber AS INTEGER) AS scale, CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' END AS source, round(100.0 * (1 - count(*) FILTER (WHERE l_discount < 0.05) / count(*)), 4) AS noncompliance_percent
FROM lineitem GROUP BY l_linenumber, l_returnflag
""")
def q95_report_of_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-compliance in percent by scale and source, sources by their names in reports, null where there is none."""
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("scale"), "l_returnflag", (F.col("l_discount") < 0.05).alias("ok"))
    own = pairs.compliance(li, "scale", ["l_returnflag"], "ok").where("group_type = 'l_returnflag'")
    return own.select("scale", predicates.mapped("group_value", {"A": "Accepted", "R": "Returned"}).alias("source"), F.round(predicates.percent("noncompliance_rate"), 4).alias("noncompliance_percent"))
