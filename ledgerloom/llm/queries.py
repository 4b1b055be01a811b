"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, decontam, langid, linededup, neardup, ogg, packing, pii, search, tokencount, urltree, warc
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.verdicts(table(spark, sf_dir, "pages"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.classes(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.section_counts(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.features(ogg.media(table(spark, sf_dir, "documents")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversations_read_back(own.unionByName(chat.example(spark)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pii, op2_langid, op3_neardup, op4_url_filter, op5_decontam, op6_line_dedup, op7_token_counts, op8_warc, op9_packing, op10_ogg, op11_ranked_search, op12_chat_format, op13_filter_audit)
    return {f.__name__: f for f in own}


#: Words, windows and hits in SQL; A-Z is lower-cased letter by letter, other letters stay.
_OP5 = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), pattern AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
  FROM item, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0
), place AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM low, (SELECT DISTINCT n FROM pattern), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), hit AS (
  SELECT doc_id, i, place.n AS n, item_id FROM place JOIN pattern ON place.k = pattern.k AND place.n = pattern.n
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


#: Levels that the SQL generalises; no url of the tables has more segments.
_OP4_DEPTH = 6


def _op4() -> str:
    """The template tree in SQL, one level of it after the other."""
    rules = sorted(urltree.RULES, key=lambda r: -len(r[0] + r[1]))
    cases = [(f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in cases) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases) + " END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    levels = ""
    for d in range(2, _OP4_DEPTH + 1):
        levels += f"""
, w{d} AS (
  SELECT host, node FROM (
    SELECT host, array_to_string(now[1:{d - 1}], '/') AS node, now[{d}] AS seg, sum(n) AS n FROM t{d - 1} WHERE len(now) >= {d} AND now[{d}] <> '*' GROUP BY ALL
  ) GROUP BY ALL HAVING count(*) >= {urltree.MANY} AND count(*) * 2 > sum(n)
), t{d} AS (
  SELECT t.host, template, n, labelled, blocked, CASE WHEN w.node IS NOT NULL AND len(now) >= {d} THEN list_concat(now[1:{d - 1}], ['*'], now[{d + 1}:]) ELSE now END AS now
  FROM t{d - 1} t LEFT JOIN w{d} w ON t.host = w.host AND array_to_string(now[1:{d - 1}], '/') = w.node
)"""
    return rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), own AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), page AS (
  SELECT *, {rule} AS rule, {said} AS said,
    array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(s, '[0-9]') OR length(s) >= {urltree.LONG} THEN '*' ELSE s END), '/') AS template FROM own
), t1 AS (
  SELECT host, template, count(*) AS n, count(said) AS labelled, count(*) FILTER (WHERE said = 'block') AS blocked, string_split(template, '/') AS now FROM page GROUP BY host, template
){levels}
, shaped AS (
  SELECT host, template, array_to_string(now, '/') AS branch, labelled, blocked,
    array_to_string(list_transform(now, lambda s: CASE WHEN s IN ('*', '') THEN s ELSE '+' END), '/') AS shape FROM t{_OP4_DEPTH}
), branches AS (
  SELECT host, shape, branch, sum(labelled) AS bn, sum(blocked) AS bx FROM shaped GROUP BY ALL
), shapes AS (
  SELECT host, shape, sum(bn) AS sn, sum(bx) AS sx FROM branches GROUP BY ALL
), units AS (
  SELECT host, shape, branch, bn, bx, CASE WHEN bn > 0 AND abs(bx / bn - sx / sn) <= {urltree.Z} * sqrt(sx / sn * (1 - sx / sn) / bn) THEN shape ELSE branch END AS unit
  FROM branches JOIN shapes USING (host, shape)
), namesakes AS (
  SELECT branch, sum(bn) AS tn, sum(bx) AS tx FROM branches GROUP BY branch
), merged AS (
  SELECT host, shape, unit, sum(bn) AS un, sum(bx) AS ux FROM units GROUP BY ALL
), judged AS (
  SELECT host, shape, branch, unit, (ux + {urltree.WEIGHT} * ((sx + {urltree.WEIGHT} * (tx / (tn + 2.0))) / (sn + {urltree.WEIGHT}))) / (un + {urltree.WEIGHT}) AS purity
  FROM units JOIN shapes USING (host, shape) JOIN merged USING (host, shape, unit) JOIN namesakes USING (branch)
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= {urltree.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, unit AS template, round(CAST(purity AS DOUBLE), 6) AS purity
FROM page JOIN shaped USING (host, template) JOIN judged USING (host, shape, branch)
"""


_OP8 = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages)
, k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to FROM k
"""


#: Every document's score from all its terms.
_OP11 = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), total AS (
  SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM doc WHERE len(w) > 0
), item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM item) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs
), part AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part FROM tf JOIN weight USING (term), total
), score AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM item JOIN part USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


_OP12 = r"""
WITH row_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(text) + length(replace(role || ' ' || text, '\', '\\')) - length(role || ' ' || text)
    + len(regexp_extract_all(role || ' ' || text, '[<\[]/?(?:s>|INST\])')) + length('<s>[INST][/INST]</s>') AS size FROM row_
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


#: The orders are played through, filter by filter, for each set of failed filters.
_OP13 = r"""
WITH word AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), fail AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM word
), cell AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
    count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM fail GROUP BY ALL
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE b.l <> a.l AND c.l NOT IN (a.l, b.l) AND d.l NOT IN (a.l, b.l, c.l) AND e.l NOT IN (a.l, b.l, c.l, d.l)
), played AS (
  SELECT *, substr(o, step, 1) AS own, contains(fails, substr(o, step, 1)) AS hit, translate(substr(o, 1, step - 1), fails, '') <> substr(o, 1, step - 1) AS gone
  FROM cell, orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
), told AS (
  SELECT part, o, step, own, sum(n) FILTER (WHERE NOT hit AND NOT gone) AS kept, sum(n) FILTER (WHERE hit AND NOT gone) AS removed, sum(n) FILTER (WHERE hit AND gone) AS redundant,
    sum(n) FILTER (WHERE fails = own) AS unique_fails, sum(good) FILTER (WHERE hit AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE hit AND NOT gone) AS toxic_lost
  FROM played GROUP BY ALL
)
SELECT part, o AS filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": _op4(), "op5_decontam": _OP5, "op8_warc": _OP8, "op11_ranked_search": _OP11, "op12_chat_format": _OP12, "op13_filter_audit": _OP13}
