"""Queries that read logs, audit stored evidence, and report status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as ops
from ..registry import query
from ..sources.bindings import AT, T0, oracle, view

_OBS = "to_json(struct(CASE WHEN event_id % 19 = 3 THEN 'other' ELSE 'observation-v1' END AS format, concat('s', CAST(user_id % 5 AS STRING)) AS source_id, unix_seconds(CAST(ts AS TIMESTAMP)) AS at, event_id AS processed, event_id + 5 AS documents))"


def _lines(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id AS line", f"{_OBS} AS j")
    message = "to_json(named_struct('MESSAGE', {}))"
    return rows.selectExpr("line", f"CASE line % 8 WHEN 1 THEN {message.format('j')} WHEN 2 THEN {message.format(chr(39) + 'hello' + chr(39))} WHEN 3 THEN '{{\"MESSAGE\":null}}' WHEN 4 THEN {message.format('substr(j, 1, 40)')} WHEN 5 THEN substr(j, 1, 20) WHEN 6 THEN ' ' ELSE j END AS value")


@query("observation_read", "SELECT event_id AS line, 's' || CAST(user_id % 5 AS VARCHAR) AS source_id, CAST(floor(epoch(ts)) AS BIGINT) AS \"at\", event_id AS processed, event_id + 5 AS documents FROM events WHERE event_id % 8 IN (0, 1, 7) AND event_id % 19 <> 3")
def _(spark, sf):
    return ops.read_observations(_lines(spark, sf))[0]


@query("observation_counts", "SELECT count(*) FILTER (event_id % 8 IN (0, 1, 7) AND event_id % 19 <> 3) AS observation, count(*) FILTER (event_id % 8 = 2 OR (event_id % 8 = 1 AND event_id % 19 = 3)) AS ignored, count(*) FILTER (event_id % 8 = 3) AS unreadable, count(*) FILTER (event_id % 8 = 4 AND event_id % 19 <> 3) AS truncated, count(*) FILTER (event_id % 8 = 5) AS invalid, count(*) FILTER (event_id % 8 IN (0, 7) AND event_id % 19 = 3) AS unsupported FROM events WHERE NOT (event_id % 8 = 4 AND event_id % 19 = 3)")
def _(spark, sf):
    return ops.read_observations(_lines(spark, sf).where("NOT (line % 8 = 4 AND line % 19 = 3)"))[1]


_LOG = "to_json(struct(CASE WHEN event_id % 17 = 1 THEN 'never' ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") END AS time, 'INFO' AS level, CASE event_id % 5 WHEN 0 THEN 'fetch_started' WHEN 1 THEN 'page_processed' WHEN 2 THEN 'processing_failed' ELSE 'free text' END AS event, CASE WHEN event_id % 7 = 2 THEN 'bad id!' ELSE concat('s', CAST(user_id % 5 AS STRING)) END AS source_id, concat('run-', CAST(user_id % 50 AS STRING)) AS run_id, event_type AS stage, CASE WHEN event_type = 'error' THEN 'parse_failed' END AS error_code, event_id - 3 AS document_id, CASE WHEN event_id % 11 = 4 THEN '-1' ELSE CAST(event_id % 9 AS STRING) END AS attempted, 'x' AS succeeded, CAST(NULL AS STRING) AS failed))"
_LOGGED = """logged AS (SELECT event_id AS line, CASE WHEN event_id % 13 = 5 OR event_id % 17 = 1 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS t, CASE WHEN event_id % 13 = 5 OR event_id % 5 > 2 THEN 'unstructured_log' ELSE ['fetch_started', 'page_processed', 'processing_failed'][event_id % 5 + 1] END AS event,
CASE WHEN event_id % 13 <> 5 AND event_id % 7 <> 2 THEN 's' || CAST(user_id % 5 AS VARCHAR) END AS source_id, CASE WHEN event_id % 13 <> 5 THEN 'run-' || CAST(user_id % 50 AS VARCHAR) END AS run_id, CASE WHEN event_id % 13 <> 5 THEN event_type END AS stage, CASE WHEN event_id % 13 <> 5 AND event_type = 'error' THEN 'parse_failed' END AS error_code,
CASE WHEN event_id % 13 <> 5 AND event_id >= 3 THEN event_id - 3 END AS document_id, CASE WHEN event_id % 13 <> 5 AND event_id % 11 <> 4 THEN event_id % 9 END AS attempted FROM events)"""


def _log(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id AS line", f"CASE WHEN event_id % 13 = 5 THEN 'not json' ELSE {_LOG} END AS value")
    return ops.read_event_log(rows)


@query("eventlog_read", f"WITH {_LOGGED} SELECT line, t AS \"at\", event, source_id, run_id, stage, error_code, document_id, attempted, NULL::BIGINT AS succeeded, NULL::BIGINT AS failed FROM logged")
def _(spark, sf):
    return _log(spark, sf)


@query("run_rollup", f"WITH {_LOGGED} SELECT run_id, min(t) AS first_at, max(t) AS last_at, count(*) AS lines, count(error_code) AS errors, CAST(coalesce(sum(attempted), 0) AS BIGINT) AS attempted FROM logged WHERE run_id IS NOT NULL GROUP BY run_id")
def _(spark, sf):
    return ops.run_rollup(_log(spark, sf))


@query("manifest_check", """WITH q AS (SELECT item_id - item_id % 7 * CAST(item_id % 7 = 1 AS INT) AS query_id, CASE WHEN item_id % 11 = 3 THEN 2 ELSE 1 END AS v, CASE WHEN item_id % 13 = 2 THEN ' ' ELSE text END AS q, item_id % 20 AS f, CASE WHEN item_id % 3 = 0 THEN item_id % 17 END AS t, item_id AS a, CASE WHEN item_id % 5 = 4 THEN item_id ELSE item_id + 1 END AS b FROM benchmark),
n AS (SELECT query_id, count(*) AS times, bool_or(a NOT IN (SELECT doc_id FROM documents WHERE doc_id % 9 > 0) OR b NOT IN (SELECT doc_id FROM documents WHERE doc_id % 9 > 0)) AS unknown FROM q GROUP BY query_id)
SELECT DISTINCT query_id, CASE WHEN v <> 1 THEN 'schema_version' WHEN times > 1 THEN 'duplicate_id' WHEN trim(q) = '' THEN 'empty_query' WHEN f > t THEN 'dates_not_ordered' WHEN unknown THEN 'unknown_relevant_item' WHEN a = b THEN 'repeated_relevant_item' ELSE 'ok' END AS code FROM q JOIN n USING (query_id)""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr(
        "item_id - item_id % 7 * CAST(item_id % 7 = 1 AS INT) AS query_id", "CASE WHEN item_id % 11 = 3 THEN 2 ELSE 1 END AS schema_version", "CASE WHEN item_id % 13 = 2 THEN ' ' ELSE text END AS query", "date_add(date '2024-01-01', CAST(item_id % 20 AS INT)) AS date_from",
        "CASE WHEN item_id % 3 = 0 THEN date_add(date '2024-01-01', CAST(item_id % 17 AS INT)) END AS date_to", "array(item_id, CASE WHEN item_id % 5 = 4 THEN item_id ELSE item_id + 1 END) AS relevant",
    )
    return ops.manifest_check(rows, spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 9 > 0").selectExpr("doc_id AS item_id"))


_RUNS = "SELECT *, last_at + 600 * failed AS not_before_at, requests >= 3 AS over_budget FROM run"
_NOTED = "SELECT document_id, 's' || CAST(document_id % 5 AS VARCHAR) AS source_id, status, last_success_at, discovered_at, next_due_at FROM notice"
_AT = AT + 5 * 86400
_STATUS = f"""d AS (SELECT source_id, count(*) AS documents, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (last_success_at IS NULL) AS backlog, max({_AT} - discovered_at) FILTER (last_success_at IS NULL) AS oldest_backlog_age, count(*) FILTER (last_success_at IS NOT NULL AND next_due_at <= {_AT}) AS rechecks_due,
max({_AT} - next_due_at) FILTER (last_success_at IS NOT NULL AND next_due_at <= {_AT}) AS oldest_recheck_age, count(*) FILTER (last_success_at IS NOT NULL AND next_due_at IS NULL) AS unscheduled FROM ({_NOTED}) GROUP BY source_id),
r AS (SELECT source_id, max(finished_at) FILTER (failed = 0) AS last_complete_scan_at, count(*) FILTER (finished_at IS NULL) AS unfinished_runs, greatest(max(not_before_at) - {_AT}, 0) AS cooldown, CAST(sum(CAST(over_budget AS INT)) FILTER (i <= 3 AND finished_at IS NOT NULL) AS INT) AS budget_runs
FROM (SELECT *, row_number() OVER (PARTITION BY source_id, finished_at IS NULL ORDER BY started_at DESC, run_no DESC) AS i FROM ({_RUNS})) GROUP BY source_id),
s AS (SELECT d.*, last_complete_scan_at, unfinished_runs, cooldown, budget_runs, {_AT} - last_complete_scan_at AS scan_age FROM d LEFT JOIN r USING (source_id)),
g AS (SELECT source_id, unnest(list_filter([CASE WHEN last_complete_scan_at IS NULL THEN {{'code': 'complete_scan_missing', 'level': 'warning', 'age': NULL}} END, CASE WHEN scan_age > 93600 THEN {{'code': 'complete_scan_stale', 'level': 'warning', 'age': scan_age}} END, CASE WHEN oldest_backlog_age > 259200 THEN {{'code': 'first_processing_backlog_stale', 'level': 'warning', 'age': oldest_backlog_age}} END,
CASE WHEN oldest_recheck_age > 86400 THEN {{'code': 'rechecks_overdue', 'level': 'warning', 'age': oldest_recheck_age}} END, CASE WHEN unscheduled > 0 THEN {{'code': 'successful_rechecks_unscheduled', 'level': 'warning', 'age': NULL}} END, CASE WHEN cooldown > 0 THEN {{'code': 'source_cooldown_active', 'level': 'info', 'age': cooldown}} END,
CASE WHEN unfinished_runs > 0 THEN {{'code': 'unfinished_runs', 'level': 'info', 'age': NULL}} END, CASE WHEN budget_runs >= 3 THEN {{'code': 'recent_budget_truncation', 'level': 'warning', 'age': NULL}} END], lambda x: x IS NOT NULL)) AS x FROM s)"""


def _status(spark, sf):
    docs = view(spark, sf, "notice").withColumn("source_id", F.concat(F.lit("s"), (F.col("document_id") % 5).cast("string")))
    runs = view(spark, sf, "run").selectExpr("*", "last_at + 600 * failed AS not_before_at", "requests >= 3 AS over_budget")
    return ops.status_report(docs, runs, _AT)


@query("status_report", oracle(f"WITH {_STATUS} SELECT s.*, coalesce((SELECT string_agg(x.code, ',' ORDER BY x.code) FROM g WHERE g.source_id = s.source_id), '') AS codes FROM s", "notice", "run"))
def _(spark, sf):
    return _status(spark, sf)


@query("diagnostics", oracle(f"WITH {_STATUS} SELECT source_id, x.code AS code, x.level AS level, x.age AS age FROM g", "notice", "run"))
def _(spark, sf):
    return ops.diagnostics(_status(spark, sf))


@query("digest_violations", oracle("""WITH v AS (SELECT version_id AS key, content_sha, raw_sha, CASE WHEN version_id % 17 = 3 THEN 'x' ELSE content_sha END AS content_sha256, CASE WHEN version_id % 23 = 5 THEN NULL ELSE SHA[parser_version || '|' || CAST(document_id AS VARCHAR)] END AS policy_sha256, SHA[parser_version || '|' || CAST(document_id AS VARCHAR)] AS p FROM version)
SELECT key, 'content_sha256' AS rule FROM v WHERE content_sha256 IS DISTINCT FROM content_sha UNION ALL SELECT key, 'policy_sha256' FROM v WHERE policy_sha256 IS DISTINCT FROM p""", "version"))
def _(spark, sf):
    policy = F.sha2(F.concat_ws("|", "parser_version", F.col("document_id").cast("string")), 256)
    rows = view(spark, sf, "version").withColumn("p", policy).selectExpr("version_id AS key", "body_text", "parser_version", "document_id", "CASE WHEN version_id % 17 = 3 THEN 'x' ELSE content_sha END AS content_sha256", "CASE WHEN version_id % 23 = 5 THEN NULL ELSE p END AS policy_sha256")
    return ops.digest_violations(rows, {"content_sha256": F.sha2("body_text", 256), "policy_sha256": policy})


_REF = "SELECT requested_url AS reference, requested_url AS resolved_url, CASE WHEN min(id) % 19 = 4 THEN 's9' ELSE 's0' END AS source_id, CASE WHEN min(id) % 13 = 2 THEN -1 ELSE min(id) END AS first_id, max(id) AS last_id, min(fetched_at) + CASE WHEN min(id) % 11 = 5 THEN 1 ELSE 0 END AS first_at, max(fetched_at) AS last_at, CASE WHEN min(id) % 29 = 8 THEN 'link:v1:0' ELSE concat('link:v1:', SHA[requested_url]) END AS candidate_key FROM response GROUP BY requested_url"
_SEEN = "SELECT id, CASE WHEN id % 7 = 1 THEN 's2' ELSE 's0' END AS source_id, CASE WHEN id % 5 = 3 THEN 'notice' ELSE 'list' END AS page_type, fetched_at FROM response"


@query("reference_audit", oracle(f"""WITH f AS ({_REF}), p AS ({_SEEN}) SELECT reference, CASE WHEN a.id IS NULL THEN 'first_response_missing' WHEN b.id IS NULL THEN 'last_response_missing' WHEN a.page_type <> 'list' OR b.page_type <> 'list' THEN 'not_a_list_page' WHEN a.source_id <> f.source_id OR b.source_id <> f.source_id THEN 'source_mismatch'
WHEN a.fetched_at <> first_at OR b.fetched_at <> last_at THEN 'time_mismatch' WHEN first_at > last_at THEN 'order' WHEN candidate_key <> 'link:v1:' || SHA[resolved_url] THEN 'key_mismatch' ELSE 'ok' END AS code FROM f LEFT JOIN p a ON a.id = first_id LEFT JOIN p b ON b.id = last_id""", "response"))
def _(spark, sf):
    rows = view(spark, sf, "response")
    refs = rows.groupBy("requested_url").agg(F.min("id").alias("i"), F.max("id").alias("last_id"), F.min("fetched_at").alias("a"), F.max("fetched_at").alias("last_at")).selectExpr(
        "requested_url AS reference", "requested_url AS resolved_url", "CASE WHEN i % 19 = 4 THEN 's9' ELSE 's0' END AS source_id", "CASE WHEN i % 13 = 2 THEN -1 ELSE i END AS first_id", "last_id", "a + CASE WHEN i % 11 = 5 THEN 1 ELSE 0 END AS first_at", "last_at",
        "CASE WHEN i % 29 = 8 THEN 'link:v1:0' ELSE concat('link:v1:', sha2(requested_url, 256)) END AS candidate_key",
    )
    return ops.reference_audit(refs, rows.selectExpr("id", "CASE WHEN id % 7 = 1 THEN 's2' ELSE 's0' END AS source_id", "CASE WHEN id % 5 = 3 THEN 'notice' ELSE 'list' END AS page_type", "fetched_at"))


@query("profile_validity", """WITH p AS (SELECT c_custkey AS profile_id, c_custkey % 6 AS m FROM customer) SELECT profile_id, unnest(CASE m WHEN 0 THEN ['no_interest'] WHEN 1 THEN ['interest_excluded', 'interests_repeat'] WHEN 2 THEN ['high_value_not_interest'] WHEN 3 THEN ['store_only_high_value', 'store_only_excluded'] WHEN 4 THEN ['blank_phrase', 'phrases_repeat'] ELSE [] END) AS rule FROM p""")
def _(spark, sf):
    none = "CAST(array() AS ARRAY<STRING>)"
    pick = lambda name, **own: "CASE c_custkey % 6 " + " ".join(f"WHEN {k[1:]} THEN {v}" for k, v in own.items()) + f" ELSE {none} END AS {name}"
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey AS profile_id", pick("interests", m1="array('a', 'b', 'a')", m2="array('a')", m3="array('a', 'b')", m4="array('a')", m5="array('a')"), pick("excludes", m1="array('b')", m3="array('c')"), pick("high_value", m2="array('z')", m3="array('a')"),
        pick("store_only", m3="array('a', 'c')"), pick("phrases", m4="array(' ', ' ')"),
    )
    return ops.profile_validity(rows)


@query("snapshot_time_rules", oracle("""SELECT o_orderkey AS snapshot_id, unnest(list_filter([CASE WHEN o_orderkey % 9 = 1 THEN 'prepared_before_snapshot' END, CASE WHEN o_orderkey % 7 = 2 THEN 'last_scan_at_after_snapshot' END, CASE WHEN o_orderkey % 11 = 3 THEN 'last_parsed_at_after_snapshot' END], lambda x: x IS NOT NULL)) AS rule FROM orders"""))
def _(spark, sf):
    t = "unix_seconds(CAST(o_orderdate AS TIMESTAMP))"
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS snapshot_id", f"{t} AS snapshot_at", f"{t} + CASE WHEN o_orderkey % 9 = 1 THEN -1 ELSE 60 END AS prepared_at", f"CASE WHEN o_orderkey % 5 > 0 OR o_orderkey % 7 = 2 THEN {t} + CASE WHEN o_orderkey % 7 = 2 THEN 5 ELSE -5 END END AS last_scan_at", f"{t} + CASE WHEN o_orderkey % 11 = 3 THEN 1 ELSE 0 END AS last_parsed_at")
    return ops.snapshot_time_rules(rows, ["last_scan_at", "last_parsed_at"])


@query("payload_rules", """WITH m AS (SELECT conv_id * 100 + turn AS mail_id, coalesce(text, '') || CASE turn % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(10) ELSE '' END AS t, conv_id % 7 = 2 AS bad, turn % 4 = 3 AS odd FROM conversations)
SELECT mail_id, unnest(list_filter([CASE WHEN strlen(t) > 300 THEN 'payload_too_large' END, CASE WHEN bad THEN 'payload_digest' END, CASE WHEN contains(replace(t, chr(13) || chr(10), ''), chr(10)) OR contains(replace(t, chr(13) || chr(10), ''), chr(13)) THEN 'line_ending' END, CASE WHEN strlen(t) <> length(t) THEN 'not_ascii' END, CASE WHEN odd THEN 'result_domain' END, CASE WHEN t = '' THEN 'empty_payload' END], lambda x: x IS NOT NULL)) AS rule FROM m""")
def _(spark, sf):
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, "\r\n").when(F.col("turn") % 3 == 1, "\n").otherwise(""))
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select((F.col("conv_id") * 100 + F.col("turn")).alias("mail_id"), t.cast("binary").alias("payload"), "conv_id", "turn")
    sha = F.when(F.col("conv_id") % 7 == 2, "x").otherwise(F.sha2("payload", 256))
    return ops.payload_rules(rows.select("mail_id", "payload", sha.alias("payload_sha256"), F.lit(300).alias("max_bytes"), F.when(F.col("turn") % 4 == 3, "lost").when(F.col("turn") % 4 == 2, "accepted").alias("outcome")))


_FACTS = "SELECT source_id, count(*) AS documents, count(*) FILTER (status = 'processed') AS processed, max(last_success_at) AS latest FROM notice GROUP BY source_id"


@query("snapshot_check", oracle(f"""WITH n AS ({_FACTS}), c AS (SELECT DISTINCT source_id FROM notice WHERE length(source_id) = 5 AND document_id % 50 = 0) SELECT n.source_id, CASE WHEN documents % 3 = 0 THEN 'snapshot_binding_mismatch' WHEN c.source_id IS NOT NULL THEN 'snapshot_sending_not_paused' ELSE 'ok' END AS code FROM n LEFT JOIN c ON c.source_id = n.source_id""", "notice"))
def _(spark, sf):
    docs = view(spark, sf, "notice")
    now = docs.groupBy("source_id").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "processed").alias("processed"), F.max("last_success_at").alias("latest"))
    then = now.withColumn("processed", F.when(F.col("documents") % 3 == 0, F.col("processed") + 1).otherwise(F.col("processed")))
    return ops.snapshot_check(then, now, docs.selectExpr("source_id", "NOT (length(source_id) = 5 AND document_id % 50 = 0) AS paused"), ["documents", "processed", "latest"])


_START, _END = T0 + 86400, T0 + 8 * 86400


@query("observation_summary", oracle(f"""WITH s AS (SELECT source_id, CAST(floor(seen_at / 1800) AS BIGINT) * 1800 AS t, processed % 50 AS processed, documents FROM sample WHERE floor(seen_at / 1800) * 1800 BETWEEN {_START} AND {_END}),
o AS (SELECT source_id, t, count(*) AS n, count(DISTINCT (processed, documents)) AS kinds, min((processed, documents)) AS v FROM s GROUP BY ALL),
g AS (SELECT source_id, t - lag(t) OVER (PARTITION BY source_id ORDER BY t) AS step FROM (SELECT source_id, t FROM o UNION ALL SELECT DISTINCT source_id, {_START} FROM o UNION ALL SELECT DISTINCT source_id, {_END} FROM o))
SELECT source_id, count(*) AS samples, CAST(sum(n - 1) AS BIGINT) AS repeats, count(*) FILTER (kinds > 1) AS conflicts, arg_max(v[1], t) - arg_min(v[1], t) AS processed, arg_max(v[2], t) - arg_min(v[2], t) AS documents, (SELECT count(*) FROM g WHERE g.source_id = o.source_id AND step > 3900) AS gaps,
(SELECT max(step) FROM g WHERE g.source_id = o.source_id AND step > 3900) AS longest_gap FROM o GROUP BY source_id""", "sample"))
def _(spark, sf):
    rows = view(spark, sf, "sample").selectExpr("source_id", "CAST(floor(seen_at / 1800) AS BIGINT) * 1800 AS at", "processed % 50 AS processed", "documents")
    return ops.window_summary(rows, _START, _END, 3600, 300)


@query("ordered_distinct", "SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: list_position(w, x))), lambda i: w[i]), ' ') AS words FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))
