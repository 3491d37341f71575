"""Queries that run as streams over the tables' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.delivery import delivery_log
from ..registry import query
from ..sources.bindings import T0, oracle
from ..streaming import jobs
from .delivery import _STATE, FOLDED
from .notices import _CHANGES


def _events(spark, sf):
    rows = jobs.file_stream(spark, f"{sf}/events.parquet")
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source_id"))


@query("stream_runs", oracle("""WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM marked)
SELECT user_id, EPOCH[min(ts)] AS started_at, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM numbered GROUP BY user_id, run
HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""))
def _(spark, sf):
    return jobs.drained(jobs.sessions(_events(spark, sf), "user_id", "1 hour", "1 hour"), jobs.scratch(spark))


@query("stream_gaps", oracle("""WITH closed AS (SELECT concat('s', CAST(user_id % 5 AS VARCHAR)) AS source_id, EPOCH[date_trunc('hour', ts)] AS hour FROM events
  WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL),
span AS (SELECT source_id, unnest(generate_series(min(hour), max(hour), 3600)) AS hour FROM closed GROUP BY source_id)
SELECT source_id, hour FROM span ANTI JOIN closed USING (source_id, hour)"""))
def _(spark, sf):
    return jobs.missing_hours(jobs.drained(jobs.hourly(_events(spark, sf), "source_id", "1 hour"), jobs.scratch(spark)), "source_id")


@query("stream_dedup", oracle("SELECT DISTINCT SHA[html] AS sha256 FROM pages"))
def _(spark, sf):
    pages = jobs.file_stream(spark, f"{sf}/pages.parquet").select(F.timestamp_seconds(T0 + F.col("page_id") * 600).alias("ts"), F.col("html").alias("body"))
    return jobs.drained(jobs.new_bodies(pages, "30 days"), jobs.scratch(spark))


def _bodies(spark, sf):
    return jobs.file_stream(spark, f"{sf}/pages.parquet").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("body"))


@query("stream_ingest", oracle("SELECT SHA[html] AS sha256, min(page_id) AS first_id, max(strlen(html)) AS bytes FROM pages GROUP BY 1"))
def _(spark, sf):
    return jobs.archived(_bodies(spark, sf), jobs.scratch(spark))


@query("stream_replay", "SELECT count(DISTINCT html) AS bodies, count(DISTINCT html) AS again, CAST(0 AS BIGINT) AS repeated FROM pages")
def _(spark, sf):
    folder = jobs.scratch(spark)
    first = jobs.archived(_bodies(spark, sf), folder).agg(F.count("*").alias("bodies"))
    second = jobs.archived(_bodies(spark, sf), folder)  # the same job, started again from its checkpoint
    return first.crossJoin(second.agg(F.count("*").alias("again"), (F.count("*") - F.count_distinct("sha256")).alias("repeated")))  # one row each


@query("stream_changes", oracle(f"WITH {_CHANGES} SELECT document_id, version_id, change, count(*) FILTER (change IN ('first', 'changed')) OVER (PARTITION BY document_id ORDER BY observed_at, version_id) AS event_seq FROM changes", "version"))
def _(spark, sf):
    text = "text || CASE WHEN k = 1 AND doc_id % 3 = 0 THEN ' v2' {} ELSE '' END"
    docs = jobs.file_stream(spark, f"{sf}/documents.parquet").selectExpr("doc_id", "text", "explode(array(0, 1)) AS k")
    rows = docs.selectExpr(
        "doc_id AS document_id", "2 * doc_id + k AS version_id", f"{T0} + doc_id * 613 + k * 86400 AS observed_at", f"sha2({text.format('')}, 256) AS content_sha",
        f"sha2({text.format(chr(39).join(('WHEN k = 1 AND doc_id % 5 = 2 THEN ', '<!-- -->', '')))}, 256) AS raw_sha", "CASE WHEN doc_id % 11 = 0 AND k = 1 THEN 'p2' ELSE 'p1' END AS parser_version",
    )
    return jobs.drained(jobs.changes(rows), jobs.scratch(spark))


def _attempts(spark, sf):
    rows = jobs.file_stream(spark, f"{sf}/lineitem.parquet")
    started = "unix_seconds(CAST(l_shipdate AS TIMESTAMP))"
    return rows.selectExpr(
        "l_orderkey AS mail_id", "CAST(l_linenumber AS BIGINT) AS attempt_no", f"{started} AS started_at", "l_partkey * 100000 + l_suppkey AS line_id",
        f"CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL ELSE {started} + CAST(l_quantity AS BIGINT) * 60 END AS finished_at",
        "CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'permanent' ELSE 'temporary' END ELSE CASE WHEN l_linestatus = 'F' THEN 'uncertain' END END AS outcome",
    )


@query("stream_late", oracle("""SELECT mail_id, line_id, started_at, CASE WHEN started_at < max(started_at) OVER (PARTITION BY mail_id ORDER BY line_id, started_at, attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'late' ELSE 'accepted' END AS verdict FROM attempt""", "attempt"))
def _(spark, sf):
    return jobs.drained(jobs.late_rows(_attempts(spark, sf).select("mail_id", "line_id", "started_at", "attempt_no")), jobs.scratch(spark))


@query("stream_delivery", oracle(f"""WITH {_STATE} SELECT mail_id, attempt_no, state, CASE WHEN state IN ('uncertain', 'retry') THEN finished_at + CASE WHEN outcome = 'uncertain' THEN greatest(w, 1800) ELSE w END END AS next_attempt_at
FROM (SELECT *, CASE least(attempt_no, 3) WHEN 1 THEN 300 WHEN 2 THEN 1800 ELSE 7200 END AS w FROM state)""", "attempt"))
def _(spark, sf):
    return jobs.drained(jobs.delivery(_attempts(spark, sf)), jobs.scratch(spark))


@query("stream_grants", oracle(f"WITH {FOLDED}", "attempt", "manual_grant").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    orders = jobs.file_stream(spark, f"{sf}/orders.parquet").selectExpr("o_orderkey AS mail_id", "o_custkey", "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS day")
    times = F.expr("array_compact(array(IF(mail_id % 3 < 2, day + (mail_id * 7 % 130) * 86400, NULL), IF(mail_id % 5 = 1, day + (o_custkey * 11 % 150) * 86400, NULL)))")
    grants = orders.select("mail_id", F.explode(times).alias("at"))
    return jobs.drained(jobs.delivery_with_grants(delivery_log(_attempts(spark, sf), grants)), jobs.scratch(spark))
