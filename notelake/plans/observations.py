"""Queries on observation samples and collection runs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import next_slot
from ..operators import backlog, ordered
from ..registry import query
from ..sources.bindings import T0, oracle, view

_END = T0 + 30 * 86400


@query("observation_gaps", oracle(f"""WITH points AS (SELECT source_id, seen_at FROM sample WHERE NOT unavailable UNION ALL SELECT DISTINCT source_id, {T0} FROM sample UNION ALL SELECT DISTINCT source_id, {_END} FROM sample)
SELECT source_id, seen_at AS gap_start, nxt AS gap_end, nxt - seen_at AS seconds FROM (SELECT *, lead(seen_at) OVER (PARTITION BY source_id ORDER BY seen_at) AS nxt FROM points) WHERE nxt - seen_at > 3600 + 300""", "sample"))
def _(spark, sf):
    return ordered.gaps(view(spark, sf, "sample").where("NOT unavailable"), "source_id", "seen_at", T0, _END, 3900)


@query("net_changes", oracle("""SELECT source_id, arg_max(processed, (seen_at, event_id)) - arg_min(processed, (seen_at, event_id)) AS processed, arg_max(documents, (seen_at, event_id)) - arg_min(documents, (seen_at, event_id)) AS documents FROM sample WHERE NOT unavailable GROUP BY source_id""", "sample"))
def _(spark, sf):
    known, order = view(spark, sf, "sample").where("NOT unavailable"), F.struct("seen_at", "event_id")
    change = lambda c: F.max_by(c, order) - F.min_by(c, order)
    return known.groupBy("source_id").agg(change("processed").alias("processed"), change("documents").alias("documents"))


@query("coverage_class", oracle(f"""SELECT source_id, CASE WHEN last IS NULL THEN 'missing' WHEN {_END} - last <= 3600 THEN 'fresh' ELSE 'stale' END AS class FROM (SELECT source_id, max(seen_at) FILTER (event_type = 'purchase') AS last FROM sample GROUP BY source_id)""", "sample"))
def _(spark, sf):
    last = view(spark, sf, "sample").groupBy("source_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("seen_at"))).alias("last"))
    return last.select("source_id", F.when(F.col("last").isNull(), "missing").when(_END - F.col("last") <= 3600, "fresh").otherwise("stale").alias("class"))


@query("digest_slot", oracle("""SELECT event_id, LOCALDATE[seen_at] AS slot_day, CASE WHEN hour(timezone('Asia/Shanghai', to_timestamp(seen_at))) >= 18 THEN 'elapsed' ELSE 'open' END AS slot,
CAST(epoch(CAST(LOCALDATE[seen_at] AS TIMESTAMP)) AS BIGINT) - 28800 + 64800 + CASE WHEN hour(timezone('Asia/Shanghai', to_timestamp(seen_at))) >= 18 THEN 86400 ELSE 0 END AS next_digest_at FROM sample""", "sample"))
def _(spark, sf):
    local = F.from_utc_timestamp(F.timestamp_seconds("seen_at"), "Asia/Shanghai")
    return view(spark, sf, "sample").select("event_id", F.to_date(local).alias("slot_day"), F.when(F.hour(local) >= 18, "elapsed").otherwise("open").alias("slot"), next_slot(F.col("seen_at"), 18).alias("next_digest_at"))


@query("run_result", oracle("SELECT source_id, run_no, CASE WHEN finished_at IS NULL THEN 'interrupted' WHEN failed > 0 AND succeeded > 0 THEN 'partial_failure' WHEN failed > 0 THEN 'failed' ELSE 'succeeded' END AS result FROM run", "run"))
def _(spark, sf):
    result = F.when(F.col("finished_at").isNull(), "interrupted").when((F.col("failed") > 0) & (F.col("succeeded") > 0), "partial_failure").when(F.col("failed") > 0, "failed").otherwise("succeeded")
    return view(spark, sf, "run").select("source_id", "run_no", result.alias("result"))


@query("recent_runs", oracle("SELECT source_id, run_no, started_at, recent, busy FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_no DESC) AS recent, bool_and(requests >= 3) OVER (PARTITION BY source_id ORDER BY started_at, run_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS busy FROM run) WHERE recent <= 10", "run"))
def _(spark, sf):
    last = ordered.last_rows(view(spark, sf, "run"), "source_id", [F.desc("started_at"), F.desc("run_no")], 12, "recent")  # a run's two before it are needed too
    busy = F.every(F.col("requests") >= 3).over(W.partitionBy("source_id").orderBy("started_at", "run_no").rowsBetween(-2, 0))
    return last.withColumn("busy", busy).where("recent <= 10").select("source_id", "run_no", "started_at", "recent", "busy")


@query("run_closure", oracle("SELECT source_id, run_no, CASE WHEN finished_at IS NOT NULL THEN 'finished' WHEN lead(started_at) OVER w IS NOT NULL THEN 'interrupted' ELSE 'running' END AS state, coalesce(finished_at, lead(started_at) OVER w) AS closed_at FROM run WINDOW w AS (PARTITION BY source_id ORDER BY run_no)", "run"))
def _(spark, sf):
    rows = ordered.neighbours(view(spark, sf, "run"), "source_id", "started_at", ["run_no"], "started_at", after="n", width=86400)
    return rows.select("source_id", "run_no", F.when(F.col("finished_at").isNotNull(), "finished").when(F.col("n").isNotNull(), "interrupted").otherwise("running").alias("state"), F.coalesce("finished_at", "n").alias("closed_at"))


@query("source_state", oracle("SELECT source_id, max(finished_at) FILTER (failed = 0) AS last_complete_scan_at, min(finished_at) FILTER (failed = 0) AS bootstrap_completed_at, max(last_at + 600 * failed) AS not_before_at, arg_max(run_no, started_at) AS last_run FROM run GROUP BY source_id", "run"))
def _(spark, sf):
    good = F.when(F.col("failed") == 0, F.col("finished_at"))
    return view(spark, sf, "run").groupBy("source_id").agg(F.max(good).alias("last_complete_scan_at"), F.min(good).alias("bootstrap_completed_at"), F.max(F.col("last_at") + 600 * F.col("failed")).alias("not_before_at"), F.max_by("run_no", "started_at").alias("last_run"))


@query("source_status", oracle(f"SELECT source_id, {_END} - max(started_at) AS last_attempt_age, {_END} - max(finished_at) FILTER (failed = 0) AS complete_age, greatest(max(last_at + 600 * failed) - {_END}, 0) AS cooldown FROM run GROUP BY source_id", "run"))
def _(spark, sf):
    return view(spark, sf, "run").groupBy("source_id").agg((_END - F.max("started_at")).alias("last_attempt_age"), (_END - F.max(F.when(F.col("failed") == 0, F.col("finished_at")))).alias("complete_age"), F.greatest(F.max(F.col("last_at") + 600 * F.col("failed")) - _END, F.lit(0)).alias("cooldown"))


@query("run_groups", oracle(f"""SELECT source_id AS run_id, event_type AS grp, count(*) AS allocated, count(*) FILTER (event_id % 6 < 5) AS attempted, count(*) FILTER (event_id % 6 < 5 AND NOT unavailable) AS succeeded, count(*) FILTER (event_id % 6 < 5 AND unavailable) AS failed, count(*) FILTER (event_id % 6 = 5) AS unserved,
count(*) FILTER ((event_id % 6 = 5 OR unavailable) AND seen_at <= {T0 + 15 * 86400}) AS remaining_due, greatest(max({T0 + 15 * 86400} - seen_at), 0) AS oldest_overdue FROM sample GROUP BY ALL""", "sample"))
def _(spark, sf):
    items = view(spark, sf, "sample").selectExpr("source_id AS run_id", "event_type AS grp", "event_id % 6 < 5 AS attempted", "unavailable AS failed", "seen_at AS due_at")
    return backlog.run_groups(items, T0 + 15 * 86400)


@query("usage_cost", oracle("""SELECT conv_id, sum(length(text)) FILTER (role = 'user')::BIGINT AS tokens_in, sum(length(text)) FILTER (role <> 'user')::BIGINT AS tokens_out,
CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) * 0.000003 + coalesce(sum(length(text)) FILTER (role <> 'user'), 0) * 0.000015 AS DECIMAL(18, 6)) AS cost FROM conversations GROUP BY conv_id"""))
def _(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    size = lambda c: F.sum(F.when(c, F.length("text"))).cast("long")
    out = turns.groupBy("conv_id").agg(size(F.col("role") == "user").alias("tokens_in"), size(F.col("role") != "user").alias("tokens_out"))
    zero = F.lit(0).cast("long")
    cost = F.coalesce("tokens_in", zero).cast("decimal(18,0)") * F.lit("0.000003").cast("decimal(7,6)") + F.coalesce("tokens_out", zero).cast("decimal(18,0)") * F.lit("0.000015").cast("decimal(7,6)")
    return out.withColumn("cost", cost.cast("decimal(18,6)"))
