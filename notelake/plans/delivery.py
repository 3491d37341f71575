"""Queries on messages, delivery attempts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery as ops
from ..registry import query
from ..sources.bindings import oracle, view

_AT = 900000000
_SCHEDULE = [300, 1800, 7200]
_LAST = "arg_max({}, (attempt_no, started_at, line_id))"


@query("delivery_latest", oracle("""SELECT m.mail_id, m.state, a.attempts, a.attempt_no, a.outcome, a.finished_at FROM message m LEFT JOIN
(SELECT * FROM (SELECT mail_id, attempt_no, outcome, finished_at, count(*) OVER (PARTITION BY mail_id) AS attempts, row_number() OVER (PARTITION BY mail_id ORDER BY attempt_no DESC, started_at DESC, line_id DESC) AS i FROM attempt) WHERE i = 1) a ON m.mail_id = a.mail_id""", "message", "attempt"))
def _(spark, sf):
    return ops.delivery_latest(view(spark, sf, "message"), view(spark, sf, "attempt"))


@query("delivery_counts", oracle("""SELECT i.installation, s.state, count(m.mail_id) AS n FROM (SELECT DISTINCT installation FROM message) i
CROSS JOIN (SELECT unnest(['pending', 'sending', 'retry', 'uncertain', 'accepted', 'blocked']) AS state) s LEFT JOIN message m ON m.installation = i.installation AND m.state = s.state GROUP BY ALL""", "message"))
def _(spark, sf):
    return ops.delivery_counts(view(spark, sf, "message"))


@query("delivery_summary", oracle(f"SELECT installation, count(*) FILTER (next_attempt_at <= {_AT}) AS due, count(*) FILTER (state = 'uncertain') AS unknown, min(frozen_at) FILTER (state <> 'accepted') AS oldest_open, CAST(sum((SELECT count(*) FROM attempt a WHERE a.mail_id = m.mail_id AND a.outcome = 'uncertain')) AS BIGINT) AS uncertain_attempts FROM message m GROUP BY installation", "message", "attempt"))
def _(spark, sf):
    return ops.delivery_summary(view(spark, sf, "message"), view(spark, sf, "attempt"), _AT)


@query("delivery_latency", oracle("SELECT installation, count(accepted_at) AS accepted, max(accepted_at - frozen_at) AS slowest, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM message GROUP BY installation", "message"))
def _(spark, sf):
    return ops.delivery_latency(view(spark, sf, "message"))


@query("retry_delay", oracle("SELECT mail_id, line_id, attempt_no, CASE WHEN outcome = 'uncertain' THEN greatest(w, 1800) ELSE w END AS wait FROM (SELECT *, CASE least(attempt_no, 3) WHEN 1 THEN 300 WHEN 2 THEN 1800 ELSE 7200 END AS w FROM attempt)", "attempt"))
def _(spark, sf):
    wait = ops.retry_delay(F.col("attempt_no"), _SCHEDULE, F.coalesce(F.col("outcome") == "uncertain", F.lit(False)))
    return view(spark, sf, "attempt").select("mail_id", "line_id", "attempt_no", wait.alias("wait"))


_STATE = """state AS (SELECT mail_id, attempt_no, finished_at, outcome, CASE WHEN outcome = 'accepted' THEN 'accepted' WHEN outcome = 'permanent' OR attempt_no >= 6 THEN 'blocked' WHEN outcome = 'uncertain' THEN 'uncertain' ELSE 'retry' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY attempt_no DESC, started_at DESC, line_id DESC) AS i FROM attempt WHERE outcome IS NOT NULL) WHERE i = 1)"""


@query("delivery_state", oracle(f"""WITH {_STATE} SELECT mail_id, attempt_no, state, CASE WHEN state IN ('uncertain', 'retry') THEN finished_at + CASE WHEN outcome = 'uncertain' THEN greatest(w, 1800) ELSE w END END AS next_attempt_at
FROM (SELECT *, CASE least(attempt_no, 3) WHEN 1 THEN 300 WHEN 2 THEN 1800 ELSE 7200 END AS w FROM state)""", "attempt"))
def _(spark, sf):
    return ops.delivery_state(view(spark, sf, "attempt"), _SCHEDULE, 6)


#: The fold as a recursion: a message's log is numbered, and each step takes the next row of every message.
FOLDED = """log AS (SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY begun, kind, attempt_no, line_id, finished_at NULLS FIRST, outcome NULLS FIRST) AS i FROM (
  SELECT mail_id, started_at AS begun, 1 AS kind, attempt_no, line_id, finished_at, outcome FROM attempt UNION ALL SELECT mail_id, granted_at, 0, NULL, NULL, NULL, NULL FROM manual_grant)),
walk AS (
  SELECT DISTINCT mail_id, 0::BIGINT AS i, 'pending' AS state, NULL::VARCHAR AS reason, NULL::BIGINT AS due, false AS pending, NULL::BIGINT AS until, 0::BIGINT AS granted, 0::BIGINT AS refused FROM log
  UNION ALL
  SELECT mail_id, i + 1, CASE WHEN kind = 0 THEN CASE WHEN able THEN 'pending' ELSE state END ELSE after END,
    CASE WHEN kind = 0 THEN CASE WHEN able THEN NULL ELSE reason END WHEN after = 'blocked' THEN CASE WHEN outcome = 'permanent' THEN 'permanent' WHEN pending THEN 'manual_attempt_failed' ELSE 'retry_exhausted' END END,
    CASE WHEN kind = 0 THEN CASE WHEN able THEN greatest(begun, until) ELSE due END WHEN after = 'uncertain' THEN finished_at + greatest(w, 1800) WHEN after = 'retry' THEN finished_at + w END,
    CASE WHEN kind = 0 THEN pending OR able ELSE false END, CASE WHEN kind = 0 THEN until WHEN outcome = 'uncertain' THEN finished_at + 1800 END,
    granted + CASE WHEN kind = 0 AND able THEN 1 ELSE 0 END, refused + CASE WHEN kind = 0 AND NOT able THEN 1 ELSE 0 END
  FROM (SELECT w.*, l.begun, l.kind, l.attempt_no, l.finished_at, l.outcome, w.state = 'blocked' AND NOT w.pending AS able, CASE least(l.attempt_no, 3) WHEN 1 THEN 300 WHEN 2 THEN 1800 ELSE 7200 END AS w,
      CASE WHEN l.outcome IS NULL THEN 'sending' WHEN l.outcome = 'accepted' THEN 'accepted' WHEN l.outcome = 'permanent' OR w.pending OR l.attempt_no >= 6 THEN 'blocked' WHEN l.outcome = 'uncertain' THEN 'uncertain' ELSE 'retry' END AS after
    FROM walk w JOIN log l ON l.mail_id = w.mail_id AND l.i = w.i + 1))
SELECT mail_id, state, reason, due AS next_attempt_at, pending AS manual_pending, granted, refused FROM walk SEMI JOIN (SELECT mail_id, count(*) AS i FROM log GROUP BY mail_id) USING (mail_id, i)"""


@query("delivery_fold", oracle(f"WITH {FOLDED}", "attempt", "manual_grant").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    return ops.delivery_fold(view(spark, sf, "attempt"), view(spark, sf, "manual_grant").withColumnRenamed("granted_at", "at"), _SCHEDULE, 6)


@query("delivery_audit", oracle("""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY attempt_no DESC, started_at DESC, line_id DESC) AS i FROM attempt),
final AS (SELECT * FROM numbered WHERE i = 1),
expected AS (
  SELECT m.mail_id, m.state, m.next_attempt_at, CASE WHEN f.mail_id IS NULL THEN 'pending' WHEN f.outcome IS NULL THEN 'sending' WHEN f.outcome = 'accepted' THEN 'accepted'
      WHEN f.outcome = 'permanent' OR f.attempt_no >= 6 THEN 'blocked' WHEN f.outcome = 'uncertain' THEN 'uncertain' ELSE 'retry' END AS should,
    f.finished_at + greatest(CASE least(f.attempt_no, 3) WHEN 1 THEN 300 WHEN 2 THEN 1800 ELSE 7200 END, CASE WHEN f.outcome = 'uncertain' THEN 1800 ELSE 0 END) AS again, m.frozen_at
  FROM message m LEFT JOIN final f ON f.mail_id = m.mail_id),
timed AS (SELECT *, CASE should WHEN 'pending' THEN frozen_at WHEN 'retry' THEN again WHEN 'uncertain' THEN again END AS due FROM expected)
SELECT mail_id, state AS stored, should AS computed, next_attempt_at AS stored_due, due AS computed_due, CASE WHEN state <> should THEN 'state' ELSE 'due' END AS rule
FROM timed WHERE state <> should OR next_attempt_at IS DISTINCT FROM due""", "message", "attempt"))
def _(spark, sf):
    return ops.delivery_audit(view(spark, sf, "message"), view(spark, sf, "attempt"), _SCHEDULE, 6)


@query("attempt_audit", oracle("""WITH a AS (SELECT *, row_number() OVER w AS i, lag(finished_at) OVER w AS before, lag(outcome) OVER w AS unsure, lead(attempt_no) OVER w AS nxt FROM attempt WINDOW w AS (PARTITION BY mail_id ORDER BY attempt_no, started_at, line_id))
SELECT mail_id, i, 'not_contiguous' AS rule FROM a WHERE attempt_no <> i UNION ALL SELECT mail_id, i, 'starts_before_previous_ends' FROM a WHERE started_at < before
UNION ALL SELECT mail_id, i, 'uncertain_wait_ignored' FROM a WHERE unsure = 'uncertain' AND started_at < before + 1800
UNION ALL SELECT mail_id, i, 'open_but_not_last' FROM a WHERE finished_at IS NULL AND nxt IS NOT NULL UNION ALL SELECT mail_id, i, 'accepted_but_not_last' FROM a WHERE outcome = 'accepted' AND nxt IS NOT NULL""", "attempt"))
def _(spark, sf):
    return ops.attempt_audit(view(spark, sf, "attempt"))


@query("due_messages", oracle(f"SELECT mail_id, next_attempt_at FROM message WHERE next_attempt_at <= {_AT} ORDER BY next_attempt_at, mail_id LIMIT 100", "message"))
def _(spark, sf):
    return ops.due_messages(view(spark, sf, "message"), _AT, 100)


@query("message_diagnostics", oracle("SELECT mail_id, state, (SELECT count(*) > 100 FROM message) AS truncated FROM message ORDER BY state = 'accepted', mail_id LIMIT 100", "message"))
def _(spark, sf):
    return ops.message_diagnostics(view(spark, sf, "message"))


@query("route_interleave", oracle("""SELECT installation, event_id, route, position FROM (SELECT *, row_number() OVER (PARTITION BY installation ORDER BY r, route <> 'immediate') AS position
FROM (SELECT *, row_number() OVER (PARTITION BY installation, route ORDER BY occurred_at, event_id) AS r FROM event WHERE route <> 'none' AND NOT allocated)) WHERE position <= 1000""", "event"))
def _(spark, sf):
    return ops.route_interleave(view(spark, sf, "event"), 1000)


@query("events_pending", oracle("""SELECT e.event_id, installation, route, occurred_at, CASE WHEN e.event_id % 5 > 0 THEN e.event_id * 10 END AS decision_id, CASE WHEN route = 'immediate' THEN occurred_at + 5 END AS intent_at, x.prior_error FROM event e
LEFT JOIN (SELECT l_orderkey AS event_id, arg_max(l_returnflag, (l_linenumber * 100000000 + l_partkey, l_returnflag)) AS prior_error FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey) x ON x.event_id = e.event_id WHERE route <> 'none' AND NOT allocated""", "event"))
def _(spark, sf):
    events = view(spark, sf, "event")
    errors = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linestatus = 'F'").selectExpr("l_orderkey AS event_id", "l_returnflag AS error_code", "l_linenumber * 100000000 + l_partkey AS error_at")
    decided = events.where("event_id % 5 > 0").selectExpr("event_id", "event_id * 10 AS decision_id")
    return ops.events_pending(events, events.where("allocated"), decided, events.where("route = 'immediate'").selectExpr("event_id", "occurred_at + 5 AS intent_at"), errors)


@query("prior_decision", oracle("""SELECT event_id, document_id, lag(event_id) OVER w AS prior_event, lag(route) OVER w AS prior_route, lag(route) OVER w IS DISTINCT FROM route AS changed FROM event WINDOW w AS (PARTITION BY document_id ORDER BY occurred_at, event_id)""", "event"))
def _(spark, sf):
    from pyspark.sql import Window as W

    prior = F.lag(F.struct("event_id", "route")).over(W.partitionBy("document_id").orderBy("occurred_at", "event_id"))
    return view(spark, sf, "event").withColumn("p", prior).select("event_id", "document_id", F.col("p.event_id").alias("prior_event"), F.col("p.route").alias("prior_route"), (~F.col("p.route").eqNullSafe(F.col("route"))).alias("changed"))


@query("mail_eligible", oracle(f"SELECT event_id, route, r <= {_AT} AS eligible, r AS ready_at FROM (SELECT *, CASE WHEN route = 'immediate' THEN occurred_at ELSE greatest(due_at, occurred_at) END AS r FROM event WHERE route <> 'none')", "event"))
def _(spark, sf):
    return ops.mail_eligible(view(spark, sf, "event"), _AT)


_PACKED = """ordered AS (SELECT *, row_number() OVER (PARTITION BY installation, slot ORDER BY occurred_at, event_id) AS i FROM event WHERE route = 'digest' AND NOT allocated),
fold AS (SELECT installation, slot, i, event_id, CASE WHEN item_bytes > 1500 THEN NULL ELSE 1 END AS part, CASE WHEN item_bytes > 1500 THEN NULL ELSE 1 END AS position,
    1 AS at_part, CASE WHEN item_bytes > 1500 THEN 0 ELSE 1 END AS n, CASE WHEN item_bytes > 1500 THEN 0 ELSE item_bytes END AS bytes FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.installation, o.slot, o.i, o.event_id, CASE WHEN o.item_bytes > 1500 THEN NULL WHEN f.n > 0 AND (f.bytes + o.item_bytes > 1500 OR f.n >= 3) THEN f.at_part + 1 ELSE f.at_part END,
    CASE WHEN o.item_bytes > 1500 THEN NULL WHEN f.n > 0 AND (f.bytes + o.item_bytes > 1500 OR f.n >= 3) THEN 1 ELSE f.n + 1 END,
    CASE WHEN o.item_bytes <= 1500 AND f.n > 0 AND (f.bytes + o.item_bytes > 1500 OR f.n >= 3) THEN f.at_part + 1 ELSE f.at_part END,
    CASE WHEN o.item_bytes > 1500 THEN f.n WHEN f.n > 0 AND (f.bytes + o.item_bytes > 1500 OR f.n >= 3) THEN 1 ELSE f.n + 1 END,
    CASE WHEN o.item_bytes > 1500 THEN f.bytes WHEN f.n > 0 AND (f.bytes + o.item_bytes > 1500 OR f.n >= 3) THEN o.item_bytes ELSE f.bytes + o.item_bytes END
  FROM fold f JOIN ordered o ON o.installation = f.installation AND o.slot = f.slot AND o.i = f.i + 1)"""


@query("digest_packing", oracle(f"WITH RECURSIVE {_PACKED} SELECT installation, slot, event_id, part, position FROM fold", "event").replace("RECURSIVE ", "").replace("WITH event", "WITH RECURSIVE event"))
def _(spark, sf):
    return ops.digest_packing(view(spark, sf, "event"), 1500, 3)


@query("next_part", oracle(f"WITH {_PACKED} SELECT installation, slot, coalesce(max(part), 0) + 1 AS next_part FROM fold GROUP BY ALL", "event").replace("WITH event", "WITH RECURSIVE event"))
def _(spark, sf):
    return ops.next_part(ops.digest_packing(view(spark, sf, "event"), 1500, 3))


@query("plan_counts", oracle(f"""SELECT installation, count(*) FILTER (NOT allocated AND route = 'immediate') AS immediate, count(*) FILTER (NOT allocated AND route = 'digest') AS digest,
count(*) FILTER (NOT allocated AND route = 'digest' AND greatest(due_at, occurred_at) <= {_AT}) AS due, count(*) FILTER (NOT allocated AND route = 'digest' AND greatest(due_at, occurred_at) > {_AT}) AS deferred, count(*) FILTER (NOT allocated AND route <> 'none' AND item_bytes > 1500) AS blocked FROM event GROUP BY installation""", "event"))
def _(spark, sf):
    return ops.plan_counts(view(spark, sf, "event"), _AT, 1500)


@query("channel_pause", oracle("""SELECT installation, finished_at AS paused_at, mail_id FROM (SELECT m.installation, a.finished_at, a.mail_id, row_number() OVER (PARTITION BY m.installation ORDER BY a.finished_at DESC, a.mail_id DESC) AS i
FROM attempt a JOIN message m ON a.mail_id = m.mail_id WHERE a.outcome = 'permanent' AND a.scope = 'channel') WHERE i = 1""", "attempt", "message"))
def _(spark, sf):
    return ops.channel_pause(view(spark, sf, "attempt"), view(spark, sf, "message"))


@query("orphans", oracle("""SELECT 'attempt_without_message' AS kind, a.mail_id FROM (SELECT DISTINCT mail_id FROM attempt) a ANTI JOIN message m ON a.mail_id = m.mail_id
UNION ALL SELECT 'message_without_attempt', m.mail_id FROM message m ANTI JOIN attempt a ON a.mail_id = m.mail_id""", "attempt", "message"))
def _(spark, sf):
    m, a = view(spark, sf, "message").select("mail_id"), view(spark, sf, "attempt").select("mail_id").distinct()
    return a.join(m, "mail_id", "left_anti").select(F.lit("attempt_without_message").alias("kind"), "mail_id").unionByName(m.join(a, "mail_id", "left_anti").select(F.lit("message_without_attempt").alias("kind"), "mail_id"))


@query("unplanned_work", oracle("""SELECT CASE route WHEN 'immediate' THEN 'intent_without_message' ELSE 'digest_without_member' END AS kind, event_id AS key FROM event WHERE route <> 'none' AND NOT allocated
UNION ALL SELECT 'message_without_delivery', mail_id FROM message WHERE state <> 'pending' AND mail_id NOT IN (SELECT mail_id FROM attempt)""", "event", "message", "attempt"))
def _(spark, sf):
    e = view(spark, sf, "event")
    return ops.unplanned_work(e, e.where("allocated"), view(spark, sf, "message"), view(spark, sf, "attempt"))


@query("monotone_fact", oracle("SELECT mail_id, line_id, max(started_at) OVER (PARTITION BY mail_id ORDER BY line_id, started_at, attempt_no ROWS UNBOUNDED PRECEDING) AS stored FROM attempt", "attempt"))
def _(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("mail_id").orderBy("line_id", "started_at", "attempt_no").rowsBetween(W.unboundedPreceding, 0)
    return view(spark, sf, "attempt").select("mail_id", "line_id", F.max("started_at").over(w).alias("stored"))


@query("stale_rejects", oracle("SELECT mail_id, line_id, started_at FROM (SELECT *, max(started_at) OVER (PARTITION BY mail_id ORDER BY line_id, started_at, attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM attempt) WHERE started_at < seen", "attempt"))
def _(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("mail_id").orderBy("line_id", "started_at", "attempt_no").rowsBetween(W.unboundedPreceding, -1)
    return view(spark, sf, "attempt").withColumn("seen", F.max("started_at").over(w)).where("started_at < seen").select("mail_id", "line_id", "started_at")


@query("attempt_class", oracle("SELECT coalesce(outcome, 'open') AS outcome, CASE WHEN outcome = 'accepted' THEN 'done' WHEN outcome = 'permanent' THEN 'stop' WHEN outcome IS NULL THEN 'running' ELSE 'retry' END AS class, count(*) AS n FROM attempt GROUP BY ALL", "attempt"))
def _(spark, sf):
    o = F.col("outcome")
    kind = F.when(o == "accepted", "done").when(o == "permanent", "stop").when(o.isNull(), "running").otherwise("retry")
    return view(spark, sf, "attempt").groupBy(F.coalesce(o, F.lit("open")).alias("outcome"), kind.alias("class")).agg(F.count("*").alias("n"))
