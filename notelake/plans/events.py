"""Queries from versions to events and decisions' life."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import local_date
from ..operators import events as ops
from ..operators import versions
from ..registry import query
from ..sources.bindings import AT, T0, oracle, view
from ..sources.tables import stored
from . import decisions as decided_plans
from .notices import _CHANGES

_TODAY = f"LOCALDATE[{AT}]"
_BEFORE = ["document_id", "opens_at", "deadline_at + CASE WHEN document_id % 4 = 1 THEN 3600 ELSE 0 END AS deadline_at", "deadline_lower_at", "CASE WHEN document_id % 41 = 6 THEN NOT cancelled ELSE cancelled END AS cancelled"]


def _constraints(spark, sf, *values: str):
    one = F.struct("field", "operator", F.array_compact(F.array(*map(F.expr, values))).alias("values"))
    return view(spark, sf, "requirement").groupBy("document_id").agg(F.collect_list(one).alias("constraints"))


_SIDE = "SELECT {0}.*, (SELECT list_sort(list(field || '/' || operator || '/' || CAST(list_sort(list_filter([{1}, v2], lambda x: x IS NOT NULL)) AS VARCHAR))) FROM requirement r WHERE r.document_id = {0}.document_id) AS cs FROM {0}"


@query("condition_change", oracle(f"""WITH earlier AS (SELECT {', '.join(_BEFORE)} FROM fact WHERE document_id % 7 > 0), a AS ({_SIDE.format('fact', 'v1')}), b AS ({_SIDE.format('earlier', "CASE WHEN r.document_id % 9 = 2 THEN 'other' ELSE v1 END")})
SELECT a.document_id, b.document_id IS NOT NULL AS comparison_known, b.document_id IS NOT NULL AND (a.cs, a.opens_at, a.deadline_at, a.deadline_lower_at, a.cancelled) IS DISTINCT FROM (b.cs, b.opens_at, b.deadline_at, b.deadline_lower_at, b.cancelled) AS conditions_changed FROM a LEFT JOIN b USING (document_id)""", "fact", "requirement"))
def _(spark, sf):
    fact = view(spark, sf, "fact")
    now = fact.select("document_id", "opens_at", "deadline_at", "deadline_lower_at", "cancelled").join(_constraints(spark, sf, "v1", "v2"), "document_id", "left")
    before = fact.where("document_id % 7 > 0").selectExpr(*_BEFORE).join(_constraints(spark, sf, "v2", "CASE WHEN document_id % 9 = 2 THEN 'other' ELSE v1 END"), "document_id", "left")
    return ops.condition_change(now, before)


_RESULTS = """results AS (SELECT r.document_id, q.profile_id, r.field, CASE WHEN operator = 'unsupported' OR (v1 IS NULL AND v2 IS NULL) OR actual IS NULL THEN 'unknown' WHEN actual = v1 OR coalesce(actual = v2, false) THEN 'match' ELSE 'mismatch' END AS result
FROM requirement r CROSS JOIN (SELECT DISTINCT profile_id FROM profile) q LEFT JOIN profile p ON p.field = r.field AND p.profile_id = q.profile_id)"""


@query("constraint_results", oracle(f"{decided_plans._ALL_ASKED}{_RESULTS} SELECT * FROM results", "asked", "profile"))
def _(spark, sf):
    return ops.each_result(decided_plans._asked(spark, sf, "asked"), view(spark, sf, "profile"))


@query("review_flags", oracle(decided_plans._DECIDED + decided_plans._SPREAD + f""", {_RESULTS}, hit AS (SELECT document_id, profile_id, 1 AS o, 'interest.topic.' || topic AS r FROM topic_match JOIN profile_topic USING (topic) WHERE interest AND coalesce(context, '') NOT IN ('incidental', 'uncertain')
UNION SELECT document_id, profile_id, 2, 'exclusion.topic.' || topic FROM topic_match JOIN profile_topic USING (topic) WHERE is_primary AND excluded UNION SELECT document_id, profile_id, 3, 'retention.topic.' || topic FROM topic_match JOIN profile_topic USING (topic) WHERE store_only AND coalesce(context, '') NOT IN ('incidental', 'uncertain')
UNION SELECT document_id, profile_id, 4, 'qualification.' || field || '.' || result FROM results),
flags AS (SELECT DISTINCT d.document_id, d.profile_id, n.profile_id AS own, list_filter([CASE WHEN kind = 'update' AND previous_route <> 'none' AND NOT comparison_known THEN 'comparison_unknown' END, CASE WHEN d.relevance = 'unknown' THEN 'topic_relation_unknown' END, CASE WHEN d.eligibility = 'unknown' THEN 'eligibility_unknown' END,
  CASE WHEN NOT audience_declared THEN 'audience_unknown' END, CASE WHEN d.time_status = 'unknown' THEN 'time_unknown' END, CASE WHEN information_incomplete THEN 'information_incomplete' END], lambda x: x IS NOT NULL) AS u, d.reason, d.action, d.route, f.kind FROM sent d JOIN fact f USING (document_id) LEFT JOIN named n USING (document_id, profile_id))
SELECT DISTINCT f.document_id, f.own AS profile_id, len(u) > 0 AS needs_review, array_to_string(u, ',') AS unknowns, (SELECT coalesce(string_agg(r || ',', '' ORDER BY o, r), '') FROM hit h WHERE h.document_id = f.document_id AND h.profile_id = f.profile_id) || 'decision.' || reason || ',route.' ||
CASE WHEN route = 'none' THEN 'no_mail_action' WHEN action = 'DIGEST' THEN 'digest_action' WHEN kind = 'activation_recent' AND route = 'immediate' THEN 'activation_urgency_exception' WHEN kind = 'activation_recent' THEN 'activation_recent_digest' ELSE 'hybrid_immediate' END AS rules FROM flags f""", *decided_plans._ALL))
def _(spark, sf):
    out = ops.review_flags(stored(decided_plans._decided(spark, sf), "decided"), view(spark, sf, "fact"), view(spark, sf, "topic_match"), view(spark, sf, "profile_topic"), decided_plans._asked(spark, sf), view(spark, sf, "profile"), decided_plans._MODE)
    return out.select("document_id", "profile_id", "needs_review", F.array_join("unknowns", ",").alias("unknowns"), F.array_join("rules", ",").alias("rules"))


@query("activation_inputs", oracle("""SELECT n.document_id, n.source_id, a.list_date, a.registered_at, v.published_date AS notice_date, v.parser_version FROM notice n LEFT JOIN (SELECT * FROM activation WHERE document_id % 5 > 0) a ON a.document_id = n.document_id
LEFT JOIN version v ON v.document_id = n.document_id AND v.version_id = n.current_version_id""", "notice", "activation", "version"))
def _(spark, sf):
    listings = view(spark, sf, "activation").where("document_id % 5 > 0").select("document_id", "list_date", "registered_at")
    return ops.activation_inputs(view(spark, sf, "notice"), listings, view(spark, sf, "version"))


_RECENT = "coalesce({} BETWEEN " + _TODAY + " - 6 AND " + _TODAY + ", false)"
_MEMBERS = f"""chosen AS (SELECT *, CASE WHEN old_state IN ('generated', 'selected') THEN old_state WHEN NOT initial_recent_review THEN 'disabled' WHEN {_RECENT.format('list_date')} OR {_RECENT.format('notice_date')} THEN 'selected'
WHEN (list_date IS NULL AND notice_date IS NULL) OR coalesce(list_date > {_TODAY}, false) OR coalesce(notice_date > {_TODAY}, false) THEN 'unknown' ELSE 'not_recent' END AS state FROM activation),
members AS (SELECT document_id, source_id, state, sel AS selection, old_conflict OR len(list_distinct(list_filter([sel, list_date, notice_date], lambda x: x IS NOT NULL))) > 1 AS date_conflict FROM (
SELECT *, coalesce(old_selection, CASE WHEN state = 'selected' THEN CASE WHEN {_RECENT.format('list_date')} THEN list_date WHEN {_RECENT.format('notice_date')} THEN notice_date END END) AS sel FROM chosen))"""


def _members(spark, sf):
    return ops.activation_candidates(view(spark, sf, "activation"), local_date(F.lit(AT)))


@query("activation_candidates", oracle(f"WITH {_MEMBERS} SELECT * FROM members", "activation"))
def _(spark, sf):
    return _members(spark, sf)


@query("candidate_counts", oracle(f"WITH {_MEMBERS} SELECT source_id, state, count(*) AS n FROM members GROUP BY ALL", "activation"))
def _(spark, sf):
    return ops.candidate_counts(_members(spark, sf))


@query("event_kinds", oracle(f"""WITH {_CHANGES}, {_MEMBERS}, k AS (SELECT c.document_id, c.version_id, c.change, c.other_parser, CASE WHEN change = 'first' AND m.state = 'selected' THEN 'activation_recent' WHEN change = 'first' AND m.state IS NULL AND origin = 'regular' AND live_at >= {T0 + 86400} THEN 'new' WHEN change = 'changed' THEN 'update' END AS kind
FROM changes c JOIN activation a USING (document_id) LEFT JOIN (SELECT * FROM members WHERE document_id % 3 > 0) m USING (document_id))
SELECT document_id, version_id, kind, CASE WHEN kind IS NULL THEN CASE WHEN change = 'first' THEN 'historical_baseline' WHEN change = 'same' AND other_parser THEN 'parser_changed_same_raw' WHEN change = 'unknown' THEN 'comparison_unknown' ELSE 'unchanged' END END AS silent_reason FROM k""", "version", "activation"))
def _(spark, sf):
    changes = versions.version_changes(view(spark, sf, "version"))
    return ops.event_kinds(changes, _members(spark, sf).where("document_id % 3 > 0"), view(spark, sf, "activation").select("document_id", "origin", "live_at"), T0 + 86400)


_RUNS = "SELECT source_id || '-' || CAST(run_no AS VARCHAR) AS run_id, source_id, CASE run_no % 3 WHEN 0 THEN 'limited' ELSE 'complete' END AS coverage, last_at AS coverage_at, CASE WHEN run_no % 7 = 1 THEN 'historical' ELSE 'regular' END AS origin FROM run"
_SCANS = "SELECT source_id, max(last_at) AS last_complete_scan_at, CASE WHEN source_id = 's1' THEN NULL ELSE source_id || '-' || CAST(max(run_no) AS VARCHAR) END AS last_complete_scan_run_id FROM run GROUP BY source_id"


@query("scan_ready", oracle(f"""WITH r AS ({_RUNS}) SELECT s.source_id, coalesce(r.source_id = s.source_id AND coverage = 'complete' AND coverage_at = last_complete_scan_at AND coverage_at <= 4000000000 AND origin <> 'historical', false) AS ready FROM ({_SCANS}) s LEFT JOIN r ON r.run_id = s.last_complete_scan_run_id""", "run"))
def _(spark, sf):
    runs = view(spark, sf, "run").selectExpr("concat(source_id, '-', CAST(run_no AS STRING)) AS run_id", "source_id", "CASE run_no % 3 WHEN 0 THEN 'limited' ELSE 'complete' END AS coverage", "last_at AS coverage_at", "CASE WHEN run_no % 7 = 1 THEN 'historical' ELSE 'regular' END AS origin", "run_no")
    scans = runs.groupBy("source_id").agg(F.max("coverage_at").alias("last_complete_scan_at"), F.max("run_no").alias("n"))
    scans = scans.selectExpr("source_id", "last_complete_scan_at", "CASE WHEN source_id = 's1' THEN NULL ELSE concat(source_id, '-', CAST(n AS STRING)) END AS last_complete_scan_run_id")
    return ops.scan_ready(scans, runs.drop("run_no"), 4_000_000_000)


@query("policy_diff", oracle("""WITH cur AS (SELECT source AS source_id, SHA[to_json(list_sort(list({'profile_id': lang, 'rule': CAST(doc_id % 5 AS VARCHAR)})))] AS sha FROM (SELECT DISTINCT source, lang, doc_id % 5 AS doc_id FROM documents) GROUP BY source),
new AS (SELECT source AS source_id, SHA[to_json(list_sort(list({'profile_id': lang, 'rule': CAST(doc_id % 5 AS VARCHAR)})))] AS sha FROM (SELECT DISTINCT source, lang, doc_id % 5 AS doc_id FROM documents WHERE length(source) % 2 = 0 OR lang <> 'es') WHERE source <> 'src3' GROUP BY source)
SELECT coalesce(cur.source_id, new.source_id) AS source_id, cur.sha AS current_sha256, new.sha AS policy_sha256, cur.sha IS DISTINCT FROM new.sha AS changed FROM cur FULL JOIN new ON cur.source_id = new.source_id"""))
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.selectExpr("source AS source_id", "lang AS profile_id", "CAST(doc_id % 5 AS STRING) AS rule").distinct()
    return ops.policy_diff(rows, rows.where("(length(source_id) % 2 = 0 OR profile_id <> 'es') AND source_id <> 'src3'"))


_OPERATION = ["o_custkey % 200 AS operation_id", "o_custkey % 7 AS channel", "o_orderkey % 11 AS policy_sha256", "EPOCH[o_orderdate] AS t", "o_orderkey AS seq"]


def _operations(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey % 200 AS operation_id", "o_custkey % 7 AS channel", "o_orderkey % 11 AS policy_sha256", "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS at", "o_orderkey AS seq")


@query("policy_registry", oracle(f"""WITH once AS (SELECT operation_id, arg_min(channel, (t, seq)) AS channel, arg_min(policy_sha256, (t, seq)) AS policy_sha256, min(t) AS t FROM (SELECT {', '.join(_OPERATION)} FROM orders) GROUP BY operation_id)
SELECT 'policy' AS kind, policy_sha256 AS key, arg_min(operation_id, (t, operation_id)) AS value, count(*) AS n FROM once GROUP BY policy_sha256 UNION ALL SELECT 'channel', channel, arg_max(policy_sha256, (t, operation_id)), 1 FROM once GROUP BY channel"""))
def _(spark, sf):
    rows, pointer = ops.policy_registry(_operations(spark, sf))
    return rows.select(F.lit("policy").alias("kind"), F.col("policy_sha256").alias("key"), F.col("first_operation").alias("value"), F.col("operations").alias("n")).unionByName(
        pointer.select(F.lit("channel").alias("kind"), F.col("channel").alias("key"), F.col("policy_sha256").alias("value"), F.lit(1).cast("long").alias("n"))
    )


_SET = ["event_id", "document_id % 300 AS document_id", "2 * (document_id % 300) + CASE WHEN event_id % 5 > 0 THEN 1 ELSE 0 END AS version_id", "CASE WHEN event_id % 6 > 0 THEN 2 ELSE 1 END AS event_seq", "CASE WHEN event_id % 3 > 0 THEN 'none' ELSE route END AS route", "allocated AND event_id % 2 = 0 AS allocated",
        "CASE WHEN event_id % 8 = 1 THEN 4000000000 ELSE 0 END AS occurred_at", "event_id % 9 AS context_sha", "CASE WHEN event_id % 10 = 3 THEN 99 ELSE event_id % 9 END AS channel_sha", "event_id AS input_sha", "CASE WHEN event_id % 7 = 2 THEN 0 ELSE event_id END AS frozen_sha"]


@query("reevaluation", oracle(f"""WITH s AS (SELECT {', '.join(_SET)} FROM event), o AS (SELECT document_id, max(version_id) AS observed_version, max(observed_at) AS observed_at, count(*) AS observed_seq FROM version GROUP BY document_id)
SELECT s.event_id, CASE WHEN observed_version IS NULL OR observed_version <> version_id OR observed_seq <> event_seq THEN 'event_not_current' WHEN route <> 'none' OR allocated THEN 'route_locked'
WHEN NOT coalesce(published_date BETWEEN {_TODAY} - 6 AND {_TODAY}, false) AND NOT coalesce(category = 'opportunity' AND deadline_at >= {AT} AND (opening_confirmed OR opens_at IS NOT NULL) AND (opens_at IS NULL OR opens_at <= {AT}), false) THEN 'not_candidate'
WHEN greatest(occurred_at, observed_at) > {AT} THEN 'time_invalid' WHEN context_sha <> channel_sha THEN 'stale_context' WHEN input_sha <> frozen_sha THEN 'stale_input' ELSE 'applied' END AS status FROM s LEFT JOIN o USING (document_id) LEFT JOIN fact f USING (document_id)""", "event", "version", "fact"))
def _(spark, sf):
    return ops.reevaluation(view(spark, sf, "event").selectExpr(*_SET), ops.latest_observation(view(spark, sf, "version")), view(spark, sf, "fact"), AT, local_date(F.lit(AT)))


@query("decision_audit", oracle(decided_plans._DECIDED + decided_plans._SPREAD + """, n AS (SELECT document_id, profile_id, SHA[concat_ws('|', eligibility, time_status, relevance, action, reason, route)] AS d, SHA[CAST(document_id AS VARCHAR)] AS f, SHA[profile_id] AS p FROM spread WHERE profile_id IS NOT NULL),
s AS (SELECT document_id, profile_id, CASE WHEN document_id % 11 = 1 THEN 'x' ELSE d END AS sd, CASE WHEN document_id % 13 = 2 THEN 'x' ELSE f END AS sf, CASE WHEN document_id % 17 = 3 THEN NULL ELSE p END AS sp FROM n)
SELECT document_id, profile_id, array_to_string(list_filter([CASE WHEN sd IS DISTINCT FROM d THEN 'decision' END, CASE WHEN sf IS DISTINCT FROM f THEN 'facts' END, CASE WHEN sp IS DISTINCT FROM p THEN 'policy' END], lambda x: x IS NOT NULL), ',') AS differs FROM s JOIN n USING (document_id, profile_id)
WHERE sd IS DISTINCT FROM d OR sf IS DISTINCT FROM f OR sp IS DISTINCT FROM p""", *decided_plans._ALL))
def _(spark, sf):
    now = decided_plans._decided(spark, sf).where("profile_id IS NOT NULL").select(
        "document_id", "profile_id", F.sha2(F.concat_ws("|", "eligibility", "time_status", "relevance", "action", "reason", "route"), 256).alias("decision_sha256"),
        F.sha2(F.col("document_id").cast("string"), 256).alias("facts_sha256"), F.sha2("profile_id", 256).alias("policy_sha256"),
    )
    stored = now.selectExpr("document_id", "profile_id", "CASE WHEN document_id % 11 = 1 THEN 'x' ELSE decision_sha256 END AS decision_sha256", "CASE WHEN document_id % 13 = 2 THEN 'x' ELSE facts_sha256 END AS facts_sha256", "CASE WHEN document_id % 17 = 3 THEN NULL ELSE policy_sha256 END AS policy_sha256")
    return ops.decision_audit(stored, now)


@query("operation_progress", oracle("""WITH d AS (SELECT DISTINCT installation, event_id FROM event WHERE allocated OR installation = 3)
SELECT e.installation AS operation_id, count(*) AS items, count(d.event_id) AS done, arg_min(e.event_id, CASE WHEN d.event_id IS NULL THEN occurred_at * 10000000 + e.event_id END) AS next_event, count(*) - count(d.event_id) AS pending, count(*) = count(d.event_id) AS finished FROM event e LEFT JOIN d ON d.event_id = e.event_id GROUP BY e.installation""", "event"))
def _(spark, sf):
    events = view(spark, sf, "event")
    items = events.selectExpr("installation AS operation_id", "event_id", "occurred_at * 10000000 + event_id AS position")
    done = events.where("allocated OR installation = 3").selectExpr("installation AS operation_id", "event_id")
    return ops.operation_progress(items, done.union(done))


@query("member_evidence", oracle("""WITH m AS (SELECT event_id, e.document_id % 300 AS document_id, n.source_id, CASE WHEN event_id % 7 = 1 THEN 0 ELSE n.current_version_id END AS version_id, CASE WHEN event_id % 9 = 2 THEN 'x' ELSE v.content_sha END AS content_sha, event_id * 10 AS decision_id
FROM event e LEFT JOIN notice n ON n.document_id = e.document_id % 300 LEFT JOIN version v ON v.version_id = n.current_version_id WHERE allocated),
e AS (SELECT event_id, CASE WHEN event_id % 5 = 3 THEN document_id ELSE document_id % 300 END AS document_id, route FROM event WHERE event_id % 11 > 0), j AS (SELECT event_id, event_id * 10 AS decision_id FROM event WHERE event_id % 13 > 0)
SELECT m.event_id, CASE WHEN e.event_id IS NULL THEN 'event_missing' WHEN m.document_id IS DISTINCT FROM e.document_id THEN 'document_mismatch' WHEN m.source_id IS DISTINCT FROM n.source_id THEN 'source_mismatch' WHEN m.version_id IS DISTINCT FROM n.current_version_id THEN 'version_mismatch'
WHEN m.content_sha IS DISTINCT FROM v.content_sha THEN 'content_mismatch' WHEN m.decision_id IS DISTINCT FROM j.decision_id THEN 'decision_mismatch' WHEN e.route = 'none' THEN 'route_mismatch' ELSE 'ok' END AS code
FROM m LEFT JOIN e ON e.event_id = m.event_id LEFT JOIN notice n ON n.document_id = e.document_id LEFT JOIN version v ON v.version_id = n.current_version_id LEFT JOIN j ON j.event_id = m.event_id""", "event", "notice", "version"))
def _(spark, sf):
    events, docs, vs = view(spark, sf, "event"), view(spark, sf, "notice"), view(spark, sf, "version")
    snap = docs.join(vs.select(F.col("version_id").alias("current_version_id"), "content_sha"), "current_version_id", "left").select("document_id", "source_id", F.col("current_version_id").alias("version_id"), "content_sha")
    members = events.where("allocated").selectExpr("event_id", "document_id % 300 AS document_id").join(snap, "document_id", "left")
    members = members.selectExpr("event_id", "document_id", "source_id", "CASE WHEN event_id % 7 = 1 THEN 0 ELSE version_id END AS version_id", "CASE WHEN event_id % 9 = 2 THEN 'x' ELSE content_sha END AS content_sha", "event_id * 10 AS decision_id")
    known = events.where("event_id % 11 > 0").selectExpr("event_id", "CASE WHEN event_id % 5 = 3 THEN document_id ELSE document_id % 300 END AS document_id", "route")
    return ops.member_evidence(members, known, docs, vs, events.where("event_id % 13 > 0").selectExpr("event_id", "event_id * 10 AS decision_id"))


@query("foreground_docs", "SELECT DISTINCT CAST(floor(page_id / 30) AS BIGINT) AS run_id, page_id % 60 AS document_id FROM pages WHERE page_id % 30 < 20")
def _(spark, sf):
    entries = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("CAST(floor(page_id / 30) AS BIGINT) AS run_id", "CAST(floor(page_id % 30 / 10) AS INT) + 1 AS page", "page_id % 60 AS document_id")
    return ops.foreground(entries)


@query("document_state", oracle("""SELECT document_id, CASE WHEN arg_max(coalesce(error_code, ''), ("at", attempt_no)) = '' THEN 'processed' ELSE 'failed' END AS status, max("at") AS last_attempt_at, max("at") FILTER (error_code IS NULL) AS last_success_at, arg_max(version_id, ("at", attempt_no)) FILTER (error_code IS NULL) AS current_version_id,
nullif(arg_max(coalesce(error_code, ''), ("at", attempt_no)), '') AS last_error_code, nullif(arg_max(coalesce(next_due_at, -1), ("at", attempt_no)), -1) AS next_due_at FROM doc_attempt GROUP BY document_id""", "doc_attempt"))
def _(spark, sf):
    return ops.document_state(view(spark, sf, "doc_attempt"))


@query("coverage_members", """SELECT CAST(floor(page_id / 30) AS BIGINT) AS run_id, CASE WHEN page_id % 4 = 0 THEN 'reference' ELSE 'entry' END AS kind, CASE WHEN page_id % 9 = 1 THEN page_id + 1000000 ELSE page_id END AS key FROM pages
WHERE CASE WHEN page_id % 4 = 0 THEN page_id % 9 = 1 OR page_id % 8 = 4 AND page_id % 5 = 0 ELSE page_id % 9 = 1 OR page_id NOT IN (SELECT doc_id FROM documents) END""")
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    listed = pages.selectExpr("CAST(floor(page_id / 30) AS BIGINT) AS run_id", "CASE WHEN page_id % 4 = 0 THEN 'reference' ELSE 'entry' END AS kind", "CASE WHEN page_id % 9 = 1 THEN page_id + 1000000 ELSE page_id END AS key")
    references = pages.where("page_id % 4 = 0 AND NOT (page_id % 8 = 4 AND page_id % 5 = 0)").selectExpr("page_id AS key")
    return ops.coverage_members(listed, spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS key"), references)


@query("page_key_equality", """WITH a AS (SELECT page_id // 10 AS page, page_id AS key FROM pages), b AS (SELECT page_id // 10 AS page, CASE WHEN page_id % 27 = 4 THEN page_id + 1000000 ELSE page_id END AS key FROM pages WHERE page_id % 43 > 0)
SELECT coalesce(a.page, b.page) AS page, count(*) FILTER (b.key IS NULL) AS only_page, count(*) FILTER (a.key IS NULL) AS only_table, count(*) FILTER (a.key IS NULL OR b.key IS NULL) = 0 AS equal FROM a FULL JOIN b ON a.page = b.page AND a.key = b.key GROUP BY 1""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("CAST(floor(page_id / 10) AS BIGINT) AS page", "page_id AS key")
    return ops.page_key_equality(rows, rows.where("key % 43 > 0").selectExpr("page", "CASE WHEN key % 27 = 4 THEN key + 1000000 ELSE key END AS key"))


@query("constraint_conflicts", oracle("""WITH c AS (SELECT document_id, field, list(list_filter([v1, v2], lambda x: x IS NOT NULL)) AS sets FROM asked WHERE operator = 'in' GROUP BY document_id, field HAVING count(*) > 1)
SELECT document_id, field, len(sets) AS constraints FROM c WHERE len(list_filter(sets[1], lambda x: len(list_filter(sets, lambda s: NOT list_contains(s, x))) = 0)) = 0""", "asked"))
def _(spark, sf):
    return ops.constraint_conflicts(decided_plans._asked(spark, sf, "asked"))
