"""Queries on decisions: facts of all documents against every profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions
from ..operators.percolate import phrase_hits
from ..registry import query
from ..sources.bindings import AT, oracle, view

_MODE, _NEXT = "hybrid", AT + 86400

_STATUS = f"""CASE WHEN category <> 'opportunity' THEN 'not_required' WHEN cancelled OR {AT} > deadline_at THEN 'closed' WHEN {AT} < opens_at THEN 'not_started'
  WHEN deadline_at IS NOT NULL AND (opening_confirmed OR opens_at IS NOT NULL) THEN 'open' ELSE 'unknown' END"""
_URGENT = f"CASE WHEN deadline_lower_at IS NOT NULL THEN greatest(deadline_lower_at, {AT}) ELSE deadline_at END"
_SOON = f"coalesce({_STATUS} = 'open' AND {_URGENT} BETWEEN {AT} AND {AT} + 259200, false)"
_JUDGED = """WITH answer AS (SELECT r.document_id, q.profile_id, operator = 'unsupported' OR (v1 IS NULL AND v2 IS NULL) OR actual IS NULL AS unclear, actual = v1 OR actual = v2 AS same FROM requirement r CROSS JOIN (SELECT DISTINCT profile_id FROM profile) q LEFT JOIN profile p ON p.field = r.field AND p.profile_id = q.profile_id),
per AS (SELECT document_id, profile_id, bool_or(NOT unclear AND NOT coalesce(same, false)) AS mismatch, bool_or(unclear) AS unclear FROM answer GROUP BY ALL),
judged AS (SELECT f.*, q.profile_id, CASE WHEN category <> 'opportunity' AND unclear IS NULL THEN 'not_required' WHEN coalesce(mismatch, false) THEN 'ineligible'
  WHEN NOT audience_declared OR NOT eligibility_complete OR information_incomplete OR coalesce(unclear, false) THEN 'unknown' ELSE 'eligible' END AS eligibility
  FROM fact f CROSS JOIN (SELECT DISTINCT profile_id FROM profile) q LEFT JOIN per ON per.document_id = f.document_id AND per.profile_id = q.profile_id)
"""
_SAID = "said AS (SELECT document_id, profile_id FROM notice JOIN profile_phrase ON contains(title, phrase) OR contains(body_text, phrase))"
_DECIDED = _JUDGED + f""", {_SAID}, flag AS (SELECT document_id, profile_id, bool_or(sure AND interest AND NOT store_only) AS matched, bool_or(offer AND interest AND NOT store_only) AS offered, bool_or(sure AND store_only) AS stored,
  bool_or(coalesce(context, '') = 'uncertain' AND interest) AS doubtful, bool_or(offer AND interest AND NOT store_only AND high_value) AS valued, bool_or(is_primary AND excluded) AS vetoed
  FROM (SELECT document_id, profile_id, context, is_primary, coalesce(context, '') NOT IN ('incidental', 'uncertain') AS sure, coalesce(context, 'opportunity') = 'opportunity' AS offer, interest, excluded, high_value, store_only FROM topic_match JOIN profile_topic USING (topic)
    UNION ALL SELECT document_id, profile_id, NULL, false, true, true, true, false, false, false FROM said) GROUP BY ALL),
seen AS (SELECT j.*, {_STATUS} AS time_status, {_SOON} AND coalesce(offered, false) AS urgent, coalesce(matched, false) AS matched, coalesce(stored, false) AS stored, coalesce(doubtful, false) AS doubtful,
  coalesce(valued, false) AS valued, coalesce(vetoed, false) AS vetoed, kind = 'update' AND previous_route <> 'none' AS followed, date_diff('day', published_date, LOCALDATE[{AT}]) AS age
  FROM judged j LEFT JOIN flag USING (document_id, profile_id)),
placed AS (SELECT *, CASE WHEN NOT matched AND NOT stored AND (doubtful OR information_incomplete) THEN 'unknown' WHEN matched OR stored THEN 'matched' ELSE 'unmatched' END AS relevance FROM seen),
reasoned AS (SELECT *, CASE WHEN vetoed THEN 'excluded_topic' WHEN kind = 'historical' THEN 'historical_context'
  WHEN relevance = 'unknown' AND NOT (followed AND doubtful) THEN CASE WHEN doubtful THEN 'topic_relation_unknown' ELSE 'media_interest_unknown' END
  WHEN relevance = 'unmatched' AND NOT followed THEN 'no_interest_match' WHEN category = 'reference' AND NOT followed THEN 'reference_only' WHEN stored AND NOT matched AND NOT followed THEN 'store_only_topic'
  WHEN followed AND NOT comparison_known THEN 'update_comparison_unknown' WHEN followed AND conditions_changed THEN 'conditions_changed' WHEN eligibility = 'ineligible' THEN 'audience_mismatch'
  WHEN time_status = 'closed' THEN 'deadline_passed' WHEN age < 0 THEN 'future_publication' WHEN time_status = 'not_started' THEN 'not_started' WHEN urgent AND kind <> 'update' THEN 'deadline_soon'
  WHEN kind = 'new' AND category = 'opportunity' AND age BETWEEN 0 AND 6 AND valued THEN 'high_value_topic' WHEN kind = 'update' THEN 'relevant_update' ELSE 'relevant_digest' END AS reason FROM placed),
decided AS (SELECT *, CASE WHEN reason IN ('excluded_topic', 'no_interest_match', 'audience_mismatch') THEN 'IGNORE'
  WHEN reason = 'historical_context' THEN CASE WHEN relevance = 'matched' AND (time_status = 'closed' OR category = 'reference') THEN 'STORE_ONLY' ELSE 'IGNORE' END
  WHEN reason IN ('topic_relation_unknown', 'media_interest_unknown', 'reference_only', 'store_only_topic') THEN 'STORE_ONLY' WHEN reason = 'deadline_passed' THEN CASE WHEN kind = 'activation_recent' THEN 'STORE_ONLY' ELSE 'IGNORE' END
  WHEN reason IN ('deadline_soon', 'high_value_topic') OR (reason = 'conditions_changed' AND urgent AND eligibility <> 'ineligible' AND age >= 0) THEN 'PUSH_NOW' ELSE 'DIGEST' END AS action FROM reasoned),
sent AS (SELECT document_id, profile_id, eligibility, time_status, relevance, action, reason, CASE WHEN action IN ('IGNORE', 'STORE_ONLY') THEN 'none' WHEN action = 'DIGEST' THEN 'digest'
  WHEN kind = 'activation_recent' AND NOT coalesce(time_status = 'open' AND ({_URGENT}) BETWEEN {AT} AND {_NEXT}, false) THEN 'digest' ELSE 'immediate' END AS route FROM decided)
"""
#: The same decisions, one row for all profiles that a document has nothing to do with; these must not differ.
_SPREAD = """, named AS (SELECT r.document_id, p.profile_id FROM requirement r JOIN profile p USING (field) WHERE actual IS NOT NULL AND operator <> 'unsupported' AND (v1 IS NOT NULL OR v2 IS NOT NULL) UNION SELECT document_id, profile_id FROM flag),
spread AS (SELECT document_id, profile_id, 1::BIGINT AS profiles, eligibility, time_status, relevance, action, reason, route FROM sent SEMI JOIN named USING (document_id, profile_id)
  UNION ALL SELECT document_id, NULL, count(*), eligibility, time_status, relevance, action, reason, route FROM sent ANTI JOIN named USING (document_id, profile_id) GROUP BY ALL)
"""
_ALL = ("fact", "requirement", "profile", "topic_match", "profile_topic", "notice", "profile_phrase")


#: The same over all constraints.
_ALL_ASKED = "WITH requirement AS (SELECT * FROM asked), "


def _asked(spark, sf, name="requirement"):
    return view(spark, sf, name).select("document_id", "field", "operator", F.array_compact(F.array("v1", "v2")).alias("values"))


def _decided(spark, sf):
    phrases = view(spark, sf, "profile_phrase")
    hits = phrase_hits(view(spark, sf, "notice"), phrases.select("phrase"))
    flags = decisions.interest_flags(view(spark, sf, "topic_match"), view(spark, sf, "profile_topic"), hits, phrases)
    return decisions.decide_batch(view(spark, sf, "fact"), _asked(spark, sf), view(spark, sf, "profile"), flags, AT, _MODE, _NEXT)


@query("eligibility", oracle(_JUDGED.replace("WITH ", _ALL_ASKED, 1) + "SELECT document_id, profile_id, eligibility FROM judged", "fact", "asked", "profile"))
def _(spark, sf):
    profiles = view(spark, sf, "profile")
    rows = decisions.eligibility(view(spark, sf, "fact"), _asked(spark, sf, "asked"), profiles)
    return decisions.each_profile(rows.select("document_id", "profile_id", "eligibility", "profiles"), profiles)


@query("time_status", oracle(f"SELECT document_id, {_STATUS} AS time_status FROM fact", "fact"))
def _(spark, sf):
    return view(spark, sf, "fact").select("document_id", decisions.time_status(AT).alias("time_status"))


@query("urgency", oracle(f"SELECT document_id, {_URGENT} AS urgent_at, {_SOON} AS urgent FROM fact", "fact"))
def _(spark, sf):
    return view(spark, sf, "fact").select("document_id", decisions.urgent_at(AT).alias("urgent_at"), decisions.is_urgent(AT).alias("urgent"))


@query("actions", oracle(_DECIDED + _SPREAD + "SELECT document_id, profile_id, profiles, action, reason FROM spread", *_ALL))
def _(spark, sf):
    return _decided(spark, sf).select("document_id", "profile_id", "profiles", "action", "reason")


@query("routes", oracle(_DECIDED + "SELECT route, action, count(*) AS n FROM sent GROUP BY ALL", *_ALL))
def _(spark, sf):
    return _decided(spark, sf).groupBy("route", "action").agg(F.sum("profiles").alias("n"))


@query("decide_batch", oracle(_DECIDED + _SPREAD + "SELECT * FROM spread", *_ALL))
def _(spark, sf):
    return _decided(spark, sf)
