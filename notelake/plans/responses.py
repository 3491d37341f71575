"""Queries on stored responses: archive, cache reuse, revalidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import responses as ops
from ..registry import query
from ..sources.bindings import oracle, view


@query("raw_verify", oracle(r"""SELECT id, CASE WHEN body_sha256 IS NULL OR body_path IS NULL THEN 'raw_missing' WHEN NOT regexp_matches(body_path, '^raw/[0-9a-f]{64}\.bin$') OR body_path <> 'raw/' || body_sha256 || '.bin' THEN 'raw_path_invalid'
WHEN SHA[body] <> body_sha256 THEN 'raw_digest_mismatch' ELSE 'ok' END AS outcome FROM response""", "response"))
def _(spark, sf):
    return ops.read_bodies(view(spark, sf, "response"))


@query("raw_archive", oracle("""SELECT body_sha256 AS sha256, min(id) AS first_id, count(*) AS copies, substr(body_sha256, 1, 2) AS shard FROM response WHERE body_sha256 IS NOT NULL
AND body_sha256 NOT IN (SELECT body_sha256 FROM response WHERE body_sha256 IS NOT NULL AND id % 3 = 0) GROUP BY body_sha256""", "response"))
def _(spark, sf):
    rows = view(spark, sf, "response")
    return ops.archive(rows, rows.where("id % 3 = 0 AND body_sha256 IS NOT NULL").select(F.col("body_sha256").alias("sha256")))


@query("response_import", oracle(r"""WITH m AS (SELECT id, CASE WHEN id % 9 = 1 THEN 'poster' ELSE page_type END AS page_type, source_id, CASE WHEN id % 13 <> 2 THEN document_id END AS doc, requested_url, CASE WHEN id % 17 = 3 THEN 'ftp://x/' ELSE requested_url END AS final_url,
CASE WHEN id % 19 = 4 THEN -1 ELSE fetched_at END AS fetched_at, CASE WHEN id % 23 = 5 THEN 700 ELSE status_code END AS status_code, CASE WHEN body_state = 'complete' THEN 'complete' ELSE 'unavailable' END AS body_state,
CASE WHEN id % 43 = 8 THEN 0 WHEN body_state = 'complete' OR id % 7 = 2 THEN length(body) END AS body_bytes, id % 41 = 7 AS broken FROM response)
SELECT id, CASE WHEN NOT broken THEN page_type END AS page_type, CASE WHEN NOT broken THEN source_id END AS source_id, CASE WHEN NOT broken THEN CAST(doc AS VARCHAR) END AS source_document_id, CASE WHEN NOT broken THEN requested_url END AS requested_url, CASE WHEN NOT broken THEN final_url END AS final_url,
CASE WHEN NOT broken THEN fetched_at END AS fetched_at, CASE WHEN NOT broken THEN status_code END AS status_code, CASE WHEN NOT broken THEN body_state END AS body_state, CASE WHEN NOT broken THEN body_bytes END AS body_bytes,
CASE WHEN broken OR page_type = 'poster' THEN 'metadata_invalid' WHEN final_url = 'ftp://x/' THEN 'url_invalid' WHEN fetched_at < 0 THEN 'time_invalid' WHEN status_code = 700 THEN 'status_invalid' WHEN (page_type = 'notice') <> (doc IS NOT NULL) THEN 'target_invalid'
WHEN status_code = 304 AND body_bytes IS NOT NULL THEN '304_has_body' WHEN status_code = 200 AND body_bytes = 0 THEN 'empty_complete_body' WHEN (body_state = 'complete') <> (body_bytes IS NOT NULL) THEN 'body_completeness_mismatch' ELSE 'ok' END AS code FROM m""", "response"))
def _(spark, sf):
    rows = view(spark, sf, "response").selectExpr(
        "id", "to_json(struct(CASE WHEN id % 9 = 1 THEN 'poster' ELSE page_type END AS page_type, source_id, CAST(CASE WHEN id % 13 <> 2 THEN document_id END AS STRING) AS source_document_id, requested_url, CASE WHEN id % 17 = 3 THEN 'ftp://x/' ELSE requested_url END AS final_url, "
        "CASE WHEN id % 19 = 4 THEN -1 ELSE fetched_at END AS fetched_at, CASE WHEN id % 23 = 5 THEN 700 ELSE status_code END AS status_code, CASE WHEN body_state = 'complete' THEN 'complete' ELSE 'unavailable' END AS body_state, "
        "CASE WHEN id % 43 = 8 THEN 0 WHEN body_state = 'complete' OR id % 7 = 2 THEN length(body) END AS body_bytes)) AS j",
    )
    return ops.import_responses(rows.selectExpr("id", "CASE WHEN id % 41 = 7 THEN '{\"page_type\": \"list' ELSE j END AS value"))


@query("revalidation_binding", oracle("""SELECT r.id, b.id AS body_id, CASE WHEN b.id IS NULL THEN 'body_missing' WHEN b.status_code <> 200 THEN 'not_a_body' WHEN r.fetched_at < b.fetched_at THEN 'older_than_body' WHEN r.source_id IS DISTINCT FROM b.source_id THEN 'source_id_mismatch'
WHEN r.resource_id IS DISTINCT FROM b.resource_id THEN 'resource_id_mismatch' WHEN r.requested_url IS DISTINCT FROM b.requested_url THEN 'requested_url_mismatch' WHEN r.final_url IS DISTINCT FROM b.final_url THEN 'final_url_mismatch' WHEN r.page_type IS DISTINCT FROM b.page_type THEN 'page_type_mismatch'
WHEN r.document_id IS DISTINCT FROM b.document_id THEN 'document_id_mismatch' ELSE 'ok' END AS code FROM (SELECT * REPLACE (CASE WHEN id % 3 > 0 THEN 's3' ELSE source_id END AS source_id, CASE WHEN id % 5 > 0 OR id % 2 = 0 THEN '/same' ELSE requested_url END AS requested_url) FROM (SELECT * REPLACE ('/f' AS final_url) FROM response) WHERE status_code = 304) r
LEFT JOIN (SELECT * REPLACE ('/same' AS requested_url, '/f' AS final_url) FROM response) b ON r.validated_response_id = b.id""", "response"))
def _(spark, sf):
    rows = view(spark, sf, "response").withColumn("final_url", F.lit("/f"))
    again = F.col("status_code") == 304
    rows = rows.withColumn("source_id", F.when(again & (F.col("id") % 3 > 0), "s3").otherwise(F.col("source_id")))
    rows = rows.withColumn("requested_url", F.when(~again | (F.col("id") % 5 > 0) | (F.col("id") % 2 == 0), "/same").otherwise(F.col("requested_url")))
    return ops.binding(ops.revalidations(rows))


_NO_STORE = r"regexp_matches(lower(coalesce({}, '')), '(^|,)\s*no-store\s*(=[^,]*)?(,|$)')"
_VARY = "CASE WHEN {0} IS NULL THEN '' WHEN len(list_filter(list_transform(string_split(lower({0}), ','), lambda x: trim(x)), lambda x: x NOT IN ('accept-encoding', 'user-agent', 'accept'))) = 0 THEN lower({0}) END"
_DATE = "(regexp_matches({0}, '^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), [0-9]{{2}} [A-Z][a-z]{{2}} [0-9]{{4}} [0-9:]{{8}} (GMT|[+-]0000)$') AND try_strptime(substr({0}, 6, 20), '%d %b %Y %H:%M:%S') IS NOT NULL)"
_ETAG = "regexp_matches({}, '^(W/)?\"[\\x21\\x23-\\x7e]*\"$')"
_REUSE = f"""CASE WHEN status_code <> 200 OR body_state <> 'complete' OR body_path IS NULL THEN 'baseline_not_complete_200' WHEN r.source_id IS DISTINCT FROM s.source_id OR requested_url IS DISTINCT FROM request_uri THEN 'baseline_key_mismatch'
WHEN final_url <> requested_url THEN 'redirect_requires_full_fetch' WHEN body_path <> 'raw/' || body_sha256 || '.bin' THEN 'baseline_reference_invalid' WHEN ({_VARY.format('vary')}) IS NULL THEN 'vary_unsupported' WHEN {_NO_STORE.format('cache_control')} THEN 'cache_no_store'
WHEN coalesce(content_encoding, '') NOT IN ('', 'identity') THEN 'encoding_unsupported' WHEN NOT {_ETAG.format('etag')} OR (last_modified IS NOT NULL AND NOT {_DATE.format('last_modified')}) THEN 'validator_invalid' WHEN etag IS NULL AND last_modified IS NULL THEN 'validator_missing' ELSE 'ok' END"""


@query("cache_reuse_reason", oracle(f"SELECT r.id, {_REUSE} AS reason FROM response r LEFT JOIN resource s ON r.resource_id = s.id", "response", "resource"))
def _(spark, sf):
    return ops.with_resource(view(spark, sf, "response"), view(spark, sf, "resource")).select("id", ops.reuse_reason().alias("reason"))


@query("cache_validation_reason", oracle(f"""SELECT r.id, CASE WHEN b.id IS NULL THEN 'body_missing' WHEN coalesce(r.content_encoding, '') NOT IN ('', 'identity') THEN 'encoding_unsupported' WHEN r.vary IS NOT NULL AND ({_VARY.format('r.vary')}) IS DISTINCT FROM ({_VARY.format('b.vary')}) THEN 'vary_changed'
WHEN {_NO_STORE.format('r.cache_control')} THEN 'cache_no_store' WHEN NOT {_ETAG.format('r.etag')} THEN 'validator_invalid' WHEN regexp_replace(r.etag, '^W/', '') <> regexp_replace(b.etag, '^W/', '') THEN 'validator_changed'
WHEN r.last_modified IS NOT NULL AND (NOT {_DATE.format('r.last_modified')} OR r.last_modified IS DISTINCT FROM b.last_modified) THEN 'validator_changed' ELSE 'ok' END AS reason FROM response r LEFT JOIN response b ON r.validated_response_id = b.id WHERE r.status_code = 304""", "response"))
def _(spark, sf):
    return ops.validation_reason(ops.revalidations(view(spark, sf, "response")))


@query("cache_candidates", oracle(f"""SELECT resource_id, reason, CASE WHEN reason = 'ok' THEN id END AS response_id, CASE WHEN reason = 'ok' THEN etag END AS etag FROM (SELECT s.id AS resource_id, r.id, r.etag, CASE WHEN r.id IS NULL THEN 'baseline_missing' WHEN blocked_by_response_id IS NOT NULL THEN 'cache_validation_blocked'
WHEN profile_sha256 <> 'standard' THEN 'profile_mismatch' WHEN ({_REUSE}) <> 'ok' THEN {_REUSE} WHEN strlen(body) = 0 THEN 'baseline_empty' ELSE 'ok' END AS reason FROM resource s LEFT JOIN response r ON s.latest_response_id = r.id)""", "response", "resource"))
def _(spark, sf):
    return ops.cache_candidates(view(spark, sf, "resource"), view(spark, sf, "response"), "standard")


@query("resources_pending", oracle("SELECT id, source_id, latest_response_id, last_processed_response_id FROM resource WHERE latest_response_id IS NOT NULL AND (last_processed_response_id IS NULL OR last_processed_response_id <> latest_response_id OR last_processed_parser_version <> 'p2')", "resource"))
def _(spark, sf):
    return ops.stale_resources(view(spark, sf, "resource"), "p2")


@query("body_reason", oracle("""WITH newest AS (SELECT document_id, arg_max(id, (fetched_at, id)) AS newest FROM response WHERE status_code = 200 AND body_path IS NOT NULL AND document_id IS NOT NULL GROUP BY document_id)
SELECT r.id, CASE WHEN status_code <> 200 OR body_state <> 'complete' OR body_path IS NULL THEN 'baseline_not_complete_200' WHEN s.id IS NULL THEN 'cache_profile_unknown' WHEN r.source_id <> s.source_id OR requested_url <> request_uri THEN 'baseline_key_mismatch'
WHEN latest_response_id IS DISTINCT FROM r.id THEN 'baseline_superseded' WHEN blocked_by_response_id IS NOT NULL THEN 'cache_validation_blocked' WHEN newest <> r.id THEN 'obsolete_document_body' ELSE 'ok' END AS reason FROM response r LEFT JOIN resource s ON r.resource_id = s.id LEFT JOIN newest n ON n.document_id = r.document_id""", "response", "resource"))
def _(spark, sf):
    return ops.body_reason(view(spark, sf, "response"), view(spark, sf, "resource"))


@query("retry_after", oracle(f"""SELECT id, CASE WHEN over THEN 9223372036854775807 WHEN digits THEN fetched_at + CAST(v AS HUGEINT) WHEN {_DATE.format('v')} THEN greatest(fetched_at, CAST(epoch(try_strptime(substr(v, 6, 20), '%d %b %Y %H:%M:%S')) AS BIGINT)) END::BIGINT AS deadline, coalesce(over, false) AS overflow
FROM (SELECT *, digits AND fetched_at + TRY_CAST(v AS HUGEINT) > 9223372036854775807 AS over FROM (SELECT id, fetched_at, trim(retry_after) AS v, regexp_matches(trim(retry_after), '^[0-9]+$') AS digits FROM response))""", "response"))
def _(spark, sf):
    return ops.retry_after(view(spark, sf, "response"))


@query("safe_codes", oracle("""SELECT id, CASE WHEN regexp_full_match(etag, '[A-Za-z0-9_.:-]{1,128}') THEN etag WHEN etag IS NOT NULL THEN 'unrecognized_identifier' END AS etag, CASE WHEN regexp_full_match(error_code, '[a-z][a-z0-9_]{0,63}') THEN error_code WHEN error_code IS NOT NULL THEN 'unrecognized_error_code' END AS error_code FROM response""", "response"))
def _(spark, sf):
    return view(spark, sf, "response").select("id", ops.safe_id(F.col("etag")).alias("etag"), ops.safe_error(F.col("error_code")).alias("error_code"))


@query("outcome_class", oracle("""SELECT error_code, status, CASE WHEN error_code IN ('robots_denied', 'source_cooldown') THEN 'stop' WHEN error_code IN ('request_limit', 'run_time_limit') THEN 'budget' WHEN error_code IN ('timeout', 'connection_failed') THEN 'transport'
WHEN error_code IS NOT NULL THEN 'other' WHEN status IN (429, 500, 502, 503, 504) THEN 'retryable_status' WHEN status >= 400 THEN 'failed_status' ELSE 'done' END AS class, count(*) AS n FROM (SELECT error_code, CASE id % 8 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE status_code END AS status FROM response) GROUP BY ALL""", "response"))
def _(spark, sf):
    rows = view(spark, sf, "response").selectExpr("error_code", "CASE id % 8 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE status_code END AS status")
    return rows.groupBy("error_code", "status", ops.classify_outcome(F.col("error_code"), F.col("status")).alias("class")).agg(F.count("*").alias("n"))


@query("latest_body", oracle("SELECT source_id, resource_id, arg_max(id, (fetched_at, id)) AS id, max(fetched_at) AS fetched_at FROM response WHERE status_code = 200 AND body_state = 'complete' GROUP BY ALL", "response"))
def _(spark, sf):
    good = view(spark, sf, "response").where("status_code = 200 AND body_state = 'complete'")
    return good.groupBy("source_id", "resource_id").agg(F.max(F.struct("fetched_at", "id")).alias("m")).select("source_id", "resource_id", "m.id", "m.fetched_at")


@query("resource_state", oracle("SELECT resource_id, max(fetched_at) AS last_at, arg_max(id, (fetched_at, id)) FILTER (body_state = 'complete') AS body_id, coalesce(max(fetched_at) FILTER (body_state = 'partial') > max(fetched_at) FILTER (body_state = 'complete'), count(*) FILTER (body_state = 'partial') > 0) AS blocked FROM response GROUP BY resource_id", "response"))
def _(spark, sf):
    at = lambda s: F.when(F.col("body_state") == s, F.col("fetched_at"))
    body = F.max(F.when(F.col("body_state") == "complete", F.struct("fetched_at", "id")))
    out = view(spark, sf, "response").groupBy("resource_id").agg(F.max("fetched_at").alias("last_at"), body.alias("b"), F.max(at("partial")).alias("p"), F.max(at("complete")).alias("c"))
    return out.select("resource_id", "last_at", F.col("b.id").alias("body_id"), F.coalesce(F.col("p") > F.col("c"), F.col("p").isNotNull()).alias("blocked"))


@query("scan_coverage", oracle("""WITH a AS (SELECT *, lag(next_url) OVER w AS expected, row_number() OVER w AS i FROM list_page WINDOW w AS (PARTITION BY run_id ORDER BY ordinal)),
p AS (SELECT run_id, max(page) AS reached, max(total_pages) AS total_pages, CASE WHEN bool_or(page <> i) THEN 'page_order' WHEN bool_or(i > 1 AND expected IS DISTINCT FROM url) THEN 'next_page_mismatch' WHEN min(total_pages) <> max(total_pages) THEN 'total_pages_changed'
WHEN max(page) < max(total_pages) THEN 'page_limit' WHEN arg_max_null(next_url, ordinal) IS NOT NULL THEN 'tail_not_last' WHEN max(first_digest) IS DISTINCT FROM max(recheck_digest) THEN 'first_page_changed' ELSE 'ok' END AS code FROM a GROUP BY run_id)
SELECT *, CASE code WHEN 'ok' THEN 'complete' WHEN 'page_limit' THEN 'limited' ELSE 'interrupted' END AS coverage FROM p""", "list_page"))
def _(spark, sf):
    return ops.scan_chain(view(spark, sf, "list_page"))


@query("listing_digest", oracle("SELECT CAST(floor(id / 100) AS BIGINT) AS run_id, CAST(floor(id % 100 / 20) AS BIGINT) AS page, count(*) AS n, SHA[to_json(list({'row_index': id % 20, 'title': etag, 'url': requested_url} ORDER BY id))] AS digest FROM response GROUP BY ALL", "response"))
def _(spark, sf):
    rows = view(spark, sf, "response").selectExpr("CAST(floor(id / 100) AS BIGINT) AS run_id", "CAST(floor(id % 100 / 20) AS BIGINT) AS page", "id % 20 AS row_index", "etag AS title", "requested_url AS url")
    return ops.listing_digest(rows)


@query("reference_lifecycle", oracle("SELECT requested_url, min(fetched_at) AS first_at, max(fetched_at) AS last_at, arg_min(id, (fetched_at, id)) AS first_id, arg_max(id, (fetched_at, id)) AS last_id FROM response GROUP BY requested_url", "response"))
def _(spark, sf):
    order = F.struct("fetched_at", "id")
    return view(spark, sf, "response").groupBy("requested_url").agg(F.min("fetched_at").alias("first_at"), F.max("fetched_at").alias("last_at"), F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"))


@query("references_page", oracle("SELECT id, requested_url, (SELECT count(*) FROM response WHERE status_code = 200) AS total FROM response WHERE status_code = 200 ORDER BY fetched_at, id LIMIT 20 OFFSET 10", "response"))
def _(spark, sf):
    rows = view(spark, sf, "response").where("status_code = 200")
    return rows.orderBy("fetched_at", "id").offset(10).limit(20).select("id", "requested_url").crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))
