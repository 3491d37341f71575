"""Stored responses: archive, typed import, and whether a stored body may answer a conditional request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ETAG = r'^(W/)?"[\x21\x23-\x7e]*"$'
VARIES_BY = ("accept-encoding", "user-agent", "accept")
HTTP_DATE = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), ([0-9]{2}) ([A-Z][a-z]{2}) ([0-9]{4}) ([0-9]{2}:[0-9]{2}:[0-9]{2}) (?:GMT|[+-]0000)$"
LATEST_TIME = (1 << 63) - 1

RESPONSE = "page_type string, source_id string, source_document_id string, requested_url string, final_url string, fetched_at long, status_code int, body_state string, body_bytes long"


def first_reason(rules: list[tuple[str, Column]], otherwise: str = "ok") -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*(F.when(c, name) for name, c in rules), F.lit(otherwise))


def read_bodies(responses: DataFrame) -> DataFrame:
    """id and outcome: does a body's path name its digest, and do its bytes have it."""
    sha = F.col("body_sha256")
    rules = [
        ("raw_missing", sha.isNull() | F.col("body_path").isNull()),
        ("raw_path_invalid", ~F.col("body_path").rlike(r"^raw/[0-9a-f]{64}\.bin$") | (F.col("body_path") != F.concat(F.lit("raw/"), sha, F.lit(".bin")))),
        ("raw_digest_mismatch", F.sha2(F.col("body").cast("binary"), 256) != sha),
    ]
    return responses.select("id", first_reason(rules).alias("outcome"))


def archive(bodies: DataFrame, stored: DataFrame) -> DataFrame:
    """Bodies to add to an archive: one row for each digest that ``stored`` (sha256) does not hold yet, with its first
    id and its shard. What is stored is never written again."""
    fresh = bodies.where("body_sha256 IS NOT NULL").groupBy(F.col("body_sha256").alias("sha256")).agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return fresh.join(stored.select("sha256").distinct(), "sha256", "left_anti").withColumn("shard", F.substring("sha256", 1, 2))


def import_responses(lines: DataFrame) -> DataFrame:
    """``value`` (JSON text) as typed columns with a code; rows whose code is not ok are the quarantine."""
    r = F.from_json("value", RESPONSE, {"mode": "PERMISSIVE"})
    rows = lines.select("id", F.try_parse_json("value").isNotNull().alias("json"), r.alias("r")).select("id", "json", "r.*")
    web = lambda c: F.col(c).rlike(r"^https?://[^/?#@\s]+([/?#][^\s\\]*)?$")
    notice, body = F.col("page_type") == "notice", F.col("body_bytes")
    rules = [
        ("metadata_invalid", ~F.col("json") | F.col("page_type").isNull() | ~F.col("page_type").isin("list", "notice") | F.col("source_id").isNull()),
        ("url_invalid", ~F.coalesce(web("requested_url") & web("final_url"), F.lit(False))),
        ("time_invalid", F.col("fetched_at").isNull() | (F.col("fetched_at") < 0)),
        ("status_invalid", ~F.coalesce(F.col("status_code").between(100, 599), F.lit(False))),
        ("target_invalid", notice != F.col("source_document_id").isNotNull()),
        ("304_has_body", (F.col("status_code") == 304) & body.isNotNull()),
        ("empty_complete_body", (F.col("status_code") == 200) & (body == 0)),
        ("body_completeness_mismatch", ((F.col("body_state") == "complete") & body.isNull()) | ((F.col("body_state") == "unavailable") & body.isNotNull())),
    ]
    return rows.withColumn("code", first_reason(rules)).drop("json")


def no_store(cache_control: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(cache_control, F.lit(""))), ",")
    return F.exists(parts, lambda x: F.trim(F.split_part(x, F.lit("="), F.lit(1))) == "no-store")


def vary_fields(vary: Column) -> Column:
    """Header names, sorted; null if one of them is not supported."""
    names = F.array_sort(F.array_distinct(F.transform(F.split(F.lower(vary), ","), lambda x: F.trim(x))))
    known = F.forall(names, lambda x: x.isin(*VARIES_BY))
    return F.when(vary.isNull(), F.array().cast("array<string>")).when(known, names)


def http_date(value: Column) -> Column:
    """Seconds of an HTTP date in GMT; null for anything else."""
    clock = F.concat_ws(" ", *(F.regexp_extract(value, HTTP_DATE, i) for i in (1, 2, 3, 4)))
    return F.when(value.rlike(HTTP_DATE), F.unix_seconds(F.try_to_timestamp(clock, F.lit("dd MMM yyyy HH:mm:ss"))))


def plain_encoding(encoding: Column) -> Column:
    return F.coalesce(encoding, F.lit("")).isin("", "identity")


def reuse_reason() -> Column:
    """Why a response joined with its resource (request_uri, resource_source) cannot be reused; ok if it can."""
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    rules = [
        ("baseline_not_complete_200", (F.col("status_code") != 200) | (F.col("body_state") != "complete") | F.col("body_path").isNull()),
        ("baseline_key_mismatch", differs("source_id", "resource_source") | differs("requested_url", "request_uri")),
        ("redirect_requires_full_fetch", differs("final_url", "requested_url")),
        ("baseline_reference_invalid", ~F.col("body_path").eqNullSafe(F.concat(F.lit("raw/"), "body_sha256", F.lit(".bin")))),
        ("vary_unsupported", vary_fields(F.col("vary")).isNull()),
        ("cache_no_store", no_store(F.col("cache_control"))),
        ("encoding_unsupported", ~plain_encoding(F.col("content_encoding"))),
        ("validator_invalid", ~F.col("etag").rlike(ETAG) | (F.col("last_modified").isNotNull() & http_date(F.col("last_modified")).isNull())),
        ("validator_missing", F.col("etag").isNull() & F.col("last_modified").isNull()),
    ]
    return first_reason(rules)


def with_resource(responses: DataFrame, resources: DataFrame) -> DataFrame:
    own = resources.select(F.col("id").alias("resource_id"), F.col("source_id").alias("resource_source"), "request_uri", "latest_response_id", "blocked_by_response_id")
    return responses.join(own, "resource_id", "left")


def validation_reason(pairs: DataFrame) -> DataFrame:
    """id and reason of each 304 (columns) against the body that it validates (columns b_...)."""
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    rules = [
        ("body_missing", F.col("b_id").isNull()),
        ("encoding_unsupported", ~plain_encoding(F.col("content_encoding"))),
        ("vary_changed", F.col("vary").isNotNull() & ~vary_fields(F.col("vary")).eqNullSafe(vary_fields(F.col("b_vary")))),
        ("cache_no_store", no_store(F.col("cache_control"))),
        ("validator_invalid", ~F.col("etag").rlike(ETAG)),
        ("validator_changed", weak("etag") != weak("b_etag")),
        ("validator_changed", F.col("last_modified").isNotNull() & (http_date(F.col("last_modified")).isNull() | ~F.col("last_modified").eqNullSafe(F.col("b_last_modified")))),
    ]
    return pairs.select("id", first_reason(rules).alias("reason"))


BOUND = ("source_id", "resource_id", "requested_url", "final_url", "page_type", "document_id")


def revalidations(responses: DataFrame) -> DataFrame:
    """Each 304 with the columns of the body it names (b_...)."""
    bodies = responses.select(*(F.col(c).alias(f"b_{c}") for c in ("id", "status_code", "fetched_at", "vary", "etag", "last_modified", *BOUND)))
    return responses.where("status_code = 304").join(bodies, F.col("validated_response_id") == F.col("b_id"), "left")


def binding(pairs: DataFrame) -> DataFrame:
    """id, body_id and code: the six columns that a 304 must share with its body, and their order in time."""
    differs = [(f"{c}_mismatch", ~F.col(c).eqNullSafe(F.col(f"b_{c}"))) for c in BOUND]
    rules = [("body_missing", F.col("b_id").isNull()), ("not_a_body", F.col("b_status_code") != 200), ("older_than_body", F.col("fetched_at") < F.col("b_fetched_at")), *differs]
    return pairs.select("id", F.col("b_id").alias("body_id"), first_reason(rules).alias("code"))


def cache_candidates(resources: DataFrame, responses: DataFrame, profile: str) -> DataFrame:
    """For each resource the response whose validators may be sent, or the first reason why there is none."""
    r = resources.select(F.col("id").alias("resource"), F.col("source_id").alias("resource_source"), "request_uri", "latest_response_id", "blocked_by_response_id", "profile_sha256")
    rows = r.join(responses, F.col("latest_response_id") == F.col("id"), "left")
    rules = [
        ("baseline_missing", F.col("latest_response_id").isNull() | F.col("id").isNull()),
        ("cache_validation_blocked", F.col("blocked_by_response_id").isNotNull()),
        ("profile_mismatch", F.col("profile_sha256") != profile),
    ]
    code = first_reason(rules, "")
    reason = F.when(code != "", code).when(reuse_reason() != "ok", reuse_reason()).when(F.octet_length("body") == 0, "baseline_empty").otherwise("ok")
    rows = rows.withColumn("reason", reason)
    return rows.select(F.col("resource").alias("resource_id"), "reason", F.when(F.col("reason") == "ok", F.col("id")).alias("response_id"), F.when(F.col("reason") == "ok", F.col("etag")).alias("etag"))


def stale_resources(resources: DataFrame, version: str) -> DataFrame:
    """Resources whose latest body has not been processed by this parser version."""
    done = F.col("last_processed_response_id").eqNullSafe(F.col("latest_response_id")) & F.col("last_processed_parser_version").eqNullSafe(F.lit(version))
    return resources.where(F.col("latest_response_id").isNotNull() & ~done).select("id", "source_id", "latest_response_id", "last_processed_response_id")


def body_reason(responses: DataFrame, resources: DataFrame) -> DataFrame:
    """id and reason: may a stored body be processed without anyone asking for it."""
    whole = (F.col("status_code") == 200) & (F.col("body_state") == "complete") & F.col("body_path").isNotNull()
    newest = responses.where("status_code = 200 AND body_path IS NOT NULL AND document_id IS NOT NULL").groupBy("document_id").agg(F.max_by("id", F.struct("fetched_at", "id")).alias("newest"))
    rows = with_resource(responses, resources).join(newest, "document_id", "left")
    rules = [
        ("baseline_not_complete_200", ~whole),
        ("cache_profile_unknown", F.col("resource_source").isNull()),
        ("baseline_key_mismatch", (F.col("source_id") != F.col("resource_source")) | (F.col("requested_url") != F.col("request_uri"))),
        ("baseline_superseded", ~F.col("latest_response_id").eqNullSafe(F.col("id"))),
        ("cache_validation_blocked", F.col("blocked_by_response_id").isNotNull()),
        ("obsolete_document_body", F.col("newest") != F.col("id")),
    ]
    return rows.select("id", first_reason(rules).alias("reason"))


def retry_after(rows: DataFrame) -> DataFrame:
    """id, deadline and overflow of a Retry-After value: seconds from ``fetched_at``, or an HTTP date."""
    value = F.trim("retry_after")
    digits = F.regexp_replace(value, "^0+(?=[0-9])", "")
    seconds = value.rlike("^[0-9]+$")
    sum_ = F.try_add("fetched_at", F.expr("try_cast(regexp_replace(trim(retry_after), '^0+(?=[0-9])', '') AS bigint)"))
    overflow = seconds & ((F.length(digits) > 19) | sum_.isNull())
    deadline = F.when(overflow, F.lit(LATEST_TIME)).when(seconds, sum_).otherwise(F.greatest(http_date(value) * 1, F.when(http_date(value).isNotNull(), F.col("fetched_at"))))
    return rows.select("id", deadline.alias("deadline"), F.coalesce(overflow, F.lit(False)).alias("overflow"))


def safe_id(value: Column) -> Column:
    return F.when(value.rlike(r"^[A-Za-z0-9_.:-]{1,128}$"), value).when(value.isNotNull(), F.lit("unrecognized_identifier"))


def safe_error(value: Column) -> Column:
    return F.when(value.rlike(r"^[a-z][a-z0-9_]{0,63}$"), value).when(value.isNotNull(), F.lit("unrecognized_error_code"))


#: Outcome of a fetch, and what the run does about it.
FETCH_CLASSES = {"robots_denied": "stop", "source_cooldown": "stop", "request_limit": "budget", "run_time_limit": "budget", "timeout": "transport", "connection_failed": "transport"}
RETRYABLE = (429, 500, 502, 503, 504)


def classify_outcome(error: Column, status: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in FETCH_CLASSES.items() for x in kv))[error]
    return F.coalesce(known, F.when(error.isNotNull(), "other").when(status.isin(*RETRYABLE), "retryable_status").when(status >= 400, "failed_status").otherwise("done"))


def scan_chain(pages: DataFrame) -> DataFrame:
    """Per run whether its list pages prove a whole scan. ``pages``: run_id, ordinal, page, total_pages, url, next_url,
    first_digest, recheck_digest (of the first page, read again at the end)."""
    w = W.partitionBy("run_id").orderBy("ordinal")
    rows = pages.withColumn("expected", F.lag("next_url").over(w)).withColumn("i", F.row_number().over(w))
    broken = {
        "page_order": F.col("page") != F.col("i"),
        "next_page_mismatch": F.col("expected").isNotNull() & (F.col("expected") != F.col("url")) | (F.col("expected").isNull() & (F.col("i") > 1)),
    }
    per = rows.groupBy("run_id").agg(
        *(F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in broken.items()), F.min("total_pages").alias("least"), F.max("total_pages").alias("most"), F.max("page").alias("reached"),
        F.max_by("next_url", "ordinal").alias("tail"), F.max("first_digest").alias("first_digest"), F.max("recheck_digest").alias("recheck_digest"),
    )
    rules = [
        *((n, F.col(n)) for n in broken), ("total_pages_changed", F.col("least") != F.col("most")), ("page_limit", F.col("reached") < F.col("most")), ("tail_not_last", F.col("tail").isNotNull()),
        ("first_page_changed", ~F.col("first_digest").eqNullSafe(F.col("recheck_digest"))),
    ]
    code = first_reason(rules)
    coverage = F.when(code == "ok", "complete").when(code == "page_limit", "limited").otherwise("interrupted")
    return per.select("run_id", "reached", F.col("most").alias("total_pages"), code.alias("code"), coverage.alias("coverage"))


def listing_digest(rows: DataFrame) -> DataFrame:
    """run_id, page, n and digest of each list page's rows in order; a page is bounded by nature. ``rows``: run_id,
    page, row_index and what identifies a row (url, title)."""
    row = F.struct("row_index", "title", "url")
    listed = F.array_sort(F.collect_list(row))
    return rows.groupBy("run_id", "page").agg(F.count("*").alias("n"), F.sha2(F.to_json(listed, {"ignoreNullFields": "false"}), 256).alias("digest"))
