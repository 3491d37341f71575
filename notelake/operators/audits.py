"""Readers with quarantine, audits of stored evidence, status and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import gaps, last_rows
from .responses import first_reason

FORMAT = "observation-v1"
OBSERVATION = "format string, source_id string, at long, processed long, documents long"
LOGGED = "time string, level string, event string, source_id string, run_id string, stage string, error_code string, document_id long, attempted string, succeeded string, failed string"
EVENTS = ("fetch_started", "fetch_finished", "page_processed", "processing_failed", "crawl_started", "crawl_finished")
STALE_SCAN, STALE_BACKLOG, STALE_RECHECK = 26 * 3600, 72 * 3600, 24 * 3600


def read_observations(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, one row of counts). A line is an observation, or a journal record with one in MESSAGE; other
    journal messages are ignored, cut ones and those that are no text count as unreadable."""
    outer = F.from_json("value", "MESSAGE string, " + OBSERVATION, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json("value").isNotNull()
    rows = lines.where(F.trim("value") != "").select("line", valid.alias("json"), outer.alias("o"), F.col("value").rlike('"MESSAGE"').alias("journal"))
    message = F.col("o.MESSAGE")
    inner = F.from_json(message, OBSERVATION, {"mode": "PERMISSIVE"})
    whole = F.try_parse_json(message).isNotNull()
    rows = rows.withColumn("i", F.when(F.col("journal"), inner).otherwise(F.struct(*(F.col(f"o.{c}").alias(c) for c in ("format", "source_id", "at", "processed", "documents")))))
    kind = first_reason([
        ("invalid", ~F.col("json")), ("unreadable", F.col("journal") & message.isNull()), ("truncated", F.col("journal") & ~whole & message.contains(FORMAT)), ("ignored", F.col("journal") & ~F.coalesce(F.col("i.format") == FORMAT, F.lit(False))),
        ("unsupported", ~F.coalesce(F.col("i.format") == FORMAT, F.lit(False))),
    ], "observation")
    rows = rows.withColumn("kind", kind)
    counts = rows.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("observation", "ignored", "unreadable", "truncated", "invalid", "unsupported")))
    return rows.where("kind = 'observation'").select("line", "i.source_id", "i.at", "i.processed", "i.documents"), counts


def read_event_log(lines: DataFrame) -> DataFrame:
    """Lines of a JSON log as typed columns: known events only, identifiers and counters only where they look like it."""
    r = F.from_json("value", LOGGED, {"mode": "PERMISSIVE"})
    rows = lines.select("line", r.alias("r")).select("line", "r.*")
    safe = lambda c: F.when(F.col(c).rlike(r"^[A-Za-z0-9_.:-]{1,100}$"), F.col(c)).alias(c)
    counter = lambda c: F.when(F.col(c).rlike("^[0-9]{1,18}$"), F.col(c).cast("long")).alias(c)
    event = F.when(F.col("event").isin(*EVENTS), F.col("event")).otherwise("unstructured_log").alias("event")
    return rows.select("line", F.unix_seconds(F.try_to_timestamp("time")).alias("at"), event, *map(safe, ("source_id", "run_id", "stage", "error_code")), F.when(F.col("document_id") >= 0, F.col("document_id")).alias("document_id"), *map(counter, ("attempted", "succeeded", "failed")))


def run_rollup(log: DataFrame) -> DataFrame:
    """First and last line of each run, its lines, errors and attempts."""
    return log.where("run_id IS NOT NULL").groupBy("run_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("lines"), F.count("error_code").alias("errors"), F.coalesce(F.sum("attempted"), F.lit(0)).alias("attempted"))


def manifest_check(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id and code of each query of an evaluation manifest: version, unique id, known relevant items, ordered
    dates. ``corpus``: item_id."""
    times = queries.groupBy("query_id").agg(F.count("*").alias("times"))
    unknown = queries.select("query_id", F.explode("relevant").alias("item_id")).join(corpus.select("item_id"), "item_id", "left_anti").select("query_id").distinct().withColumn("unknown", F.lit(True))
    rows = queries.join(times, "query_id").join(unknown, "query_id", "left")
    rules = [
        ("schema_version", F.col("schema_version") != 1), ("duplicate_id", F.col("times") > 1), ("empty_query", F.trim("query") == ""), ("dates_not_ordered", F.col("date_from") > F.col("date_to")), ("unknown_relevant_item", F.col("unknown")),
        ("repeated_relevant_item", F.size(F.array_distinct("relevant")) < F.size("relevant")),
    ]
    return rows.select("query_id", first_reason(rules).alias("code")).distinct()


def write_report(report: DataFrame, path: str) -> None:
    """As JSON, never over an existing report."""
    report.write.mode("errorifexists").json(path)


def diagnostics(sources: DataFrame) -> DataFrame:
    """source_id, code, level, age of each of eight rules that a source's status breaks."""
    none = F.lit(None).cast("long")
    rules = [
        (F.col("last_complete_scan_at").isNull(), "complete_scan_missing", "warning", none),
        (F.col("scan_age") > STALE_SCAN, "complete_scan_stale", "warning", F.col("scan_age")),
        (F.col("oldest_backlog_age") > STALE_BACKLOG, "first_processing_backlog_stale", "warning", F.col("oldest_backlog_age")),
        (F.col("oldest_recheck_age") > STALE_RECHECK, "rechecks_overdue", "warning", F.col("oldest_recheck_age")),
        (F.col("unscheduled") > 0, "successful_rechecks_unscheduled", "warning", none),
        (F.col("cooldown") > 0, "source_cooldown_active", "info", F.col("cooldown")),
        (F.col("unfinished_runs") > 0, "unfinished_runs", "info", none),
        (F.col("budget_runs") >= 3, "recent_budget_truncation", "warning", none),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("code"), F.lit(v).alias("level"), a.cast("long").alias("age"))) for c, n, v, a in rules)))
    return sources.select("source_id", F.explode(found).alias("d")).select("source_id", "d.*")


def status_report(docs: DataFrame, runs: DataFrame, at: int) -> DataFrame:
    """One row a source: documents by state, backlog, rechecks, scans, runs and the codes of its diagnostics.
    ``budget_runs`` is null where no run has finished."""
    first, due = F.col("last_success_at").isNull(), F.col("next_due_at") <= at
    d = docs.groupBy("source_id").agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(first).alias("backlog"), F.max(F.when(first, at - F.col("discovered_at"))).alias("oldest_backlog_age"),
        F.count_if(~first & due).alias("rechecks_due"), F.max(F.when(~first & due, at - F.col("next_due_at"))).alias("oldest_recheck_age"), F.count_if(~first & F.col("next_due_at").isNull()).alias("unscheduled"),
    )
    good = F.when(F.col("failed") == 0, F.col("finished_at"))
    r = runs.groupBy("source_id").agg(
        F.max(good).alias("last_complete_scan_at"), F.count_if(F.col("finished_at").isNull()).alias("unfinished_runs"), F.greatest(F.max("not_before_at") - at, F.lit(0)).alias("cooldown"),
    )
    recent = last_rows(runs.where("finished_at IS NOT NULL"), "source_id", [F.desc("started_at"), F.desc("run_no")], 3, "recent")
    budget = recent.groupBy("source_id").agg(F.sum(F.col("over_budget").cast("int")).cast("int").alias("budget_runs"))
    rows = d.join(r.join(budget, "source_id", "left"), "source_id", "left").withColumn("scan_age", at - F.col("last_complete_scan_at"))
    codes = diagnostics(rows).groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    return rows.join(codes, "source_id", "left").withColumn("codes", F.coalesce("codes", F.lit("")))


def digest_violations(rows: DataFrame, digests: dict[str, Column]) -> DataFrame:
    """key and rule of stored digests (columns by name) that are not those of what they stand for."""
    wrong = F.array_compact(F.array(*(F.when(~F.col(name).eqNullSafe(now), F.lit(name)) for name, now in digests.items())))
    return rows.select("key", F.explode(wrong).alias("rule"))


def reference_audit(references: DataFrame, responses: DataFrame) -> DataFrame:
    """reference and code: the responses that a reference was first and last seen in must be list pages of its source,
    and in order."""
    side = lambda p: responses.select(F.col("id").alias(f"{p}_id"), F.col("source_id").alias(f"{p}_source"), F.col("page_type").alias(f"{p}_type"), F.col("fetched_at").alias(f"{p}_fetched"))
    rows = references.join(side("first"), "first_id", "left").join(side("last"), "last_id", "left")
    rules = [
        ("first_response_missing", F.col("first_type").isNull()), ("last_response_missing", F.col("last_type").isNull()), ("not_a_list_page", (F.col("first_type") != "list") | (F.col("last_type") != "list")),
        ("source_mismatch", (F.col("first_source") != F.col("source_id")) | (F.col("last_source") != F.col("source_id"))), ("time_mismatch", (F.col("first_fetched") != F.col("first_at")) | (F.col("last_fetched") != F.col("last_at"))),
        ("order", F.col("first_at") > F.col("last_at")), ("key_mismatch", F.col("candidate_key") != F.concat(F.lit("link:v1:"), F.sha2("resolved_url", 256))),
    ]
    return rows.select("reference", first_reason(rules).alias("code"))


def profile_validity(profiles: DataFrame) -> DataFrame:
    """profile_id and broken rules of profiles of array columns: interests, excludes, high_value, store_only, phrases."""
    lists = ("interests", "excludes", "high_value", "store_only", "phrases")
    repeats = {f"{c}_repeat": F.size(F.array_distinct(c)) < F.size(c) for c in lists}
    blank = F.exists("phrases", lambda p: ~p.rlike(r"[^\p{C}\s]"))
    rules = {
        "no_interest": (F.size("interests") == 0) & (F.size("phrases") == 0), "interest_excluded": F.arrays_overlap("interests", "excludes"), "high_value_not_interest": F.size(F.array_except("high_value", "interests")) > 0,
        "store_only_high_value": F.arrays_overlap("store_only", "high_value"), "store_only_excluded": F.arrays_overlap("store_only", "excludes"), "blank_phrase": blank, **repeats,
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return profiles.select("profile_id", F.explode(broken).alias("rule"))


def snapshot_time_rules(snapshots: DataFrame, facts: list[str]) -> DataFrame:
    """snapshot_id and rule: prepared not before the snapshot, and no recorded fact after it."""
    rules = [("prepared_before_snapshot", F.col("prepared_at") < F.col("snapshot_at")), *((f"{c}_after_snapshot", F.col(c) > F.col("snapshot_at")) for c in facts)]
    return snapshots.select("snapshot_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))).alias("rule"))


def payload_rules(messages: DataFrame) -> DataFrame:
    """mail_id and rule of frozen payloads: size, digest, line endings, ASCII, and the domain of a delivery's result."""
    text = F.decode("payload", "ISO-8859-1")
    rules = {
        "payload_too_large": F.octet_length("payload") > F.col("max_bytes"), "payload_digest": F.sha2("payload", 256) != F.col("payload_sha256"), "line_ending": text.rlike("(?<!\r)\n|\r(?!\n)"), "not_ascii": text.rlike("[^\\x00-\\x7f]"),
        "result_domain": F.col("outcome").isNotNull() & ~F.col("outcome").isin("accepted", "retryable", "uncertain", "permanent"), "empty_payload": F.octet_length("payload") == 0,
    }
    return messages.select("mail_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("rule"))


def snapshot_check(recorded: DataFrame, recomputed: DataFrame, channels: DataFrame, facts: list[str]) -> DataFrame:
    """source_id and code: facts recorded with a snapshot must be those computed again, and no channel may be sending."""
    now = recomputed.select("source_id", F.struct(*facts).alias("now"))
    open_ = channels.where("NOT paused").select("source_id").distinct().withColumn("open", F.lit(True))
    rows = recorded.select("source_id", F.struct(*facts).alias("then")).join(now, "source_id", "left").join(open_, "source_id", "left")
    code = F.when(~F.col("then").eqNullSafe(F.col("now")), "snapshot_binding_mismatch").when(F.col("open"), "snapshot_sending_not_paused").otherwise("ok")
    return rows.select("source_id", code.alias("code"))


def window_summary(samples: DataFrame, start: int, end: int, interval: int, slack: int) -> DataFrame:
    """Per source over [start, end]: samples, repeated and conflicting ones, net change, gaps and the longest of them.
    ``samples``: source_id, at, processed, documents."""
    inside = samples.where(F.col("at").between(start, end))
    one = inside.groupBy("source_id", "at").agg(F.count("*").alias("n"), F.count_distinct("processed", "documents").alias("kinds"), F.min(F.struct("processed", "documents")).alias("v"))
    out = one.groupBy("source_id").agg(
        F.count("*").alias("samples"), F.sum(F.col("n") - 1).alias("repeats"), F.count_if(F.col("kinds") > 1).alias("conflicts"), (F.max_by("v.processed", "at") - F.min_by("v.processed", "at")).alias("processed"),
        (F.max_by("v.documents", "at") - F.min_by("v.documents", "at")).alias("documents"),
    )
    missed = gaps(one, "source_id", "at", start, end, interval + slack).groupBy("source_id").agg(F.count("*").alias("gaps"), F.max("seconds").alias("longest_gap"))
    return out.join(missed, "source_id", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
