"""From versions to events: activation, kinds of events, re-evaluation, policy revisions, audits of frozen decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import canonical
from .responses import first_reason

RECENT_DAYS = 6


def _conditions(side: str) -> Column:
    """What counts as a notice's conditions, as canonical text: not the order or the place of constraints."""
    one = lambda c: F.struct(c["field"].alias("field"), c["operator"].alias("operator"), F.array_sort(c["values"]).alias("values"))
    cols = {c: F.col(f"{side}.{c}") for c in ("opens_at", "deadline_at", "deadline_lower_at", "cancelled")}
    return canonical(constraints=F.array_sort(F.transform(F.col(f"{side}.constraints"), one)), **cols)


def condition_change(current: DataFrame, previous: DataFrame) -> DataFrame:
    """document_id, comparison_known, conditions_changed: set comparison of constraints, null-safe of times."""
    both = current.alias("a").join(previous.alias("b"), F.col("a.document_id") == F.col("b.document_id"), "left")
    known = F.col("b.document_id").isNotNull()
    return both.select(F.col("a.document_id").alias("document_id"), known.alias("comparison_known"), (known & ~_conditions("a").eqNullSafe(_conditions("b"))).alias("conditions_changed"))


def review_flags(decided: DataFrame, facts: DataFrame, topics: DataFrame, interests: DataFrame, constraints: DataFrame, profiles: DataFrame, mode: str) -> DataFrame:
    """document_id, profile_id, needs_review, unknowns (unique codes) and rules (matched, in a fixed order) of every row
    of ``decided``, that of all other profiles of a document too."""
    key = ["document_id", "profile_id"]
    context = F.col("context")
    sure = context.isNull() | ~context.isin("incidental", "uncertain")
    named = lambda p: F.concat(F.lit(p), "topic")
    hits = topics.join(interests, "topic").select(
        *key, F.explode(F.array_compact(F.array(
            F.when(sure & F.col("interest"), F.struct(F.lit(1).alias("o"), named("interest.topic.").alias("r"))),
            F.when(F.col("is_primary") & F.col("excluded"), F.struct(F.lit(2).alias("o"), named("exclusion.topic.").alias("r"))),
            F.when(sure & F.col("store_only"), F.struct(F.lit(3).alias("o"), named("retention.topic.").alias("r"))),
        ))).alias("x"),
    )
    known = profiles.select(F.col("profile_id").alias("who"), F.col("field").alias("of"), "actual")
    asked = decided.select(*key).join(constraints, "document_id").join(known, (F.col("profile_id") == F.col("who")) & (F.col("field") == F.col("of")), "left")
    asked = asked.select(*key, F.struct(F.lit(4).alias("o"), F.concat_ws(".", F.lit("qualification"), "field", _result()).alias("r")).alias("x"))
    rules = hits.unionByName(asked).groupBy(*key).agg(F.transform(F.array_sort(F.collect_set("x")), lambda x: x["r"]).alias("rules")).withColumnsRenamed({"document_id": "d", "profile_id": "p"})
    own = facts.select("document_id", "kind", "previous_route", "comparison_known", "information_incomplete", "audience_declared", "eligibility_complete")
    rows = decided.join(own, "document_id").join(rules, (F.col("document_id") == F.col("d")) & F.col("profile_id").eqNullSafe(F.col("p")), "left")
    unknown = F.array_distinct(F.array_compact(F.array(
        F.when((F.col("kind") == "update") & (F.col("previous_route") != "none") & ~F.col("comparison_known"), "comparison_unknown"),
        F.when(F.col("relevance") == "unknown", "topic_relation_unknown"), F.when(F.col("eligibility") == "unknown", "eligibility_unknown"),
        F.when(~F.col("audience_declared"), "audience_unknown"), F.when(F.col("time_status") == "unknown", "time_unknown"), F.when(F.col("information_incomplete"), "information_incomplete"),
    )))
    recent = F.col("kind") == "activation_recent"
    code = (
        F.when(F.col("route") == "none", "no_mail_action")
        .when(F.col("action") == "DIGEST", "digest_action")
        .when(F.lit(mode == "digest_only"), "digest_only_mode")
        .when(recent, F.when(F.col("route") == "immediate", "activation_urgency_exception").otherwise("activation_recent_digest"))
        .otherwise("hybrid_immediate")
    )
    every = F.concat(F.coalesce("rules", F.array().cast("array<string>")), F.array(F.concat(F.lit("decision."), "reason"), F.concat(F.lit("route."), code)))
    return rows.select(*key, (F.size(unknown) > 0).alias("needs_review"), unknown.alias("unknowns"), every.alias("rules"))


def _result() -> Column:
    unclear = (F.col("operator") == "unsupported") | (F.size("values") == 0) | F.col("actual").isNull()
    return F.when(unclear, "unknown").when(F.array_contains("values", F.col("actual")), "match").otherwise("mismatch")


def constraint_results(constraints: DataFrame, profiles: DataFrame) -> DataFrame:
    """document_id, field, result and profiles of every constraint: match, mismatch or unknown, one row for each profile
    that answers its field, and one (profile_id null) for all ``profiles`` that do not."""
    n = profiles.select("profile_id").distinct().count()
    known = profiles.where("actual IS NOT NULL")
    own = constraints.join(known, "field").select("document_id", "profile_id", "field", _result().alias("result"), F.lit(1).cast("long").alias("profiles"))
    rest = constraints.join(known.groupBy("field").agg(F.count("*").alias("some")), "field", "left").withColumn("profiles", n - F.coalesce("some", F.lit(0))).where("profiles > 0")
    return own.unionByName(rest.select("document_id", F.lit(None).cast("string").alias("profile_id"), "field", F.lit("unknown").alias("result"), "profiles"))


def each_result(constraints: DataFrame, profiles: DataFrame) -> DataFrame:
    """document_id, profile_id, field and result of every constraint for every profile, one row each."""
    rows = constraint_results(constraints, profiles)
    known = profiles.where("actual IS NOT NULL").select("profile_id", "field")
    others = rows.where("profile_id IS NULL").drop("profile_id").crossJoin(F.broadcast(profiles.select("profile_id").distinct())).join(known, ["profile_id", "field"], "left_anti")
    return rows.where("profile_id IS NOT NULL").unionByName(others).drop("profiles")


def activation_inputs(docs: DataFrame, listings: DataFrame, versions: DataFrame) -> DataFrame:
    """Every document with its listing evidence and its current version, whichever there is."""
    v = versions.select("document_id", F.col("version_id").alias("current_version_id"), F.col("published_date").alias("notice_date"), "parser_version")
    rows = docs.select("document_id", "source_id", "current_version_id").join(listings, "document_id", "left").join(v, ["document_id", "current_version_id"], "left")
    return rows.select("document_id", "source_id", "list_date", "registered_at", "notice_date", "parser_version")


def activation_candidates(members: DataFrame, today: Column) -> DataFrame:
    """document_id, state, selection (the date that selected it) and date_conflict. Selected and generated members stay
    so, and a conflict of dates once seen is kept."""
    listed, noticed = F.col("list_date"), F.col("notice_date")
    recent = lambda d: F.coalesce(d.between(F.date_sub(today, RECENT_DAYS), today), F.lit(False))
    future = lambda d: F.coalesce(d > today, F.lit(False))
    state = (
        F.when(F.col("old_state").isin("generated", "selected"), F.col("old_state"))
        .when(~F.col("initial_recent_review"), "disabled")
        .when(recent(listed) | recent(noticed), "selected")
        .when((listed.isNull() & noticed.isNull()) | future(listed) | future(noticed), "unknown")
        .otherwise("not_recent")
    )
    rows = members.withColumn("state", state)
    first = F.when(recent(listed), listed).when(recent(noticed), noticed)
    rows = rows.withColumn("selection", F.coalesce("old_selection", F.when(F.col("state") == "selected", first)))
    dates = F.array_distinct(F.array_compact(F.array("selection", "list_date", "notice_date")))
    return rows.select("document_id", "source_id", "state", "selection", (F.col("old_conflict") | (F.size(dates) > 1)).alias("date_conflict"))


def candidate_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("source_id", "state").agg(F.count("*").alias("n"))


def event_kinds(changes: DataFrame, candidates: DataFrame, discovered: DataFrame, activation_at: int) -> DataFrame:
    """document_id, version_id, kind of the event that an observation makes (null: none) and why it stays silent."""
    rows = changes.join(candidates.select("document_id", "state"), "document_id", "left").join(discovered, "document_id", "left")
    first = F.col("change") == "first"
    live = (F.col("origin") == "regular") & (F.col("live_at") >= activation_at)
    kind = F.when(first & (F.col("state") == "selected"), "activation_recent").when(first & F.col("state").isNull() & F.coalesce(live, F.lit(False)), "new").when(F.col("change") == "changed", "update")
    quiet = F.when(first, "historical_baseline").when((F.col("change") == "same") & F.col("other_parser"), "parser_changed_same_raw").when(F.col("change") == "unknown", "comparison_unknown").otherwise("unchanged")
    return rows.select("document_id", "version_id", kind.alias("kind"), F.when(kind.isNull(), quiet).alias("silent_reason"))


def scan_ready(sources: DataFrame, runs: DataFrame, at: int) -> DataFrame:
    """source_id and ready: the last complete scan of a source must be a run of it that says the same."""
    own = runs.select(F.col("run_id").alias("last_complete_scan_run_id"), F.col("source_id").alias("run_source"), "coverage", "coverage_at", "origin")
    rows = sources.join(own, "last_complete_scan_run_id", "left")
    good = (F.col("run_source") == F.col("source_id")) & (F.col("coverage") == "complete") & (F.col("coverage_at") == F.col("last_complete_scan_at")) & (F.col("coverage_at") <= at) & (F.col("origin") != "historical")
    return rows.select("source_id", F.coalesce(good, F.lit(False)).alias("ready"))


def policy_diff(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """source_id, both digests of the canonical manifests (profile_id, topics), and whether they differ."""
    sha = lambda rows: rows.groupBy("source_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("profile_id", "rule")))), 256).alias("sha"))
    both = sha(current).withColumnRenamed("sha", "current_sha256").join(sha(proposed).withColumnRenamed("sha", "policy_sha256"), "source_id", "full")
    return both.select("source_id", "current_sha256", "policy_sha256", (~F.col("current_sha256").eqNullSafe(F.col("policy_sha256"))).alias("changed"))


def policy_registry(operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a policy digest: first operation and number of them; each channel's digest after its last operation).
    An operation that occurs again does nothing."""
    once = operations.groupBy("operation_id").agg(F.min_by(F.struct("channel", "policy_sha256", "at"), F.struct("at", "seq")).alias("o")).select("operation_id", "o.*")
    rows = once.groupBy("policy_sha256").agg(F.min_by("operation_id", F.struct("at", "operation_id")).alias("first_operation"), F.count("*").alias("operations"))
    pointer = once.groupBy("channel").agg(F.max_by("policy_sha256", F.struct("at", "operation_id")).alias("policy_sha256"))
    return rows, pointer


def reevaluation(events: DataFrame, observations: DataFrame, facts: DataFrame, at: int, today: Column) -> DataFrame:
    """event_id and status of each event of a re-evaluation: not current, locked, no candidate, or what becomes of it."""
    rows = events.join(observations, "document_id", "left").join(facts, "document_id", "left")
    recent = F.col("published_date").between(F.date_sub(today, RECENT_DAYS), today)
    open_ = (F.col("category") == "opportunity") & (F.col("deadline_at") >= at) & (F.col("opening_confirmed") | F.col("opens_at").isNotNull()) & (F.col("opens_at").isNull() | (F.col("opens_at") <= at))
    rules = [
        ("event_not_current", F.col("observed_version").isNull() | (F.col("observed_version") != F.col("version_id")) | (F.col("observed_seq") != F.col("event_seq"))),
        ("route_locked", (F.col("route") != "none") | F.col("allocated")),
        ("not_candidate", ~F.coalesce(recent, F.lit(False)) & ~F.coalesce(open_, F.lit(False))),
        ("time_invalid", F.greatest("occurred_at", "observed_at") > at),
        ("stale_context", F.col("context_sha") != F.col("channel_sha")),
        ("stale_input", F.col("input_sha") != F.col("frozen_sha")),
    ]
    return rows.select("event_id", first_reason(rules, "applied").alias("status"))


def decision_audit(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Frozen decisions that recomputation does not give again, with the parts (decision, facts, policy) that differ."""
    key = ["document_id", "profile_id"]
    parts = ("decision_sha256", "facts_sha256", "policy_sha256")
    both = stored.join(recomputed.select(*key, *(F.col(p).alias(f"now_{p}") for p in parts)), key, "left")
    differs = F.array_compact(F.array(*(F.when(~F.col(p).eqNullSafe(F.col(f"now_{p}")), p.removesuffix("_sha256")) for p in parts)))
    return both.withColumn("differs", differs).where(F.size("differs") > 0).select(*key, F.array_join("differs", ",").alias("differs"))


def operation_progress(items: DataFrame, results: DataFrame) -> DataFrame:
    """Per operation its items, what is done and pending, the next item in order, and whether it is finished."""
    done = results.select("operation_id", "event_id").distinct().withColumn("done", F.lit(1))
    rows = items.join(done, ["operation_id", "event_id"], "left")
    out = rows.groupBy("operation_id").agg(F.count("*").alias("items"), F.count("done").alias("done"), F.min_by("event_id", F.when(F.col("done").isNull(), F.col("position"))).alias("next_event"))
    return out.select("*", (F.col("items") - F.col("done")).alias("pending"), (F.col("items") == F.col("done")).alias("finished"))


def member_evidence(members: DataFrame, events: DataFrame, docs: DataFrame, versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """event_id and code of each message member: its snapshot must agree with event, document, version and decision."""
    e = events.select("event_id", F.col("document_id").alias("e_document"), F.col("route").alias("e_route"), F.lit(1).alias("e"))
    d = docs.select(F.col("document_id").alias("e_document"), F.col("source_id").alias("d_source"), F.col("current_version_id").alias("d_version"))
    v = versions.select(F.col("version_id").alias("d_version"), F.col("content_sha").alias("v_content"))
    j = decisions.select("event_id", F.col("decision_id").alias("j_decision"))
    rows = members.join(e, "event_id", "left").join(d, "e_document", "left").join(v, "d_version", "left").join(j, "event_id", "left")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    rules = [
        ("event_missing", F.col("e").isNull()), ("document_mismatch", ~same("document_id", "e_document")), ("source_mismatch", ~same("source_id", "d_source")), ("version_mismatch", ~same("version_id", "d_version")),
        ("content_mismatch", ~same("content_sha", "v_content")), ("decision_mismatch", ~same("decision_id", "j_decision")), ("route_mismatch", F.col("e_route") == "none"),
    ]
    return rows.select("event_id", first_reason(rules).alias("code"))


def foreground(entries: DataFrame, pages: int = 2) -> DataFrame:
    """run_id, document_id: what stood on the first pages of a run."""
    return entries.where(F.col("page") <= pages).select("run_id", "document_id").distinct()


def document_state(attempts: DataFrame) -> DataFrame:
    """Each document after its attempts: status, last attempt, success and error, next due. A failure never takes back a
    success; the error is that of the last attempt."""
    order = F.struct("at", "attempt_no")
    good = F.col("error_code").isNull()
    out = attempts.groupBy("document_id").agg(F.max(F.struct("at", "attempt_no", "error_code", "next_due_at")).alias("l"), F.max(F.when(good, F.col("at"))).alias("last_success_at"), F.max_by("version_id", F.when(good, order)).alias("current_version_id"))
    return out.select(
        "document_id", F.when(F.col("l.error_code").isNull(), "processed").otherwise("failed").alias("status"), F.col("l.at").alias("last_attempt_at"), "last_success_at", "current_version_id",
        F.col("l.error_code").alias("last_error_code"), F.col("l.next_due_at").alias("next_due_at"),
    )


def coverage_members(listed: DataFrame, documents: DataFrame, references: DataFrame) -> DataFrame:
    """Keys of a run's pages that neither table holds. ``listed``: run_id, kind (entry, reference), key."""
    held = documents.select(F.lit("entry").alias("kind"), "key").unionByName(references.select(F.lit("reference").alias("kind"), "key"))
    return listed.join(held.distinct(), ["kind", "key"], "left_anti").select("run_id", "kind", "key")


def page_key_equality(page: DataFrame, table: DataFrame) -> DataFrame:
    """Per page how many keys only it has, and how many only the table has; equal if none. Both: page, key."""
    a, b = page.select("page", "key").distinct().withColumn("a", F.lit(1)), table.select("page", "key").distinct().withColumn("b", F.lit(1))
    both = a.join(b, ["page", "key"], "full").groupBy("page").agg(F.count_if(F.col("b").isNull()).alias("only_page"), F.count_if(F.col("a").isNull()).alias("only_table"))
    return both.select("*", ((F.col("only_page") == 0) & (F.col("only_table") == 0)).alias("equal"))


def constraint_conflicts(constraints: DataFrame) -> DataFrame:
    """document_id, field of fields whose constraints leave no common value."""
    sets = constraints.where("operator = 'in'").groupBy("document_id", "field").agg(F.collect_list("values").alias("sets"))
    common = F.aggregate("sets", F.get("sets", F.lit(0)), lambda s, x: F.array_intersect(s, x))
    return sets.where((F.size("sets") > 1) & (F.size(common) == 0)).select("document_id", "field", F.size("sets").cast("long").alias("constraints"))


def latest_observation(versions: DataFrame) -> DataFrame:
    """document_id with the version, time and event number of its last observation."""
    w = W.partitionBy("document_id").orderBy("observed_at", "version_id")
    rows = versions.withColumn("observed_seq", F.row_number().over(w))
    last = rows.groupBy("document_id").agg(F.max_by(F.struct(F.col("version_id").alias("observed_version"), "observed_at", "observed_seq"), "observed_seq").alias("l"))
    return last.select("document_id", "l.*")
