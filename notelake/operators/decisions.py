"""Decisions on notices for many profiles at once: eligibility, time, action and route.

``facts`` has one row per document; times are seconds. Documents meet only profiles that have something to do with them:
those that answer a field of their constraints, or care for one of their topics or a phrase. All others are decided alike,
so they are one row a document, without a profile_id, that says in ``profiles`` for how many it stands. A pair's decision
is its own row or, if it has none, its document's; no step compares all documents with all profiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_date
from ..sources.tables import stored

URGENT = 72 * 3600
FRESH_DAYS = 6


def _hard() -> Column:
    """Constraints that no profile can answer."""
    return (F.col("operator") == "unsupported") | (F.size("values") == 0)


def _answered(constraints: DataFrame, profiles: DataFrame) -> DataFrame:
    """document_id, profile_id, answered (constraints the profile answers) and mismatch, of profiles that answer any."""
    known = profiles.where("actual IS NOT NULL").groupBy("profile_id", "field").agg(F.max("actual").alias("actual"))
    both = constraints.where(~_hard()).join(known, "field")
    return both.groupBy("document_id", "profile_id").agg(F.count("*").alias("answered"), F.max(~F.array_contains("values", F.col("actual"))).alias("mismatch"))


def _with_the_rest(facts: DataFrame, constraints: DataFrame, pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``facts`` once for each of ``pairs`` (document_id, profile_id, ...), and once for all other profiles if there are
    any: profile_id null, profiles their number."""
    n = profiles.select("profile_id").distinct().count()
    asked = constraints.groupBy("document_id").agg(F.count("*").alias("asked"))
    rows = facts.join(asked, "document_id", "left")
    own = rows.join(pairs, "document_id").withColumn("profiles", F.lit(1).cast("long"))
    named = pairs.groupBy("document_id").agg(F.count("*").alias("named"))
    rest = rows.join(named, "document_id", "left").withColumn("profiles", n - F.coalesce("named", F.lit(0))).where("profiles > 0").drop("named")
    return own.unionByName(rest, allowMissingColumns=True)


def _eligibility() -> Column:
    unclear = F.coalesce(F.col("asked") > F.coalesce("answered", F.lit(0)), F.lit(False))
    open_question = ~F.col("audience_declared") | ~F.col("eligibility_complete") | F.col("information_incomplete") | unclear
    return (
        F.when((F.col("category") != "opportunity") & F.col("asked").isNull(), "not_required")
        .when(F.coalesce("mismatch", F.lit(False)), "ineligible")
        .when(open_question, "unknown")
        .otherwise("eligible")
    )


def eligibility(facts: DataFrame, constraints: DataFrame, profiles: DataFrame) -> DataFrame:
    """``facts`` with profile_id, profiles and eligibility. ``constraints``: document_id, field, operator, values;
    ``profiles``: profile_id, field, actual. A constraint that is unsupported, empty or not answered by the profile (no
    row, or a null) is unknown; one mismatch decides."""
    rows = _with_the_rest(facts, constraints, _answered(constraints, profiles), profiles)
    return rows.withColumn("eligibility", _eligibility()).drop("mismatch", "answered", "asked")


def each_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """``rows`` of decisions or eligibility with one row for each document and profile: a row for all other profiles is
    said again for each of them. Its size is documents times profiles, so what can do with ``profiles`` should."""
    rows = stored(rows, "spread")
    own, rest = rows.where("profile_id IS NOT NULL"), rows.where("profile_id IS NULL").drop("profile_id")
    others = rest.crossJoin(F.broadcast(profiles.select("profile_id").distinct())).join(own.select("document_id", "profile_id"), ["document_id", "profile_id"], "left_anti")
    return own.unionByName(others).drop("profiles")


def time_status(at: int) -> Column:
    deadline, opens = F.col("deadline_at"), F.col("opens_at")
    return (
        F.when(F.col("category") != "opportunity", "not_required")
        .when(F.col("cancelled") | (at > deadline), "closed")
        .when(at < opens, "not_started")
        .when(deadline.isNotNull() & (F.col("opening_confirmed") | opens.isNotNull()), "open")
        .otherwise("unknown")
    )


def urgent_at(at: int) -> Column:
    """The earliest time at which a notice may close; never before ``at`` while only a lower bound is known."""
    lower = F.col("deadline_lower_at")
    return F.when(lower.isNotNull(), F.greatest(lower, F.lit(at))).otherwise(F.col("deadline_at"))


def is_urgent(at: int) -> Column:
    return F.coalesce((time_status(at) == "open") & (urgent_at(at) - at).between(0, URGENT), F.lit(False))


FLAGS = ("matched", "offered", "stored", "doubtful", "valued", "vetoed")


def interest_flags(matches: DataFrame, interests: DataFrame, hits: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """What a document's topics and phrases mean to each profile that has a say on one of them. ``hits``: document_id,
    phrase; ``phrases``: profile_id, phrase that the profile includes: a literal hit is an interest that is offered."""
    context = F.col("context")
    sure = context.isNull() | ~context.isin("incidental", "uncertain")
    offered = context.isNull() | (context == "opportunity")
    active = F.col("interest") & ~F.col("store_only")
    flags = {
        "matched": sure & active,
        "offered": offered & active,
        "stored": sure & F.col("store_only"),
        "doubtful": (context == "uncertain") & F.col("interest"),
        "valued": offered & active & F.col("high_value"),
        "vetoed": F.col("is_primary") & F.col("excluded"),
    }
    key = ["document_id", "profile_id"]
    rows = matches.join(interests, "topic").select(*key, *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))
    if hits is not None:
        said = hits.join(phrases, "phrase").select(*key)
        rows = rows.unionByName(said.select(*key, *(F.lit(n in ("matched", "offered")).alias(n) for n in FLAGS)))
    return rows.groupBy(*key).agg(*(F.max(n).alias(n) for n in FLAGS))


def decide_batch(facts: DataFrame, constraints: DataFrame, profiles: DataFrame, flags: DataFrame, at: int, mode: str, next_digest: int) -> DataFrame:
    """Action, reason and route of every document for every profile: rows of pairs that have to do with each other, and a
    row a document for all other profiles (profile_id null, profiles their number)."""
    names = FLAGS
    pairs = _answered(constraints, profiles).join(flags, ["document_id", "profile_id"], "full")
    rows = _with_the_rest(facts, constraints, pairs, profiles).withColumn("eligibility", _eligibility()).na.fill(False, list(names))
    matched, offered, stored, doubtful, valued, vetoed = map(F.col, names)
    kind, able = F.col("kind"), F.col("eligibility")
    rows = rows.withColumn("time_status", time_status(at)).withColumn("urgent", is_urgent(at) & offered)
    rows = rows.withColumn("relevance", F.when(~matched & ~stored & (doubtful | F.col("information_incomplete")), "unknown").when(matched | stored, "matched").otherwise("unmatched"))
    followed = (kind == "update") & (F.col("previous_route") != "none")
    age = F.datediff(local_date(F.lit(at)), "published_date")
    future = age < 0
    soon = F.col("urgent") & (kind != "update")
    fresh = (kind == "new") & (F.col("category") == "opportunity") & age.between(0, FRESH_DAYS) & valued
    kept = (F.col("relevance") == "matched") & ((F.col("time_status") == "closed") | (F.col("category") == "reference"))
    step = lambda action, code: F.struct(F.lit(action) if isinstance(action, str) else action, F.lit(code) if isinstance(code, str) else code)
    push_if = lambda c: F.when(c, "PUSH_NOW").otherwise("DIGEST")
    ladder = [
        (vetoed, step("IGNORE", "excluded_topic")),
        (kind == "historical", step(F.when(kept, "STORE_ONLY").otherwise("IGNORE"), "historical_context")),
        ((F.col("relevance") == "unknown") & ~(followed & doubtful), step("STORE_ONLY", F.when(doubtful, "topic_relation_unknown").otherwise("media_interest_unknown"))),
        ((F.col("relevance") == "unmatched") & ~followed, step("IGNORE", "no_interest_match")),
        ((F.col("category") == "reference") & ~followed, step("STORE_ONLY", "reference_only")),
        (stored & ~matched & ~followed, step("STORE_ONLY", "store_only_topic")),
        (followed & ~F.col("comparison_known"), step("DIGEST", "update_comparison_unknown")),
        (followed & F.col("conditions_changed"), step(push_if(F.col("urgent") & (able != "ineligible") & ~future), "conditions_changed")),
        (able == "ineligible", step("IGNORE", "audience_mismatch")),
        (F.col("time_status") == "closed", step(F.when(kind == "activation_recent", "STORE_ONLY").otherwise("IGNORE"), "deadline_passed")),
        (future, step("DIGEST", "future_publication")),
        (F.col("time_status") == "not_started", step("DIGEST", "not_started")),
        (soon | fresh, step("PUSH_NOW", F.when(F.col("urgent"), "deadline_soon").otherwise("high_value_topic"))),
    ]
    decision = F.coalesce(*(F.when(when, then) for when, then in ladder), step("DIGEST", F.when(kind == "update", "relevant_update").otherwise("relevant_digest")))
    rows = rows.withColumn("d", decision).withColumn("action", F.col("d.col1")).withColumn("reason", F.col("d.col2"))
    return rows.select("document_id", "profile_id", "profiles", "eligibility", "time_status", "relevance", "action", "reason", route(at, mode, next_digest).alias("route"))


def route(at: int, mode: str, next_digest: int) -> Column:
    """Where an action goes: of recent notices at activation only what may close before the next digest goes at once."""
    closes = (F.col("time_status") == "open") & urgent_at(at).between(at, next_digest)
    return (
        F.when(F.col("action").isin("IGNORE", "STORE_ONLY"), "none")
        .when((F.col("action") == "DIGEST") | F.lit(mode == "digest_only"), "digest")
        .when((F.col("kind") == "activation_recent") & ~F.coalesce(closes, F.lit(False)), "digest")
        .otherwise("immediate")
    )
