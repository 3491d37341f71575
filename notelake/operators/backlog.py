"""Queues of documents: what is due, in which order, and how far behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import local_date

DAY = 86400


def pending(docs: DataFrame, at: int) -> DataFrame:
    """Documents to process at ``at``: not held back, and never processed or given a time."""
    return docs.where((F.col("next_due_at").isNull() | (F.col("next_due_at") <= at)) & ((F.col("status") != "processed") | F.col("next_due_at").isNotNull()))


def doc_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source_id", "status", F.col("last_success_at").isNotNull().alias("has_success")).agg(F.count("*").alias("n"))


def first_backlog(docs: DataFrame, at: int) -> DataFrame:
    """Per source, documents never processed: total, due, deferred, failed, and the oldest."""
    waiting = docs.where("last_success_at IS NULL")
    due = F.col("next_due_at").isNull() | (F.col("next_due_at") <= at)
    oldest = F.min(F.struct("discovered_at", "document_id", "last_error_code"))
    out = waiting.groupBy("source_id").agg(
        F.count("*").alias("total"), F.count_if(due).alias("due"), F.count_if(~due).alias("deferred"), F.count_if(F.col("status") == "failed").alias("failed"), oldest.alias("o")
    )
    return out.select("source_id", "total", "due", "deferred", "failed", F.col("o.document_id").alias("oldest_id"), F.greatest(F.lit(at) - F.col("o.discovered_at"), F.lit(0)).alias("oldest_age"), F.col("o.last_error_code").alias("oldest_error"))


def recheck_backlog(docs: DataFrame, at: int) -> DataFrame:
    """Per source, documents processed before: due again, deferred, failed, without a time, and the oldest overdue."""
    due = F.col("next_due_at") <= at
    out = docs.where("last_success_at IS NOT NULL").groupBy("source_id").agg(
        F.count("*").alias("successful"),
        F.count_if(due).alias("due"),
        F.count_if(F.col("next_due_at") > at).alias("deferred"),
        F.count_if(due & (F.col("status") == "failed")).alias("failed_due"),
        F.count_if(F.col("next_due_at").isNull()).alias("no_deadline"),
        F.count_if(F.col("next_due_at").isNull() & (F.col("status") == "processed")).alias("unscheduled"),
        F.min(F.when(due, F.col("next_due_at"))).alias("oldest"),
    )
    return out.withColumn("oldest_overdue", F.lit(at) - F.col("oldest")).drop("oldest")


def group_of(foreground: Column) -> Column:
    return F.when(F.col("last_success_at").isNotNull(), "recheck").when(foreground, "foreground").otherwise("history")


_GROUPS = ("foreground", "history", "recheck")


def due_rank(docs: DataFrame, at: int, foreground: Column) -> DataFrame:
    """Due documents with their group and rank in it: by due time (never given one: discovery), then id."""
    order = W.partitionBy("source_id", "grp").orderBy(F.coalesce("next_due_at", "discovered_at"), "document_id")
    return pending(docs, at).withColumn("grp", group_of(foreground)).select("source_id", "document_id", "grp", F.row_number().over(order).alias("rank"))


def slot_selection(ranked: DataFrame, quotas: dict[str, int], most: int) -> DataFrame:
    """The ``most`` documents a source's run takes, in order. Each group has its quota first, in rotation; what a group
    leaves is lent to the groups in order; the groups then alternate. Window ranks are cut at ``most`` before any sort
    over a whole source, so a large queue is never sorted as one."""
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col("grp")]
    own = ranked.where(F.col("rank") <= most).withColumn("g", F.array_position(F.array(*map(F.lit, _GROUPS)), F.col("grp")))
    reserved = F.col("rank") <= quota
    first = W.partitionBy("source_id").orderBy(
        F.when(reserved, 0).otherwise(1), F.when(reserved, F.col("rank")).otherwise(F.col("g")), F.when(reserved, F.col("g")).otherwise(F.col("rank"))
    )
    taken = own.withColumn("i", F.row_number().over(first)).where(F.col("i") <= most)
    taken = taken.withColumn("r", F.row_number().over(W.partitionBy("source_id", "grp").orderBy("rank")))
    return taken.select("source_id", "document_id", "grp", F.row_number().over(W.partitionBy("source_id").orderBy("r", "g")).alias("position"))


def success_due(docs: DataFrame, recent: int = 6 * 3600, middle: int = DAY, old: int = 7 * DAY) -> DataFrame:
    """Next check after a success, by the notice's age in local days."""
    age = F.datediff(local_date(F.col("last_success_at")), "published_date")
    wait = F.when(age <= 7, recent).when(age <= 30, middle).otherwise(old)
    return docs.where("last_success_at IS NOT NULL").select("document_id", (F.col("last_success_at") + wait).alias("due"), (age < 0).alias("future"))


def recheck_policy(docs: DataFrame, at: int, **waits: int) -> DataFrame:
    """Times that change under a new policy: never later than the stored one; without one, now."""
    proposed = success_due(docs.where("status = 'processed'"), **waits)
    both = docs.join(proposed, "document_id")
    due = F.when(F.col("next_due_at").isNull(), F.lit(at)).otherwise(F.least("next_due_at", "due"))
    return both.where(~due.eqNullSafe(F.col("next_due_at"))).select("document_id", F.col("next_due_at").alias("old_due"), due.cast("long").alias("new_due"))


#: Codes of failures that last as long as the page or the site stays as it is.
ACCESS = ("tls_error", "http_unauthorized", "http_forbidden")
UNREADABLE = (
    "identity_mismatch", "invalid_target", "unsupported_content_type", "unsupported_content_encoding", "empty_body", "body_too_large", "invalid_response_headers", "redirect_invalid", "redirect_loop", "redirect_limit",
)


def failure_due(failures: DataFrame, waits: dict[str, int]) -> DataFrame:
    """Next try after a failure, by the class of its status and error code: missing, access, parse or transient."""
    code, status = F.col("last_error_code"), F.coalesce("status_code", F.lit(0))
    kind = (
        F.when(status.isin(404, 410) | (code == "http_not_found"), "missing")
        .when(status.isin(401, 403) | code.isin(*ACCESS), "access")
        .when(code.startswith("parse_") | code.isin(*UNREADABLE), "parse")
        .otherwise("transient")
    )
    wait = F.create_map(*(F.lit(x) for kv in waits.items() for x in kv))
    return failures.where("last_error_code IS NOT NULL").withColumn("kind", kind).select("document_id", "kind", (F.col("last_attempt_at") + wait[F.col("kind")]).alias("due"))


def run_groups(items: DataFrame, at: int) -> DataFrame:
    """Per run and group what was allocated, attempted, succeeded, failed, left unserved and still due, and how long the
    oldest item is overdue. ``items``: run_id, grp, attempted, failed, due_at."""
    tried = F.col("attempted")
    return items.groupBy("run_id", "grp").agg(
        F.count("*").alias("allocated"), F.count_if(tried).alias("attempted"), F.count_if(tried & ~F.col("failed")).alias("succeeded"), F.count_if(tried & F.col("failed")).alias("failed"), F.count_if(~tried).alias("unserved"),
        F.count_if((~tried | F.col("failed")) & (F.col("due_at") <= at)).alias("remaining_due"), F.greatest(F.max(at - F.col("due_at")), F.lit(0)).alias("oldest_overdue"),
    )


def oldest_backlog(docs: DataFrame, at: int, n: int = 1) -> DataFrame:
    return pending(docs, at).orderBy(F.coalesce("next_due_at", "discovered_at"), "document_id").limit(n).select("document_id", F.coalesce("next_due_at", "discovered_at").alias("since"))
