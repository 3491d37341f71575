"""Digest texts, plans and delivery passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import digest, visible
from .responses import first_reason

LABELS = {
    "published": "Published: ", "event": "Event: ", "decision": "Decision: ", "review": "[to be checked] Some of this is not confirmed yet.", "reasons": "Reasons:", "no_reason": "- none given; see the notice", "more": "- and more: ",
    "unknowns": "Not confirmed:", "excerpt": "Excerpt:", "no_text": "No text; see the notice.", "cut": "[cut]", "regular": "=== Regular ===", "checked": "=== To be checked ===",
}
TITLE, SUMMARY, LINE, LISTED = 180, 400, 280, 8


def _listed(heading: str, lines: Column, none: str | None, labels: dict[str, str]) -> Column:
    """A heading and at most LISTED lines, then how many are left out."""
    shown = F.transform(F.slice(lines, 1, LISTED), lambda x: F.concat(F.lit("- "), visible(x, LINE)))
    rest = F.when(F.size(lines) > LISTED, F.concat(F.lit(labels["more"]), (F.size(lines) - LISTED).cast("string")))
    full = F.concat(F.array(F.lit(labels[heading])), shown, F.array_compact(F.array(rest)))
    empty = F.array(F.lit(labels[heading]), F.lit(none)) if none else F.array().cast("array<string>")
    return F.when(F.size(lines) == 0, empty).otherwise(full)


def digest_items(items: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    """event_id and text of each item: title, date, kind, decision, reasons, open questions and an excerpt, each of
    bounded length, with marks where something is left out."""
    flat = F.trim(F.regexp_replace(F.coalesce("body_text", F.lit("")), r"[\p{C}\s]+", " "))
    excerpt = F.array(F.lit(labels["excerpt"]), F.when(flat == "", labels["no_text"]).otherwise(visible(flat, SUMMARY)))
    head = F.array(
        visible(F.col("title"), TITLE), F.concat(F.lit(labels["published"]), F.date_format("published_date", "yyyy-MM-dd")), F.concat(F.lit(labels["event"]), "kind"), F.concat(F.lit(labels["decision"]), "action"),
    )
    lines = F.concat(
        head, F.array_compact(F.array(F.when(F.col("needs_review"), labels["review"]))), _listed("reasons", F.col("reasons"), labels["no_reason"], labels), _listed("unknowns", F.col("unknowns"), None, labels),
        excerpt, F.array_compact(F.array(F.when(F.length(flat) > SUMMARY, labels["cut"]))),
    )
    return items.select("event_id", "needs_review", F.array_join(lines, "\n").alias("text"))


def digest_documents(parts: DataFrame, texts: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    """installation, slot, part, items and body of each digest: regular items, then those to be checked, each numbered
    from 1. A part holds a bounded number of items."""
    rows = parts.where("part IS NOT NULL").join(texts, "event_id")
    whole = rows.groupBy("installation", "slot", "part").agg(F.array_sort(F.collect_list(F.struct("needs_review", "position", "text"))).alias("items"))

    def section(flag: bool, heading: str) -> Column:
        own = F.filter("items", lambda x: x["needs_review"] == flag)
        numbered = F.transform(own, lambda x, i: F.concat((i + 1).cast("string"), F.lit(".\n"), x["text"]))
        return F.when(F.size(own) > 0, F.concat(F.lit(labels[heading] + "\n"), F.array_join(numbered, "\n")))

    body = F.concat_ws("\n\n", section(False, "regular"), section(True, "checked"))
    return whole.select("installation", "slot", "part", F.size("items").cast("long").alias("items"), F.concat(body, F.lit("\n")).alias("body"))


def plan_capacity(immediate: DataFrame, parts: DataFrame, most: int) -> DataFrame:
    """Per installation how many of ``most`` messages are immediate and how many digest parts: one is kept for a digest
    that is due, and what digests leave goes back to immediates. Both: installation, one row an item or part."""
    i = immediate.groupBy("installation").agg(F.count("*").alias("waiting"))
    p = parts.groupBy("installation").agg(F.count("*").alias("parts"))
    rows = i.join(p, "installation", "full").na.fill(0, ["waiting", "parts"])
    first = F.least("waiting", most - (F.col("parts") > 0).cast("int"))
    rows = rows.withColumn("first", first).withColumn("digests", F.least("parts", most - F.col("first")))
    rest = F.least(F.col("waiting") - F.col("first"), most - F.col("first") - F.col("digests"))
    return rows.select("installation", (F.col("first") + rest).alias("immediate"), "digests", (F.col("waiting") - F.col("first") - rest).alias("immediate_left"), (F.col("parts") - F.col("digests")).alias("parts_left"))


def plan_preview(events: DataFrame, packed: DataFrame, capacity: DataFrame, max_bytes: int) -> DataFrame:
    """What a plan would send (kind, slot, part, event_ids, bytes) and which items it blocks (code)."""
    fits = events.where("route = 'immediate' AND NOT allocated")
    large = F.col("item_bytes") > max_bytes
    own = W.partitionBy("installation").orderBy("occurred_at", "event_id")
    one = fits.where(~large).withColumn("r", F.row_number().over(own)).join(capacity, "installation").where(F.col("r") <= F.col("immediate"))
    one = one.select("installation", F.lit("immediate").alias("kind"), F.lit(None).cast("long").alias("slot"), F.lit(1).alias("part"), F.col("event_id").cast("string").alias("event_ids"), F.col("item_bytes").cast("long").alias("bytes"), F.lit(None).cast("string").alias("code"))
    members = packed.join(events.select("event_id", "item_bytes"), "event_id")
    parts = members.where("part IS NOT NULL").groupBy("installation", "slot", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("event_ids"), F.sum("item_bytes").alias("bytes")
    )
    order = W.partitionBy("installation").orderBy("slot", "part")
    sent = parts.withColumn("r", F.row_number().over(order)).join(capacity, "installation").where(F.col("r") <= F.col("digests"))
    sent = sent.select("installation", F.lit("digest").alias("kind"), "slot", "part", "event_ids", "bytes", F.lit(None).cast("string").alias("code"))
    blocked = fits.where(large).select("installation", "event_id", F.lit(None).cast("long").alias("slot")).unionByName(members.where("part IS NULL").select("installation", "event_id", "slot"))
    blocked = blocked.select("installation", F.lit("blocked").alias("kind"), "slot", F.lit(None).cast("int").alias("part"), F.col("event_id").cast("string").alias("event_ids"), F.lit(None).cast("long").alias("bytes"), F.lit("mail_item_too_large").alias("code"))
    return one.unionByName(sent).unionByName(blocked)


def retry_grants(messages: DataFrame, last: DataFrame, at: int, wait: int = 1800) -> DataFrame:
    """For each message whether one more attempt can be granted by hand, and from when; after an uncertain attempt not
    before its waiting time is over."""
    rows = messages.join(last.select("mail_id", "outcome", "finished_at"), "mail_id", "left")
    rules = [
        ("mail_already_accepted", F.col("state") == "accepted"), ("mail_recovery_required", F.col("state") == "sending"), ("mail_clock_regressed", F.col("frozen_at") > at),
        ("already_granted", F.col("granted")), ("mail_manual_retry_requires_blocked", F.col("state") != "blocked"),
    ]
    rows = rows.withColumn("code", first_reason(rules, "granted"))
    until = F.when(F.col("outcome") == "uncertain", F.col("finished_at") + wait)
    return rows.select("mail_id", "code", F.when(F.col("code") == "granted", F.greatest(F.lit(at), until)).alias("next_attempt_at"))


def delivery_pass(attempts: DataFrame, messages: DataFrame) -> DataFrame:
    """Per pass (installation and day) its attempts by outcome, corrupt and recovered ones, and whether somebody should
    look at it."""
    rows = attempts.join(messages.select("mail_id", "installation", "corrupt"), "mail_id").withColumn("day", F.floor(F.col("started_at") / 86400))
    sent, is_ = ~F.col("corrupt"), lambda o: F.col("outcome") == o
    out = rows.groupBy("installation", "day").agg(
        F.count_if(sent).alias("attempted"), F.count_if(sent & is_("accepted")).alias("accepted"), F.count_if(sent & is_("temporary")).alias("retryable"), F.count_if(sent & is_("uncertain")).alias("uncertain"),
        F.count_if(sent & is_("permanent")).alias("permanent"), F.count_if("corrupt").alias("corrupt"), F.count_if(sent & F.col("finished_at").isNull()).alias("recovered"),
    )
    return out.withColumn("needs_attention", (F.col("retryable") + F.col("permanent") + F.col("uncertain") + F.col("corrupt")) > 0)


def delivery_keys(messages: DataFrame) -> DataFrame:
    """mail_id and the key that makes a message unique: of a digest its slot and part, of an immediate its event."""
    whole = digest(kind=F.col("kind"), installation=F.col("installation"), recipient=F.col("recipient"), slot=F.col("slot"), part=F.col("part"))
    single = digest(event_seq=F.col("event_seq"), document=F.col("document_id"), installation=F.col("installation"), recipient=F.col("recipient"))
    return messages.select("mail_id", F.when(F.col("kind") == "digest", whole).otherwise(single).alias("delivery_key"))
