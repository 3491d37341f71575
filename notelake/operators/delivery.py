"""Messages, attempts and event routing: states, audits, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATES = ("pending", "sending", "retry", "uncertain", "accepted", "blocked")

def latest_attempt(attempts: DataFrame) -> DataFrame:
    one = F.max(F.struct("attempt_no", "started_at", "line_id", "finished_at", "outcome"))
    return attempts.groupBy("mail_id").agg(F.count("*").alias("attempts"), one.alias("last")).select("mail_id", "attempts", F.col("last.attempt_no").alias("attempt_no"), F.col("last.outcome").alias("outcome"), F.col("last.finished_at").alias("finished_at"))


def delivery_latest(messages: DataFrame, attempts: DataFrame) -> DataFrame:
    return messages.select("mail_id", "state").join(latest_attempt(attempts), "mail_id", "left")


def delivery_counts(messages: DataFrame) -> DataFrame:
    """Messages by installation and state, states without any as zero."""
    every = messages.select("installation").distinct().withColumn("state", F.explode(F.array(*map(F.lit, STATES))))
    return every.join(messages.groupBy("installation", "state").agg(F.count("*").alias("n")), ["installation", "state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def delivery_summary(messages: DataFrame, attempts: DataFrame, at: int) -> DataFrame:
    """Per installation: messages due and uncertain, the oldest not accepted, and uncertain attempts."""
    open_ = F.col("state") != "accepted"
    unsure = attempts.groupBy("mail_id").agg(F.count_if(F.col("outcome") == "uncertain").alias("u"))
    return messages.join(unsure, "mail_id", "left").groupBy("installation").agg(
        F.count_if(F.col("next_attempt_at") <= at).alias("due"), F.count_if(F.col("state") == "uncertain").alias("unknown"), F.min(F.when(open_, F.col("frozen_at"))).alias("oldest_open"),
        F.coalesce(F.sum("u"), F.lit(0)).alias("uncertain_attempts"),
    )


def events_pending(events: DataFrame, members: DataFrame, decisions: DataFrame, intents: DataFrame, errors: DataFrame) -> DataFrame:
    """Deliverable events that no message holds yet, each with its decision, its intent and the last planning error."""
    last = errors.groupBy("event_id").agg(F.max_by("error_code", F.struct("error_at", "error_code")).alias("prior_error"))
    out = events.where("route <> 'none'").join(members.select("event_id"), "event_id", "left_anti").join(decisions, "event_id", "left").join(intents, "event_id", "left").join(last, "event_id", "left")
    return out.select("event_id", "installation", "route", "occurred_at", "decision_id", "intent_at", "prior_error")


def unplanned_work(events: DataFrame, members: DataFrame, messages: DataFrame, attempts: DataFrame) -> DataFrame:
    """What should have a successor and has none: intents without a message, digest events without a member, messages
    never attempted."""
    held = members.select("event_id").distinct()
    free = events.join(held, "event_id", "left_anti")
    named = lambda rows, kind, key: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("key"))
    never = messages.where("state <> 'pending'").join(attempts.select("mail_id").distinct(), "mail_id", "left_anti")
    return named(free.where("route = 'immediate'"), "intent_without_message", "event_id").unionByName(named(free.where("route = 'digest'"), "digest_without_member", "event_id")).unionByName(named(never, "message_without_delivery", "mail_id"))


def delivery_latency(messages: DataFrame) -> DataFrame:
    return messages.groupBy("installation").agg(
        F.count("accepted_at").alias("accepted"), F.max(F.col("accepted_at") - F.col("frozen_at")).alias("slowest"), F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states")
    )


def retry_delay(attempt_no: Column, schedule: list[int], uncertain: Column, least: int = 1800) -> Column:
    wait = F.element_at(F.array(*map(F.lit, schedule)), F.least(attempt_no, F.lit(len(schedule))).cast("int"))
    return F.when(uncertain, F.greatest(wait, F.lit(least))).otherwise(wait)


_LAST = ("attempt_no", "started_at", "line_id", "outcome", "finished_at")


def _after_outcome(most: int) -> Column:
    """State after a finished attempt."""
    return (
        F.when(F.col("outcome") == "accepted", "accepted")
        .when((F.col("outcome") == "permanent") | (F.col("attempt_no") >= most), "blocked")
        .when(F.col("outcome") == "uncertain", "uncertain")
        .otherwise("retry")
    )


def _due_again(schedule: list[int]) -> Column:
    return F.when(F.col("state").isin("uncertain", "retry"), F.col("finished_at") + retry_delay(F.col("attempt_no"), schedule, F.col("outcome") == "uncertain"))


def last_finished(attempts: DataFrame) -> DataFrame:
    """The last finished attempt of each message that has one."""
    return attempts.where("outcome IS NOT NULL").groupBy("mail_id").agg(F.max(F.struct(*_LAST)).alias("l")).select("mail_id", "l.*")


def delivery_state(attempts: DataFrame, schedule: list[int], most: int) -> DataFrame:
    """State of each message after its last finished attempt, and when it is due again."""
    return state_after(last_finished(attempts), schedule, most)


def state_after(last: DataFrame, schedule: list[int], most: int) -> DataFrame:
    """``delivery_state`` from rows of ``last_finished``."""
    return last.withColumn("state", _after_outcome(most)).select("mail_id", "attempt_no", "state", _due_again(schedule).alias("next_attempt_at"))


def delivery_log(attempts: DataFrame, grants: DataFrame) -> DataFrame:
    """Attempts and manual grants as one log: mail_id, at, kind (0 grant, 1 attempt), attempt_no, line_id, finished_at and
    outcome, in whose order (at, kind, attempt_no, line_id) a message's state follows; a grant comes before an attempt
    that starts in the same second."""
    nothing = {"attempt_no": "long", "line_id": "long", "finished_at": "long", "outcome": "string"}
    own = attempts.select("mail_id", F.col("started_at").alias("at"), F.lit(1).alias("kind"), "attempt_no", "line_id", "finished_at", "outcome")
    return own.unionByName(grants.select("mail_id", "at", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items())))


def delivery_fold(attempts: DataFrame, grants: DataFrame, schedule: list[int], most: int, wait: int = 1800) -> DataFrame:
    """mail_id, state, reason, next_attempt_at, manual_pending, granted and refused (numbers of grants) of each message
    that has an attempt or a grant, by a fold over both logs in their order.

    A grant gives one more attempt to a blocked message, not before the waiting time after an uncertain attempt is over;
    any other grant is refused and changes nothing. An attempt under a grant is manual: if it fails, the message is
    blocked again. An attempt without an outcome leaves its message sending. Logs hold a message's few attempts and
    grants; repeated rows are rows of their own.
    """
    return log_fold(delivery_log(attempts, grants), schedule, most, wait)


def log_fold(log: DataFrame, schedule: list[int], most: int, wait: int = 1800) -> DataFrame:
    """``delivery_fold`` over rows of ``delivery_log``, in any order."""
    names = ("attempt_no", "line_id", "finished_at", "outcome")
    event = F.struct("at", "kind", *names)
    logs = log.groupBy("mail_id").agg(F.array_sort(F.collect_list(event)).alias("log"))
    null = lambda t: F.lit(None).cast(t)
    kinds = {"state": "string", "reason": "string", "due": "long", "pending": "boolean", "until": "long", "granted": "long", "refused": "long"}
    start = F.struct(*(x.cast(kinds[n]).alias(n) for n, x in {"state": F.lit("pending"), "reason": null("string"), "due": null("long"), "pending": F.lit(False), "until": null("long"), "granted": F.lit(0), "refused": F.lit(0)}.items()))

    def step(s: Column, e: Column) -> Column:
        change = lambda **new: F.struct(*(new.get(n, s[n]).cast(t).alias(n) for n, t in kinds.items()))
        wanted = (s["state"] == "blocked") & ~s["pending"]
        grant = F.when(wanted, change(state=F.lit("pending"), reason=null("string"), due=F.greatest(e["at"], s["until"]), pending=F.lit(True), granted=s["granted"] + 1)).otherwise(change(refused=s["refused"] + 1))
        unsure = e["outcome"] == "uncertain"
        over = s["pending"] | (e["attempt_no"] >= most)
        state = F.when(e["outcome"].isNull(), "sending").when(e["outcome"] == "accepted", "accepted").when((e["outcome"] == "permanent") | over, "blocked").when(unsure, "uncertain").otherwise("retry")
        reason = F.when(state == "blocked", F.when(e["outcome"] == "permanent", "permanent").when(s["pending"], "manual_attempt_failed").otherwise("retry_exhausted"))
        due = F.when(state.isin("uncertain", "retry"), e["finished_at"] + retry_delay(e["attempt_no"], schedule, unsure, wait))
        return F.when(e["kind"] == 0, grant).otherwise(change(state=state, reason=reason, due=due, pending=F.lit(False), until=F.when(unsure, e["finished_at"] + wait)))

    rows = logs.select("mail_id", F.aggregate("log", start, step).alias("s"))
    return rows.select("mail_id", "s.state", "s.reason", F.col("s.due").alias("next_attempt_at"), F.col("s.pending").alias("manual_pending"), "s.granted", "s.refused")


def delivery_audit(messages: DataFrame, attempts: DataFrame, schedule: list[int], most: int) -> DataFrame:
    """Messages whose stored state, or else due time, is not what their attempts say: stored, computed, stored_due,
    computed_due and the rule that is broken (state or due). Every message is audited: without an attempt it must be
    pending since it was frozen, and while its last attempt is open it is being sent and not due."""
    last = attempts.groupBy("mail_id").agg(F.max(F.struct(*_LAST)).alias("l"))
    rows = messages.select("mail_id", "frozen_at", F.col("state").alias("stored"), F.col("next_attempt_at").alias("stored_due")).join(last, "mail_id", "left")
    rows = rows.select("mail_id", "frozen_at", "stored", "stored_due", F.col("l").isNull().alias("none"), "l.*")
    rows = rows.withColumn("state", F.when(F.col("none"), "pending").when(F.col("outcome").isNull(), "sending").otherwise(_after_outcome(most)))
    rows = rows.withColumn("computed_due", F.when(F.col("none"), F.col("frozen_at")).otherwise(_due_again(schedule)))
    rule = F.when(~F.col("stored").eqNullSafe(F.col("state")), "state").when(~F.col("stored_due").eqNullSafe(F.col("computed_due")), "due")
    return rows.select("mail_id", "stored", F.col("state").alias("computed"), "stored_due", "computed_due", rule.alias("rule")).where("rule IS NOT NULL")


def attempt_audit(attempts: DataFrame) -> DataFrame:
    """Rules that a message's attempt log breaks, one row each."""
    log = W.partitionBy("mail_id").orderBy("attempt_no", "started_at", "line_id")
    rows = attempts.select("*", F.row_number().over(log).alias("i"), F.lag("finished_at").over(log).alias("before"), F.lag("outcome").over(log).alias("unsure"), F.lead("attempt_no").over(log).alias("next"))
    rules = {
        "not_contiguous": F.col("attempt_no") != F.col("i"),
        "starts_before_previous_ends": F.col("started_at") < F.col("before"),
        "open_but_not_last": F.col("finished_at").isNull() & F.col("next").isNotNull(),
        "accepted_but_not_last": (F.col("outcome") == "accepted") & F.col("next").isNotNull(),
        "uncertain_wait_ignored": (F.col("unsure") == "uncertain") & (F.col("started_at") < F.col("before") + 1800),
    }
    broken = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items()))))
    return rows.select("mail_id", "i", broken.alias("rule"))


def due_messages(messages: DataFrame, at: int, most: int) -> DataFrame:
    return messages.where(F.col("next_attempt_at") <= at).orderBy("next_attempt_at", "mail_id").limit(most).select("mail_id", "next_attempt_at")


def message_diagnostics(messages: DataFrame, most: int = 100) -> DataFrame:
    """The first messages, not accepted ones before others, and whether there are more."""
    total = messages.agg((F.count("*") > most).alias("truncated"))  # one row
    return messages.orderBy(F.when(F.col("state") == "accepted", 1).otherwise(0), "mail_id").limit(most).select("mail_id", "state").crossJoin(total)


def route_interleave(events: DataFrame, cap: int) -> DataFrame:
    """Immediate and digest events in turn, the oldest of each first, ``cap`` in all for each installation."""
    own = W.partitionBy("installation", "route").orderBy("occurred_at", "event_id")
    rows = events.where("route <> 'none' AND NOT allocated").withColumn("r", F.row_number().over(own)).where(F.col("r") <= cap)
    order = W.partitionBy("installation").orderBy("r", F.when(F.col("route") == "immediate", 0).otherwise(1))
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= cap).select("installation", "event_id", "route", "position")


def mail_eligible(events: DataFrame, at: int) -> DataFrame:
    ready = F.when(F.col("route") == "immediate", F.col("occurred_at")).otherwise(F.greatest("due_at", "occurred_at"))
    return events.where("route <> 'none'").select("event_id", "route", (ready <= at).alias("eligible"), ready.alias("ready_at"))


def digest_packing(events: DataFrame, max_bytes: int, max_events: int) -> DataFrame:
    """Next-fit packing of a slot's digest events, in order, into parts of bounded bytes and number. An item that is
    too large by itself is blocked (part null) and later items go on. A slot's items are one row's array: packing is
    sequential, and a slot (one installation, one week) bounds it."""
    item = F.struct("occurred_at", "event_id", "item_bytes")
    slots = events.where("route = 'digest' AND NOT allocated").groupBy("installation", "slot").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "array<struct<event_id:bigint,part:int,position:int>>"
    start = F.struct(F.lit(1).alias("part"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        blocked = x["item_bytes"] > max_bytes
        full = (s["n"] > 0) & ((s["bytes"] + x["item_bytes"] > max_bytes) | (s["n"] >= max_events))
        part = F.when(full, s["part"] + 1).otherwise(s["part"])
        n = F.when(full, F.lit(1)).otherwise(s["n"] + 1)
        size = F.when(full, x["item_bytes"]).otherwise(s["bytes"] + x["item_bytes"])
        placed = F.struct(x["event_id"].alias("event_id"), F.when(~blocked, part).alias("part"), F.when(~blocked, n).alias("position"))
        return F.struct(
            F.when(blocked, s["part"]).otherwise(part).alias("part"), F.when(blocked, s["n"]).otherwise(n).alias("n"), F.when(blocked, s["bytes"]).otherwise(size).cast("long").alias("bytes"),
            F.concat(s["out"], F.array(placed).cast(kind)).alias("out"),
        )

    return slots.select("installation", "slot", F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("o")).select("installation", "slot", "o.*")


def next_part(packed: DataFrame) -> DataFrame:
    return packed.groupBy("installation", "slot").agg((F.coalesce(F.max("part"), F.lit(0)) + 1).alias("next_part"))


def plan_counts(events: DataFrame, at: int, max_bytes: int) -> DataFrame:
    free = ~F.col("allocated")
    due = F.greatest("due_at", "occurred_at") <= at
    return events.groupBy("installation").agg(
        F.count_if(free & (F.col("route") == "immediate")).alias("immediate"), F.count_if(free & (F.col("route") == "digest")).alias("digest"),
        F.count_if(free & (F.col("route") == "digest") & due).alias("due"), F.count_if(free & (F.col("route") == "digest") & ~due).alias("deferred"),
        F.count_if(free & (F.col("route") != "none") & (F.col("item_bytes") > max_bytes)).alias("blocked"),
    )


def channel_pause(attempts: DataFrame, messages: DataFrame) -> DataFrame:
    """The last permanent failure of each installation's channel (not of one message): what paused it, and when."""
    failed = attempts.where("outcome = 'permanent' AND scope = 'channel'").join(messages.select("mail_id", "installation"), "mail_id")
    return failed.groupBy("installation").agg(F.max(F.struct("finished_at", "mail_id")).alias("m")).select("installation", F.col("m.finished_at").alias("paused_at"), F.col("m.mail_id").alias("mail_id"))
