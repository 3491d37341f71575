"""Structured Streaming jobs over files: sessions, hourly counts, repeated bodies, archive, changes, late rows, delivery.

State is bounded by a watermark, or is one small row a key (document), or is a table of rows by key (message) that each
batch is joined with: all keys of a batch are folded by one query. A job reads all files there are, writes Parquet with a
checkpoint in the shared folder, and can be started again from it: what was written once is not written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.delivery import last_finished, log_fold, state_after
from ..sources.tables import shared_dir


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_dir(spark)}/notelake-stream-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a folder of files, or of a single file: a stream takes that only as a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


@dataclass(frozen=True)
class Folding:
    """A stream whose rows are folded by key with what came before. ``fold`` (a batch, what earlier batches kept or None)
    gives what the batch keeps, and ``shown`` (what it kept, what earlier ones kept or None) its rows of the result.
    Where ``shown`` is None, both are the same."""

    rows: DataFrame
    schema: str
    fold: Callable[[DataFrame, DataFrame | None], DataFrame]
    result: str
    shown: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None

    def drained(self, folder: str) -> DataFrame:
        """A batch has folders of its own, which it writes over if it runs again."""
        kept, table = f"{folder}/kept", f"{folder}/table"

        def held(spark: SparkSession, test: str) -> DataFrame:
            return spark.read.schema(f"{self.schema}, batch long").parquet(kept).where(test).drop("batch")

        def add(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            before = held(spark, f"batch < {number}") if number else None  # the first batch finds nothing
            self.fold(batch, before).write.mode("overwrite").parquet(f"{kept}/batch={number}")
            if self.shown is not None:
                self.shown(held(spark, f"batch = {number}"), before).write.mode("overwrite").parquet(f"{table}/batch={number}")

        self.rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        read = self.rows.sparkSession.read.schema(f"{self.result}, batch long")
        return read.parquet(kept if self.shown is None else table).drop("batch")


def drained(stream: DataFrame | Folding, folder: str) -> DataFrame:
    """Run the stream over what is there now and return its table; the same ``folder`` goes on where it ended."""
    if isinstance(stream, Folding):
        return stream.drained(folder)
    job = stream.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def sessions(events: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Closed runs of a key's events (``ts``) with at most ``gap`` between neighbours."""
    runs = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return runs.select(key, F.unix_seconds("w.start").alias("started_at"), "events", "errors")


def hourly(events: DataFrame, key: str, delay: str) -> DataFrame:
    """Events of each key in each closed hour."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.unix_seconds("w.start").alias("hour"), "n")


def missing_hours(hours: DataFrame, key: str) -> DataFrame:
    """Hours between a key's first and last that have no row."""
    span = hours.groupBy(key).agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    return span.select(key, F.explode(F.sequence("a", "b", F.lit(3600).cast("long"))).alias("hour")).join(hours, [key, "hour"], "left_anti")


def new_bodies(pages: DataFrame, delay: str) -> DataFrame:
    """Hash of each body that has not come within ``delay`` before; ``ts`` is when it came."""
    return pages.select("ts", F.sha2("body", 256).alias("sha256")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sha256"]).select("sha256")


def archived(bodies: DataFrame, folder: str) -> DataFrame:
    """Archive of a stream of bodies (id, body): one row a digest, with its first id in the batch that brought it.

    A batch only adds digests that the archive lacks, in a folder of its own that it writes over if it runs again; so
    neither a repeated batch nor a restart adds one twice.
    """
    spark, table = bodies.sparkSession, f"{folder}/archive"
    schema = "sha256 string, first_id long, bytes long, batch long"

    def add(batch: DataFrame, number: int) -> None:
        own = batch.groupBy(F.sha2("body", 256).alias("sha256")).agg(F.min("id").alias("first_id"), F.max(F.octet_length("body")).cast("long").alias("bytes"))
        if number:  # the first batch finds no archive
            held = batch.sparkSession.read.schema(schema).parquet(table).where(F.col("batch") < number).select("sha256")
            own = own.join(held, "sha256", "left_anti")
        own.write.mode("overwrite").parquet(f"{table}/batch={number}")

    job = bodies.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(schema).parquet(table).drop("batch")


def _folded(rows: DataFrame, key: str, fold, out: str, state: str, mode: str) -> DataFrame:
    return rows.groupBy(key).applyInPandasWithState(fold, out, state, mode, GroupStateTimeout.NoTimeout)


def _changed(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    content, raw, parser, seq = state.get if state.exists else (None, None, None, 0)
    rows, out = pd.concat(list(parts)).sort_values(["observed_at", "version_id"]), []
    for r in rows.itertuples():
        if content is None:
            change = "first"
        elif parser == r.parser_version:
            change = "same" if content == r.content_sha else "changed"
        else:
            change = "same" if raw == r.raw_sha else "unknown"
        seq += change in ("first", "changed")
        content, raw, parser = r.content_sha, r.raw_sha, r.parser_version
        out.append((key[0], r.version_id, change, seq))
    state.update((content, raw, parser, seq))
    yield pd.DataFrame(out, columns=["document_id", "version_id", "change", "event_seq"])


def changes(versions: DataFrame) -> DataFrame:
    """What each version of a stream means for its document, and the document's number of events so far. State: the
    last content, raw body, parser and number of each document."""
    return _folded(versions, "document_id", _changed, "document_id long, version_id long, change string, event_seq long", "content string, raw string, parser string, seq long", "append")


def _judged(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    own = W.partitionBy("mail_id").orderBy("line_id", "started_at", "attempt_no").rowsBetween(W.unboundedPreceding, -1)
    latest = F.max("started_at").over(own)
    if before is not None:
        batch = batch.join(_earlier(before, batch).groupBy("mail_id").agg(F.max("started_at").alias("latest")), "mail_id", "left")
        latest = F.greatest(latest, "latest")
    return batch.select("mail_id", "line_id", "started_at", F.when(F.col("started_at") < latest, "late").otherwise("accepted").alias("verdict"))


def _earlier(before: DataFrame, batch: DataFrame) -> DataFrame:
    """What was kept of a batch's messages."""
    return before.join(batch.select("mail_id").distinct(), "mail_id", "left_semi")


_LATE = "mail_id long, line_id long, started_at long, verdict string"


def late_rows(attempts: DataFrame) -> Folding:
    """Each attempt with a verdict: late if one of its message with a later time came before it. Attempts of one batch come
    in order of line, time and number. State: the verdicts themselves."""
    return Folding(attempts, _LATE, _judged, _LATE)


SCHEDULE, LEAST_WAIT, MOST_ATTEMPTS = (300, 1800, 7200), 1800, 6
_LAST = "mail_id long, attempt_no long, started_at long, line_id long, outcome string, finished_at long"


def _last(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    return last_finished(batch if before is None else batch.unionByName(_earlier(before, batch)))


def delivery(attempts: DataFrame) -> Folding:
    """State of each message after every batch of attempts that concerns it. State: its last finished attempt."""
    result = "mail_id long, attempt_no long, state string, next_attempt_at long"
    return Folding(attempts, _LAST, _last, result, lambda own, _: state_after(own, list(SCHEDULE), MOST_ATTEMPTS))


Event = tuple[int, int, int, int, int, str]
_LOG = "mail_id long, at long, kind int, attempt_no long, line_id long, finished_at long, outcome string"
_FOLDED = "mail_id long, state string, reason string, next_attempt_at long, manual_pending boolean, granted long, refused long"


def folded(log: list[Event]) -> tuple:
    """``log_fold`` of one message, as a plain loop over its log of (at, kind, attempt_no, line_id, finished_at, outcome);
    kind 0 is a grant. Numbers that are not there are -1, and a missing outcome is empty."""
    state, reason, due, pending, until, granted, refused = "pending", None, None, False, -1, 0, 0
    for at, kind, number, _, finished, outcome in sorted(log):
        if kind == 0:
            if state == "blocked" and not pending:
                state, reason, due, pending, granted = "pending", None, max(at, until), True, granted + 1
            else:
                refused += 1
            continue
        unsure, reason, due = outcome == "uncertain", None, None
        if outcome in ("", "accepted"):
            state = outcome or "sending"
        elif outcome == "permanent" or pending or number >= MOST_ATTEMPTS:
            state, reason = "blocked", "permanent" if outcome == "permanent" else "manual_attempt_failed" if pending else "retry_exhausted"
        else:
            state, wait = "uncertain" if unsure else "retry", SCHEDULE[min(number, len(SCHEDULE)) - 1]
            due = finished + (max(wait, LEAST_WAIT) if unsure else wait)
        pending, until = False, finished + LEAST_WAIT if unsure else -1
    return state, reason, due, pending, granted, refused


def delivery_with_grants(log: DataFrame) -> Folding:
    """State of each message after every batch of its attempts and grants (rows of ``delivery_log``). State: all rows so
    far; what comes late takes its place by its own time, so the last state does not depend on the order of arrival."""

    def shown(own: DataFrame, before: DataFrame | None) -> DataFrame:
        return log_fold(own if before is None else own.unionByName(_earlier(before, own)), list(SCHEDULE), MOST_ATTEMPTS, LEAST_WAIT)

    return Folding(log, _LOG, lambda batch, _: batch, _FOLDED, shown)
