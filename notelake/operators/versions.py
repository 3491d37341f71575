"""Versions of documents: changes, sequences, pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def _history() -> WindowSpec:
    return W.partitionBy("document_id").orderBy("observed_at", "version_id")


def version_pairs(versions: DataFrame) -> DataFrame:
    """Each version with the one observed before it."""
    return versions.select("document_id", "version_id", F.lag("version_id").over(_history()).alias("previous_id"), F.lag("raw_sha").over(_history()).eqNullSafe(F.col("raw_sha")).alias("same_body"))


def version_changes(versions: DataFrame) -> DataFrame:
    """What each observation means: first, changed or same. Contents (``content_sha``, or raw_sha without it) are
    compared as one parser read them; where the parser is another, the same raw body is the same, and of another body
    nothing is known."""
    content = "content_sha" if "content_sha" in versions.columns else "raw_sha"
    before = F.lag(F.struct(F.col(content).alias("content"), "raw_sha", "parser_version")).over(_history())
    one_parser = before["parser_version"] == F.col("parser_version")
    kind = (
        F.when(before.isNull(), "first")
        .when(one_parser, F.when(before["content"] == F.col(content), "same").otherwise("changed"))
        .when(before["raw_sha"] == F.col("raw_sha"), "same")
        .otherwise("unknown")
    )
    return versions.select("document_id", "version_id", "observed_at", kind.alias("change"), F.coalesce(~one_parser, F.lit(False)).alias("other_parser"))


def event_seq(versions: DataFrame) -> DataFrame:
    """Events (first and changed observations) with their number in the document."""
    flag = F.col("change").isin("first", "changed").cast("long")
    order = W.partitionBy("document_id").orderBy("observed_at", "version_id").rowsBetween(W.unboundedPreceding, 0)
    return version_changes(versions).withColumn("event_seq", F.sum(flag).over(order)).where(flag == 1).select("document_id", "version_id", "change", "event_seq")


def current_pointer(versions: DataFrame) -> DataFrame:
    """The version processed last, whatever its number."""
    return versions.groupBy("document_id").agg(F.max(F.struct("observed_at", "version_id")).alias("m")).select("document_id", F.col("m.version_id").alias("version_id"))


def current_versions(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents with the version they point at."""
    v = versions.select("document_id", F.col("version_id").alias("current_version_id"), "raw_sha", "parser_version")
    return docs.join(v, ["document_id", "current_version_id"]).select("document_id", F.col("current_version_id").alias("version_id"), "source_id", "raw_sha", "parser_version")


def index_stale(docs: DataFrame, index: DataFrame, index_version: str) -> DataFrame:
    """Documents whose index row is missing, of another version, or of another index format."""
    both = docs.where("status = 'processed'").join(index.select("document_id", F.col("version_id").alias("indexed"), "index_version"), "document_id", "left")
    reason = F.when(F.col("indexed").isNull(), "missing").when(F.col("indexed") != F.col("current_version_id"), "version").when(F.col("index_version") != index_version, "format")
    return both.withColumn("reason", reason).where("reason IS NOT NULL").select("document_id", "reason")


def upsert_newest(target: DataFrame, batch: DataFrame, key: list[str], time: str, seq: str) -> DataFrame:
    """Rows of both by ``key``, the newest each; an equal time lets the batch win."""
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    order = W.partitionBy(*key).orderBy(F.desc(time), F.desc("_new"), F.desc(seq))
    return both.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i", "_new")


def insert_if_absent(target: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``batch`` to append: keys that ``target`` lacks, one row each, the first in ``order``."""
    new = batch.join(target.select(*key).distinct(), key, "left_anti")
    return new.withColumn("_i", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_i = 1").drop("_i")


def rebuild_equal(built: DataFrame, kept: DataFrame, group: str) -> DataFrame:
    """Per group its rows as built, and how many of them the kept table lacks and has too many (copies count)."""
    mark = lambda df, *n: df.select(group, *(F.lit(x).cast("long").alias(c) for c, x in zip(("rows", "missing", "extra"), n, strict=True)))
    both = mark(built, 1, 0, 0).unionByName(mark(built.exceptAll(kept), 0, 1, 0)).unionByName(mark(kept.exceptAll(built), 0, 0, 1))
    return both.groupBy(group).agg(*(F.sum(c).alias(c) for c in ("rows", "missing", "extra")))


def snapshot_facts(docs: DataFrame, versions: DataFrame, references: DataFrame) -> DataFrame:
    """Per source its documents, those with a current version, failures with and without an earlier success, the latest
    fetch and parse of current versions, and references that no parser takes."""
    good = F.col("last_success_at").isNotNull()
    v = versions.select("document_id", F.col("version_id").alias("current_version_id"), "observed_at")
    rows = docs.withColumn("current_version_id", F.when(good, F.col("current_version_id"))).join(v, ["document_id", "current_version_id"], "left")
    failed = F.col("status") == "failed"
    out = rows.groupBy("source_id").agg(
        F.count("*").alias("documents"), F.count("observed_at").alias("processed"), F.count_if(failed & ~good).alias("failed_without_success"), F.count_if(failed & good).alias("failed_with_success"),
        F.max("last_success_at").alias("latest_fetched_at"), F.max("observed_at").alias("latest_parsed_at"),
    )
    waiting = references.groupBy("source_id").agg(F.count("*").alias("unadapted_references"))
    return out.join(waiting, "source_id", "left").na.fill(0, ["unadapted_references"])
