"""A stored lexical index that is kept up to date: texts, and n-gram postings with counts from the first use of them on.

A batch of queries reads the texts alone (``query_scan``). Single terms (``term_hits``) read postings, which are extracted
when first asked for. Both tables are bucketed by document and version, so terms meet postings where they lie: their grams
are handed to every bucket, the grams of one term meet within a bucket, and a candidate's text is in the bucket of the same
number, so neither grams nor texts are shuffled; and a gram that most documents hold is spread over all buckets, which a
bucketing by gram would gather in one. Within a bucket postings are sorted by gram, so a scan for few grams skips most
row groups by the files' own statistics.

An index is a value: ``updated`` appends the postings of new and changed versions and returns an index with another
``live`` table. Postings of versions that are no longer live stay until ``compacted`` and are never found.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.tables import bucketed, stored

BUCKETS = 16
INDEX_VERSION = "trigram-1"
SIZES = (1, 2, 3)

_POSTING = "document_id long, version_id long, gram string, in_title int, in_body int"
_KEYS = ["document_id", "version_id"]
_TEXT = ["document_id", "version_id", "source_id", "published_date", "len", "title_text", "body_text"]


def _counted(sizes: tuple[int, ...], rows: int = 64):
    """Each document's distinct n-grams with how often title and body hold them: one pass, and no shuffle."""

    def grams(text: str) -> Counter:
        out: Counter = Counter()
        for n in sizes:
            out.update(text[i : i + n] for i in range(len(text) - n + 1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                documents, versions, found, titles, bodies = [], [], [], [], []
                for document, version, title, body in zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True):
                    in_title, in_body = grams(title or ""), grams(body or "")
                    own = in_title.keys() | in_body.keys()
                    documents += [document] * len(own)
                    versions += [version] * len(own)
                    found += own
                    titles += [in_title.get(g, 0) for g in own]
                    bodies += [in_body.get(g, 0) for g in own]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
                columns = [pa.array(x, t) for x, t in zip((documents, versions, found, titles, bodies), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _POSTING.split(", ")])

    return run


def gram_counts(rows: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """document_id, version_id, gram, in_title, in_body of all n-grams of each document's title_text and body_text."""
    return rows.select(F.col("document_id").cast("long"), F.col("version_id").cast("long"), "title_text", "body_text").mapInArrow(_counted(sizes), _POSTING)


@dataclass(frozen=True)
class SearchIndex:
    """``postings`` and ``texts`` are bucketed tables, ``live`` holds (document_id, version_id) of what can be found."""

    name: str
    buckets: int
    live: DataFrame

    @property
    def postings(self) -> DataFrame:
        """document_id, version_id, gram, in_title, in_body, also of versions that are not live. Made when first asked for."""
        spark, table = self.live.sparkSession, f"{self.name}_postings"
        if spark.catalog.tableExists(table):
            return spark.table(table)
        return bucketed(gram_counts(spark.table(f"{self.name}_texts")), table, self.buckets, _KEYS, "gram")

    @property
    def frequency(self) -> DataFrame:
        """gram, df: tells rare grams from common ones; it may be old, as it only orders the work."""
        spark, table = self.live.sparkSession, f"{self.name}_frequency"
        if spark.catalog.tableExists(table):
            return spark.table(table)
        return bucketed(self.postings.groupBy("gram").agg(F.count("*").alias("df")), table, self.buckets, ["gram"], "gram")

    @property
    def texts(self) -> DataFrame:
        """Live documents with their texts."""
        return self.live.sparkSession.table(f"{self.name}_texts").join(self.live.hint("merge"), _KEYS, "left_semi")

    @property
    def documents(self) -> DataFrame:
        """Live documents without their texts, with len (of title and body, in trigrams)."""
        return self.texts.drop("title_text", "body_text")


def index_rows(docs: DataFrame) -> DataFrame:
    """Search text of current, processed documents."""
    return docs.where("status = 'processed'").select(
        "document_id", "source_id", "published_date", F.col("current_version_id").alias("version_id"), normalize(F.coalesce("title", F.lit(""))).alias("title_text"),
        normalize(F.coalesce("body_text", F.lit(""))).alias("body_text"), F.lit(INDEX_VERSION).alias("index_version"),
    )


def _append(name: str, buckets: int, rows: DataFrame) -> None:
    size = lambda c: F.greatest(F.length(c) - 2, F.lit(0))
    texts = rows.withColumn("len", size("title_text") + size("body_text")).select(*_TEXT)
    if rows.sparkSession.catalog.tableExists(f"{name}_postings"):
        texts = stored(texts, "texts")
        bucketed(gram_counts(texts).repartition(buckets, *_KEYS), f"{name}_postings", buckets, _KEYS, "gram")
    bucketed(texts.repartition(buckets, *_KEYS), f"{name}_texts", buckets, _KEYS, "document_id")


def _live(name: str, buckets: int, ids: DataFrame) -> DataFrame:
    return bucketed(ids.repartition(buckets, *_KEYS), f"{name}_live_{uuid.uuid4().hex[:12]}", buckets, _KEYS, "document_id")


def built(rows: DataFrame, buckets: int = BUCKETS) -> SearchIndex:
    """An index of ``rows`` (as ``index_rows`` gives them; a document_id once)."""
    name = f"notelake_{uuid.uuid4().hex[:12]}"
    _append(name, buckets, rows)
    return SearchIndex(name, buckets, _live(name, buckets, rows.sparkSession.table(f"{name}_texts").select(*_KEYS)))


def delta(index: SearchIndex, docs: DataFrame) -> DataFrame:
    """document_id, version_id, change: 'add' for current versions that the index lacks, 'drop' for live ones that are
    not current any more. Reads no text."""
    now = docs.where("status = 'processed'").select(F.col("document_id").cast("long").alias("document_id"), F.col("current_version_id").cast("long").alias("version_id"))
    add = now.join(index.live, _KEYS, "left_anti").withColumn("change", F.lit("add"))
    return add.unionByName(index.live.join(now, _KEYS, "left_anti").withColumn("change", F.lit("drop")))


def updated(index: SearchIndex, docs: DataFrame) -> SearchIndex:
    """The index of the current versions of ``docs``: grams are extracted of those alone that it lacks. A version that
    comes back finds its postings still there. ``index`` itself stays as it is."""
    changes = stored(delta(index, docs), "delta")
    if changes.isEmpty():
        return index
    held = index.live.sparkSession.table(f"{index.name}_texts").select(*_KEYS)
    missing = changes.where("change = 'add'").select(*_KEYS).join(held, _KEYS, "left_anti")
    wanted = docs.join(missing, (docs["document_id"] == missing["document_id"]) & (docs["current_version_id"] == missing["version_id"]), "left_semi")
    _append(index.name, index.buckets, index_rows(wanted))
    ids = index.live.join(changes.where("change = 'drop'"), _KEYS, "left_anti").unionByName(changes.where("change = 'add'").select(*_KEYS))
    return replace(index, live=_live(index.name, index.buckets, ids))


def compacted(index: SearchIndex) -> SearchIndex:
    """The same index without what is not live; postings and frequencies are made anew when asked for."""
    return built(index.texts.withColumn("index_version", F.lit(INDEX_VERSION)), index.buckets)
