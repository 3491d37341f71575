"""Standing phrases met by documents: many profiles' literal interests against a corpus in one job.

Every phrase is charged to its rarest grams among those the corpus holds; a document meets a phrase only where it has
them, and is then searched once for all phrases it may hold. Phrases never meet documents by comparison of all with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .search_index import gram_counts

RARE = 2
SLICE = 512

def _places(text: str, phrase: str, every: bool) -> list[int]:
    """Where a phrase stands, the first place or all that do not overlap, from the left."""
    out, at = [], text.find(phrase)
    while at >= 0:
        out.append(at)
        at = text.find(phrase, at + len(phrase)) if every else -1
    return out


def _searched(every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                own = batch.slice(i, 64)
                rows, hits = [], []
                for k, (phrases, text) in enumerate(zip(own["phrases"].to_pylist(), own["text"].to_pylist(), strict=True)):
                    found = [(p, at) for p in phrases for at in _places(text or "", p, every)]
                    rows += [k] * len(found)
                    hits += found
                at = pa.array([h[1] for h in hits], pa.int32())
                size = pa.array([len(h[0]) for h in hits], pa.int32())
                yield pa.RecordBatch.from_arrays([own["row"].take(pa.array(rows, pa.int64())), pa.array([h[0] for h in hits], pa.string()), at, size], names=["row", "phrase", "at", "size"])

    return run


def phrase_places(texts: DataFrame, phrases: DataFrame, every: bool = True) -> DataFrame:
    """``texts`` without its column ``text``, once for each place of each phrase in it: phrase, at (code points from 0)
    and size; of a phrase all places that do not overlap, from the left, or only the first.

    A null text is empty. ``phrases``: phrase, letter for letter; a null or empty one is nowhere, a repeated one counts
    once. Rows of ``texts`` may repeat. The plan has the same size for any number of phrases.
    """
    wanted = stored(phrases.select("phrase").where("phrase <> ''").distinct(), "phrases")
    own = [c for c in texts.columns if c != "text"]
    rows = stored(texts.select(F.monotonically_increasing_id().alias("id"), F.struct(*own).alias("row"), F.col("text").cast("string").alias("text")), "texts")
    size = F.least(F.length("phrase"), F.lit(3))
    each = F.transform(F.sequence(F.lit(1), F.length("phrase") - size + 1), lambda i: F.substring(F.col("phrase"), i, size))
    grams = wanted.select("phrase", F.explode(F.array_distinct(each)).alias("gram"))
    sizes = tuple(r[0] for r in wanted.select(size).distinct().collect())  # of 1, 2 and 3
    index = rows.select(F.col("id").alias("document_id"), F.lit(0).alias("version_id"), F.lit("").alias("title_text"), F.col("text").alias("body_text"))
    held = gram_counts(index, sizes or (3,)).select(F.col("document_id").alias("id"), "gram")
    there = stored(held.join(grams.select("gram").distinct(), "gram", "left_semi"), "held")
    often = there.groupBy("gram").agg(F.count("*").alias("df"))
    rare = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))), 1, RARE)
    anchors = grams.join(often, "gram", "left").groupBy("phrase").agg(rare.alias("g")).select("phrase", F.size("g").alias("n"), F.explode("g.gram").alias("gram"))
    near = there.join(anchors, "gram").groupBy("id", "phrase", "n").agg(F.count("*").alias("m")).where("m = n")
    slices = max(1, -(-wanted.count() // SLICE))
    asked = near.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices))).groupBy("id", "slice").agg(F.collect_list("phrase").alias("phrases"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, phrase string, at int, size int"
    found = asked.join(rows, "id").select("row", "phrases", "text").mapInArrow(_searched(every), schema)
    return found.select("row.*", "phrase", "at", "size")


def title_and_body(docs: DataFrame) -> DataFrame:
    """document_id, field, text of both fields of ``docs`` (document_id, title, body_text)."""
    fields = F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("body_text").alias("field"), F.col("body_text").alias("text")))
    return docs.select("document_id", F.inline(fields))


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """document_id, field, phrase, start, end of the first place of each phrase in title and body of ``docs``."""
    rows = phrase_places(title_and_body(docs), phrases, every=False)
    return rows.select("document_id", "field", "phrase", F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))
