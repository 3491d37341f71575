"""Operator 11: importance resampling towards a target distribution.

Features are runs of 1 to 3 words, hashed into a fixed number of buckets. Documents and target texts are counted by
bucket; a bucket's gain is the logarithm of the ratio of its smoothed shares, and a document's weight the sum of the
gains of all its features, read from one array. Weight plus Gumbel noise (from the doc_id alone) is the score; the
highest scores are a draw without replacement in proportion to exp(weight).

The cutoff is found by weighted median-of-medians: each task reports the medians of its keys on both sides of the last
pivot and how many keys each side holds; the median of these medians, weighted by those numbers, is the next pivot. At
least a quarter of the keys of the side that is kept falls away each time, whatever their spread over tasks, until a
pivot is the cutoff itself. Only the keys from the cutoff on are then sorted.

The documents are read twice (counts, scores); texts are never shuffled. The driver sees the buckets, and one row a
task and round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, slices, stored, utf8
from .words import STRETCH, words

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42


def features(text: bytes, size: int = STRETCH, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end in them) of each stretch of a text."""
    tail: list[bytes] = []
    for own in words(text, size):
        some = tail + own
        spaced = [b" " + w for w in some]
        crc, found = list(map(crc32, some)), []
        for length in range(1, longest + 1):
            found += crc[max(0, len(tail) - length + 1) :]  # the others end in the stretch before
            crc = list(map(crc32, spaced[length:], crc))  # a run's crc goes on from that of the run less its last word
        tail = some[-(longest - 1) :] if longest > 1 else []
        yield len(own), np.array(found, np.int64) % buckets


def _counted(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for body in batch["body"]:
                for _, own in features(body.as_py(), STRETCH, buckets, longest):
                    total += np.bincount(own, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all ``texts`` fall into each bucket: summed in the tasks, then over them."""
    own = texts.select(utf8().alias("body")).mapInArrow(_counted(buckets, longest), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in own.groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed shares in target and source, rounded down."""
    k, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """1000 times a Gumbel variable, rounded down, that ``seed`` and ``doc_id`` (null like no digits) fix."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, tag long, n_words long, n_features long, weight long, score long"


def _scored(gain: np.ndarray, seed: int, longest: int):
    names = [c.split()[0] for c in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, tag, body in zip(batch["doc_id"].to_pylist(), batch["tag"].to_pylist(), batch["body"], strict=True):
                n = m = weight = 0
                for some, own in features(body.as_py(), STRETCH, len(gain), longest):
                    n, m, weight = n + some, m + len(own), weight + int(gain[own].sum())
                rows.append((doc_id, tag, n, m, weight, weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

    return run


_LAST = np.iinfo(np.int64).max
_SIDES = "n_better long, score_b long, doc_b long, tag_b long, n_worse long, score_w long, doc_w long, tag_w long"


def _sides(low: tuple | None, pivot: tuple | None, high: tuple | None):
    """Of the keys between ``low`` (better) and ``high`` (worse): how many are on each side of ``pivot``, and the median
    of each side. A key is (-score, doc_id, tag) in ascending order; without a pivot all are worse."""

    def before(keys: np.ndarray, than: tuple) -> np.ndarray:
        s, d, t = keys
        return (s < than[0]) | ((s == than[0]) & ((d < than[1]) | ((d == than[1]) & (t < than[2]))))

    def middle(keys: np.ndarray) -> list[int]:
        n = keys.shape[1]
        if not n:
            return [0, 0, 0, 0]
        return [n, *keys[:, np.lexsort(keys[::-1])[(n - 1) // 2]].tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((3, 0), np.int64)]
        for batch in batches:
            keys = np.array([-batch["score"].to_numpy(), batch["doc_id"].fill_null(_LAST).to_numpy(), batch["tag"].to_numpy()])
            if low:
                keys = keys[:, ~before(keys, (*low[:2], low[2] + 1))]
            if high:
                keys = keys[:, before(keys, high)]
            held.append(keys)
        keys = np.concatenate(held, axis=1)
        better = before(keys, pivot) if pivot else np.zeros(keys.shape[1], bool)
        worse = ~before(keys, (*pivot[:2], pivot[2] + 1)) if pivot else ~better
        row = middle(keys[:, better]) + middle(keys[:, worse])
        if row[0] or row[4]:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=[c.split()[0] for c in _SIDES.split(", ")])

    return run


def _weighted_median(medians: list[tuple[tuple, int]]) -> tuple:
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int) -> tuple[int, int, int]:
    """The k-th best key (-score, doc_id, tag) of ``keys`` (doc_id, tag, score; tags differ), 1 <= k <= their number."""
    low = pivot = high = None
    ahead = 0  # keys better than all that remain
    own = keys.select("doc_id", "tag", "score")
    while True:
        between = own  # the scan skips what lies outside by the files' own statistics
        if low:
            between = between.where(F.col("score") <= -low[0])
        if high:
            between = between.where(F.col("score") >= -high[0])
        rows = between.mapInArrow(_sides(low, pivot, high), _SIDES).collect()
        better = sum(r[0] for r in rows)
        place = ahead + better + 1 if pivot else 0
        if place == k:
            return pivot
        if place > k:
            high, side = pivot, 0
        else:
            low, ahead, side = pivot or low, place or ahead, 4
        pivot = _weighted_median([(tuple(r[side + 1 : side + 4]), r[side]) for r in rows if r[side]])


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight, score and rank: 1, 2, 3 ... of the drawn rows by descending
    score, null of the others. Of the n rows with at least ``least_words`` words, floor(percent * n / 100) are drawn.

    A null text has no words, weight 0 and the noise of its doc_id; an empty target makes gains that only favour rare
    buckets; an empty table gives no rows. Equal scores go to the smaller doc_id (null last). Rows that repeat a doc_id
    are rows of their own with the same noise; rows with equal doc_id and text are told apart by their place in the
    table as it was read. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("tag"), utf8().alias("body"))
    scored = stored(slim.mapInArrow(_scored(gain, seed, longest), _SCORED), "scores")
    able = F.col("n_words") >= least_words
    k = percent * scored.where(able).count() // 100
    if not k:
        return scored.drop("tag").withColumn("rank", F.lit(None).cast("long"))
    score, doc_id, tag = cutoff(scored.where(able), k)
    doc = F.coalesce(F.col("doc_id"), F.lit(_LAST))
    ahead = (F.col("score") > -score) | ((F.col("score") == -score) & ((doc < doc_id) | ((doc == doc_id) & (F.col("tag") <= tag))))
    drawn, _ = numbered(scored.where(able & ahead), [F.col("score").desc(), doc, F.col("tag")], "rank", "drawn")
    rest = scored.where(~(able & ahead)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.withColumn("rank", F.col("rank") + 1).unionByName(rest).drop("tag")


def drawn_texts(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """All rows of ``docs`` whose doc_id has a drawn row in the result of ``importance_resample``, with all columns."""
    return docs.join(ranks.where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct(), docs["doc_id"].eqNullSafe(F.col("_drawn")), "left_semi")
