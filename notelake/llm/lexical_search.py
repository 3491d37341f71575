"""Operator 12: ranked lexical search by presence masks.

Documents become stored rows of the query terms they hold, with counts: texts are read once a block of items and never
shuffled. Scores are sums over an item's terms of a weight (rarer terms more) times a saturating count, shorter
documents first.

A task takes documents in slices. For each slice every term has a bitmap of the documents that hold it and the most it
adds to any of them. For each item: the documents that hold none of the terms without which the item's tenth best score
so far cannot be reached are left out by one OR over bitmaps; the others are grouped by the mask of the item's terms
that they hold, and a mask's maximum is the sum of its terms' most. Masks are taken by descending maximum and their
documents scored exactly, until the next maximum is below the tenth best score (an equal one may still win by doc_id).
So the result is exact. What is left of a task is at most ten documents an item; a window ranks them.

Items are broadcast in blocks of at most BLOCK_CHARS characters; each further block is one more pass.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, utf8
from .words import words

TOP = 10
BLOCK_CHARS = 2_000_000
SLICE = 2_048
RUN = 32  # documents scored at a time, at least

_POSTINGS = "doc_id long, n long, terms array<int>, counts array<long>"
_FOUND = "item int, item_id long, doc_id long, score long"


def counted(text: bytes, known: dict[bytes, int] | None = None) -> tuple[int, Counter]:
    """How many words a text has, and how often each (of ``known``, by its number there)."""
    n, out = 0, Counter()
    for own in words(text):
        n += len(own)
        out.update(own if known is None else filter(None.__ne__, map(known.get, own)))
    return n, out


class Items:
    """A block of items: the number of each term, and each item's terms with how often it repeats them."""

    def __init__(self, rows: tuple[tuple[int, int | None, str | None], ...]):
        self.known: dict[bytes, int] = {}
        self.items: list[tuple[int, int | None, np.ndarray, np.ndarray]] = []
        for at, item_id, text in rows:
            _, own = counted((text or "").encode())
            terms = [self.known.setdefault(w, len(self.known)) for w in own]
            self.items.append((at, item_id, np.array(terms, np.int64), np.array(list(own.values()), np.int64)))


@lru_cache(maxsize=1)
def _items(rows: tuple[tuple[int, int | None, str | None], ...]) -> Items:
    return Items(rows)


def _blocks(items: DataFrame, block_chars: int) -> list[Broadcast]:
    """Broadcast blocks of (place, item_id, text). Items stream over the driver one partition at a time."""
    out, own, held = [], [], 0
    for at, (item_id, text) in enumerate(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()):
        if own and held + len(text or "") > block_chars:
            out.append(tuple(own))
            own, held = [], 0
        own.append((at, item_id, text))
        held += len(text or "")
    return [items.sparkSession.sparkContext.broadcast(b) for b in [*out, tuple(own)]]


def _posted(block: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _items(block.value).known
        for batch in slices(batches):
            sizes, terms, counts = [], [], []
            for body in batch["body"]:
                n, own = counted(body.as_py(), known)
                sizes.append(n)
                terms.append(list(own))
                counts.append(list(own.values()))
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

    return run


def _held(vocabulary: int):
    """How many documents of a task hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(batch["terms"].flatten().to_numpy(), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    return run


def by_mask(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal columns of a 0/1 matrix (terms by documents): (a column of each group, each column's group)."""
    packed = np.packbits(present, axis=0)
    packed = np.pad(packed, ((0, -len(packed) % 8), (0, 0)))
    words64 = np.ascontiguousarray(packed.T).view(np.uint64)
    group = np.zeros(len(words64), np.int64)
    for chunk in words64.T:  # 64 terms at a time
        _, own = np.unique(chunk, return_inverse=True)
        _, first, group = np.unique(group * (own.max() + 1) + own, return_index=True, return_inverse=True)
    return first, group


class Best:
    """The best documents of one item so far."""

    def __init__(self, k: int):
        self.k, self.found = k, []

    @property
    def least(self) -> int:
        """Scores below this one cannot enter."""
        return -self.found[-1][0] if len(self.found) == self.k else 1

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        least = self.least
        new = [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids, strict=True) if s >= least]
        if new:
            self.found = sorted(self.found + new)[: self.k]


class Slice:
    """Documents with their query terms: bitmaps, what each term adds, and the most it adds to any of them."""

    def __init__(self, doc_ids: list[int | None], sizes: list[int], lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray, n: int, total: int):
        self.doc_ids, self.terms = doc_ids, terms
        self.ends = np.cumsum(lengths)
        self.lengths = lengths
        m = np.array([25 + 75 * own * n // total for own in sizes], np.int64)  # of 100, 75 depend on the length
        doc = np.repeat(np.arange(len(lengths)), lengths)
        self.adds = weight[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[doc]))
        self.here, row = np.unique(terms, return_inverse=True)
        self.most = np.zeros(len(self.here), np.int64)
        np.maximum.at(self.most, row, self.adds)
        self.bitmaps = np.zeros((len(self.here), (len(lengths) + 7) // 8), np.uint8)
        np.bitwise_or.at(self.bitmaps, (row, doc >> 3), (1 << (doc & 7)).astype(np.uint8))

    def scores(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``times``: how often the item has each term of the vocabulary."""
        lengths = self.lengths[docs]
        edges = np.concatenate(([0], np.cumsum(lengths)))
        at = np.arange(edges[-1]) + np.repeat(self.ends[docs] - lengths - edges[:-1], lengths)
        return np.add.reduceat(times[self.terms[at]] * self.adds[at], edges[:-1])

    def search(self, terms: np.ndarray, times: np.ndarray, own: np.ndarray, best: Best) -> None:
        """``terms`` and ``times`` of an item, and ``own``: the same by the number of the term."""
        row = np.searchsorted(self.here, terms)
        row[row == len(self.here)] = 0
        held = self.here[row] == terms
        row, most = row[held], self.most[row[held]] * times[held]
        row, most = row[most > 0], most[most > 0]
        order = np.argsort(-most, kind="stable")
        row, most = row[order], most[order]
        rest = np.cumsum(most[::-1])[::-1]  # what this term and all after it can add together
        needed = int((rest >= best.least).sum())
        if not needed:
            return
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(self.bitmaps[row[:needed]], axis=0), bitorder="little"))
        present = np.unpackbits(self.bitmaps[row], axis=1, bitorder="little")[:, docs]
        first, group = by_mask(present)
        bound = most @ present[:, first].astype(np.int64)
        rank = np.empty(len(bound), np.int64)
        masks = np.argsort(-bound, kind="stable")
        rank[masks] = np.arange(len(masks))
        docs, sizes = docs[np.argsort(rank[group], kind="stable")], np.bincount(rank[group])
        ends, bound, at = np.cumsum(sizes), bound[masks], 0
        while at < len(bound) and bound[at] >= best.least:
            start = ends[at] - sizes[at]
            last = int(min(np.searchsorted(ends, start + RUN), len(bound) - 1))
            last = max(at, min(last, int((bound >= best.least).sum()) - 1))
            some = docs[start : ends[last]]
            best.add(self.scores(some, own), [self.doc_ids[i] for i in some])
            at = last + 1


def _searched(block: Broadcast, weights: Broadcast, n: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = _items(block.value).items, weights.value
        best, times = [Best(k) for _ in items], np.zeros(len(weight), np.int64)
        for batch in slices(batches, SLICE):
            lengths = np.diff(batch["terms"].offsets.to_numpy())
            terms, counts = batch["terms"].flatten().to_numpy().astype(np.int64), batch["counts"].flatten().to_numpy()
            own = Slice(batch["doc_id"].to_pylist(), batch["n"].to_pylist(), lengths, terms, counts, weight, n, total)
            for (_, _, wanted, often), found in zip(items, best, strict=True):
                times[wanted] = often
                own.search(wanted, often, times, found)
                times[wanted] = 0
        rows = [(at, item_id, None if null else doc_id, -s) for (at, item_id, _, _), found in zip(items, best, strict=True) for s, null, doc_id in found.found]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["item", "item_id", "doc_id", "score"])

    return run


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of each row of ``items`` (all with a score
    above 0, if fewer), equal scores by ascending doc_id (null last).

    Null and wordless texts are found by nothing and find nothing. Each row of ``docs`` is a document and each row of
    ``items`` an item of its own: repeated documents are ranked each for itself, one after the other, and a repeated
    item_id has a ranking for each of its rows. Without documents that have words there are no rows. Other columns
    than doc_id, item_id and text are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"))
    spark, out = docs.sparkSession, None
    for block in _blocks(items, block_chars):
        vocabulary = len(_items(block.value).known)
        rows = stored(slim.mapInArrow(_posted(block), _POSTINGS), "postings")
        n, total = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        some = rows.where(F.size("terms") > 0)
        weight = np.zeros(vocabulary, np.int64)
        for term, df in some.select("terms").mapInArrow(_held(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n")).collect():
            weight[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        found = some.mapInArrow(_searched(block, spark.sparkContext.broadcast(weight), n, total, k), _FOUND)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
