"""Operator 7: benchmark decontamination by pigeonhole edit matching.

Documents and items are compared in lower case with white space collapsed. An item of n characters may differ from a
stretch of a document in e = floor(n * ERROR_RATE) insertions, deletions and substitutions. It is cut into e + 1
pieces; e errors cannot touch all of them, so every match holds a piece exactly. One Aho-Corasick pass finds the
pieces; the stretches round their hits, merged where they overlap, are verified with Myers' bit-parallel distance.

Documents are read once, without a shuffle. Items are broadcast in blocks of at most BLOCK_CHARS characters; each
further block is one more pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ERROR_RATE = 0.06
BLOCK_CHARS = 4_000_000

_HITS = "doc_id long, item_id long, distance int, n_chars int, start int, end int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float) -> int:
    return int(n * rate + 1e-9)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(place, piece) of errors + 1 pieces of nearly one length."""
    n, k = len(item), errors + 1
    return [(i * n // k, item[i * n // k : (i + 1) * n // k]) for i in range(k)]


def myers(pattern: str, text: str) -> list[int]:
    """For each position of ``text``, the least edit distance of ``pattern`` to a stretch that ends there."""
    m, full = len(pattern), (1 << len(pattern)) - 1
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    up, down, score, last, out = full, 0, m, 1 << (m - 1), []
    for c in text:
        eq = equal.get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | x) & full
        plus, minus = (down | ~(d | up)) & full, up & d
        score += bool(plus & last) - bool(minus & last)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(x | plus)) & full, plus & x
        out.append(score)
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces(text, errors):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, own in places.items():
            self.automaton.add_word(piece, (len(piece), own))
        if places:
            self.automaton.make_automaton()

    def stretches(self, text: str) -> dict[int, list[list[int]]]:
        """For each item with a piece in ``text``, the merged stretches where it can lie."""
        found: dict[int, list[list[int]]] = {}
        for end, (length, own) in self.automaton.iter(text):
            for n, at in own:
                item = self.items[n]
                first = end + 1 - length - at
                found.setdefault(n, []).append([max(0, first - item[2]), first + len(item[1]) + item[2]])
        for n, spans in found.items():
            spans.sort()
            merged = [spans[0]]
            for s in spans[1:]:
                if s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(s)
            found[n] = merged
        return found

    def hits(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, n_chars, start, end) of the first best match of each item that ``text`` holds."""
        if not self.items:
            return []
        out = []
        for n, spans in sorted(self.stretches(text).items()):
            item_id, item, errors = self.items[n]
            best: tuple[int, int, int] | None = None
            for a, b in spans:
                exact = text.find(item, a, b)
                if exact >= 0:
                    near = (0, exact + len(item), len(item))
                else:
                    scores = myers(item, text[a:b])
                    low = min(scores, default=len(item))
                    end = a + scores.index(low) + 1 if scores else a
                    near = (low, end, 0)
                if near[0] <= errors and (best is None or near[:2] < best[:2]):
                    best = near
            if best:
                distance, end, length = best
                if not length:
                    back = text[max(0, end - len(item) - distance) : end][::-1]
                    length = myers(item[::-1], back).index(distance) + 1
                out.append((item_id, distance, len(item), end - length, end))
        return out


@lru_cache(maxsize=1)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(list(items), rate)


def _blocks(items: DataFrame, rate: float, block_chars: int) -> list[Broadcast]:
    """Broadcast blocks of (item_id, normalised text). Items stream over the driver one partition at a time."""
    spark, out, own, held = items.sparkSession, [], [], 0
    for item_id, text in items.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL").toLocalIterator():
        if own and held + len(text or "") > block_chars:
            out.append(spark.sparkContext.broadcast(tuple(own)))
            own, held = [], 0
        if text := normal(text):
            own.append((item_id, text))
            held += len(text)
    return [*out, spark.sparkContext.broadcast(tuple(own))]


def _found(block: Broadcast, rate: float):
    names = ["doc_id", "item_id", "distance", "n_chars", "start", "end"]
    kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block.value, rate)
        for batch in slices(batches):
            rows = [(d.as_py(), *hit) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for hit in matcher.hits(normal(t.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return run


def _clean(block: Broadcast, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block.value, rate)
        for batch in slices(batches):
            yield batch.filter(pa.array([not matcher.hits(normal(t.as_py())) for t in batch["text"]], pa.bool_()))

    return run


def benchmark_hits(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, distance (edits), n_chars (of the item),
    start and end of the first best match in the normalised text.

    Null or blank texts hold and match nothing; an item without an id is left out; two items with one text both
    match; rows that repeat another are searched each for itself. Other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in _blocks(items, rate, block_chars):
        own = slim.mapInArrow(_found(block, rate), _HITS)
        out = own if out is None else out.unionByName(own)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs``, all columns, without the rows that hold an item."""
    for block in _blocks(items, rate, block_chars):
        docs = docs.mapInArrow(_clean(block, rate), docs.schema)
    return docs
