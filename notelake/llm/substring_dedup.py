"""Operator 3: removal of 20-word windows that occur earlier, with a count-min prefilter.

First pass: every partition counts the anchors of its windows (see anchors.py) in a count-min sketch and hands on the
cells it touched; cells of all partitions are added up segment by segment. Each occurrence of a window is also one
occurrence of its anchor, so the merged sketch never underestimates a window's count. Only one bit a cell, "two or
more", is broadcast: DEPTH * width / 8 bytes, at most MAX_WIDTH / 4.
Second pass: windows whose estimate is two or more are grouped exactly, none is lost; the others cannot be repeated.
Equal runs of windows are grouped as one row of fixed size first, so copies of a passage are not expanded. Windows are
spelled out, in a pass over the documents concerned, only for the first of equal runs whose anchor also stands in
other text. Runs and windows that very many documents share meet their first places by a broadcast (``met``).

At MAX_WIDTH the sketch stops growing, at about 90 million anchors or 4 GB of text: beyond that more and more windows
pass that are not repeated (most of them at 30 GB), which costs work in the second pass and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import covered, mix, runs
from .common import discard, keyed, met, same_document, slices, stored

WORDS = 20
GRAM = 8
DEPTH = 2
#: Cells of a row: a power of two, about three for an anchor, at most MAX_WIDTH (a broadcast of 64 MiB).
MAX_WIDTH = 1 << 28
SEGMENT = 1 << 18

_BASE = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
#: Windows that a task spells out at once.
CHUNK = 500_000
_FOUND = "doc_id long, dk long, k long, f long, lo int, hi int"
_EACH = "k long, w long, doc_id long, dk long, lo int"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _joint(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = out * _BASE + h[i : i + len(out)]
    return mix(mix(out))


def _hashed(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    if len(known) > 500_000:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _anchored(words: list[bytes], size: int, gram: int, known: dict) -> tuple[np.ndarray, ...]:
    """Hashes of the words, then (lo, hi, k) of each anchor."""
    h = _hashed(words, known)
    grams = _joint(h, gram)
    lo, hi, b = runs(grams, size - gram + 1, len(words) - size + 1)
    return h, lo, hi, mix(grams[b] ^ _SEEDS[0])


def _cells(k: np.ndarray, width: int) -> list[np.ndarray]:
    return [mix(k ^ s) & np.uint64(width - 1) for s in _SEEDS[:DEPTH]]


def _sketch(size: int, gram: int, width: int):
    """A partition's sketch: for each row and segment, the cells touched once and those touched more often."""
    segment = min(SEGMENT, width)

    def flush(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k = np.concatenate(found)
        for row, cells in enumerate(_cells(k, width)):
            cells, n = np.unique(cells, return_counts=True)
            at = np.searchsorted(cells, np.arange(0, width + 1, segment, dtype=np.uint64))
            part = [i for i in range(len(at) - 1) if at[i] < at[i + 1]]
            once, more = [], []
            for i in part:
                own, many = (cells[at[i] : at[i + 1]] & np.uint64(segment - 1)).astype("<u4"), n[at[i] : at[i + 1]] > 1
                once.append(own[~many].tobytes())
                more.append(own[many].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([row * (width // segment) + i for i in part], pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["segment", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        found, held = [], 0
        for batch in batches:
            for body in batch["body"]:
                words = body.as_py().split()
                if len(words) >= size:
                    found.append(_anchored(words, size, gram, known)[3])
                    held += len(found[-1])
                if held > 4_000_000:
                    yield from flush(found)
                    found, held = [], 0
        if held:
            yield from flush(found)

    return run


def _merged(width: int):
    """Adds up a segment's cells from all partitions, one row at a time, in an array of fixed size."""
    segment = min(SEGMENT, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, once, more in zip(*(batch[c].to_pylist() for c in ("segment", "once", "more")), strict=True):
                seen, many = counts.setdefault(s, (np.zeros(segment, bool), np.zeros(segment, bool)))
                one, two = np.frombuffer(once, "<u4"), np.frombuffer(more, "<u4")
                many[one[seen[one]]] = True
                many[two] = True
                seen[one] = True
                seen[two] = True
        for s, (_, many) in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(many, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    return run


def _repeated(size: int, gram: int, width: int, sketch):
    """Runs of windows that the sketch takes for repeated; f is a hash of all words of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = np.frombuffer(sketch.value, np.uint8), {}
        names = ["doc_id", "dk", "k", "f", "lo", "hi"]
        for batch in batches:
            sizes, out = [], []
            for body in batch["body"]:
                words = body.as_py().split()
                sizes.append(0)
                if len(words) < size:
                    continue
                h, lo, hi, k = _anchored(words, size, gram, known)
                keep = np.ones(len(k), bool)
                for row, cell in enumerate(_cells(k, width)):
                    cell = cell.astype(np.int64) + row * width
                    keep &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
                if not keep.any():
                    continue
                sizes[-1] = int(keep.sum())
                lo, hi, k = lo[keep], hi[keep], k[keep]
                f = [xxhash.xxh3_64_intdigest(h[a : b + size].tobytes()) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                out.append((k, np.array(f, np.uint64), lo, hi))
            if not out:
                continue
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            k, f, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), batch["dk"].take(at), pa.array(k.view(np.int64)), pa.array(f.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=names)

    return run


def _spelled(size: int):
    """One row for each window of a document's listed runs."""
    names = ["k", "w", "doc_id", "dk", "lo"]

    def flush(out: list[tuple]) -> pa.RecordBatch:
        n = [len(w) for _, w, _, _, _ in out]
        fixed = [pa.array([row[i] for row in out], pa.int64()).take(pa.array(np.repeat(np.arange(len(out)), n))) for i in (0, 2, 3)]
        w = np.concatenate([row[1] for row in out]).view(np.int64)
        lo = np.concatenate([np.arange(row[4], row[4] + len(row[1]), dtype=np.int32) for row in out])
        return pa.RecordBatch.from_arrays([fixed[0], pa.array(w), fixed[1], fixed[2], pa.array(lo)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        out, held = [], 0
        for batch in slices(batches):
            for doc_id, dk, body, own in zip(*(batch[c] for c in ("doc_id", "dk", "body", "runs")), strict=True):
                ws = _joint(_hashed(body.as_py().split(), known), size)
                for r in own.as_py():
                    out.append((r["k"], ws[r["lo"] : r["hi"] + 1], doc_id.as_py(), dk.as_py(), r["lo"]))
                    held += r["hi"] + 1 - r["lo"]
                if held > CHUNK:
                    yield flush(out)
                    out, held = [], 0
        if out:
            yield flush(out)

    return run


def _removed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for body, ranges in zip(batch["body"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
                words, n = body.split(), 0
                total = len(words)
                if ranges:
                    at = np.array([(r["lo"], r["hi"]) for r in ranges], np.int64)
                    gone = covered(at[:, 0], at[:, 1], size, total)
                    n = int(gone.sum())
                    words = [words[i] for i in np.flatnonzero(~gone)]
                out.append((total, n, hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.string()]))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def sketched(bodies: DataFrame, size: int, gram: int, max_width: int) -> tuple[bytes, int]:
    """The merged sketch, one bit a cell, and its width."""
    spark = bodies.sparkSession
    total = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    anchors = total / 6 * 2 / (size - gram + 2)  # about six bytes a word
    width = 1 << 16
    while width < 3 * anchors and width < max_width:
        width *= 2
    segments = DEPTH * width // min(SEGMENT, width)
    cells = bodies.mapInArrow(_sketch(size, gram, width), "segment long, once binary, more binary")
    merged = cells.repartition(min(segments, 256), "segment").mapInArrow(_merged(width), "segment long, bits binary").collect()
    block = min(SEGMENT, width) // 8
    bits = bytearray(DEPTH * width // 8)
    for s, own in merged:
        bits[s * block : (s + 1) * block] = own
    return bytes(bits), width


def earlier_ranges(docs: DataFrame, size: int = WORDS, gram: int = GRAM, max_width: int = MAX_WIDTH) -> DataFrame:
    """``doc_id, dk, lo, hi``: every window that starts in words lo..hi also starts earlier."""
    bodies = keyed(docs)
    spark = docs.sparkSession
    bits, width = sketched(bodies, size, gram, max_width)
    found = stored(bodies.mapInArrow(_repeated(size, gram, width, spark.sparkContext.broadcast(bits)), _FOUND), "windows")
    place = F.struct("doc_id", "dk", "lo")
    texts = stored(found.groupBy("k", "f").agg(F.min(F.struct("doc_id", "dk", "lo", "hi")).alias("one"), F.count("*").alias("c")), "runs")
    again = met(found, texts.where("c > 1").select("k", "f", F.struct("one.doc_id", "one.dk", "one.lo").alias("first"), "c"), ["k", "f"], "c")
    later = stored(again.where(~place.eqNullSafe(F.col("first"))).select("doc_id", "dk", "lo", "hi"), "later")
    discard(found)

    several = texts.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k")
    own = texts.join(several, "k", "left_semi").select("k", "one.*").groupBy("doc_id", "dk").agg(F.collect_list(F.struct("k", "lo", "hi")).alias("runs"))
    listed = bodies.join(own, same_document(bodies, own)).select(bodies["doc_id"], bodies["dk"], "body", "runs")
    each = stored(listed.mapInArrow(_spelled(size), _EACH), "each")
    discard(texts)
    first = stored(each.groupBy("k", "w").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    more = met(each, first, ["k", "w"], "n").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "dk", "lo", F.col("lo").alias("hi"))
    return later.unionByName(more)


def substring_dedup(docs: DataFrame, **settings: int) -> DataFrame:
    """Per row of ``docs``: n_words, n_removed and the SHA-256 of the words that stay, joined by one space.

    A null or blank text has no words; a null doc_id comes before all others; among rows with one doc_id the smaller
    text hash comes first, and a row that repeats another in full is the same document. Other columns are not read.
    """
    size = settings.get("size", WORDS)
    ranges = earlier_ranges(docs, **settings).groupBy("doc_id", "dk").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    bodies = keyed(docs)
    marked = bodies.join(ranges, same_document(bodies, ranges), "left").select(bodies["doc_id"], "body", "ranges")
    return marked.mapInArrow(_removed(size), _RESULT)
