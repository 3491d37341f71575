"""Operator 1: removal of byte strings that occur more than once, by prefix-free parsing.

The corpus is parsed at rolling-hash triggers (8-byte hashes that are smallest in a window of SPAN, so there are no
long stretches without a trigger) into phrases. The text from a trigger on is that parse suffix's context; the bytes
before it, back to where the trigger takes over, are the dictionary phrase. Every string of LENGTH bytes is one
phrase suffix plus a prefix of one context. So corpus order, cut off at LENGTH bytes, follows from two sorted lists:
phrases sorted from their right end (the suffix array of the dictionary) and contexts (that of the parse), each with
the common lengths of neighbours. Two strings are equal if they lie in one class of both lists.

Two 64-bit hashes of different stretches (k and f, or k and w) must agree before bytes count as equal unseen.

Scale: parse suffixes meet on a hash of the bytes that any string through the trigger must share; nearly all stand
alone there and go no further. Whole copies fall together by a second hash and are never expanded. Bytes are read
again only for one representative of each distinct text round a shared trigger. Those are sorted in shards of a
bounded number of rows; groups with more distinct representatives than a shard holds take the same comparison as a
plain aggregation of their strings instead, so no group is gathered in one task.
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

LENGTH = 400
SPAN = 256
#: Distinct representatives of one shared trigger that are sorted together, and rows of a shard.
HOT_GROUP = 4_000
SHARD_ROWS = 40_000
#: Rows of one key from which a join broadcasts the key.
HOT = 20_000

_PARSE = "doc_id long, dk long, k long, f long, lo int, hi int, b int"
_BYTES = "doc_id long, dk long, k long, f long, c long, lo int, hi int, b int, phrase binary, context binary"
_STARTS = "doc_id long, dk long, lo int, hi int"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def parse(body: bytes, length: int, span: int) -> tuple[np.ndarray, ...]:
    """(lo, hi, b, k, f) of each trigger b: strings starting in lo..hi are its own; k hashes the bytes from b on that
    all of these contain, f all bytes of all these strings."""
    n = len(body) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    grams = np.ndarray((len(body) - 7,), "<u8", body, 0, (1,))
    lo, hi, b = runs(mix(grams), span, n)
    view, must = memoryview(body), length - span + 1
    k = _signed([xxhash.xxh3_64_intdigest(view[x : x + must]) for x in b.tolist()])
    f = _signed([xxhash.xxh3_64_intdigest(view[x : y + length], z - x) for x, y, z in zip(lo.tolist(), hi.tolist(), b.tolist(), strict=True)])
    return lo, hi, b, k, f


def _parsed(length: int, span: int):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "dk", "k", "f")] + [(c, pa.int32()) for c in ("lo", "hi", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, sizes = [], []
            for body in batch["body"]:
                out.append(parse(body.as_py(), length, span))
                sizes.append(len(out[-1][0]))
            if not out:
                continue
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            lo, hi, b, k, f = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), batch["dk"].take(at), pa.array(k), pa.array(f), *(pa.array(x.astype(np.int32)) for x in (lo, hi, b))], schema=schema)

    return run


def _cut(length: int):
    names = ("doc_id", "dk", "k", "f", "c", "lo", "hi", "b", "phrase", "context")
    kinds = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, dk, body, marks in zip(*(batch[c].to_pylist() for c in ("doc_id", "dk", "body", "marks")), strict=True):
                rows += [(doc_id, dk, m["k"], m["f"], m["c"], m["lo"], m["hi"], m["b"], body[m["lo"] : m["b"]], body[m["b"] : m["hi"] + length]) for m in marks]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(names))

    return run


def _ordered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each text in sorted order, and the common length of each text with the one before it in that order."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    rank = np.empty(len(texts), np.int64)
    rank[order] = np.arange(len(texts))
    wide = max(map(len, texts), default=0)
    rows = np.frombuffer(b"".join(texts[i].ljust(wide, b"\0") for i in order), np.uint8).reshape(len(texts), wide)
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    common = np.zeros(len(texts), np.int64)
    if wide and len(texts) > 1:
        differ = rows[1:] != rows[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), wide)
        common[1:] = np.minimum(common[1:], np.minimum(lengths[1:], lengths[:-1]))
    return rank, common


def repeated_starts(phrases: list[bytes], contexts: list[bytes], copies: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(row, x) of each string that occurs again: it starts x bytes before the row's trigger, least <= x <= most.
    A row that stands for two or more copies repeats throughout and is left out."""
    left, left_common = _ordered([p[::-1] for p in phrases])  # dictionary, in the order of phrase suffixes
    right, right_common = _ordered(contexts)  # parse
    found = []
    for x in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        on = np.flatnonzero((least <= x) & (x <= most))
        if len(on) < 2:
            continue
        both = np.cumsum(left_common < x)[left[on]] * (len(contexts) + 1) + np.cumsum(right_common < length - x)[right[on]]
        _, of, n = np.unique(both, return_inverse=True, return_counts=True)
        found += [(int(r), x) for r in on[(n[of] > 1) & (copies[on] < 2)]]
    return found


def _sorted_shards(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        lo, hi, b, c = (t[x].to_numpy() for x in ("lo", "hi", "b", "c"))
        found = repeated_starts(t["phrase"].to_pylist(), t["context"].to_pylist(), c, b - hi, b - lo, length)
        if found:
            row, x = np.array(found, np.int64).T
            start = pa.array((b[row] - x).astype(np.int32))
            yield pa.RecordBatch.from_arrays([t[n].combine_chunks().take(pa.array(row)) for n in ("doc_id", "dk")] + [start, start], names=["doc_id", "dk", "lo", "hi"])

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for body, ranges in zip(batch["body"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
                if not ranges:
                    out.append((len(body), 0, 0, hashlib.sha256(body).hexdigest()))
                    continue
                at = np.array([(r["lo"], r["hi"]) for r in ranges], np.int64)
                gone = covered(at[:, 0], at[:, 1], length, len(body))
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                out.append((len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64()] * 3 + [pa.string()]))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, span: int = SPAN, hot_group: int = HOT_GROUP, shard_rows: int = SHARD_ROWS, hot: int = HOT) -> DataFrame:
    """``doc_id, dk, lo, hi``: every string of ``length`` bytes that starts in lo..hi also starts elsewhere."""
    if not 8 <= span <= length - 7:
        raise ValueError("span must leave the trigger's 8 bytes inside every string")
    bodies = keyed(docs)
    rows = stored(bodies.where(F.length("body") >= length).mapInArrow(_parsed(length, span), _PARSE), "parse")
    shared = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("f").alias("f0"), F.max("f").alias("f1")).where("n > 1")
    shared = stored(shared.selectExpr("k", "n", "f0 = f1 AS pure"), "shared")
    both = stored(met(rows, shared, ["k"], "n", hot), "met")
    discard(rows)
    mixed = both.where("NOT pure")
    texts = stored(
        mixed.groupBy("k", "f").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "dk", "lo", "hi", "b")).alias("one")).select("k", "f", "c", "one.*"), "texts"
    )
    copies = met(mixed, texts.where("c > 1").select("k", "f", "c"), ["k", "f"], "c", hot)
    whole = both.where("pure").select("doc_id", "dk", "lo", "hi").unionByName(copies.select("doc_id", "dk", "lo", "hi"))

    marks = texts.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("k", "f", "c", "lo", "hi", "b")).alias("marks"))
    once = bodies.join(marks, same_document(bodies, marks)).select(bodies["doc_id"], bodies["dk"], "body", "marks")
    cut = stored(once.mapInArrow(_cut(length), _BYTES).dropDuplicates(["k", "f"]), "cut")
    sizes = cut.groupBy("k").agg(F.count("*").alias("m"))
    large = sizes.where(F.col("m") > hot_group).select("k")
    shards = 1 + cut.count() // shard_rows
    some = cut.join(large, "k", "left_anti").repartition(shards, "k").mapInArrow(_sorted_shards(length), _STARTS)

    every = stored(
        cut.join(large, "k", "left_semi")
        .withColumn("x", F.explode(F.expr("sequence(b - hi, b - lo)")))
        .withColumn("s", F.expr("concat(substring(phrase, length(phrase) - x + 1, x), substring(context, 1, %d - x))" % length))
        .select("doc_id", "dk", "k", "c", (F.col("b") - F.col("x")).alias("lo"), F.xxhash64("s").alias("w")),
        "every",
    )
    again = stored(every.groupBy("k", "w").agg(F.sum("c").alias("n")).where("n > 1"), "again")
    spread = met(every.where("c = 1"), again, ["k", "w"], "n", hot).select("doc_id", "dk", "lo", F.col("lo").alias("hi"))
    return whole.unionByName(some).unionByName(spread)


def suffix_dedup(docs: DataFrame, **settings: int) -> DataFrame:
    """Per row of ``docs``: n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay.

    A null text is empty and keeps nothing; a text under ``length`` bytes is kept whole; rows with a null doc_id, and
    rows that repeat another, count as documents of their own. Other columns are not read.
    """
    length = settings.get("length", LENGTH)
    ranges = repeated_ranges(docs, **settings).groupBy("doc_id", "dk").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    bodies = keyed(docs)
    marked = bodies.join(ranges, same_document(bodies, ranges), "left").select(bodies["doc_id"], "body", "ranges")
    return marked.mapInArrow(_removed(length), _RESULT)
