"""Operator 2: language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels, level(n) = 1 + floor(log2 n), and n-gram x is put into the
filter as (x, 1) ... (x, level). A count is read by probing level after level until one is missing, so it can come out
too high (a false positive) but never too low. A pair's probability mixes its quantised count with the word's
(Dirichlet smoothing with mass MU). Every word and every pair of the training rows is in the filter.

The filter is made where the counts are, BITS_EACH bits an entry or more. That of the words is broadcast: it grows
with the vocabulary only. That of the pairs grows with the text, so it is never held whole: pairs are dealt to segments
by the first bits of their keys, a task fills a segment from its counts, and the segments are rows of a stored table.
To score, each task sends its documents' pairs to the segments, in one packed row a segment and chunk; sums for a chunk's
documents come back, packed in one row from each task that holds segments, and are added up by chunk. Pairs with at least 1 / HEAD of all tokens are read from their segments beforehand and broadcast,
so no segment gets a stretch of the text that does not shrink with more segments.

The base score needs exact counts: those of the most frequent words (at most HEAD, 16 bytes each) are broadcast, the
others are joined. Words are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mix
from .common import stored, utf8

HEAD = 1 << 18
BITS_EACH = 8
PROBES = 3
SEGMENTS = 256
MU = 50.0
#: Tokens handled at once in a task.
CHUNK = 1_000_000
#: Training tokens of a task that fills segments of the pairs' filter.
TASK_TOKENS = 1_500_000

END = xxhash.xxh3_64_intdigest(b" ")  # no word holds a space
_PAIR = np.uint64(0x9FB21C651E98DF25)
_LEVEL = np.uint64(0xC2B2AE3D27D4EB4F)
#: A document, or (row is null) what some segments add to documents of the chunk that begins with row ``first``.
_SCORED = "first long, packed binary, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<t:long,n:long>>"
#: Rows on their way to the segments; kind: 0 a segment, 1 pairs of a chunk, 2 a document.
_SENT = "segment long, kind int, " + _SCORED
_FILTER, _PAIRS, _DOCUMENT = range(3)


def words(body: bytes) -> list[bytes]:
    return body.lower().split()


def _chunks(bodies: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, documents' ends in tokens, distinct token hashes, each token's place in these)."""
    at, ends, known, places = 0, [], {None: 0}, []
    for i, body in enumerate(bodies):
        own = words(body)
        places += [known.setdefault(w, len(known)) for w in own]
        places.append(0)
        ends.append(len(places))
        if len(places) >= CHUNK or i == len(bodies) - 1:
            hashes = [END, *(xxhash.xxh3_64_intdigest(w) for w in list(known)[1:])]
            yield at, np.array(ends), np.array(hashes, np.uint64), np.array(places)
            at, ends, known, places = i + 1, [], {None: 0}, []


def pairs(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys of each token with the one before it; an end also stands before a document's first word."""
    now = hashes[places]
    return mix(mix(np.append(np.uint64(END), now[:-1]) * _PAIR) + now)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, of = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(of, np.concatenate(counts), len(key)).astype(np.int64)


def _added_up(counted, emit):
    """Counts of ``counted(hashes, places)``, added up within a task as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, _, hashes, places in _chunks(batch["body"].to_pylist()):
                key, n = counted(hashes, places)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > 4_000_000:
                    yield emit(*_merged(keys, counts))
                    keys, counts, held = [], [], 0
        if held:
            yield emit(*_merged(keys, counts))

    return run


def _counted_words():
    return _added_up(
        lambda hashes, places: (hashes, np.bincount(places, minlength=len(hashes))),
        lambda key, n: pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["t", "n"]),
    )


def _counted_pairs(segments: int):
    def emit(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at, ends = _stretches(segment_of(key, segments))
        packed = [pa.array([x[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary()) for x in (key, n)]
        return pa.RecordBatch.from_arrays([pa.array(segment_of(key[at], segments)), *packed], names=["segment", "keys", "counts"])

    return _added_up(lambda hashes, places: np.unique(pairs(hashes, places), return_counts=True), emit)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each key: its first bits (``segments`` is a power of two, 2 at least)."""
    return (keys >> np.uint64(65 - segments.bit_length())).astype(np.int64)


def _stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one value."""
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return at, np.append(at[1:], len(values))[: len(at)]


def levels(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1]


def level_count(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    return np.where(level > 0, (np.exp2(level - 1.0) + np.exp2(level.astype(np.float64)) - 1) / 2, 0.0)


def _bits(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """Probe positions of (key, level); a key's segment is its own remainder, so all its entries lie in one."""
    size = np.uint64(bits // SEGMENTS)
    segment = (keys % np.uint64(SEGMENTS)) * size
    h = mix(keys + np.uint64(level * int(_LEVEL) % (1 << 64)))
    step = mix(h ^ _PAIR) | np.uint64(1)
    for i in range(PROBES):
        yield segment + (h + np.uint64(i) * step) % size


def probe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key, from probes of levels 1, 2, ... up to the first that is missing."""
    found, asked, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    while len(asked):
        level += 1
        there = np.ones(len(asked), bool)
        for at in _bits(keys[asked], level, len(bits) * 8):
            there &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        asked = asked[there]
        found[asked] = level
    return found


def _filled(bits: int):
    """The segments of one partition; each n-gram (t, n) is entered at all its levels."""
    size = bits // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, most = batch["t"].to_numpy().view(np.uint64), levels(batch["n"].to_numpy())
            for level in range(1, int(most.max(initial=0)) + 1):
                for at in _bits(keys[most >= level], level, bits):
                    segment = (at // np.uint64(size)).astype(np.int64)
                    for s in np.unique(segment).tolist():
                        own.setdefault(s, np.zeros(size, bool))[(at[segment == s] - np.uint64(s * size)).astype(np.int64)] = True
        for s, flags in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    return run


def _size(entries: int) -> int:
    bits = 1 << 16
    while bits < entries * BITS_EACH:
        bits *= 2
    return bits


def log_frequency_filter(ngrams: DataFrame, entries: int) -> np.ndarray:
    """The filter of ``ngrams`` (t: key, n: count), made by the executors part by part."""
    bits = _size(entries)
    segment = F.pmod(F.col("t"), F.lit(SEGMENTS))  # of the signed key; SEGMENTS is a power of two
    made = ngrams.repartition(min(SEGMENTS, 1 + entries // 500_000), segment).mapInArrow(_filled(bits), "segment long, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for s, own in made:
        out[s * (bits // SEGMENTS // 8) :][: bits // SEGMENTS // 8] = np.frombuffer(own, np.uint8)
    return out


def _filter_of(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    most = levels(n)
    flags = np.zeros(_size(int(most.sum())), bool)
    for level in range(1, int(most.max(initial=0)) + 1):
        for at in _bits(keys[most >= level], level, len(flags)):
            flags[at.astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


def _segments(hot: int):
    """Filters of the segments of one partition, with the keys that occur ``hot`` times or more and their levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for s, keys, counts in zip(*(batch[c].to_pylist() for c in ("segment", "keys", "counts")), strict=True):
                held = own.setdefault(s, ([], []))
                held[0].append(np.frombuffer(keys, np.uint64))
                held[1].append(np.frombuffer(counts, np.int64))
        for s in list(own):
            keys, n = _merged(*own.pop(s))
            bits = _filter_of(keys, n)
            often = keys[n >= hot]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s]), *(pa.array([x.tobytes()], pa.binary()) for x in (bits, often, probe(bits, often).astype(np.uint8)))], names=["segment", "bits", "hot", "hot_levels"]
            )

    return run


def _log_p(seen: np.ndarray, context: np.ndarray, alone: np.ndarray, unit: float) -> np.ndarray:
    """Of a word after another, from the levels of the pair, of the word before and of the word."""
    context = level_count(context)
    return np.log10((np.minimum(level_count(seen), context) + MU * (level_count(alone) + 0.5) / unit) / (context + MU))


def _scores(model):
    """Documents with all that is known without the segments, and the pairs that these are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        unit, segments = m["unit"], m["segments"]
        for batch in batches:
            rows = batch["row"].to_numpy()
            for start, ends, hashes, places in _chunks(batch["body"].to_pylist()):
                at = np.minimum(np.searchsorted(m["head"], hashes), max(0, len(m["head"]) - 1))
                exact = m["head_n"][at] * (m["head"][at] == hashes) if len(m["head"]) else np.zeros(len(hashes), np.int64)
                base = np.where(exact > 0, np.log10((exact + 0.5) / unit), 0.0)[places]
                known = (exact > 0)[places]
                level = probe(m["bits"], hashes).astype(np.uint8)
                alone, context = level[places], level[np.append(0, places[:-1])]
                key = pairs(hashes, places)
                seen, ask = _hot_levels(key, m["hot"], m["hot_levels"])
                ask &= (alone > 0) & (context > 0)  # else the pair has not been met
                first = np.append(0, ends[:-1])
                add = lambda x, first=first: np.add.reduceat(x, first)
                score = add(np.where(ask, 0.0, _log_p(seen, context, alone, unit)))
                tails = [np.unique(hashes[places[a:b][~known[a:b]]].view(np.int64), return_counts=True) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                tail_ends = pa.array(np.concatenate(([0], np.cumsum([len(t) for t, _ in tails]))).astype(np.int32))
                pair = pa.StructArray.from_arrays([pa.array(np.concatenate([x[i] for x in tails]).astype(np.int64)) for i in (0, 1)], names=["t", "n"])
                own = rows[start : start + len(ends)]
                here = {
                    "segment": pa.array(own & (segments - 1)), "row": pa.array(own), "doc_id": batch["doc_id"].slice(start, len(ends)), "held_out": batch["held_out"].slice(start, len(ends)),
                    "n_tokens": pa.array(ends - first), "n_known": pa.array(add(known.astype(np.int64))), "base": pa.array(add(base)), "score": pa.array(score), "tail": pa.ListArray.from_arrays(tail_ends, pair),
                }
                yield _sent(_DOCUMENT, here)
                if own[-1] - own[0] != len(own) - 1:
                    raise ValueError("rows are not numbered in order")
                asked = np.flatnonzero(ask)
                segment = segment_of(key[asked], segments)
                order = np.argsort(segment.astype(np.uint16 if segments <= 1 << 16 else np.int64), kind="stable")
                asked, segment = asked[order], segment[order]
                of = np.repeat(np.arange(len(ends), dtype=np.uint32), ends - first)
                a, b = _stretches(segment)
                packed = [b"".join(x[asked[i:j]].tobytes() for x in (key, of, context, alone)) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                yield _sent(_PAIRS, {"segment": pa.array(segment[a]), "first": pa.array(np.full(len(a), own[0])), "packed": pa.array(packed, pa.binary())})

    return run


def _hot_levels(key: np.ndarray, hot: np.ndarray, hot_levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of keys that are in ``hot`` (sorted), 0 for others; which are not."""
    if not len(hot):
        return np.zeros(len(key), np.uint8), np.ones(len(key), bool)
    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
    there = hot[at] == key
    return np.where(there, hot_levels[at], 0), ~there


def _sent(kind: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(columns["segment"])
    kinds = {"segment": pa.int64(), **_KINDS}
    every = {"kind": pa.array(np.full(n, kind, np.int32))} | columns
    names = ["segment", "kind", *_KINDS]
    return pa.RecordBatch.from_arrays([every[c] if c in every else pa.nulls(n, kinds[c]) for c in names], names=names)


_KINDS = {
    "first": pa.int64(), "packed": pa.binary(), "row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(),
    "tail": pa.list_(pa.struct([("t", pa.int64()), ("n", pa.int64())])),
}


def _answered(unit: float):
    """Documents as they came, and for each chunk one packed row of what the partition's segments add to its documents.
    A segment's filter comes before its pairs; one without filter has met none."""

    def summed(found: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        packed = []
        for own in found.values():
            doc, of = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
            packed.append(doc.astype("<u4").tobytes() + np.bincount(of, np.concatenate([x[1] for x in own]), len(doc)).astype("<f8").tobytes())
        have = {"first": pa.array(list(found), pa.int64()), "packed": pa.array(packed, pa.binary())}
        return pa.RecordBatch.from_arrays([have[c] if c in have else pa.nulls(len(packed), k) for c, k in _KINDS.items()], names=list(_KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, of, found, held = np.zeros(1 << 13, np.uint8), -1, {}, 0
        for batch in batches:
            kind = batch["kind"].to_numpy()
            documents = np.flatnonzero(kind == _DOCUMENT)
            if len(documents):
                yield batch.select(list(_KINDS)).take(pa.array(documents))
            segment, first, packed = batch["segment"].to_numpy(), batch["first"], batch["packed"]
            for i in np.flatnonzero(kind != _DOCUMENT).tolist():
                if segment[i] != of:
                    bits, of = np.zeros(1 << 13, np.uint8), segment[i]
                blob = packed[i].as_py()
                if kind[i] == _FILTER:
                    bits = np.frombuffer(blob, np.uint8)
                    continue
                n = len(blob) // 14
                key, doc = np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint32, n, 8 * n)
                context, alone = np.frombuffer(blob, np.uint8, n, 12 * n), np.frombuffer(blob, np.uint8, n, 13 * n)
                a, _ = _stretches(doc)
                found.setdefault(first[i].as_py(), []).append((doc[a], np.add.reduceat(_log_p(probe(bits, key), context, alone, unit), a)))
                held += len(a)
                if held > 2_000_000:
                    yield summed(found)
                    found, held = {}, 0
        if held:
            yield summed(found)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of row and part: the sums of each chunk's packed rows, which follow each other."""
    now, total = None, np.zeros(0)

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(now + at), pa.array(total[at])], names=["row", "part"])

    for batch in batches:
        for first, blob in zip(batch["first"].to_pylist(), batch["packed"].to_pylist(), strict=True):
            if first != now:
                if now is not None:
                    yield done()
                now, total = first, np.zeros(0)
            n = len(blob) // 12
            doc, own = np.frombuffer(blob, "<u4", n), np.frombuffer(blob, "<f8", n, 4 * n)
            if n and doc[-1] >= len(total):
                total = np.append(total, np.zeros(int(doc[-1]) + 1 - len(total)))
            total[doc] += own
    if now is not None:
        yield done()


def _threshold(sizes: list[tuple[int, int]], most: int) -> int:
    """The least count that at most ``most`` words reach; sizes: (count, words that have it)."""
    left, least = most, max((n for n, _ in sizes), default=0) + 1
    for n, k in sorted(sizes, reverse=True):
        if k > left:
            break
        left, least = left - k, n
    return least


def lm_scores(docs: DataFrame, held_out, head: int = HEAD, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``held_out`` is a Boolean column of ``docs``; where it is null the row trains. A null or blank text is its end
    token alone. Without training rows every word is unknown. Rows that repeat another are scored, and train, each
    for itself. Other columns are not read. ``head`` and ``task_tokens`` change where counts are kept, not the result.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), utf8().alias("body"))
    train = bodies.where("NOT held_out").select("body")
    counts = stored(train.mapInArrow(_counted_words(), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2(F.col("n"))) + 1
    tokens, distinct, entries = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(level), F.lit(0))).first()
    sizes = [(r[0], r[1]) for r in counts.groupBy(F.least("n", F.lit(1 << 16))).count().collect()]
    least = _threshold(sizes, head)
    rows = counts.where(F.col("n") >= least).toArrow()
    head_t = rows["t"].to_numpy().view(np.uint64)
    order = np.argsort(head_t)
    bits = log_frequency_filter(counts, int(entries))

    tasks = 1 + tokens // task_tokens
    segments = 1 << max(4, (4 * tasks - 1).bit_length())
    counted = train.mapInArrow(_counted_pairs(segments), "segment long, keys binary, counts binary").repartition(tasks, "segment")
    grams = stored(counted.mapInArrow(_segments(1 + tokens // head), "segment long, bits binary, hot binary, hot_levels binary"), "pairs")
    often = grams.select("hot", "hot_levels").collect()  # at most ``head`` keys
    hot = np.frombuffer(b"".join(r.hot for r in often), np.uint64)
    hot_order = np.argsort(hot)
    hot_levels = np.frombuffer(b"".join(r.hot_levels for r in often), np.uint8)

    unit = tokens + 0.5 * (distinct + 1)
    model = send({"unit": unit, "segments": segments, "head": head_t[order], "head_n": rows["n"].to_numpy()[order], "bits": bits, "hot": hot[hot_order], "hot_levels": hot_levels[hot_order]})
    asked = bodies.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_scores(model), _SENT)
    filters = grams.select("segment", F.lit(_FILTER).alias("kind"), F.col("bits").alias("packed"))
    dealt = asked.unionByName(filters, allowMissingColumns=True).repartition(tasks, "segment").sortWithinPartitions("segment", "kind")
    scored = stored(dealt.mapInArrow(_answered(unit), _SCORED), "scored")

    rest = scored.select("row", F.explode("tail").alias("x")).select("row", F.col("x.t").alias("t"), F.col("x.n").alias("m"))
    rest = rest.join(counts.where(F.col("n") < least), "t", "left").select(
        "row", (F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(unit))).alias("more"), F.when(F.col("n") > 0, F.col("m")).otherwise(0).alias("met"), F.lit(0.0).alias("part")
    )
    packed = scored.where("row IS NULL").select("first", "packed").repartition(tasks, "first").sortWithinPartitions("first")
    parts = packed.mapInArrow(_added, "row long, part double").select("row", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("met"), "part")
    rest = rest.unionByName(parts).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more", "met", "part")))
    return scored.where("row IS NOT NULL").drop("tail").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("part", F.lit(0.0))).alias("score"),
    )
