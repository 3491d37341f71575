"""Operator 5: SimHash near-duplicates, linked by a Gray-order hierarchical index.

Equal fingerprints become one node before any comparison. Two fingerprints within BITS differences agree on at least
BLOCKS - BITS of BLOCKS bit blocks, so each is dealt to one group per choice of such blocks. A group's fingerprints
are sorted by Gray rank; FANOUT neighbours become a node that holds the bits they share (mask and pattern), and so on
upwards. A search goes down from the root for all fingerprints at once: a child only tests the bits that its parent
does not fix, differences add up, and a branch whose sum passes BITS is left out with everything below it.

A group yields its least spanning forest, the closest links that join its components, not all pairs; and of these only
links that no earlier choice of blocks says. An order of all links that every group uses keeps the forest of the whole:
its links are in the forest of each group that holds them. Links of all groups are then joined by distributed connected
components. Groups of more than GROUP fingerprints are cut by Gray order into blocks, whose
shared bits are the upper nodes of the group's tree: only pairs of blocks that these do not rule out are searched,
each by itself, so no group is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed, met, same_document, slices, stored
from .graph import components

BITS = 4
BLOCKS = 6
FANOUT = 8
GROUP = 4_096
#: Stretches of Gray ranks that an oversized group is cut into at most before these are cut by hash.
CUTS = 256
SHINGLE = 4
SEED = 42
#: For removal: words of a shingle, bits that may differ, blocks, and the least Jaccard similarity of a link.
NEAR_SHINGLE, NEAR_BITS, NEAR_BLOCKS, SIMILAR = 5, 8, 10, 0.8


def fingerprint(body: bytes, n: int = SHINGLE) -> int:
    """Bit j is 1 if more than half of the shingles' hashes have it; 0 without words."""
    words = body.lower().split()
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    one = xxhash.xxh64_intdigest
    shape = b" ".join([b"%b"] * n)
    hashes = [one(shape % w, SEED) for w in zip(*(words[i:] for i in range(n)))]  # noqa: B905
    return int(_majority(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8))[0])


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Bits that more than half of the hashes (rows of bytes) have, as 64-bit numbers."""
    count = np.zeros(8 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)


def shingle_hashes(body: bytes, n: int) -> np.ndarray:
    """128-bit hashes of all shingles of n words, as rows of 16 bytes; of the whole text where it has fewer words."""
    words = body.lower().split()
    shape = b" ".join([b"%b"] * n)
    each = [shape % w for w in zip(*(words[i:] for i in range(n)))] if len(words) >= n else [b" ".join(words)] if words else []  # noqa: B905
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in each), np.uint8).reshape(-1, 16)


def two_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """Two fingerprints that do not depend on each other; zeros without shingles."""
    return _majority(hashes) if len(hashes) else np.zeros(2, np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint(body.as_py()) for body in batch["body"]], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["dk"], pa.array(prints)], names=["doc_id", "dk", "fp"])


def gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Static trees over fingerprints in Gray order, one for each group; all are built and searched at once.

    A level has pattern and mask (shared bits) of its nodes, and each node's first child and number of children in the
    level below; ``levels[0]`` are the fingerprints, the last level is one root a group.
    """

    def __init__(self, prints: np.ndarray, group: np.ndarray, fanout: int = FANOUT):
        self.order = np.lexsort((gray_rank(prints), group))
        self.fanout = fanout
        pattern, mask, group = prints[self.order], np.full(len(prints), 0xFFFFFFFFFFFFFFFF, np.uint64), group[self.order]
        none = np.zeros(len(prints), np.int64)
        self.levels = [(pattern, mask, none, none)]
        while True:
            new = np.append(True, group[1:] != group[:-1])
            within = np.arange(len(group)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            starts = np.flatnonzero(within % fanout == 0)
            sizes = np.diff(np.append(starts, len(group)))
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ np.repeat(pattern[starts], sizes)), starts)
            pattern, mask, group = pattern[starts] & shared, shared, group[starts]
            self.levels.append((pattern, mask, starts, sizes))
            if (group[1:] != group[:-1]).all():
                self.groups = group
                return

    def search(self, queries: np.ndarray, group: np.ndarray, bits: int, chunk: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, fingerprint) positions of one group within ``bits`` differences, a bounded frontier at a time."""
        top = len(self.levels) - 1
        pattern, mask = self.levels[top][:2]
        root = np.searchsorted(self.groups, group)
        for at in range(0, len(queries), chunk):
            q = np.arange(at, min(at + chunk, len(queries)))
            stack = [(top, q, root[q], np.bitwise_count((queries[q] ^ pattern[root[q]]) & mask[root[q]]).astype(np.int64))]
            while stack:
                level, q, node, far = stack.pop()
                near = far <= bits
                q, node, far = q[near], node[near], far[near]
                if not len(q):
                    continue
                if level == 0:
                    yield q, self.order[node]
                    continue
                if len(q) > chunk:
                    half = len(q) // 2
                    stack += [(level, q[:half], node[:half], far[:half]), (level, q[half:], node[half:], far[half:])]
                    continue
                (_, fixed, first, sizes), below = self.levels[level], self.levels[level - 1]
                n = sizes[node]
                up = np.repeat(node, n)
                child = first[up] + np.arange(len(up)) - np.repeat(np.cumsum(n) - n, n)
                q = np.repeat(q, n)
                far = np.repeat(far, n) + np.bitwise_count((queries[q] ^ below[0][child]) & below[1][child] & ~fixed[up]).astype(np.int64)
                stack.append((level - 1, q, child, far))


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that the pairs join the smallest label of theirs."""
    while len(a):
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high != low
        a, b, high, low = a[apart], b[apart], high[apart], low[apart]
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root[:] = root[root]


def _least_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of those pairs, given from the least on, that are the least spanning forest of n positions."""
    root, left, chosen = np.arange(n), np.arange(len(a)), []
    while True:
        x, y = root[a[left]], root[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return np.sort(np.concatenate([np.zeros(0, np.int64), *chosen]))
        best = np.full((2, n), len(a))
        best[0, x[::-1]], best[1, y[::-1]] = left[::-1], left[::-1]  # the last one written is the least
        best = best.min(0)
        own = np.flatnonzero(best < len(a))
        up = np.arange(n)
        up[own] = root[a[best[own]]] + root[b[best[own]]] - own
        twice = own[(up[up[own]] == own) & (own < up[own])]
        up[twice] = twice
        chosen.append(np.unique(best[own]))
        while (up != up[up]).any():
            up = up[up]
        root = up[root]


def _forest(prints: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]], bits: int, hold: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, out of those found among positions of ``prints``, that are their least spanning forest in the order of
    (bits that differ, smaller and larger fingerprint): the closest links that join all that these join."""
    n = len(prints)
    roots = [np.arange(n)] * (bits + 1)  # what the forest so far joins by links of at most so many bits
    a = b = np.zeros(0, np.int64)
    held, size = [], 0

    def settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)])
        far = np.bitwise_count(prints[a] ^ prints[b]).astype(np.int64)
        order = np.lexsort((np.maximum(prints[a], prints[b]), np.minimum(prints[a], prints[b]), far))
        a, b, far = a[order], b[order], far[order]
        keep = _least_forest(n, a, b)
        a, b, far = a[keep], b[keep], far[keep]
        for d in range(1, bits + 1):
            roots[d] = roots[d - 1].copy()
            _union(roots[d], a[far == d], b[far == d])
        return a, b

    for x, y in found:
        x, y = x[x > y], y[x > y]  # a pair is found from both its ends
        far = np.bitwise_count(prints[x] ^ prints[y]).astype(np.int64)
        for d in np.unique(far).tolist():
            at = far == d
            at[at] = roots[d - 1][x[at]] != roots[d - 1][y[at]]
            held.append((x[at], y[at]))
            size += len(held[-1][0])
        if size >= hold:
            a, b = settled(a, b)
            held, size = [], 0
    return settled(a, b) if size else (a, b)


def _linked(bits: int, masks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A row is a group of a choice, or two blocks of one, of which only links between the two count.
            left, right = (pc.list_value_length(batch[c]).fill_null(0).to_numpy() for c in ("left", "right"))
            rows = np.arange(batch.num_rows)
            group = np.concatenate((np.repeat(rows, left), np.repeat(rows, right)))
            prints = np.concatenate([batch[c].flatten().to_numpy().view(np.uint64) for c in ("left", "right")])
            if not len(prints):
                continue
            a, b = _forest(prints, GrayIndex(prints, group).search(prints, group, bits), bits)
            # Two fingerprints meet in all choices of blocks in which they agree; the first of these says the link.
            differ, choice = prints[a] ^ prints[b], batch["c"].to_numpy()[group[a]]
            first = np.full(len(a), len(masks))
            for i in range(len(masks) - 1, -1, -1):
                first[(differ & np.uint64(masks[i])) == 0] = i
            inner = left.sum()
            own = (first == choice) & ((right[group[a]] == 0) | ((a < inner) != (b < inner)))
            yield pa.RecordBatch.from_arrays([pa.array(prints[i[own]].view(np.int64)) for i in (a, b)], names=["a", "b"])

    return run


def gray_order(x: Column) -> Column:
    """``gray_rank`` as a column."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def block_masks(blocks: int, agree: int) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    own = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(own[i] for i in c) for c in combinations(range(blocks), agree)]


def near_links(prints: DataFrame, bits: int = BITS, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """``a, b``: links that join all of ``prints`` (fp: distinct longs) within ``bits`` differences, directly or over others."""
    own = block_masks(blocks, blocks - bits)
    masks = [m - (1 << 64) if m >> 63 else m for m in own]
    choice = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("g")) for i, m in enumerate(masks))))
    dealt = prints.select("fp", choice.alias("x")).select("fp", F.col("x.c").alias("c"), F.col("x.g").alias("g"))
    # A block is a stretch of Gray ranks within a group; one block is the rule.
    size = stored(dealt.groupBy("c", "g").agg(F.count("*").alias("n")).where("n > 1").select("c", "g", F.ceil(F.col("n") / group).cast("int").alias("parts")), "groups")
    one = dealt.join(size.where("parts = 1").select("c", "g"), ["c", "g"]).groupBy("c", "g").agg(F.collect_list("fp").alias("left")).select("c", "left")
    large = stored(dealt.join(size.where("parts > 1"), ["c", "g"]).withColumn("rank", gray_order(F.col("fp"))), "large")
    cuts = large.groupBy("c", "g").agg(F.percentile_approx("rank", [i / CUTS for i in range(1, CUTS)], 16 * CUTS).alias("cuts"))
    at = F.size(F.filter("cuts", lambda x: x <= F.col("rank")))
    part = (F.floor(at * F.least("parts", F.lit(CUTS)) / CUTS) * F.ceil(F.col("parts") / CUTS) + F.pmod(F.xxhash64("fp"), F.ceil(F.col("parts") / CUTS))).cast("int")
    named = large.join(cuts, ["c", "g"]).select("c", "g", part.alias("part"), "fp")
    blocks = stored(named.groupBy("c", "g", "part").agg(F.collect_list("fp").alias("fps"), F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")), "blocks")
    heads = blocks.select("c", "g", "part", F.col("all").alias("pattern"), F.bitwise_not(F.col("all").bitwiseXOR(F.col("any"))).alias("mask"))
    a, b = heads.alias("a"), heads.alias("b")
    apart = F.bit_count(F.col("a.pattern").bitwiseXOR(F.col("b.pattern")).bitwiseAND(F.col("a.mask")).bitwiseAND(F.col("b.mask")))
    pairs = a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.part") < F.col("b.part")) & (apart <= bits))
    pairs = pairs.select(F.col("a.c").alias("c"), F.col("a.g").alias("g"), F.col("a.part").alias("part"), F.col("b.part").alias("other"))
    across = pairs.join(blocks.select("c", "g", "part", F.col("fps").alias("left")), ["c", "g", "part"]).join(
        blocks.select("c", "g", F.col("part").alias("other"), F.col("fps").alias("right")), ["c", "g", "other"]
    )
    every = one.unionByName(blocks.select("c", F.col("fps").alias("left"))).unionByName(across.select("c", "left", "right"), allowMissingColumns=True)
    return every.select("c", "left", "right").mapInArrow(_linked(bits, own), "a long, b long")


def _grouped(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows (doc_id, dk, fp), and fp with its component's first doc_id and first row."""
    prints = stored(keyed(docs).mapInArrow(_fingerprints, "doc_id long, dk long, fp long"), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "dk")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("component_id"), F.min(row).alias("first")), "nodes")
    groups = components(near_links(nodes.select("fp"), bits))
    named = stored(nodes.join(groups, nodes["fp"] == groups["id"], "left").drop("id").withColumn("component", F.coalesce("component", "fp")), "named")
    least = stored(named.groupBy("component").agg(F.min("component_id").alias("component_id"), F.min("first").alias("first")), "least")
    return prints, stored(named.select("fp", "component").join(least, "component"), "components")


def simhash_groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable.

    A null or blank text has fingerprint zero, linked like any other. Null doc_ids are grouped but never name a
    component that has others. Other columns are not read.
    """
    prints, names = _grouped(docs, bits)
    return prints.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _sketched(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = np.array([two_fingerprints(shingle_hashes(body.as_py(), n)) for body in batch["body"]], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["dk"], *(pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1))], names=["doc_id", "dk", "f0", "f1"])

    return run


def _shingled(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(np.ascontiguousarray(shingle_hashes(body.as_py(), n)[:, :8]).view(np.uint64)).tobytes() for body in batch["body"]]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def similar_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) whose texts have a Jaccard similarity of ``least`` on shingles of n words.
    Texts are read for nodes of pairs only; a node of many pairs is dealt out over as many rows as these need."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    first = nodes.join(ends, "node").select("node", "first.doc_id", "first.dk")
    bodies = keyed(docs)
    own = bodies.join(first, same_document(bodies, first)).dropDuplicates(["node"]).select("node", "body")
    sets = stored(own.mapInArrow(_shingled(n), "node long, shingles binary"), "shingles")
    often = stored(pairs.groupBy("b").agg(F.count("*").alias("n"), F.ceil(F.count("*") / 2_000).cast("int").alias("parts")), "often")
    dealt = met(pairs, often, ["b"], "n").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(often, "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("b", "part", "y")
    return dealt.select("a", "b", "part").join(x, "a").join(y, ["b", "part"]).select("a", "b", "x", "y").mapInArrow(_alike(least), "a long, b long")


def simhash_unique(docs: DataFrame, n: int = NEAR_SHINGLE, bits: int = NEAR_BITS, blocks: int = NEAR_BLOCKS, least: float = SIMILAR) -> DataFrame:
    """``docs``, all columns, one row of each group of near-duplicates: that of the smallest doc_id (null last), then
    text hash. Texts are linked if one of two fingerprints of theirs (shingles of ``n`` words) differs in ``bits`` bits
    or fewer and their shingles have a Jaccard similarity of ``least`` or more.

    Null and blank texts are near-duplicates of each other; of repeated rows one stays; an empty table stays empty;
    other columns, whatever their names, are handed on.
    """
    prints = stored(keyed(docs).mapInArrow(_sketched(n), "doc_id long, dk long, f0 long, f1 long"), "prints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "dk")
    nodes = stored(prints.groupBy(F.xxhash64("f0", "f1").alias("node")).agg(F.min("f0").alias("f0"), F.min("f1").alias("f1"), F.min(row).alias("first")), "nodes")
    pairs = None
    for f in ("f0", "f1"):
        head = stored(nodes.groupBy(F.col(f).alias("fp")).agg(F.min("node").alias("head")), "heads")
        own = nodes.join(head, nodes[f] == head["fp"]).where("node <> head").selectExpr("node AS a", "head AS b")
        near = near_links(head.select("fp"), bits, blocks)
        ends = near.join(head.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(head.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").selectExpr("x AS a", "y AS b")
        pairs = own.union(ends) if pairs is None else pairs.union(own).union(ends)
    pairs = stored(pairs.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "pairs")
    groups = components(similar_links(docs, nodes, pairs, n, least))
    named = nodes.join(groups, nodes["node"] == groups["id"], "left").withColumn("component", F.coalesce("component", "node"))
    key = lambda c: F.coalesce(c.cast("long"), F.lit(-(2**63)))
    id_, dk = fresh("id", docs), fresh("dk", docs)
    first = named.groupBy("component").agg(F.min("first").alias("first")).select(key(F.col("first.doc_id")).alias(id_), F.col("first.dk").alias(dk)).distinct()
    rows = docs.withColumns({id_: key(F.col("doc_id")), dk: F.xxhash64("text")})
    return rows.join(first, [id_, dk], "left_semi").dropDuplicates([id_, dk]).select(docs.columns)
