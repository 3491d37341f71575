"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, met, stored

ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    halves = [F.sum(F.shiftright(F.xxhash64("a", "b", F.lit(seed)), 24)) for seed in (1, 2)]  # 40 bits each, so sums do not overflow
    return tuple(edges.agg(F.count("*"), *halves).first())


def components(edges: DataFrame, hot: int = 10_000) -> DataFrame:
    """``id, component`` (smallest id reachable) of every id in ``edges`` (a, b; any direction, repeats allowed).

    Alternating large-star and small-star rounds: an edge list of at most the first size is rewritten until it is a
    set of stars, in about log2(longest path) rounds (ROUNDS would do for any path that can be stored). Each round is
    stored, so lineage stays short. The minimum of a neighbourhood is a partial aggregate, and nodes with very many
    neighbours get theirs by a broadcast, so a hub is not gathered. An edge list is compared with the next one by its
    size and sums of hashes.
    """
    now = stored(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    before = _mark(now)
    for _ in range(ROUNDS):
        both = now.union(now.selectExpr("b", "a"))
        low = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n")), "low")
        large = stored(met(both, low, ["a"], "n", hot).where("b > a").selectExpr("b AS a", "m AS b").where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")  # a node's neighbours of smaller id: not a hub after the step before
        after = stored(small.selectExpr("b AS a", "m AS b").union(least.selectExpr("a", "m AS b")).where("a <> b").distinct(), "edges")
        for done in (low, large, now):
            discard(done)
        now, last, before = after, before, _mark(after)
        if last == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.selectExpr("a AS id", "b AS component").union(now.selectExpr("b AS id", "b AS component").distinct())
