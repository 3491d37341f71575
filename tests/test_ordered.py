"""Running values in two levels against plain loops, with one source that holds most of the log."""

import random

import pytest
from pyspark.sql import functions as F

from notelake.operators import audits, ordered

LOG = "source string, at long, id long, v long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    hot = [("hot", rng.choice([0, 5000, 100_000]) + rng.randint(0, 9_000), i, rng.choice([None, 1, 2, -3])) for i in range(400)]
    return hot + [(rng.choice(["a", None]), rng.randint(-5_000, 30_000), 1_000 + i, 1) for i in range(60)] + [("one", 7, 2_000, 4), ("hot", 5_000, 3_000, 1), ("hot", 5_000, 3_001, 1)]


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, LOG).repartition(5)


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [1, 60, 3_600, 10**9])
def test_running_sums(log, rows, width):
    got = {r.id: (r.total, r.n) for r in ordered.running_sums(log, "source", "at", ["at", "id"], {"total": F.col("v"), "n": F.lit(1)}, width).collect()}
    want = {}
    for own in grouped(rows).values():
        total = 0
        for n, (_, _, i, v) in enumerate(own):
            total += v or 0
            want[i] = (total, n + 1)
    assert got == want


@pytest.mark.parametrize("width", [1, 3_600, 10**9])
def test_neighbours_and_sessions(log, rows, width):
    near = ordered.neighbours(log, "source", "at", ["at", "id"], "v", "old", "new", width)
    got = {r.id: (r.old, r.new) for r in near.collect()}
    numbered = {r.id: r.run for r in ordered.sessions(log, "source", "at", ["at", "id"], 900, "run", width).collect()}
    for own in grouped(rows).values():
        run = 0
        for k, (_, at, i, _) in enumerate(own):
            assert got[i] == (own[k - 1][3] if k else None, own[k + 1][3] if k + 1 < len(own) else None)
            run += k == 0 or at - own[k - 1][1] > 900
            assert numbered[i] == run


def test_gaps_with_ends(spark):
    points = spark.createDataFrame([("a", 100), ("a", 100), ("a", 5_000), ("b", 9_000), ("c", 0)], "source string, at long")
    got = sorted(tuple(r) for r in ordered.gaps(points, "source", "at", 0, 10_000, 1_000).select("source", "gap_start", "gap_end", "seconds").collect())
    assert got == [("a", 100, 5_000, 4_900), ("a", 5_000, 10_000, 5_000), ("b", 0, 9_000, 9_000), ("c", 0, 10_000, 10_000)]
    assert ordered.gaps(points.limit(0), "source", "at", 0, 10_000, 1_000).count() == 0


def test_one_source_is_many_tasks(spark, log):
    """The rows of one source stand in many partitions of the result, whose windows they went through."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        hot = log.where("source = 'hot'")
        out = ordered.sessions(hot, "source", "at", ["at", "id"], 900, "run", 600).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) > 8 and max(sizes) < sum(sizes) / 3


def test_columns_in_use_are_refused(log):
    with pytest.raises(ValueError, match="in use"):
        ordered.running_sums(log.withColumn("_bucket", F.lit(1)), "source", "at", ["at"], {"n": F.lit(1)})
    with pytest.raises(ValueError, match="in use"):
        ordered.neighbours(log, "source", "at", ["at"], "v", before="V")


def test_window_summary_gathers_no_list(spark):
    rows = spark.createDataFrame([("a", 0, 1, 1), ("a", 0, 1, 1), ("a", 3_600, 2, 1), ("a", 3_600, 3, 1), ("a", 20_000, 5, 5), ("a", 99_999, 9, 9), ("b", 50, 1, 1)], "source_id string, at long, processed long, documents long")
    out = audits.window_summary(rows, 0, 30_000, 3_600, 300)
    got = {r.source_id: tuple(r)[1:] for r in out.select("source_id", "samples", "repeats", "conflicts", "processed", "documents", "gaps", "longest_gap").collect()}
    assert got == {"a": (3, 2, 1, 4, 4, 2, 16_400), "b": (1, 0, 0, 0, 0, 1, 29_950)}
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
