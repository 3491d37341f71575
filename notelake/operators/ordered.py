"""Running values over one long ordered log, in two levels, so that a source of any size is many tasks.

A window over a source is one task, and one source may hold most of a log. Here time is cut into buckets: a bucket's
totals, or its first and last rows, are partial aggregates; a window over these few rows gives what each bucket carries
in from those before (or after) it; and within a bucket, a window of its own does the rest. Only buckets that have rows
exist, so quiet times cost nothing. What is gathered in one task is a bucket's rows, or a source's buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a bucket, if no other width is asked for.
WIDTH = 3600


def _free(rows: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in rows.columns}
    if clash := [n for n in names if n.lower() in taken]:
        raise ValueError(f"columns in use: {clash}")


def running_sums(rows: DataFrame, group: str, at: str, order: list[str], sums: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """``rows`` with a running sum for each of ``sums``, over the rows of a group up to and with this one.

    ``at`` is a time in seconds that never falls along ``order`` (ascending, nulls first). A null value adds nothing; a
    null group is a group; rows equal in ``order`` are taken one after another.
    """
    _free(rows, "_bucket", "_group", *sums)
    values = {f"_v_{n}": F.coalesce(c, F.lit(0)).cast("long") for n, c in sums.items()}
    own = rows.withColumns({**values, "_bucket": F.floor(F.col(at) / width)})
    before = W.partitionBy("_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = own.groupBy(F.col(group).alias("_group"), F.col("_bucket").alias("_b")).agg(*(F.sum(v).alias(v) for v in values)).withColumnRenamed("_b", "_bucket")
    carried = totals.select("_group", F.col("_bucket").alias("_b"), *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_c{v}") for v in values))
    both = own.join(carried, F.col(group).eqNullSafe(F.col("_group")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    within = W.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumns({n: F.sum(f"_v_{n}").over(within) + F.col(f"_c_v_{n}") for n in sums})
    return out.drop("_bucket", "_b", "_group", *values, *(f"_c{v}" for v in values))


def neighbours(rows: DataFrame, group: str, at: str, order: list[str], value: str, before: str | None = None, after: str | None = None, width: int = WIDTH) -> DataFrame:
    """``rows`` with the ``value`` of the row before and after each in its group, under these names; null at the ends.
    ``at`` and ``order`` as in ``running_sums``."""
    wanted = [n for n in (before, after) if n]
    _free(rows, "_bucket", "_group", *wanted)
    own = rows.withColumn("_bucket", F.floor(F.col(at) / width))
    place = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(value).alias("v"))
    edges = own.groupBy(F.col(group).alias("_group"), F.col("_bucket").alias("_b")).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    along = W.partitionBy("_group").orderBy("_b")
    carried = edges.select("_group", "_b", F.lag("_last").over(along)["v"].alias("_in"), F.lead("_first").over(along)["v"].alias("_out"))
    both = own.join(carried, F.col(group).eqNullSafe(F.col("_group")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    within = W.partitionBy(group, "_bucket").orderBy(*order, value)
    new = {}
    if before:
        new[before] = F.when(F.row_number().over(within) == 1, F.col("_in")).otherwise(F.lag(value).over(within))
    if after:
        new[after] = F.when(F.lead(F.lit(1)).over(within).isNull(), F.col("_out")).otherwise(F.lead(value).over(within))
    return both.withColumns(new).drop("_bucket", "_b", "_group", "_in", "_out")


def sessions(rows: DataFrame, group: str, at: str, order: list[str], gap: int, name: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with the number (from 1) of the session of its group that each belongs to: a new one begins where more
    than ``gap`` seconds have passed since the row before."""
    near = neighbours(rows, group, at, order, at, before="_before", width=width)
    fresh = F.when(F.col("_before").isNull() | (F.col(at) - F.col("_before") > gap), 1).otherwise(0)
    return running_sums(near, group, at, order, {name: fresh}, width).drop("_before")


def gaps(points: DataFrame, group: str, at: str, start: int, end: int, longest: int, width: int = WIDTH) -> DataFrame:
    """group, gap_start, gap_end and seconds of each stretch without a point that is longer than ``longest``, with
    ``start`` and ``end`` as points of every group."""
    ends = points.select(group).distinct().select(group, F.explode(F.array(F.lit(start).cast("long"), F.lit(end).cast("long"))).alias(at))
    every = neighbours(points.select(group, at).unionByName(ends), group, at, [at], at, after="gap_end", width=width)
    found = every.withColumn("seconds", F.col("gap_end") - F.col(at)).where(F.col("seconds") > longest)
    return found.withColumnRenamed(at, "gap_start")


def last_rows(rows: DataFrame, group: str, order: list[Column], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows of each group in ``order`` with their rank: tasks keep no more than these before they meet."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col(rank) <= n)
