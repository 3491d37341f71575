"""What the operators of this folder share: inputs, stored intermediates, word rules."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every contract of this folder.
SPACE = "[\\x20\\x09-\\x0D]+"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one serves a local
    master, whose executors are the driver; on a cluster that fails."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/notelake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Free a stored table that nothing reads any more."""
    _drop(df.sparkSession, df.stored_at)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: what a task makes of texts then takes no more memory than these few need."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()


def utf8(name: str = "text") -> Column:
    """A text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``dk`` and ``body`` of every row. ``dk`` (a hash of the text) tells rows apart that share a
    doc_id; rows equal in both are the same text and get the same result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("dk"), utf8().alias("body"))


def fresh(name: str, docs: DataFrame) -> str:
    """``name``, with as many underscores after it as no column of ``docs`` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def met(rows: DataFrame, keys: DataFrame, on: list[str], n: str, hot: int = 50_000, most: int = 100_000) -> DataFrame:
    """``rows`` joined with ``keys`` (one row a key; ``n``: how many rows have it). Keys with over ``hot`` rows, at
    most ``most`` of them, are broadcast, so none of them is gathered in one task; the others are joined by a shuffle."""
    total = keys.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) > max(hot, total // most)
    heavy, light = keys.where(often).drop(n).withColumnsRenamed({c: f"hot_{c}" for c in on}), keys.where(~often).drop(n)
    is_hot = reduce(Column.__and__, (F.col(c) == F.col(f"hot_{c}") for c in on))
    spread = rows.join(F.broadcast(heavy), is_hot).drop(*(f"hot_{c}" for c in on))
    return rows.join(F.broadcast(heavy), is_hot, "left_anti").join(light, on).unionByName(spread)


def numbered(rows: DataFrame, by: list[Column], at: str, name: str) -> tuple[DataFrame, int]:
    """``rows`` stored in the order of ``by`` with their place in it (from 0) as column ``at``, and how many there are.
    Ranges of the order are sorted apart; the driver sees one number a range. Rows equal in ``by`` may take any order,
    but each has a place of its own."""
    place = fresh("_place", rows)
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(place, F.monotonically_increasing_id())
    out = stored(ranges, name)
    part, seq = F.shiftright(place, 33), F.col(place).bitwiseAND((1 << 33) - 1)
    starts, total = [], 0
    for p, n in sorted(out.groupBy(part.alias("p")).count().collect()):
        starts.append((p, total))
        total += n
    first = out.sparkSession.createDataFrame(starts, "_p int, _first long")
    joined = out.join(F.broadcast(first), part.cast("int") == F.col("_p"))  # one row a range
    return joined.withColumn(at, F.col("_first") + seq).drop("_p", "_first", place), total


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["dk"] == b["dk"])


def fold(hash_id: Column, parts: int) -> Column:
    return F.pmod(hash_id, F.lit(parts))


def remainder(modulus: int) -> Column:
    """The fold of a document: crc32 of its doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus
