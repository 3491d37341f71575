"""Search form of texts against Python's own tables."""

import unicodedata

from pyspark.sql import functions as F

from notelake.functions.text import normalize


def want(text):
    return " ".join(unicodedata.normalize("NFC", text).casefold().split())


def test_every_character_of_the_basic_plane(spark):
    """Alone, between letters, and with combining marks before which it may have to be composed or put in order."""
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"A{c}B {c}̣́ {c}" for c in chars] + ["", " \t\n ", "ẹ́ 각 ẞ", "x" * 100_000, "😀 Ａ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.n for r in rows.select("i", normalize(F.col("t")).alias("n")).collect()}
    assert [(texts[i], got[i]) for i in got if got[i] != want(texts[i])][:5] == []


def test_null_stays_null(spark):
    rows = spark.createDataFrame([(None,), ("É",)], "t string")
    assert [r.n for r in rows.select(normalize(F.col("t")).alias("n")).collect()] == [None, "é"]
