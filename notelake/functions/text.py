"""Column functions on text and canonical JSON."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Text whose search form is its lower case: ASCII without the controls that count as white space, and composed Latin
#: letters that fold to one letter.
_PLAIN = r"^[\t\n\x0b\f\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00de\u00e0-\u00f6\u00f8-\u00ff]*+$"


def search_form(text: str) -> str:
    """Canonically composed, case-folded by the full table, white space of any kind collapsed."""
    return " ".join(unicodedata.normalize("NFC", text).casefold().split())


def _search_forms(texts: pd.Series) -> pd.Series:
    return texts.map(search_form, na_action="ignore")


def normalize(text: Column) -> Column:
    """Search form of a text: NFC, case-folded, white space collapsed. Text that is plain stays with built-in functions;
    only the others go through an Arrow batch."""
    plain = text.rlike(_PLAIN)
    return F.when(plain, F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))).otherwise(F.pandas_udf(_search_forms, "string")(F.when(~plain, text)))


def visible(text: Column, limit: int) -> Column:
    """One line without control characters, at most ``limit`` characters, cut off with an ellipsis."""
    line = F.trim(F.regexp_replace(text, r"[\p{C}\s]+", " "))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 1), F.lit("…"))).otherwise(line)


def is_cut(text: Column, limit: int) -> Column:
    """Whether ``visible`` leaves something of it out."""
    return F.length(F.trim(F.regexp_replace(text, r"[\p{C}\s]+", " "))) > limit


def canonical(**fields: Column) -> Column:
    """JSON with sorted keys and nulls kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def digest(**fields: Column) -> Column:
    return F.sha2(canonical(**fields), 256)


def tree_digest(rows: DataFrame, group: list[str], key: str, item: Column, width: int = 512, levels: int = 4) -> DataFrame:
    """Digest of each group's items in the order of an integer ``key``, and their number: ranges of ``width`` keys are
    digested first, then ranges of these digests, so no more than a range is ever gathered, however large a group is."""
    out = rows.select(*group, F.col(key).cast("long").alias("_k"), item.alias("_v"), F.lit(1).cast("long").alias("n"))
    for level in range(levels):
        own = [] if level == levels - 1 else [F.floor(F.col("_k") / width).alias("_k")]
        out = out.groupBy(*group, *own).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("_k").alias("k"), F.col("_v").alias("v")))), {"ignoreNullFields": "false"}), 256).alias("_v"), F.sum("n").alias("n"))
    return out.select(*group, "n", F.col("_v").alias("digest"))


def snippet(text: Column, terms: Column) -> Column:
    """240 characters from 60 before the earliest term, with ellipses where something is left out."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(F.lower(line), t)), lambda i: i > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - 61, F.lit(0))
    cut = F.substring(line, start + 1, F.lit(240))
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(F.length(line) > start + 240, "…").otherwise(""))


def next_slot(at: Column, hour: int, minute: int = 0) -> Column:
    """Seconds of the next ``hour``:``minute`` in Shanghai after a time in seconds."""
    local = F.from_utc_timestamp(F.timestamp_seconds(at), "Asia/Shanghai")
    day = F.date_trunc("day", local)
    slot = F.unix_seconds(F.to_utc_timestamp(day, "Asia/Shanghai")) + hour * 3600 + minute * 60
    return F.when(slot <= at, slot + 86400).otherwise(slot)


def local_date(at: Column) -> Column:
    """Calendar day in Shanghai of a time in seconds."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(at), "Asia/Shanghai"))
