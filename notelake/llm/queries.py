"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_cnn import quality_scores
from .chat_format import chat_examples, read_back
from .common import remainder, table, utf8
from .decontaminate import benchmark_hits
from .lexical_search import lexical_search
from .lm_score import lm_scores
from .mixing import domain_of_labels, mixing_rates
from .quality_rules import quality_verdicts
from .resample import importance_resample
from .sharding import SEED, SHARDS, round_keys, sharded
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_ids import read_tokens, token_files


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), remainder(5) == 1)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(chat_examples(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
ranked AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 15 AS size
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM ranked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", domain_of_labels().alias("domain"))
    return mixing_rates(table(spark, sf_dir, "documents"), labels)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(4) == 2)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


#: Of every byte value, the step of crc32; a text's crc32 is a fold of its bytes (the upper half of the list of pairs of
#: hexadecimal digits) over it.
_CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i))"""


def _crc(text: str) -> str:
    """SQL of the crc32 of a text's UTF-8 bytes, beside the table ``t``."""
    digits = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({digits}, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295)"


def _words(text: str) -> str:
    """SQL of the list of words of a text: A-Z is lower-cased, everything outside ASCII is part of a word."""
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = f"""
WITH {_CRC_TABLE},
worded AS MATERIALIZED (
  SELECT true AS source, doc_id AS id, {_words("text")} AS w FROM documents
  UNION ALL SELECT false, item_id, {_words("text")} FROM benchmark),
features AS MATERIALIZED (
  SELECT source, id, unnest(
    w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
      || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f
  FROM worded),
hashed AS MATERIALIZED (SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), crc_table),
counted AS (
  SELECT bucket, count(*) FILTER (source) AS s, count(*) FILTER (NOT source) AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
gained AS (
  SELECT bucket,
    floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counted),
weighed AS (
  SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM features JOIN hashed USING (f) JOIN gained USING (bucket) WHERE source GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM worded LEFT JOIN weighed USING (id) WHERE source),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM drawn) // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = f"""
WITH worded AS (SELECT doc_id, {_words("text")} AS w FROM documents),
sized AS (SELECT doc_id, len(w) AS n, w FROM worded WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM sized) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_words("text")}) AS term FROM benchmark) GROUP BY ALL),
weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM held, total GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weighed USING (term), total GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        (F.octet_length(utf8()) + 1).cast("long").alias("size"),
        F.crc32(utf8()).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
total AS (
  SELECT count(*)::UBIGINT AS n, greatest(1, ceil(ceil(log2(count(*))) / 2))::INT AS bits, (1::UBIGINT << bits) - 1 AS mask,
    {round_keys(SEED)}::UBIGINT[] AS keys
  FROM documents),
ordered AS (
  SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(coalesce(text, ''))) - 1)::UBIGINT AS i FROM documents),
walk AS (
  SELECT i, 0 AS step, i >> bits AS a, i & mask AS b FROM ordered, total
  UNION ALL
  SELECT i, CASE WHEN step = 6 THEN 0 ELSE step + 1 END, b, CASE WHEN step = 6 THEN a ELSE xor(a, xor(h2, h2 >> 13) & mask) END
  FROM (
    SELECT *, (((b + keys[step % 6 + 1]) % 4294967296) * 2654435761) % 4294967296 AS h1, (xor(h1, h1 >> 15) * 2246822519) % 4294967296 AS h2
    FROM walk, total WHERE step < 6 OR b << bits | a >= n)),
placed AS (SELECT i, (b << bits | a)::BIGINT AS p FROM walk, total WHERE step = 6 AND b << bits | a < n)
SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc("coalesce(text, '')")} AS text_crc32, 'rows' AS law,
  (p % {SHARDS})::INT AS shard, p // {SHARDS} AS slot, NULL::INT AS grown_shard
FROM ordered JOIN placed USING (i), crc_table
"""


_QUERIES = (op1_suffix_dedup, op2_lm_score, op3_substring_dedup, op4_chat_format, op5_simhash, op6_mixing, op7_decontaminate, op8_quality_rules, op9_quality_classifier, op10_token_ids, op11_resample, op12_lexical_search, op13_sharding)
_ORACLES: dict[str, str] = {"op4_chat_format": OP4_SQL, "op11_resample": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_sharding": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
