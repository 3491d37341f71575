"""Queries on questions, answers and their review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import local_date
from ..operators import questions as ops
from ..operators import search
from ..registry import query
from ..sources.bindings import AT, VIEWS, oracle, view
from .search import _INDEX, _NORM, _scored

WORDING = ops.Wording(vague="recently|lately|some time ago|last year|next week|in 20[0-9]{2}|近期|去年|前阵子", deadline="deadline|due|closes|报名截止|截止", stop="[.?!,;，。？]")
#: Words after a question's own: expressions of time, some of them twice, wrong, or about a deadline.
_SAID = ["最近一个月", "近30天", "过去七天", "本月", "上个月", "今年", "今天", "2024-01-02 至 2024-01-09", "2024-02-30到2024-03-01", "2024-01-09~2024-01-02", "本月，上月", "近期", "报名截止本月", "本月截止", "", "去年", "lately", "due 今天", "in 2023"]
_ASKED = "CASE {} % " + str(len(_SAID)) + " " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SAID)) + " END"
_HINTS = [(("der ", "die "), ("die",)), (("the ",), ("the", "of")), (("la ", "les "), ("la",))]
_HINTED = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(question, '{w}')" for w in words) + f" THEN {list(then)}" for words, then in _HINTS) + " ELSE [trim(substr(question, 1, 200))] END"
_CONV = f"SELECT conv_id AS query_id, coalesce(text, '') || '? ' || {_ASKED.format('conv_id')} AS question FROM conversations WHERE turn = 0"


def _questions(spark, sf):
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("conv_id") % len(_SAID)).cast("int") + 1)
    rows = spark.read.parquet(f"{sf}/conversations.parquet").where("turn = 0")
    return rows.select(F.col("conv_id").alias("query_id"), F.concat(F.coalesce("text", F.lit("")), F.lit("? "), said).alias("question"))


_TODAY = f"LOCALDATE[{AT}]"
_FOUND = "[" + ", ".join(f"regexp_extract_all(question, '{p}')" for p in ops.WINDOWS.values()) + "]"


def _window(source: str) -> str:
    return f"""f AS (SELECT query_id, question, regexp_matches(question, '{ops.EXPLICIT}') AS explicit, {_FOUND} AS found, {list(ops.WINDOWS)} AS kinds FROM {source}),
g AS (SELECT *, len(flatten(found)) AS n, list_position(list_transform(found, lambda x: len(x) > 0), true) AS i FROM f),
h AS (SELECT *, kinds[i] AS kind, CASE WHEN explicit THEN regexp_extract(question, '{ops.EXPLICIT}', 0) ELSE found[i][1] END AS said FROM g),
i AS (SELECT *, list_last(string_split_regex(substr(question, 1, strpos(question, said) - 1), '{WORDING.stop}')) || substr(string_split_regex(substr(question, strpos(question, said) + length(said)), '{WORDING.stop}')[1], 1, 12) AS near,
  CAST(CASE WHEN explicit THEN try_strptime(regexp_extract(question, '{ops.EXPLICIT}', 1), '%Y-%m-%d') WHEN kind = 'last_month' THEN {_TODAY} - INTERVAL 1 MONTH WHEN kind = 'last_30_days' THEN {_TODAY} - 29 WHEN kind = 'last_7_days' THEN {_TODAY} - 6 WHEN kind = 'this_month' THEN date_trunc('month', {_TODAY})
    WHEN kind = 'previous_month' THEN date_trunc('month', {_TODAY}) - INTERVAL 1 MONTH WHEN kind = 'this_year' THEN date_trunc('year', {_TODAY}) WHEN kind = 'today' THEN {_TODAY} END AS DATE) AS b,
  CAST(CASE WHEN explicit THEN try_strptime(regexp_extract(question, '{ops.EXPLICIT}', 2), '%Y-%m-%d') WHEN kind = 'previous_month' THEN date_trunc('month', {_TODAY}) - INTERVAL 1 DAY WHEN kind IS NOT NULL THEN {_TODAY} END AS DATE) AS e FROM h),
j AS (SELECT *, CASE WHEN n + CAST(explicit AS INT) > 1 THEN 'ambiguous_date_expression' WHEN NOT explicit AND kind IS NULL THEN CASE WHEN regexp_matches(question, '{WORDING.vague}') THEN 'date_expression_not_resolved' END WHEN regexp_matches(near, '{WORDING.deadline}') THEN 'deadline_window_not_supported'
  WHEN explicit AND NOT coalesce(b <= e, false) THEN 'invalid_date_expression' END AS warning FROM i),
win AS (SELECT query_id, CASE WHEN warning IS NULL THEN b END AS date_from, CASE WHEN warning IS NULL THEN e END AS date_to, CASE WHEN warning IS NULL OR warning = 'deadline_window_not_supported' THEN said END AS expression, warning FROM j)"""


@query("publication_window", oracle(f"WITH q AS ({_CONV}), {_window('q')} SELECT * FROM win"))
def _(spark, sf):
    return ops.publication_window(_questions(spark, sf), local_date(F.lit(AT)), WORDING)


@query("seed_keywords", f"WITH q AS ({_CONV}) SELECT query_id, array_to_string({_HINTED}, '|') AS terms FROM q")
def _(spark, sf):
    return ops.seed_keywords(_questions(spark, sf), _HINTS).select("query_id", F.array_join("terms", "|").alias("terms"))


def _asked(spark, sf):
    """The searched terms as questions, with an expression of time after them."""
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("query_id") % len(_SAID)).cast("int") + 1)
    return view(spark, sf, "term").select("query_id", F.concat("term", F.lit(" ? "), said).alias("question"))


@query("question_retrieval", oracle(f"""WITH q AS (SELECT query_id, term || ' ? ' || {_ASKED.format('query_id')} AS question FROM ({VIEWS['term'].strip()})), {_window('q')}, seeds AS (SELECT query_id, unnest({_HINTED}) AS seed FROM q), {_INDEX},
cut AS (SELECT seed, list_filter(string_split({_NORM.format('seed')}, ' '), lambda x: x <> '') AS ws FROM (SELECT DISTINCT seed FROM seeds)),
single AS (SELECT DISTINCT seed, w AS pos, [w] AS alts, length(w) >= 3 AS long FROM (SELECT seed, unnest(ws) AS w FROM cut WHERE len(list_distinct(ws)) <= 8)),
numbered AS (SELECT dense_rank() OVER (ORDER BY seed) AS query_id, seed, pos, alts, long FROM single), {_scored('numbered')},
hit AS (SELECT s.query_id, s.seed, d.* EXCLUDE query_id, w.warning, row_number() OVER (PARTITION BY s.query_id, s.seed, source_id ORDER BY score DESC, published_date DESC, document_id) AS r FROM seeds s JOIN (SELECT DISTINCT query_id AS sid, seed FROM numbered) k ON k.seed = s.seed JOIN scored d ON d.query_id = k.sid JOIN win w ON w.query_id = s.query_id
  WHERE (date_from IS NULL OR published_date >= date_from) AND (date_to IS NULL OR published_date <= date_to))
SELECT query_id, source_id, document_id, (SELECT current_version_id FROM notice n WHERE n.document_id = hit.document_id) AS version_id, min(r) AS rank, count(*) AS seeds, any_value(warning) AS warning, NULL AS code FROM hit WHERE r <= 2 GROUP BY query_id, source_id, document_id
UNION ALL SELECT query_id, NULL, NULL, NULL, NULL, count(*), any_value(warning), 'too_many_terms' FROM seeds JOIN cut USING (seed) JOIN win USING (query_id) WHERE len(list_distinct(ws)) > 8 GROUP BY query_id""", "notice"))
def _(spark, sf):
    asked = _asked(spark, sf)
    docs = view(spark, sf, "notice")
    seeds = ops.seed_keywords(asked, _HINTS).select("query_id", F.explode("terms").alias("seed"))
    unique = seeds.select(F.col("seed").alias("query_id"), F.col("seed").alias("term")).distinct()
    ranked = seeds.join(search.search_rank(search.index_rows(docs), unique).withColumnRenamed("query_id", "seed"), "seed")
    refused = seeds.join(search.refused(unique).withColumnRenamed("query_id", "seed"), "seed")
    return ops.question_retrieval(ranked, ops.publication_window(asked, local_date(F.lit(AT)), WORDING), docs, 2, refused)


@query("question_warnings", oracle(f"""WITH q AS ({_CONV}), {_window('q')}, st AS (SELECT query_id, 's' || CAST(query_id % 3 + k AS VARCHAR) AS source_id, (query_id + k) % 5 AS m FROM q CROSS JOIN (SELECT unnest([0, 1]) AS k)),
c AS (SELECT query_id, source_id || ':' || unnest(CASE m WHEN 0 THEN ['complete_scan_unknown'] WHEN 1 THEN ['complete_scan_stale', 'unprocessed_notices'] WHEN 2 THEN ['failed_recheck_using_saved_version'] WHEN 3 THEN ['frozen_snapshot_not_live', 'unadapted_references_not_searched'] ELSE [] END) AS c FROM st)
SELECT query_id, array_to_string(['saved_notices_only', 'retrieval_not_exhaustive', 'eligibility_requires_review'] || list_filter([warning], lambda x: x IS NOT NULL) || coalesce((SELECT list(c ORDER BY c) FROM c WHERE c.query_id = win.query_id), []), ',') AS warnings FROM win"""))
def _(spark, sf):
    asked = _questions(spark, sf)
    m = (F.col("query_id") + F.col("k")) % 5
    sources = asked.select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(
        "query_id", F.concat(F.lit("s"), (F.col("query_id") % 3 + F.col("k")).cast("string")).alias("source_id"), F.when(m != 0, F.lit(AT)).alias("last_complete_scan_at"), F.when(m == 1, 100_000).otherwise(10).alias("scan_age"),
        F.when(m == 1, 3).otherwise(0).alias("first_total"), F.when(m == 2, 1).otherwise(0).alias("failed_with_success"), (m == 3).alias("frozen"), F.when(m == 3, 2).otherwise(0).alias("references"),
    )
    return ops.question_warnings(ops.publication_window(asked, local_date(F.lit(AT)), WORDING), sources).select("query_id", F.array_join("warnings", ",").alias("warnings"))


_QUOTE = "SELECT conv_id AS answer_id, turn AS quote_no, CAST(conv_id % 50 AS BIGINT) AS reference, role AS field, CASE WHEN turn % 3 = 2 THEN 'not shown' ELSE substr(coalesce(text, ''), 3, 12) END AS text FROM conversations WHERE conv_id % 4 > 0"
_SHOWN = "SELECT CAST(conv_id % 50 AS BIGINT) AS reference, role AS field, substr(coalesce(text, ''), 1, 60) AS text FROM conversations WHERE conv_id % 50 < 45"
_REFERRED = "SELECT conv_id AS answer_id, CAST((conv_id + CASE WHEN conv_id % 7 = 3 THEN 0 ELSE turn END) % 50 AS BIGINT) AS reference FROM conversations WHERE turn < 2"


def _talk(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    quotes = c.where("conv_id % 4 > 0").selectExpr("conv_id AS answer_id", "turn AS quote_no", "CAST(conv_id % 50 AS BIGINT) AS reference", "role AS field", "CASE WHEN turn % 3 = 2 THEN 'not shown' ELSE substr(coalesce(text, ''), 3, 12) END AS text")
    shown = c.where("conv_id % 50 < 45").selectExpr("CAST(conv_id % 50 AS BIGINT) AS reference", "role AS field", "substr(coalesce(text, ''), 1, 60) AS text")
    return c, quotes, shown


@query("quote_containment", f"SELECT answer_id, quote_no, coalesce(bool_or(contains(s.text, q.text)), false) AS valid FROM ({_QUOTE}) q LEFT JOIN ({_SHOWN}) s ON s.reference = q.reference AND s.field = q.field GROUP BY ALL")
def _(spark, sf):
    _, quotes, shown = _talk(spark, sf)
    return ops.quote_containment(quotes, shown)


@query("citation_check", f"""WITH v AS (SELECT answer_id, quote_no, coalesce(bool_or(contains(s.text, q.text)), false) AS valid FROM ({_QUOTE}) q LEFT JOIN ({_SHOWN}) s ON s.reference = q.reference AND s.field = q.field GROUP BY ALL)
SELECT answer_id, CASE WHEN count(*) > count(DISTINCT reference) THEN 'duplicate_answer_reference' WHEN bool_or(reference NOT IN (SELECT reference FROM ({_SHOWN}))) THEN 'citation_not_read' WHEN EXISTS (SELECT 1 FROM v WHERE v.answer_id = a.answer_id AND NOT valid) THEN 'citation_quote_invalid' ELSE 'ok' END AS code FROM ({_REFERRED}) a GROUP BY answer_id""")
def _(spark, sf):
    c, quotes, shown = _talk(spark, sf)
    answers = c.where("turn < 2").selectExpr("conv_id AS answer_id", "CAST((conv_id + CASE WHEN conv_id % 7 = 3 THEN 0 ELSE turn END) % 50 AS BIGINT) AS reference")
    return ops.citation_check(answers, quotes, shown)


_INPUT = "to_json({'item_id': item_id, 'predicted': predicted, 'source_id': source_id})"


@query("review_bundle", oracle(f"SELECT item_id, {_INPUT} AS input, SHA[{_INPUT}] AS input_sha256 FROM review", "review"))
def _(spark, sf):
    return ops.review_bundle(view(spark, sf, "review"), ["item_id", "predicted", "source_id"])


@query("labels_bound", oracle(f"""WITH b AS (SELECT item_id, SHA[{_INPUT}] AS s FROM review WHERE item_id % 23 > 0), l AS (SELECT item_id, SHA[CASE WHEN mismatch THEN 'old' ELSE CAST({_INPUT} AS VARCHAR) END] AS s, CASE WHEN item_id % 29 = 3 THEN 'b0' ELSE 'b1' END AS bundle FROM review)
SELECT l.item_id, CASE WHEN b.s IS NULL THEN 'unknown_item' WHEN bundle <> 'b1' OR l.s <> b.s THEN 'stale' ELSE 'bound' END AS binding FROM l LEFT JOIN b ON l.item_id = b.item_id""", "review"))
def _(spark, sf):
    items = view(spark, sf, "review")
    bundle = ops.review_bundle(items, ["item_id", "predicted", "source_id"]).withColumn("bundle_sha256", F.lit("b1"))
    labels = bundle.join(items.select("item_id", "mismatch"), "item_id").selectExpr("item_id", "CASE WHEN mismatch THEN sha2('old', 256) ELSE input_sha256 END AS input_sha256", "CASE WHEN item_id % 29 = 3 THEN 'b0' ELSE 'b1' END AS bundle_sha256")
    return ops.labels_bound(labels, bundle.where("item_id % 23 > 0"))


_SETS = ["CASE WHEN doc_id % 7 = 0 THEN {0} ELSE {1} END AS relevant", "{2} AS retrieved", "CASE WHEN doc_id % 5 = 0 THEN {0} ELSE {3} END AS selected", "CASE doc_id % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' END AS assessment"]
_MADE = {"spark": ("CAST(array() AS ARRAY<BIGINT>)", "array(doc_id % 4, doc_id % 6)", "array(doc_id % 4, doc_id % 5)", "array(doc_id % 3, doc_id % 6)"), "duck": ("CAST([] AS BIGINT[])", "[doc_id % 4, doc_id % 6]", "[doc_id % 4, doc_id % 5]", "[doc_id % 3, doc_id % 6]")}


@query("answer_metrics", f"""WITH a AS (SELECT list_distinct(relevant) AS rel, list_distinct(retrieved) AS ret, list_distinct(selected) AS sel, len(relevant) AS size, assessment FROM (SELECT {', '.join(s.format(*_MADE['duck']) for s in _SETS)} FROM labels))
SELECT count(*) AS answers, round(avg(CASE WHEN size > 0 THEN len(list_intersect(rel, ret)) / size END), 6) AS retrieval_recall, round(avg(CASE WHEN size > 0 THEN len(list_intersect(rel, sel)) / size END), 6) AS answer_recall, CAST(sum(len(list_filter(sel, lambda x: NOT list_contains(rel, x)))) AS BIGINT) AS irrelevant,
count(*) FILTER (size = 0) AS empty_questions, count(*) FILTER (size = 0 AND len(sel) = 0) AS empty_correct, count(*) FILTER (assessment = 'correct') AS assessed_correct, count(*) FILTER (assessment = 'wrong') AS assessed_wrong FROM a""")
def _(spark, sf):
    return ops.answer_metrics(spark.read.parquet(f"{sf}/labels.parquet").selectExpr(*(s.format(*_MADE["spark"]) for s in _SETS)))


@query("case_mismatches", oracle("""SELECT item_id AS case_id, array_to_string(list_filter([CASE WHEN actual <> predicted THEN 'action' END, CASE WHEN item_id % 3 > 0 AND source_id <> 'src8' THEN 'source' END], lambda x: x IS NOT NULL)
|| CASE WHEN item_id % 4 > 0 THEN ['absent:r' || CAST(item_id % 4 AS VARCHAR)] ELSE [] END || CASE WHEN item_id % 2 = 0 THEN ['present:r0'] ELSE [] END, ',') AS mismatches FROM review""", "review"))
def _(spark, sf):
    cases = view(spark, sf, "review").selectExpr(
        "item_id AS case_id", "predicted AS action", "actual AS e_action", "source_id AS source", "CASE WHEN item_id % 3 > 0 THEN 'src8' END AS e_source", "CASE WHEN item_id % 2 = 0 THEN array('r0', 'r9') ELSE array('r0x') END AS rules",
        "CASE WHEN item_id % 4 = 0 THEN array(CASE WHEN item_id % 2 = 0 THEN 'r9' ELSE 'r0x' END) ELSE array(concat('r', CAST(item_id % 4 AS STRING))) END AS rules_present", "array('r0', 'r7') AS rules_absent",
    )
    return ops.case_mismatches(cases, ["action", "source"]).select("case_id", F.array_join("mismatches", ",").alias("mismatches"))


_REPORT = """SELECT 'labels' AS metric, binding AS key, CAST(count(*) AS DOUBLE) AS value FROM (SELECT CASE WHEN mismatch THEN 'stale' ELSE 'bound' END AS binding FROM review) GROUP BY binding
UNION ALL SELECT 'confusion', actual || '>' || predicted, count(*) FROM review WHERE NOT mismatch GROUP BY ALL UNION ALL SELECT 'urgent_misses', 'all', count(*) FILTER (actual = 'PUSH_NOW' AND predicted <> 'PUSH_NOW') FROM review WHERE NOT mismatch
UNION ALL SELECT 'reminder_recall', 'all', round(count(*) FILTER (a AND p) / nullif(count(*) FILTER (a), 0), 6) FROM (SELECT actual IN ('PUSH_NOW', 'DIGEST') AS a, predicted IN ('PUSH_NOW', 'DIGEST') AS p FROM review WHERE NOT mismatch)
UNION ALL SELECT 'conflicting_labels', 'all', count(*) FROM (SELECT item_id FROM (SELECT DISTINCT item_id, actual FROM review) GROUP BY item_id HAVING count(*) > 1)"""


@query("review_report", oracle(_REPORT, "review"))
def _(spark, sf):
    rows = view(spark, sf, "review")
    bound = rows.where("NOT mismatch")
    a, p = F.col("actual").isin("PUSH_NOW", "DIGEST"), F.col("predicted").isin("PUSH_NOW", "DIGEST")
    out = lambda df, metric, key, value: df.select(F.lit(metric).alias("metric"), key.alias("key"), value.cast("double").alias("value"))
    parts = [
        out(rows.groupBy(F.when(F.col("mismatch"), "stale").otherwise("bound").alias("b")).count(), "labels", F.col("b"), F.col("count")),
        out(bound.groupBy("actual", "predicted").count(), "confusion", F.concat_ws(">", "actual", "predicted"), F.col("count")),
        out(bound.agg(F.count_if((F.col("actual") == "PUSH_NOW") & (F.col("predicted") != "PUSH_NOW")).alias("n")), "urgent_misses", F.lit("all"), F.col("n")),
        out(bound.agg(F.round(F.try_divide(F.count_if(a & p), F.count_if(a)), 6).alias("n")), "reminder_recall", F.lit("all"), F.col("n")),
        out(rows.groupBy("item_id").agg(F.count_distinct("actual").alias("k")).where("k > 1").agg(F.count("*").alias("n")), "conflicting_labels", F.lit("all"), F.col("n")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
