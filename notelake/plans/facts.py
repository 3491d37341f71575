"""Queries on rule facts. The given texts hold none of the pack's words, so what must be found follows from the ends put
after them (``RULED``), and the oracles say it outright."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions
from ..operators import facts as ops
from ..operators.audience import qualifications
from ..operators.percolate import phrase_hits
from ..registry import query
from ..sources.bindings import AT, RULED, oracle, view
from ..sources.tables import stored
from . import decisions as decided

PACK = ops.Pack(action="apply|register")
_PHRASE = {"exchange": "exchange program", "scholarship": "scholarship", "contest": "contest"}
_N = len(RULED)


def _expected(columns: str, rows: list[tuple]) -> str:
    """Rows of (variant, ...) for every document of the variant; a text column is SQL where it begins with '='."""
    said = lambda x: "NULL" if x is None else x[1:] if isinstance(x, str) and x.startswith("=") else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    return " UNION ALL ".join(f"SELECT document_id, {', '.join(f'{said(x)} AS {c}' for c, x in zip(columns.split(), row[1:], strict=True))} FROM ruled WHERE document_id % {_N} = {row[0]}" for row in rows)


def _topics(spark):
    return spark.createDataFrame(list(_PHRASE.items()), "topic string, phrase string")


def _texts(spark, sf):
    fields = F.inline(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("body_text").alias("field"), F.col("body_text").alias("text"))))
    return view(spark, sf, "ruled").select("document_id", fields)


def _cut(spark, sf):
    return ops.clauses(_texts(spark, sf), PACK)


def _acts(spark, sf):
    return ops.action_blocked(ops.action_mentions(_cut(spark, sf), PACK), PACK)


@query("clauses", oracle("""WITH t AS (SELECT document_id, 'title' AS field, title AS text FROM ruled UNION ALL SELECT document_id, 'body_text', body_text FROM ruled), s AS (SELECT document_id, field, string_split_regex(text, '[.;!?\\n]') AS p FROM t),
c AS (SELECT document_id, field, generate_subscripts(p, 1) - 1 AS clause_no, unnest(p) AS text FROM s), o AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id, field ORDER BY clause_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c)
SELECT document_id, field, clause_no, start, SHA[text] AS sha256 FROM o WHERE trim(text) <> ''""", "ruled"))
def _(spark, sf):
    return _cut(spark, sf).select("document_id", "field", "clause_no", "start", F.sha2("text", 256).alias("sha256"))


#: Variant, word, and why its action is blocked.
_ACTIONS = [
    (0, "apply", "ok", False), (1, "register", "ok", True), (2, "register", "ok", True), (3, "register", "ok", True), (4, "apply", "negated", False), (5, "apply", "closed", False), (6, "apply", "record", False), (7, "apply", "past", False),
    (8, "apply", "administration", False), (9, "apply", "ok", True), (15, "apply", "ok", False), (16, "apply", "ok", False), (19, "register", "ok", False),
]
_START = "=length(body_text) - {} + {}"


def _at(v: int, word: str) -> str:
    return _START.format(len(RULED[v][1]), RULED[v][1].index(word))


@query("action_mentions", oracle(_expected("start word", [(v, _at(v, w), w) for v, w, *_ in _ACTIONS]), "ruled"))
def _(spark, sf):
    return ops.action_mentions(_cut(spark, sf), PACK).select("document_id", (F.col("clause_start") + F.col("at")).alias("start"), "word")


@query("action_blocked", oracle(_expected("word blocked instructed", [(v, w, b, i) for v, w, b, i in _ACTIONS]), "ruled"))
def _(spark, sf):
    return _acts(spark, sf).select("document_id", "word", "blocked", "instructed")


def _title_at(v: int, word: str) -> str:
    return f"=length(title) - {len(RULED[v][0])} + {RULED[v][0].index(word)}"


_TITLES = [(0, "scholarship", "subject"), (1, "contest", "subject"), (2, "contest", "subject"), (2, "scholarship", "subject"), (3, "contest", "subject")]
_BODIES = [(0, "scholarship", "opportunity"), *((v, "exchange", "incidental") for v in (4, 5, 6, 7, 8)), (19, "contest", "opportunity"), (19, "scholarship", "incidental")]


def _contexts(titles):
    return [(v, "title", t, _title_at(v, _PHRASE[t]), c) for v, t, c in titles] + [(v, "body_text", t, _at(v, _PHRASE[t]), c) for v, t, c in _BODIES]


def _context(spark, sf):
    cut = _cut(spark, sf)
    mentions = ops.topic_mentions(cut, _topics(spark))
    acts = ops.action_blocked(ops.action_mentions(cut, PACK), PACK)
    return mentions, acts, ops.topic_context(mentions, acts)


@query("topic_context", oracle(_expected("field topic start context", _contexts(_TITLES)), "ruled"))
def _(spark, sf):
    return _context(spark, sf)[2]


_LINKED = [(0, "scholarship", "subject"), (1, "contest", "opportunity"), (2, "contest", "uncertain"), (2, "scholarship", "uncertain"), (3, "contest", "subject")]


def _link(spark, sf):
    mentions, acts, contexts = _context(spark, sf)
    return acts, ops.document_link(contexts, acts, mentions, view(spark, sf, "ruled"), PACK)


@query("document_link", oracle(_expected("field topic start context unknown", [(*row, "topic_action_link_unknown" if row[-1] == "uncertain" else "=CAST(NULL AS VARCHAR)") for row in _contexts(_LINKED)]), "ruled"))
def _(spark, sf):
    return _link(spark, sf)[1]


def _recruitment(spark, sf):
    return ops.recruitment_topic(_cut(spark, sf), _acts(spark, sf), view(spark, sf, "ruled"), PACK)


@query("recruitment_topic", oracle(_expected("context", [(9, "opportunity"), (10, "incidental"), (11, "uncertain")]), "ruled"))
def _(spark, sf):
    return _recruitment(spark, sf)


_OPEN = {0, 1, 2, 9, 15, 16, 19}
_KIND = f"CASE WHEN document_id % {_N} = 3 THEN 'reference' WHEN document_id % {_N} IN ({', '.join(map(str, sorted(_OPEN)))}) THEN 'opportunity' ELSE 'information' END"


def _category(spark, sf):
    acts, linked = _link(spark, sf)
    return ops.notice_category(view(spark, sf, "ruled"), acts, _recruitment(spark, sf), linked, PACK)


@query("notice_category", oracle(f"SELECT document_id, {_KIND} AS category FROM ruled", "ruled"))
def _(spark, sf):
    return _category(spark, sf)


_ASKED = [(0, "level", "undergraduate", "in", True), (0, "institution", "own", "in", True), (12, "level", "graduate", "unsupported", False), (12, "role", "teacher", "unsupported", False)]


@query("qualifications", oracle(_expected("field value operator complete", _ASKED), "ruled"))
def _(spark, sf):
    rows = qualifications(ops.audience_clauses(_cut(spark, sf), PACK), view(spark, sf, "lexicon"))
    return rows.select("document_id", "field", F.array_join("values", "|").alias("value"), "operator", "complete")


@query("audiences", oracle("""WITH x AS (SELECT *, CASE k WHEN 2 THEN 'unsupported_or' WHEN 3 THEN 'unsupported_or' WHEN 4 THEN 'unsupported_negation' WHEN 5 THEN 'unsupported_negation' WHEN 6 THEN 'unbalanced_group' WHEN 10 THEN 'unsupported_negation' WHEN 12 THEN 'soft_qualification' ELSE '' END AS why FROM audience),
c AS (SELECT id, k, 'college' AS field, CASE WHEN k IN (1, 2, 3, 10) THEN list_sort(list_distinct([a, 'law'])) ELSE [a] END AS v, why AS code FROM x WHERE k NOT IN (8, 9)
  UNION ALL SELECT id, k, 'level', CASE k WHEN 9 THEN ['graduate', 'undergraduate'] ELSE ['graduate'] END, CASE WHEN k IN (6, 10, 12) THEN why ELSE '' END FROM x WHERE k IN (1, 3, 5, 6, 7, 9, 10, 11, 12)
  UNION ALL SELECT id, k, 'entry_year', [y], CASE WHEN k IN (5, 6) THEN why ELSE '' END FROM x WHERE k IN (1, 3, 5, 6)
  UNION ALL SELECT id, k, 'student_status', ['full-time'], 'unsupported_condition' FROM x WHERE k = 11
  UNION ALL SELECT id, k, 'other', [], CASE k WHEN 7 THEN 'unrecognized_condition' ELSE 'unrecognized_audience' END FROM x WHERE k IN (7, 8))
SELECT id AS document_id, field, array_to_string(v, '|') AS value, CASE code WHEN '' THEN 'in' ELSE 'unsupported' END AS operator, code, k IN (0, 1, 9) AS complete FROM c""", "audience"))
def _(spark, sf):
    clauses = view(spark, sf, "audience").select(F.col("id").alias("document_id"), F.lit(0).alias("clause_no"), "said", F.lit(False).alias("negated"))
    return qualifications(clauses, view(spark, sf, "lexicon")).select("document_id", "field", F.array_join("values", "|").alias("value"), "operator", "code", "complete")


@query("unsupported_conditions", oracle(_expected("field start excerpt", [(12, "gpa", _at(12, "GPA"), "GPA"), (12, "age", _at(12, "aged under 30"), "aged under 30")]), "ruled"))
def _(spark, sf):
    return ops.unsupported_conditions(_cut(spark, sf), PACK)


@query("section_conditions", oracle(_expected("number text", [(13, 1, "one thing"), (13, 2, "another")]), "ruled"))
def _(spark, sf):
    return ops.section_conditions(view(spark, sf, "ruled"), PACK)


def _t(text: str) -> str:
    return f"=CAST(epoch(TIMESTAMP '{text}') AS BIGINT) - 28800"


_NONE = "=CAST(NULL AS BIGINT)"
_PUBLISHED = "=CAST(epoch(CAST(published_date AS TIMESTAMP)) AS BIGINT) - 28800"
_TIMES = [
    (0, _NONE, _t("2024-02-01 23:59:59"), _NONE, None), (1, _NONE, _t("2024-01-21 00:00:00"), _NONE, None), (14, _t("2024-01-05 00:00:00"), _t("2024-01-10 12:30:00"), _NONE, None), (14, _NONE, _t("2024-01-11 23:59:59"), _NONE, None),
    (15, _NONE, _t("2024-01-15 23:59:59"), _t("2024-01-15 00:00:00"), None), (15, _NONE, _NONE, _NONE, "year_missing"), (16, _NONE, _t("2024-01-15 23:59:59"), _t("2024-01-15 00:00:00"), None), (17, _NONE, _NONE, _NONE, "invalid_time"),
    (18, _NONE, _NONE, _NONE, "time_unrecognized"), (19, _PUBLISHED, _NONE, _NONE, None),
]


def _times(spark, sf):
    return ops.time_facts(_cut(spark, sf), view(spark, sf, "ruled").select("document_id", "published_date"), PACK)


@query("time_facts", oracle(_expected("opens_at deadline_at lower_at unknown", _TIMES), "ruled"))
def _(spark, sf):
    return _times(spark, sf).select("document_id", "opens_at", "deadline_at", "lower_at", "unknown")


_DAY = "epoch(CAST({} AS TIMESTAMP))::BIGINT - 28800"


@query("time_ranges", oracle(f"""WITH d AS (SELECT *, {_DAY.format('a')} AS at_a, {_DAY.format('b')} AS at_b, CASE WHEN NOT (month(b) = 2 AND day(b) = 29 AND (year(a) % 4 > 0 OR (year(a) % 100 = 0 AND year(a) % 400 > 0))) THEN
  {_DAY.format("CAST(CAST(year(a) AS VARCHAR) || '-' || lpad(CAST(month(b) AS VARCHAR), 2, '0') || '-' || lpad(CAST(day(b) AS VARCHAR), 2, '0') AS DATE)").replace('CAST(CAST(', 'TRY_CAST(CAST(')} END AS handed FROM dated WHERE k < 14),
r AS (SELECT document_id, k, CASE WHEN k IN (1, 2, 9) THEN at_a + CASE k WHEN 9 THEN minute * 60 ELSE 0 END WHEN k = 4 THEN at_a + minute * 60 END AS o,
  CASE k WHEN 0 THEN at_a + 86399 WHEN 12 THEN at_a + 86399 WHEN 1 THEN at_b + 86399 WHEN 2 THEN handed + 86399 WHEN 4 THEN handed + 86400 END AS e, CASE k WHEN 12 THEN at_a END AS l FROM d),
c AS (SELECT *, CASE WHEN k IN (3, 11) THEN 'year_missing' WHEN k = 6 THEN 'unsupported_timezone' WHEN k IN (5, 7) THEN 'invalid_time' WHEN k IN (8, 10, 13) THEN 'ambiguous_time' WHEN k IN (1, 2, 4) AND NOT coalesce(o <= e, false) THEN 'invalid_time' END AS unknown FROM r)
SELECT document_id, CASE WHEN unknown IS NULL THEN o END AS opens_at, CASE WHEN unknown IS NULL THEN e END AS deadline_at, CASE WHEN unknown IS NULL THEN l END AS lower_at, unknown FROM c""", "dated"))
def _(spark, sf):
    docs = view(spark, sf, "dated")
    cut = ops.clauses(docs.select("document_id", F.lit("body_text").alias("field"), F.col("body_text").alias("text")), PACK)
    return ops.time_facts(cut, docs.select("document_id", "published_date"), PACK).select("document_id", "opens_at", "deadline_at", "lower_at", "unknown")


_RESOLVED = [
    (0, _NONE, _t("2024-02-01 23:59:59"), _NONE, ""), (1, _NONE, _t("2024-01-21 00:00:00"), _NONE, ""), (14, _t("2024-01-05 00:00:00"), _NONE, _NONE, "conflicting_evidence"), (15, _NONE, _NONE, _NONE, "year_missing"),
    (16, _NONE, _t("2024-01-15 23:59:59"), _t("2024-01-15 00:00:00"), "imprecise_deadline"), (17, _NONE, _NONE, _NONE, "invalid_time"), (18, _NONE, _NONE, _NONE, "time_unrecognized"), (19, _PUBLISHED, _NONE, _NONE, ""),
]


@query("time_resolution", oracle(_expected("opens_at deadline_at deadline_lower_at unknowns", _RESOLVED), "ruled"))
def _(spark, sf):
    return ops.time_resolution(_times(spark, sf)).withColumn("unknowns", F.array_join("unknowns", ","))


@query("media_dependence", oracle(f"SELECT document_id, document_id % {_N} = 18 OR (media > 0 AND length(trim(body_text)) = 0) AS incomplete FROM ruled", "ruled"))
def _(spark, sf):
    return ops.media_dependence(view(spark, sf, "ruled"), PACK)


_TOPICS = {v: sorted({f"{t}:{c}" for w, t, c in [*_LINKED, *_BODIES] if w == v}) for v in range(_N)}
_CONSTRAINTS = {v: sorted(f"{f}:{o}:{x}" for w, f, x, o, _ in _ASKED if w == v) for v in range(_N)}


def _parts(spark, sf):
    """Clauses, actions and linked topics of all texts, each worked out once, and what follows from them."""
    docs, cut = view(spark, sf, "ruled"), stored(_cut(spark, sf), "clauses")
    acts, mentions = stored(ops.action_blocked(ops.action_mentions(cut, PACK), PACK), "actions"), ops.topic_mentions(cut, _topics(spark))
    linked = stored(ops.document_link(ops.topic_context(mentions, acts), acts, mentions, docs, PACK), "topics")
    category = ops.notice_category(docs, acts, ops.recruitment_topic(cut, acts, docs, PACK), linked, PACK)
    times = ops.time_resolution(ops.time_facts(cut, docs.select("document_id", "published_date"), PACK))
    asked, hard = stored(qualifications(ops.audience_clauses(cut, PACK), view(spark, sf, "lexicon")), "asked"), ops.unsupported_conditions(cut, PACK)
    return acts, linked, asked, hard, ops.notice_facts(category, linked, asked, hard, times, ops.media_dependence(docs, PACK))


def _whole() -> str:
    rows = [
        (v, "=" + _KIND, ",".join(_TOPICS[v]), ",".join(_CONSTRAINTS[v]), v in (0, 12), v == 0, *next(((o, e, lo) for w, o, e, lo, _ in _RESOLVED if w == v), (_NONE,) * 3), f"=document_id % {_N} = 18") for v in range(_N)
    ]
    return _expected("category topics constraints audience_declared eligibility_complete opens_at deadline_at deadline_lower_at information_incomplete", rows)


@query("notice_facts", oracle(f"""SELECT document_id, category, topics, constraints, audience_declared, eligibility_complete, opens_at, deadline_at, deadline_lower_at, information_incomplete, sha256(to_json({{'audience_declared': audience_declared, 'category': category, 'constraints': CASE WHEN constraints = '' THEN [] ELSE string_split(constraints, ',') END, 'deadline_at': deadline_at, 'deadline_lower_at': deadline_lower_at, 'document_id': document_id,
'eligibility_complete': eligibility_complete, 'information_incomplete': information_incomplete, 'opens_at': opens_at, 'topics': CASE WHEN topics = '' THEN [] ELSE string_split(topics, ',') END}})) AS facts_sha256 FROM ({_whole()})""", "ruled"))
def _(spark, sf):
    return _parts(spark, sf)[-1].withColumns({c: F.array_join(c, ",") for c in ("topics", "constraints")})


_QUOTED = "SELECT document_id, 1 AS quote_no, right(body_text, 10) AS quote FROM ruled UNION ALL SELECT document_id, 2, right(body_text, 30) FROM ruled UNION ALL SELECT document_id, 3, left(body_text, 12) || '?' FROM ruled"
_SUPPORTED = f"CASE document_id % {_N} WHEN 0 THEN quote_no = 1 OR quote_no = 2 AND right(body_text, 30) NOT LIKE '%.%' WHEN 1 THEN quote_no < 3 WHEN 16 THEN quote_no = 1 OR quote_no = 2 AND NOT contains(right(body_text, 30), chr(10)) ELSE false END"


@query("deadline_evidence", oracle(f"SELECT q.document_id, quote_no, {_SUPPORTED.replace('document_id', 'r.document_id')} AS supported FROM ({_QUOTED}) q JOIN ruled r ON r.document_id = q.document_id", "ruled"))
def _(spark, sf):
    docs = view(spark, sf, "ruled")
    quotes = docs.selectExpr("document_id", "inline(array(struct(1 AS quote_no, right(body_text, 10) AS quote), struct(2 AS quote_no, right(body_text, 30) AS quote), struct(3 AS quote_no, concat(left(body_text, 12), '?') AS quote)))")
    times = _times(spark, sf)
    return ops.deadline_evidence(times, ops.time_resolution(times), quotes)


@query("phrase_hits", oracle("""WITH t AS (SELECT document_id, 'title' AS field, title AS text FROM notice UNION ALL SELECT document_id, 'body_text', body_text FROM notice)
SELECT document_id, field, phrase, strpos(text, phrase) - 1 AS start, strpos(text, phrase) - 1 + length(phrase) AS "end" FROM t JOIN (SELECT DISTINCT phrase FROM profile_phrase) p ON contains(text, phrase)""", "notice", "profile_phrase"))
def _(spark, sf):
    return phrase_hits(view(spark, sf, "notice"), view(spark, sf, "profile_phrase").select("phrase"))


@query("topic_candidates", oracle(" UNION ALL ".join(f"SELECT document_id, '{t}' AS topic FROM ruled WHERE contains(title, '{p}') OR contains(body_text, '{p}')" for t, p in _PHRASE.items()), "ruled"))
def _(spark, sf):
    return ops.topic_candidates(view(spark, sf, "ruled"), _topics(spark))


_PROFILES = "(VALUES ('p1', 'level', 'undergraduate'), ('p1', 'institution', 'own'), ('p2', 'level', 'graduate'), ('p2', 'role', 'student')) AS t(profile_id, field, actual)"
_INTERESTS = """(VALUES ('p1', 'scholarship', true, false, true, false), ('p1', 'contest', true, false, false, false), ('p2', 'exchange', true, false, false, false), ('p2', 'contest', false, false, false, true),
('p2', 'scholarship', false, true, false, false)) AS t(profile_id, topic, interest, excluded, high_value, store_only)"""
_TOLD = ", ".join(str(v) for v, _, blocked, told in _ACTIONS if told and blocked == "ok")
_NULLS = "CAST(NULL AS VARCHAR)"
_FROM_FACTS = f"""WITH fact AS (SELECT w.document_id, category, opens_at, deadline_at, deadline_lower_at, opens_at IS NOT NULL OR w.document_id % {_N} IN ({_TOLD}) AS opening_confirmed, false AS cancelled, audience_declared, eligibility_complete, information_incomplete, r.published_date,
'new' AS kind, 'none' AS previous_route, true AS comparison_known, false AS conditions_changed FROM ({_whole()}) w JOIN ruled r ON r.document_id = w.document_id),
requirement AS ({_expected("field operator v1 v2", [(v, f, o, x, "=" + _NULLS) for v, f, x, o, _ in _ASKED] + [(12, "gpa", "unsupported", "GPA", "=" + _NULLS), (12, "age", "unsupported", "aged under 30", "=" + _NULLS)])}),
profile AS (SELECT * FROM {_PROFILES}), profile_topic AS (SELECT * FROM {_INTERESTS}),
topic_match AS ({_expected("topic context is_primary", [(v, t, c, True) for v, t, c in _LINKED] + [(v, t, c, False) for v, t, c in _BODIES])}), """


@query("decide_from_facts", oracle(_FROM_FACTS + decided._DECIDED.strip().removeprefix("WITH ").replace(decided._SAID, "said AS (SELECT document_id, profile_id FROM requirement JOIN profile USING (field) WHERE false)") + " SELECT * FROM sent", "ruled"))
def _(spark, sf):
    """From texts to decisions: rule facts of every notice, for every profile."""
    acts, linked, said, hard, facts = _parts(spark, sf)
    told = acts.where("instructed AND blocked = 'ok' AND field = 'body_text'").select("document_id").distinct().withColumn("told", F.lit(True))
    rows = stored(facts, "facts").join(told, "document_id", "left").join(view(spark, sf, "ruled").select("document_id", "published_date"), "document_id")
    rows = rows.selectExpr("*", "opens_at IS NOT NULL OR coalesce(told, false) AS opening_confirmed", "false AS cancelled", "'new' AS kind", "'none' AS previous_route", "true AS comparison_known", "false AS conditions_changed")
    asked = said.select("document_id", "field", "operator", "values")
    asked = asked.unionByName(hard.select("document_id", "field", F.lit("unsupported").alias("operator"), F.array("excerpt").alias("values")))
    matches = linked.select("document_id", "topic", "context", (F.col("field") == "title").alias("is_primary"))
    flags = decisions.interest_flags(matches, spark.sql(f"SELECT * FROM {_INTERESTS}"))
    profiles = spark.sql(f"SELECT * FROM {_PROFILES}")
    return decisions.each_profile(decisions.decide_batch(rows, asked, profiles, flags, AT, decided._MODE, decided._NEXT), profiles)
