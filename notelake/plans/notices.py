"""Queries on notices and their versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import digest, is_cut, local_date, normalize, tree_digest, visible
from ..operators import backlog, versions
from ..operators.search import index_rows
from ..registry import query
from ..sources.bindings import AT, oracle, view

_PENDING = f"(next_due_at IS NULL OR next_due_at <= {AT}) AND (status <> 'processed' OR next_due_at IS NOT NULL)"
_FOREGROUND = "document_id % 9 = 0"
_QUOTAS = {"foreground": 4, "history": 3, "recheck": 5}
_RANKED = f"""ranked AS (SELECT source_id, document_id, grp, row_number() OVER (PARTITION BY source_id, grp ORDER BY coalesce(next_due_at, discovered_at), document_id) AS rank
  FROM (SELECT *, CASE WHEN last_success_at IS NOT NULL THEN 'recheck' WHEN {_FOREGROUND} THEN 'foreground' ELSE 'history' END AS grp FROM notice WHERE {_PENDING}))"""


@query("docs_pending", oracle(f"SELECT document_id, status, next_due_at FROM notice WHERE {_PENDING}", "notice"))
def _(spark, sf):
    return backlog.pending(view(spark, sf, "notice"), AT).select("document_id", "status", "next_due_at")


@query("doc_counts", oracle("SELECT source_id, status, last_success_at IS NOT NULL AS has_success, count(*) AS n FROM notice GROUP BY ALL", "notice"))
def _(spark, sf):
    return backlog.doc_counts(view(spark, sf, "notice"))


@query("first_backlog", oracle(f"""
SELECT source_id, count(*) AS total, count(*) FILTER (next_due_at IS NULL OR next_due_at <= {AT}) AS due, count(*) FILTER (next_due_at > {AT}) AS deferred,
  count(*) FILTER (status = 'failed') AS failed, arg_min(document_id, (discovered_at, document_id)) AS oldest_id, greatest({AT} - min(discovered_at), 0) AS oldest_age,
  first(last_error_code ORDER BY discovered_at, document_id) AS oldest_error
FROM notice WHERE last_success_at IS NULL GROUP BY source_id""", "notice"))
def _(spark, sf):
    return backlog.first_backlog(view(spark, sf, "notice"), AT)


@query("recheck_backlog", oracle(f"""
SELECT source_id, count(*) AS successful, count(*) FILTER (next_due_at <= {AT}) AS due, count(*) FILTER (next_due_at > {AT}) AS deferred,
  count(*) FILTER (next_due_at <= {AT} AND status = 'failed') AS failed_due, count(*) FILTER (next_due_at IS NULL) AS no_deadline,
  count(*) FILTER (next_due_at IS NULL AND status = 'processed') AS unscheduled, {AT} - min(next_due_at) FILTER (next_due_at <= {AT}) AS oldest_overdue
FROM notice WHERE last_success_at IS NOT NULL GROUP BY source_id""", "notice"))
def _(spark, sf):
    return backlog.recheck_backlog(view(spark, sf, "notice"), AT)


@query("due_rank", oracle(f"WITH {_RANKED} SELECT * FROM ranked", "notice"))
def _(spark, sf):
    return backlog.due_rank(view(spark, sf, "notice"), AT, F.expr(_FOREGROUND))


@query("slot_selection", oracle(f"""WITH {_RANKED},
sized AS (SELECT *, CASE grp WHEN 'foreground' THEN 0 WHEN 'history' THEN 1 ELSE 2 END AS g, CASE grp WHEN 'foreground' THEN 4 WHEN 'history' THEN 3 ELSE 5 END AS quota FROM ranked),
taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rank > quota, CASE WHEN rank <= quota THEN rank ELSE g END, CASE WHEN rank <= quota THEN g ELSE rank END) AS i FROM sized) WHERE i <= 10)
SELECT source_id, document_id, grp, row_number() OVER (PARTITION BY source_id ORDER BY r, g) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY source_id, grp ORDER BY rank) AS r FROM taken)""", "notice"))
def _(spark, sf):
    return backlog.slot_selection(backlog.due_rank(view(spark, sf, "notice"), AT, F.expr(_FOREGROUND)), _QUOTAS, 10)


_AGE = "date_diff('day', published_date, LOCALDATE[last_success_at])"
_DUE = f"last_success_at + CASE WHEN {_AGE} <= 7 THEN 21600 WHEN {_AGE} <= 30 THEN 86400 ELSE 604800 END"


@query("success_due", oracle(f"SELECT document_id, {_DUE} AS due, {_AGE} < 0 AS future FROM notice WHERE last_success_at IS NOT NULL", "notice"))
def _(spark, sf):
    return backlog.success_due(view(spark, sf, "notice"))


@query("recheck_policy", oracle(f"""
SELECT document_id, next_due_at AS old_due, CASE WHEN next_due_at IS NULL THEN {AT} ELSE least(next_due_at, {_DUE}) END AS new_due
FROM notice WHERE status = 'processed' AND last_success_at IS NOT NULL AND (next_due_at IS NULL OR {_DUE} < next_due_at)""", "notice"))
def _(spark, sf):
    return backlog.recheck_policy(view(spark, sf, "notice"), AT)


_FAILED = [
    "document_id", "last_attempt_at", "CASE document_id % 8 WHEN 0 THEN 'http_not_found' WHEN 1 THEN 'tls_error' WHEN 2 THEN 'parse_failed' WHEN 3 THEN 'redirect_loop' WHEN 4 THEN 'timeout' WHEN 5 THEN 'http_status' WHEN 6 THEN 'empty_body' END AS last_error_code",
    "CASE WHEN document_id % 8 = 5 THEN CASE document_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 410 WHEN 3 THEN 401 ELSE 500 END END AS status_code",
]


@query("failure_due", oracle(f"""SELECT document_id, kind, last_attempt_at + CASE kind WHEN 'missing' THEN 604800 WHEN 'access' THEN 86400 WHEN 'parse' THEN 7200 ELSE 1800 END AS due FROM (SELECT *, CASE WHEN status_code IN (404, 410) OR last_error_code = 'http_not_found' THEN 'missing'
WHEN status_code IN (401, 403) OR last_error_code = 'tls_error' THEN 'access' WHEN last_error_code IN ('parse_failed', 'redirect_loop', 'empty_body') THEN 'parse' ELSE 'transient' END AS kind FROM (SELECT {', '.join(_FAILED)} FROM notice) WHERE last_error_code IS NOT NULL)""", "notice"))
def _(spark, sf):
    return backlog.failure_due(view(spark, sf, "notice").selectExpr(*_FAILED), {"missing": 604800, "access": 86400, "parse": 7200, "transient": 1800})


@query("oldest_backlog", oracle(f"SELECT document_id, coalesce(next_due_at, discovered_at) AS since FROM notice WHERE {_PENDING} ORDER BY 2, 1 LIMIT 1", "notice"))
def _(spark, sf):
    return backlog.oldest_backlog(view(spark, sf, "notice"), AT)


_HISTORY = "(PARTITION BY document_id ORDER BY observed_at, version_id)"
_CHANGES = f"""changes AS (SELECT document_id, version_id, observed_at, CASE WHEN pparser IS NULL THEN 'first' WHEN parser_version = pparser AND content_sha = pcontent THEN 'same' WHEN parser_version = pparser THEN 'changed' WHEN raw_sha = psha THEN 'same' ELSE 'unknown' END AS change,
  coalesce(parser_version <> pparser, false) AS other_parser
  FROM (SELECT *, lag(raw_sha) OVER w AS psha, lag(content_sha) OVER w AS pcontent, lag(parser_version) OVER w AS pparser FROM version WINDOW w AS {_HISTORY}))"""


@query("version_pairs", oracle(f"SELECT document_id, version_id, lag(version_id) OVER w AS previous_id, lag(raw_sha) OVER w IS NOT DISTINCT FROM raw_sha AS same_body FROM version WINDOW w AS {_HISTORY}", "version"))
def _(spark, sf):
    return versions.version_pairs(view(spark, sf, "version"))


@query("version_changes", oracle(f"WITH {_CHANGES} SELECT * FROM changes", "version"))
def _(spark, sf):
    return versions.version_changes(view(spark, sf, "version"))


@query("event_seq", oracle(f"""WITH {_CHANGES} SELECT document_id, version_id, change, row_number() OVER {_HISTORY} AS event_seq FROM changes WHERE change IN ('first', 'changed')""", "version"))
def _(spark, sf):
    return versions.event_seq(view(spark, sf, "version"))


@query("current_pointer", oracle("SELECT document_id, arg_max(version_id, (observed_at, version_id)) AS version_id FROM version GROUP BY document_id", "version"))
def _(spark, sf):
    return versions.current_pointer(view(spark, sf, "version"))


@query("current_versions", oracle("SELECT n.document_id, v.version_id, n.source_id, v.raw_sha, v.parser_version FROM notice n JOIN version v ON n.document_id = v.document_id AND n.current_version_id = v.version_id", "notice", "version"))
def _(spark, sf):
    return versions.current_versions(view(spark, sf, "notice"), view(spark, sf, "version"))


_INDEX = "SELECT document_id, 2 * document_id + 1 AS version_id, CASE WHEN document_id % 6 = 0 THEN 'old' ELSE 'trigram-1' END AS index_version FROM notice WHERE document_id % 5 <> 2"


@query("index_stale", oracle(f"""WITH i AS ({_INDEX}) SELECT * FROM (
SELECT n.document_id, CASE WHEN i.version_id IS NULL THEN 'missing' WHEN i.version_id <> n.current_version_id THEN 'version' WHEN i.index_version <> 'trigram-1' THEN 'format' END AS reason
FROM notice n LEFT JOIN i ON n.document_id = i.document_id WHERE n.status = 'processed') WHERE reason IS NOT NULL""", "notice"))
def _(spark, sf):
    docs = view(spark, sf, "notice")
    index = docs.where("document_id % 5 <> 2").selectExpr("document_id", "2 * document_id + 1 AS version_id", "CASE WHEN document_id % 6 = 0 THEN 'old' ELSE 'trigram-1' END AS index_version")
    return versions.index_stale(docs, index, "trigram-1")


@query("upsert_newest", oracle("""
SELECT document_id, version_id, observed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY observed_at DESC, fresh DESC, version_id DESC) AS i FROM (
    SELECT document_id, version_id, observed_at, 0 AS fresh FROM version WHERE k = 0
    UNION ALL SELECT document_id, version_id, observed_at - CASE WHEN document_id % 5 = 0 THEN 90000 ELSE 0 END, 1 FROM version WHERE k = 1)) WHERE i = 1""", "version"))
def _(spark, sf):
    v = view(spark, sf, "version")
    batch = v.where("k = 1").selectExpr("document_id", "version_id", "observed_at - CASE WHEN document_id % 5 = 0 THEN 90000 ELSE 0 END AS observed_at")
    return versions.upsert_newest(v.where("k = 0").select("document_id", "version_id", "observed_at"), batch, ["document_id"], "observed_at", "version_id")


@query("insert_if_absent", oracle("""
SELECT raw_sha, version_id FROM (SELECT raw_sha, version_id, row_number() OVER (PARTITION BY raw_sha ORDER BY version_id) AS i FROM version WHERE k = 1 AND raw_sha NOT IN (SELECT raw_sha FROM version WHERE k = 0)) WHERE i = 1""", "version"))
def _(spark, sf):
    v = view(spark, sf, "version").select("raw_sha", "version_id", "k")
    return versions.insert_if_absent(v.where("k = 0"), v.where("k = 1"), ["raw_sha"], ["version_id"]).select("raw_sha", "version_id")


@query("text_normalize", oracle(r"SELECT document_id, trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '\s+', ' ', 'g')) AS title_text FROM notice", "notice"))
def _(spark, sf):
    return view(spark, sf, "notice").select("document_id", normalize(F.col("title")).alias("title_text"))


#: Endings in decomposed, compatible, final and full-width letters, and white space that is not ASCII.
_ODD = ["e\u0301 o\u0308", "\u1e9e\u017f \u03a3\u03c2", "\ufb01\u00a0x", "\u2003A\u030a", "\uac00\u11a8", "\u0130", "a\u0323\u0302"]


@query("text_composed", oracle(f"""SELECT document_id, trim(regexp_replace(CASE document_id % {len(_ODD)} {' '.join(f"WHEN {i} THEN replace(lower(nfc_normalize(title || ' {x}')), 'ß', 'ss')" for i, x in enumerate(_ODD) if i not in (1, 2, 5))}
  WHEN 1 THEN replace(lower(nfc_normalize(title)), 'ß', 'ss') || ' sss σσ' WHEN 2 THEN replace(lower(nfc_normalize(title)), 'ß', 'ss') || ' fi x' ELSE replace(lower(nfc_normalize(title)), 'ß', 'ss') || ' i' || chr(775) END, '[\\s\\p{{Z}}]+', ' ', 'g')) AS title_text FROM notice""", "notice"))
def _(spark, sf):
    ends = F.element_at(F.array(*map(F.lit, _ODD)), (F.col("document_id") % len(_ODD)).cast("int") + 1)
    return view(spark, sf, "notice").select("document_id", normalize(F.concat("title", F.lit(" "), ends)).alias("title_text"))


@query("text_visible", oracle(r"""
SELECT document_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS line, length(t) > 60 AS cut FROM (SELECT document_id, trim(regexp_replace(body_text, '[\p{C}\s]+', ' ', 'g')) AS t FROM notice)""", "notice"))
def _(spark, sf):
    body = F.col("body_text")
    return view(spark, sf, "notice").select("document_id", visible(body, 60).alias("line"), is_cut(body, 60).alias("cut"))


@query("scope_filter", oracle("SELECT document_id, published_date FROM notice WHERE source_id = 'src3' AND published_date BETWEEN date '2024-01-10' AND date '2024-02-20'", "notice"))
def _(spark, sf):
    return view(spark, sf, "notice").where("source_id = 'src3' AND published_date BETWEEN date '2024-01-10' AND date '2024-02-20'").select("document_id", "published_date")


@query("local_date", oracle("SELECT document_id, LOCALDATE[discovered_at] AS day FROM notice", "notice"))
def _(spark, sf):
    return view(spark, sf, "notice").select("document_id", local_date(F.col("discovered_at")).alias("day"))


@query("doc_reference", oracle("SELECT document_id, concat_ws(':', source_id, CAST(document_id AS VARCHAR), 'v' || current_version_id) AS reference, current_version_id AS version_back FROM notice", "notice"))
def _(spark, sf):
    ref = F.concat_ws(":", "source_id", F.col("document_id").cast("string"), F.concat(F.lit("v"), F.col("current_version_id").cast("string")))
    return view(spark, sf, "notice").withColumn("reference", ref).select("document_id", "reference", F.substring(F.split_part("reference", F.lit(":"), F.lit(3)), 2, 20).cast("long").alias("version_back"))


@query("content_digest", oracle("""SELECT document_id, SHA[to_json({'published_date': CAST(published_date AS VARCHAR), 'source_id': source_id, 'status': status})] AS digest FROM notice""", "notice"))
def _(spark, sf):
    return view(spark, sf, "notice").select("document_id", digest(published_date=F.col("published_date").cast("string"), source_id=F.col("source_id"), status=F.col("status")).alias("digest"))


@query("text_chunks", oracle("""
SELECT document_id, i * 500 AS start, substr(body_text, i * 500 + 1, 500) AS chunk, CASE WHEN (i + 1) * 500 < length(body_text) THEN (i + 1) * 500 END AS next_start
FROM (SELECT document_id, body_text, unnest(range(0, greatest(CAST(ceil(length(body_text) / 500.0) AS BIGINT), 1))) AS i FROM notice)""", "notice"))
def _(spark, sf):
    n = F.greatest(F.ceil(F.length("body_text") / 500.0), F.lit(1))
    rows = view(spark, sf, "notice").select("document_id", "body_text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    start = F.col("i") * 500
    return rows.select("document_id", start.alias("start"), F.substring("body_text", (start + 1).cast("int"), F.lit(500)).alias("chunk"), F.when(start + 500 < F.length("body_text"), start + 500).alias("next_start"))


@query("duplicate_conflicts", oracle("SELECT title, count(*) AS n, count(DISTINCT SHA[body_text]) AS texts, count(DISTINCT SHA[body_text]) > 1 AS conflict FROM notice GROUP BY title HAVING count(*) > 1", "notice"))
def _(spark, sf):
    texts = F.count_distinct(F.sha2("body_text", 256))
    return view(spark, sf, "notice").groupBy("title").agg(F.count("*").alias("n"), texts.alias("texts"), (texts > 1).alias("conflict")).where("n > 1")


def _tree(levels: int, width: int = 512) -> str:
    """The tree of digests, one query a level; the last gathers what is left of a source."""
    out = "SELECT source_id, document_id AS k, status AS v, 1 AS n FROM notice"
    for level in range(levels):
        own = "" if level == levels - 1 else f", CAST(floor(k / {width}) AS BIGINT)"
        out = f"SELECT source_id{own and own + ' AS k'}, sha256(to_json(list({{'k': k, 'v': v}} ORDER BY k))) AS v, CAST(sum(n) AS BIGINT) AS n FROM ({out}) GROUP BY source_id{own}"
    return f"SELECT source_id, n, v AS digest FROM ({out})"


@query("members_digest", oracle(_tree(4), "notice"))
def _(spark, sf):
    return tree_digest(view(spark, sf, "notice"), ["source_id"], "document_id", F.col("status"))


@query("foreign_sources", oracle("SELECT DISTINCT source_id FROM (SELECT source_id FROM notice UNION SELECT source_id FROM response) WHERE source_id <> 'src0'", "notice", "response"))
def _(spark, sf):
    both = view(spark, sf, "notice").select("source_id").union(view(spark, sf, "response").select("source_id")).distinct()
    return both.where("source_id <> 'src0'")


@query("snapshot_facts", oracle("""SELECT n.source_id, count(*) AS documents, count(v.version_id) AS processed, count(*) FILTER (status = 'failed' AND last_success_at IS NULL) AS failed_without_success, count(*) FILTER (status = 'failed' AND last_success_at IS NOT NULL) AS failed_with_success,
max(last_success_at) AS latest_fetched_at, max(v.observed_at) AS latest_parsed_at, count(*) FILTER (a.list_date IS NULL) AS unadapted_references FROM notice n JOIN activation a USING (document_id)
LEFT JOIN version v ON v.document_id = n.document_id AND v.version_id = n.current_version_id AND n.last_success_at IS NOT NULL GROUP BY n.source_id""", "notice", "version", "activation"))
def _(spark, sf):
    references = view(spark, sf, "activation").where("list_date IS NULL").select("source_id")
    return versions.snapshot_facts(view(spark, sf, "notice"), view(spark, sf, "version"), references)


@query("recent_candidates", oracle(f"SELECT document_id, discovered_at, n > 50 AS truncated FROM (SELECT document_id, discovered_at, count(*) OVER () AS n FROM notice WHERE {_PENDING}) ORDER BY discovered_at DESC, document_id LIMIT 50", "notice"))
def _(spark, sf):
    docs = backlog.pending(view(spark, sf, "notice"), AT)
    total = docs.agg((F.count("*") > 50).alias("truncated"))
    return docs.orderBy(F.desc("discovered_at"), "document_id").limit(50).select("document_id", "discovered_at").crossJoin(F.broadcast(total))


@query("rebuild_equal", oracle("""WITH w AS (SELECT source_id, count(*) AS rows FROM notice WHERE status = 'processed' GROUP BY source_id), m AS (SELECT source_id, count(*) AS n FROM notice WHERE status = 'processed' AND document_id % 50 = 7 AND title IS NOT NULL GROUP BY source_id)
SELECT w.source_id, rows, coalesce(n, 0) AS missing, coalesce(n, 0) AS extra FROM w LEFT JOIN m ON m.source_id = w.source_id""", "notice"))
def _(spark, sf):
    """An index built at once against one kept up to date: a third of the documents comes later, and some rows of the
    kept index are of an older title."""
    docs = view(spark, sf, "notice")
    whole = index_rows(docs)
    early = index_rows(docs.where("document_id % 3 > 0").withColumn("title", F.when(F.col("document_id") % 50 == 7, F.concat("title", F.lit(" (old)"))).otherwise(F.col("title"))))
    late = index_rows(docs.where("document_id % 3 = 0").withColumn("title", F.when(F.col("document_id") % 50 == 7, F.concat("title", F.lit(" (old)"))).otherwise(F.col("title"))))
    return versions.rebuild_equal(whole, versions.insert_if_absent(early, late, ["document_id"], ["version_id"]).unionByName(early), "source_id")
