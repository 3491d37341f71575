"""Notice-corpus views over the generic test tables.

Each view is one SQL text that Spark and DuckDB both run, so a query and its oracle start from the same rows.
``SHA[x]``, ``EPOCH[x]`` and ``LOCALDATE[x]`` stand for what the two dialects spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_sums, sessions

T0 = 1704067200
AT = T0 + 12 * 86400

_TABLES = {"documents", "pages", "events", "orders", "lineitem", "labels", "benchmark", "conversations", "customer"}

#: What the rule facts are tried on: ends put after every document's title and text, in turn.
RULED = (
    ("the scholarship", "You can apply for the scholarship. It is open to undergraduates of this university. The deadline is 2024-02-01"),
    ("the contest", "please register now, until 2024-01-20 24:00"),
    ("the contest and the scholarship", "please register"),
    ("results of the contest", "please register"),
    ("", "You may not apply for the exchange program"),
    ("", "to apply is closed, the exchange program"),
    ("", "see records of whoever may apply, the exchange program"),
    ("", "last year you could apply for the exchange program"),
    ("", "you may apply fee refund, exchange program"),
    ("we recruit teaching assistants", "we recruit teaching assistants now; please apply"),
    ("we recruit assistants", "there is no recruitment"),
    ("we recruit assistants", "we recruit assistants now. recruitment is suspended"),
    ("", "limited to graduates or teachers; GPA over 3; aged under 30"),
    ("", "\nRequirements:\n1) one thing\n2) another\nContact: x\n3) no"),
    ("", "opens on 2024-01-05 until 2024-01-10 12:30; deadline 2024-01-11"),
    ("", "apply by before 2024-01-15; deadline Jan 5"),
    ("", "apply by before 2024-01-15"),
    ("", "opens on 2024-02-30"),
    ("", "the deadline, see the attachment"),
    ("", "from today on you can register, not before contest scholarship"),
)


def _text(s: str) -> str:
    return "concat(" + ", chr(10), ".join(f"'{x}'" for x in s.split("\n")) + ")"


VIEWS: dict[str, str] = {
    "ruled": f"""
SELECT doc_id AS document_id, date '2024-01-01' + CAST((doc_id * 7) % 90 AS INT) AS published_date, doc_id % 3 AS media,
  concat(substr(split_part(text, chr(10), 1), 1, 80), ' ', CASE doc_id % {len(RULED)} {' '.join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(RULED))} END) AS title,
  concat(text, chr(10), CASE doc_id % {len(RULED)} {' '.join(f'WHEN {i} THEN {_text(b)}' for i, (_, b) in enumerate(RULED))} END) AS body_text
FROM documents""",
    "notice": f"""
SELECT doc_id AS document_id, source AS source_id, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS body_text,
  date '2024-01-01' + CAST((doc_id * 7) % 90 AS INT) AS published_date, {T0} + doc_id * 613 AS discovered_at,
  CASE WHEN doc_id % 10 = 0 THEN 'discovered' WHEN doc_id % 10 = 1 THEN 'failed' ELSE 'processed' END AS status,
  CASE WHEN doc_id % 10 = 0 OR doc_id % 20 = 1 THEN NULL ELSE {T0} + doc_id * 613 + 3600 END AS last_success_at,
  CASE WHEN doc_id % 10 = 0 THEN NULL ELSE {T0} + doc_id * 613 + 7200 END AS last_attempt_at,
  CASE WHEN doc_id % 10 = 1 THEN 'parse_failed' END AS last_error_code,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE {T0} + doc_id * 613 + (doc_id % 23) * 86400 END AS next_due_at,
  2 * doc_id + CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 1 END AS current_version_id
FROM documents""",
    "version": f"""
SELECT doc_id AS document_id, 2 * doc_id + k AS version_id, k, text || CASE WHEN k = 1 AND doc_id % 3 = 0 THEN ' v2' ELSE '' END AS body_text,
  {T0} + doc_id * 613 + k * 86400 AS observed_at, CASE WHEN doc_id % 11 = 0 AND k = 1 THEN 'p2' ELSE 'p1' END AS parser_version,
  SHA[text || CASE WHEN k = 1 AND doc_id % 3 = 0 THEN ' v2' ELSE '' END] AS content_sha, SHA[text || CASE WHEN k = 1 AND doc_id % 3 = 0 THEN ' v2' WHEN k = 1 AND doc_id % 5 = 2 THEN '<!-- -->' ELSE '' END] AS raw_sha, date '2024-01-01' + CAST((doc_id * 7) % 90 AS INT) AS published_date
FROM documents CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) AS ks""",
    "response": f"""
SELECT page_id AS id, concat('s', CAST(page_id % 5 AS STRING)) AS source_id, url AS requested_url,
  CASE WHEN page_id % 17 = 3 THEN concat(url, '#moved') ELSE url END AS final_url, {T0} + page_id * 600 AS fetched_at,
  CASE WHEN page_id % 5 = 4 THEN 304 ELSE 200 END AS status_code, CASE WHEN page_id % 5 = 4 THEN page_id - 1 END AS validated_response_id,
  CASE WHEN page_id % 23 = 6 THEN NULL WHEN page_id % 29 = 8 THEN 'unquoted' WHEN page_id % 31 = 9 THEN concat('W/"e', CAST(CAST(floor(page_id / 5) AS BIGINT) AS STRING), '"') ELSE concat('"e', CAST(CAST(floor(page_id / 5) AS BIGINT) AS STRING), '"') END AS etag,
  CAST(floor(page_id / 5) AS BIGINT) AS resource_id, CASE WHEN page_id % 4 = 0 THEN 'list' ELSE 'notice' END AS page_type, CASE WHEN page_id % 4 > 0 THEN CAST(floor(page_id / 10) AS BIGINT) END AS document_id,
  CASE page_id % 12 WHEN 1 THEN 'Tue, 02 Jan 2024 03:04:05 GMT' WHEN 2 THEN 'yesterday' WHEN 3 THEN 'Tue, 02 Jan 2024 03:04:05 +0100' WHEN 4 THEN 'Tue, 31 Feb 2024 03:04:05 GMT' WHEN 5 THEN 'Tue, 02 Jan 2024 03:04:05 GMT' END AS last_modified,
  CASE page_id % 11 WHEN 1 THEN '120' WHEN 2 THEN ' 0030 ' WHEN 3 THEN '9223372036854775807' WHEN 4 THEN '99999999999999999999' WHEN 5 THEN 'Sat, 13 Jan 2024 03:04:05 GMT' WHEN 6 THEN 'soon' WHEN 7 THEN '-5' WHEN 8 THEN 'Mon, 01 Jan 2001 00:00:00 GMT' END AS retry_after,
  CASE page_id % 14 WHEN 1 THEN 'timeout' WHEN 2 THEN 'request_limit' WHEN 3 THEN 'robots_denied' WHEN 4 THEN 'Bad Error' WHEN 5 THEN 'parse_failed' END AS error_code,
  CASE page_id % 13 WHEN 1 THEN 'Accept-Encoding' WHEN 2 THEN '*' WHEN 3 THEN 'Cookie' END AS vary,
  CASE page_id % 13 WHEN 4 THEN 'no-store' WHEN 5 THEN 'max-age=60, No-Store' WHEN 6 THEN 'max-age=60' END AS cache_control,
  CASE page_id % 13 WHEN 7 THEN 'gzip' WHEN 8 THEN 'identity' END AS content_encoding,
  CASE WHEN page_id % 5 = 4 THEN NULL ELSE SHA[html] END AS body_sha256, CASE WHEN page_id % 5 = 4 THEN NULL WHEN page_id % 37 = 3 THEN 'raw/../x.bin' ELSE concat('raw/', SHA[html], '.bin') END AS body_path,
  CASE WHEN page_id % 5 = 4 THEN 'none' WHEN page_id % 19 = 7 THEN 'partial' ELSE 'complete' END AS body_state, html AS body
FROM pages""",
    "page": """
SELECT page_id, url, CASE WHEN page_id % 16 = 7 THEN substr(html, 1, CAST(floor(length(html) * (page_id % 10 + 1) / 11) AS INT)) ELSE html END AS html FROM (
SELECT page_id, url, replace(html, '</h1>', concat('</h1>', CASE WHEN page_id % 9 = 8 THEN '' ELSE concat('<i class="date">Date: ', CASE page_id % 6 WHEN 0 THEN '2024-02-30' WHEN 1 THEN 'soon' ELSE concat('2024-01-', lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0')) END, '</i>') END,
  CASE page_id % 4 WHEN 1 THEN '<img src="../i/a.png" alt="a plan" width="40"><img src="/dot.gif" width="1" height="1">' WHEN 2 THEN '<img alt="none">' ELSE '' END,
  CASE page_id % 5 WHEN 1 THEN '<p hidden>unseen text</p><span class="counter">17 views</span>' WHEN 2 THEN '<p onclick="go(1)" data-x="y">seen &lt;here&gt;</p>' ELSE '' END,
  '<a href="./x/../y.htm">y</a><a href=''mailto:a@b''>m</a><a href="//other.example/z">z</a><a href="https:/bad">b</a><a href=''?q=1''>q</a><a href=../../../../../up.htm>up <b>and</b> up</a>',
  CASE page_id % 8 WHEN 1 THEN '<div hidden><div>one</div>two<div>three<nav>four</nav></div></div>kept' WHEN 2 THEN '<p style=''color: red; DISPLAY : none''>lost<p>found &#233;&#x4E2D;<pre>  as   is </pre>'
    WHEN 3 THEN '<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><th>3</table>' WHEN 4 THEN '<div class=''wide ad''><div>x</div><a href="/no">y</a></div><a href=bare.htm>bare</a>'
    WHEN 5 THEN '<b>bold<div>in</b> block</div></i></p>after' WHEN 6 THEN '<img src=''one.png'' alt=''it is''><img src=bare.png width=1 height=1><img src=two.png alt=>' ELSE '' END,
  CASE WHEN page_id % 27 = 4 THEN '<div class="fj"></div><div class=fj><a href="/x">x</a></div>' ELSE '' END,
  CASE WHEN page_id % 3 = 0 THEN concat('<div class="', CASE WHEN page_id % 6 = 3 THEN 'panel fj"><div>files</div><div><ul>' ELSE 'fj"><ul>' END, '<li><a href="/download?owner=', CAST(page_id AS STRING), '&file=', CASE WHEN page_id % 7 = 3 THEN 'b-d' ELSE 'f1' END, CASE WHEN page_id % 11 = 6 THEN '&file=f2' ELSE '' END, '">plan.pdf</a></li><li><a href=files/t.doc>', CASE WHEN page_id % 5 = 4 THEN '' ELSE 't<i>.doc</i>' END, '</a></li></ul></div>', CASE WHEN page_id % 6 = 3 THEN '</div>' ELSE '' END) ELSE '' END)) AS html
FROM pages) AS p""",
    "list_html": """
SELECT page_id, url, concat('<ul class="am-list"><li><a href="/info/12/', CAST(page_id AS STRING), '.htm"><span>One ', CAST(page_id AS STRING), '</span><i>2024-01-0', CAST(page_id % 9 + 1 AS STRING), '</i></a>', CASE WHEN page_id % 4 = 3 THEN '<ul><li><a href="/inner">inner</a></ul>' ELSE '</li>' END, '<li><a href="', CASE page_id % 4 WHEN 1 THEN 'a b' WHEN 2 THEN '' ELSE 'x%41.htm' END, '"><span>Two</span><i> ', CASE WHEN page_id % 5 = 3 THEN '2024-13-01' ELSE '2023-12-31' END,
  ' </i></a></li><li>', CASE WHEN page_id % 3 = 2 THEN 'nothing' ELSE '<a href="/z"><span> </span><i>2024-01-01</i></a>' END, '</li></ul>',
  CASE WHEN page_id % 13 = 12 THEN '' ELSE concat('<div class="p_pages"><span class="p_no_d">', CASE WHEN page_id % 11 = 10 THEN 'x' ELSE CAST(CASE WHEN page_id % 7 = 6 THEN 2 ELSE 1 END AS STRING) END, '</span><span class="p_no"><a href="/l/2.htm">2</a></span>',
    CASE WHEN page_id % 17 = 5 THEN '' ELSE '<span class="p_dot">...</span>' END, '<span class="p_no"><a href="/l/', CASE WHEN page_id % 19 = 4 THEN '2' ELSE '9' END, '.htm">9</a></span>', CASE WHEN page_id % 23 = 7 THEN '' ELSE concat('<span class="p_next"><a href="/l/', CASE WHEN page_id % 5 = 2 THEN '3' ELSE '2' END, '.htm">next</a></span>') END, '<span class="p_last"><a href="/l/9.htm">last</a></span></div>') END) AS html
FROM pages""",
    "resource": """
SELECT CAST(floor(page_id / 5) AS BIGINT) AS id, 's3' AS source_id, max(CASE WHEN page_id % 5 = 3 THEN url END) AS request_uri, max(CASE WHEN page_id % 5 = 3 THEN page_id END) AS latest_response_id,
  CASE WHEN floor(min(page_id) / 5) % 7 = 3 THEN max(page_id) END AS blocked_by_response_id, CASE WHEN floor(min(page_id) / 5) % 9 = 2 THEN 'other' ELSE 'standard' END AS profile_sha256,
  CASE floor(min(page_id) / 5) % 4 WHEN 0 THEN NULL WHEN 1 THEN min(page_id) ELSE max(CASE WHEN page_id % 5 = 3 THEN page_id END) END AS last_processed_response_id,
  CASE floor(min(page_id) / 5) % 4 WHEN 0 THEN NULL WHEN 2 THEN 'p1' ELSE 'p2' END AS last_processed_parser_version
FROM pages GROUP BY floor(page_id / 5)""",
    "list_page": """
SELECT CAST(floor(page_id / 6) AS BIGINT) AS run_id, page_id % 6 + 1 AS ordinal, page_id % 6 + 1 + CASE WHEN page_id % 97 = 3 THEN 1 ELSE 0 END AS page, CASE WHEN floor(page_id / 6) % 7 = 2 THEN 9 WHEN page_id % 89 = 4 THEN 7 ELSE 6 END AS total_pages,
  concat('/list/', CAST(page_id % 6 + 1 AS STRING)) AS url, CASE WHEN page_id % 6 < 5 OR floor(page_id / 6) % 11 = 5 THEN concat('/list/', CAST(page_id % 6 + CASE WHEN page_id % 53 = 7 THEN 3 ELSE 2 END AS STRING)) END AS next_url,
  concat('d', CAST(floor(page_id / 6) AS STRING)) AS first_digest, CASE WHEN floor(page_id / 6) % 5 = 1 THEN 'changed' ELSE concat('d', CAST(floor(page_id / 6) AS STRING)) END AS recheck_digest
FROM pages""",
    "sample": """
SELECT event_id, concat('s', CAST(user_id % 5 AS STRING)) AS source_id, EPOCH[ts] AS seen_at, event_type, event_type = 'error' AS unavailable,
  sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS processed,
  sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS documents
FROM events""",
    "run": """
SELECT source_id, run_no, min(seen_at) AS started_at, max(seen_at) AS last_at, count(*) AS requests,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS succeeded,
  CASE WHEN min(event_id) % 9 = 0 THEN NULL ELSE max(seen_at) END AS finished_at
FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY seen_at, event_id) AS run_no
  FROM (SELECT event_id, concat('s', CAST(user_id % 5 AS STRING)) AS source_id, EPOCH[ts] AS seen_at, event_type,
      EPOCH[ts] - lag(EPOCH[ts]) OVER (PARTITION BY user_id % 5 ORDER BY EPOCH[ts], event_id) AS gap FROM events) AS a) AS b
GROUP BY source_id, run_no""",
    "message": """
SELECT o_orderkey AS mail_id, o_custkey % 20 AS installation, CASE WHEN o_orderpriority LIKE '1%' THEN 'immediate' ELSE 'digest' END AS kind,
  EPOCH[o_orderdate] AS frozen_at, CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'sending' WHEN 2 THEN 'retry' WHEN 3 THEN 'uncertain' WHEN 4 THEN 'accepted' ELSE 'blocked' END AS state,
  CASE WHEN o_orderkey % 6 IN (2, 3) THEN EPOCH[o_orderdate] + (o_orderkey % 50) * 3600 WHEN o_orderkey % 6 = 0 THEN EPOCH[o_orderdate] END AS next_attempt_at,
  CASE WHEN o_orderkey % 6 = 4 THEN EPOCH[o_orderdate] + 60 * (o_orderkey % 500) END AS accepted_at
FROM orders""",
    "attempt": """
SELECT l_orderkey AS mail_id, l_linenumber AS attempt_no, EPOCH[l_shipdate] AS started_at, l_partkey * 100000 + l_suppkey AS line_id,
  CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL ELSE EPOCH[l_shipdate] + CAST(l_quantity AS BIGINT) * 60 END AS finished_at,
  CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'permanent' ELSE 'temporary' END ELSE CASE WHEN l_linestatus = 'F' THEN 'uncertain' END END AS outcome,
  CASE WHEN l_partkey % 3 = 0 THEN 'channel' ELSE 'message' END AS scope
FROM lineitem""",
    "manual_grant": """
SELECT o_orderkey AS mail_id, EPOCH[o_orderdate] + (o_orderkey * 7 % 130) * 86400 AS granted_at FROM orders WHERE o_orderkey % 3 < 2
UNION ALL SELECT o_orderkey, EPOCH[o_orderdate] + (o_custkey * 11 % 150) * 86400 FROM orders WHERE o_orderkey % 5 = 1""",
    "event": """
SELECT o_orderkey AS event_id, o_custkey % 20 AS installation, o_custkey AS document_id, EPOCH[o_orderdate] AS occurred_at,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'immediate' WHEN o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN 'digest' ELSE 'none' END AS route,
  o_orderkey % 4 = 0 AS allocated, 200 + o_orderkey % 1500 AS item_bytes, CAST(floor(EPOCH[o_orderdate] / 604800) AS BIGINT) AS slot,
  EPOCH[o_orderdate] + (o_orderkey % 3) * 43200 AS due_at
FROM orders""",
    "review": """
SELECT d.doc_id AS item_id, d.source AS source_id,
  CASE WHEN l.toxic = 1 THEN 'IGNORE' WHEN l.quality = 1 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'PUSH_NOW' ELSE 'DIGEST' END ELSE 'STORE_ONLY' END AS actual,
  CASE d.n_chars % 4 WHEN 0 THEN 'PUSH_NOW' WHEN 1 THEN 'DIGEST' WHEN 2 THEN 'STORE_ONLY' ELSE 'IGNORE' END AS predicted, d.doc_id % 17 = 0 AS mismatch
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "lexicon": """
SELECT DISTINCT 'condition' AS role, 'college' AS field, lower(c_mktsegment) AS value, concat('school of ', lower(c_mktsegment)) AS phrase FROM customer
UNION ALL SELECT DISTINCT 'condition', 'entry_year', CAST(c_custkey % 100 + 1990 AS STRING), concat('entry ', CAST(c_custkey % 100 + 1990 AS STRING)) FROM customer
UNION ALL SELECT * FROM (VALUES ('condition', 'college', 'law', 'school of law'), ('condition', 'level', 'undergraduate', 'undergraduates'), ('condition', 'level', 'undergraduate', 'undergraduate'), ('condition', 'level', 'graduate', 'graduates'), ('condition', 'level', 'graduate', 'graduate students'),
  ('condition', 'role', 'teacher', 'teachers'), ('condition', 'institution', 'own', 'this university'), ('and', '', '', 'and'), ('or', '', '', 'or'), ('not', '', '', 'not'), ('not', '', '', 'except'), ('open', '', '', '('), ('close', '', '', ')'), ('soft', '', '', 'in principle'), ('soft', '', '', 'preferably'),
  ('status', 'student_status', 'full-time', 'full-time'), ('filler', '', '', 'students'), ('filler', '', '', 'of'), ('filler', '', '', 'of the'), ('filler', '', '', 'at'), ('filler', '', '', 'all'), ('filler', '', '', 'the')) AS t(role, field, value, phrase)""",
    "audience": """
SELECT id, k, a, y, CASE k WHEN 0 THEN concat('students of the ', sa) WHEN 1 THEN concat('Graduates of ', sa, ', school of law and entry ', y) WHEN 2 THEN concat(sa, ' or school of law') WHEN 3 THEN concat('graduates of the (', sa, ' or school of law) and entry ', y) WHEN 4 THEN concat('not ', sa)
  WHEN 5 THEN concat('graduates, not (', sa, ' and entry ', y, ')') WHEN 6 THEN concat('graduates of ', sa, ' (entry ', y) WHEN 7 THEN concat('graduate students of ', sa, ' with honours') WHEN 8 THEN 'friends of the house' WHEN 9 THEN 'all undergraduates and graduates' WHEN 10 THEN concat('except (', sa, ' or (graduates and school of law))')
  WHEN 11 THEN concat('full-time graduates of ', sa) ELSE concat('preferably graduates of ', sa) END AS said
FROM (SELECT c_custkey AS id, c_custkey % 13 AS k, lower(c_mktsegment) AS a, concat('school of ', lower(c_mktsegment)) AS sa, CAST(c_custkey % 100 + 1990 AS STRING) AS y FROM customer) AS c""",
    "dated": """
SELECT id AS document_id, published_date, k, a, b, minute, concat(CASE k WHEN 0 THEN concat('deadline ', da, ' (Beijing time)') WHEN 1 THEN concat('open from ', da, ' until ', db) WHEN 2 THEN concat('registration period ', da, ' to ', mb) WHEN 3 THEN concat('registration period ', ma, ' to ', db)
    WHEN 4 THEN concat('applications from ', da, ' ', clock, ' - ', mb, ' 24:00') WHEN 5 THEN concat('apply by ', da, ' ', clock, ':30') WHEN 6 THEN concat('apply by ', da, ' (Paris time)') WHEN 7 THEN concat('apply by ', da, ' ', clock, ' to 18:00')
    WHEN 8 THEN concat('deadline ', da, ', or ', db) WHEN 9 THEN concat('opens on ', da, ' ', clock) WHEN 10 THEN concat('registration period ', da) WHEN 11 THEN concat('deadline ', da, ', then ', mb) WHEN 12 THEN concat('apply by before ', da) WHEN 13 THEN concat('registration period ', da, ' to ', mb, ' to ', mb) ELSE concat('no such thing on ', da) END, '; ') AS body_text
FROM (SELECT *, CAST(a AS STRING) AS da, CAST(b AS STRING) AS db, concat(CAST(month(a) AS STRING), '-', CAST(day(a) AS STRING)) AS ma, concat(CAST(month(b) AS STRING), '-', CAST(day(b) AS STRING)) AS mb, concat(lpad(CAST(CAST(floor(minute / 60) AS INT) AS STRING), 2, '0'), ':', lpad(CAST(minute % 60 AS STRING), 2, '0')) AS clock
  FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + CAST(10950 AS INT) AS a, CAST(o_orderdate AS DATE) + CAST(10950 + o_custkey % 300 - 40 AS INT) AS b, CAST(o_orderdate AS DATE) + CAST(10900 AS INT) AS published_date, o_custkey * 7 % 1440 AS minute, o_orderkey % 15 AS k FROM orders) AS x) AS y""",
    "fact": f"""
SELECT doc_id AS document_id, CASE n_chars % 5 WHEN 0 THEN 'reference' WHEN 1 THEN 'information' ELSE 'opportunity' END AS category,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {AT} + (doc_id % 13 - 6) * 21600 END AS opens_at, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE {AT} + (doc_id % 29 - 8) * 43200 END AS deadline_at,
  CASE WHEN doc_id % 5 <> 4 AND doc_id % 11 = 2 THEN {AT} + (doc_id % 29 - 8) * 43200 - 86400 END AS deadline_lower_at,
  n_chars % 2 = 0 AS opening_confirmed, doc_id % 37 = 5 AS cancelled, n_chars % 11 <> 0 AS audience_declared, n_chars % 13 <> 0 AS eligibility_complete, n_chars % 17 = 0 AS information_incomplete,
  date '2024-01-01' + CAST((doc_id * 7) % 20 AS INT) AS published_date, CASE doc_id % 5 WHEN 1 THEN 'update' WHEN 2 THEN 'activation_recent' WHEN 3 THEN 'historical' ELSE 'new' END AS kind,
  CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE 'digest' END AS previous_route, doc_id % 9 <> 1 AS comparison_known, n_chars % 4 = 1 AS conditions_changed
FROM documents""",
    "asked": """
SELECT doc_id AS document_id, 'lang' AS field, CASE WHEN n_chars % 19 = 0 THEN 'unsupported' ELSE 'in' END AS operator, lang AS v1, CASE WHEN n_chars % 2 = 0 THEN 'en' END AS v2 FROM documents
UNION ALL SELECT doc_id, 'source', 'in', source, 'src8' FROM documents
UNION ALL SELECT doc_id, 'gpa', 'unsupported', '3.0', NULL FROM documents WHERE n_chars % 23 < 3
UNION ALL SELECT doc_id, 'lang', 'in', 'fr', NULL FROM documents WHERE n_chars % 29 = 4""",
    "requirement": """
SELECT doc_id AS document_id, 'lang' AS field, CASE WHEN n_chars % 19 = 0 THEN 'unsupported' ELSE 'in' END AS operator, lang AS v1, CASE WHEN n_chars % 2 = 0 THEN 'en' END AS v2 FROM documents WHERE n_chars % 3 > 0
UNION ALL SELECT doc_id, 'source', 'in', source, 'src8' FROM documents WHERE n_chars % 3 > 0
UNION ALL SELECT doc_id, 'gpa', 'unsupported', '3.0', NULL FROM documents WHERE n_chars % 23 < 3
UNION ALL SELECT doc_id, 'lang', 'in', 'fr', NULL FROM documents WHERE n_chars % 29 = 4""",
    "activation": f"""
SELECT doc_id AS document_id, source AS source_id, CASE WHEN doc_id % 5 > 0 THEN date '2024-01-01' + CAST((doc_id * 5) % 20 AS INT) END AS list_date, CASE WHEN doc_id % 10 > 1 THEN date '2024-01-01' + CAST((doc_id * 7) % 20 AS INT) END AS notice_date,
  CASE doc_id % 13 WHEN 1 THEN 'generated' WHEN 2 THEN 'selected' WHEN 3 THEN 'unknown' END AS old_state, CASE WHEN doc_id % 13 = 2 THEN date '2024-01-10' END AS old_selection, doc_id % 17 <> 4 AS initial_recent_review, doc_id % 19 = 5 AS old_conflict,
  {T0} + doc_id * 613 + 60 AS registered_at, CASE WHEN doc_id % 6 = 1 THEN 'historical' ELSE 'regular' END AS origin, {T0} + doc_id * 613 AS live_at
FROM documents""",
    "doc_attempt": f"""
SELECT page_id % 60 AS document_id, page_id AS attempt_no, {T0} + page_id * 600 AS at, CASE WHEN page_id % 3 = 1 THEN 'parse_failed' WHEN page_id % 7 = 2 THEN 'timeout' END AS error_code, CASE WHEN page_id % 5 > 0 THEN {T0} + page_id * 600 + 86400 END AS next_due_at, page_id + 1000 AS version_id, page_id
FROM pages""",
    "topic_match": """
SELECT doc_id AS document_id, source AS topic, 'opportunity' AS context, true AS is_primary FROM documents
UNION ALL SELECT doc_id, lang, CASE n_chars % 4 WHEN 0 THEN 'opportunity' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'subject' END, false FROM documents""",
    "profile": """
SELECT * FROM (VALUES ('p1', 'lang', 'en'), ('p1', 'source', NULL), ('p2', 'lang', 'fr'), ('p2', 'source', 'src8'), ('p3', 'lang', NULL), ('p3', 'source', 'src12'), ('p4', 'college', 'arts')) AS t(profile_id, field, actual)
UNION ALL SELECT concat('q', CAST(item_id AS STRING)), NULL, NULL FROM benchmark""",
    "profile_phrase": """
SELECT concat('p', CAST(item_id % 4 + 1 AS STRING)) AS profile_id, substr(text, 1, CAST(item_id % 11 + 1 AS INT)) AS phrase FROM benchmark WHERE length(text) > 11
UNION SELECT concat('q', CAST(item_id AS STRING)), substr(text, 20, 40) FROM benchmark WHERE length(text) > 60""",
    "pack": """
SELECT concat('r', CAST(item_id AS STRING), '-', CAST(n AS STRING)) AS rule_id, concat('t', CAST(item_id % 8 AS STRING)) AS topic, split_part(replace(text, chr(10), ' '), ' ', n) AS phrase
FROM benchmark CROSS JOIN (SELECT CAST(doc_id AS INT) + 1 AS n FROM documents WHERE doc_id < 60) AS places WHERE length(split_part(replace(text, chr(10), ' '), ' ', n)) > 7""",
    "profile_topic": """SELECT * FROM (VALUES ('p1', 'en', true, false, false, false), ('p1', 'src8', true, false, true, false), ('p1', 'src9', true, false, false, true), ('p1', 'src10', false, true, false, false),
  ('p2', 'fr', true, false, true, false), ('p2', 'src12', true, false, true, false), ('p2', 'de', false, false, false, true), ('p3', 'es', true, false, false, false), ('p3', 'src8', true, true, false, false)) AS t(profile_id, topic, interest, excluded, high_value, store_only)""",
    "term": """
SELECT item_id AS query_id, lower(substr(text, 1, 40)) AS term FROM benchmark
UNION ALL SELECT 1000000 + i AS query_id, w AS term FROM (SELECT 0 AS i, 'the of' AS w UNION ALL SELECT 1, 'die' UNION ALL SELECT 2, 'und der' UNION ALL SELECT 3, 'la') AS fixed""",
}

_SPARK = {"SHA": "sha2({}, 256)", "EPOCH": "unix_seconds(CAST({} AS TIMESTAMP))", "LOCALDATE": "to_date(from_utc_timestamp(timestamp_seconds({}), 'Asia/Shanghai'))"}
_DUCK = {"SHA": "sha256({})", "EPOCH": "CAST(floor(epoch({})) AS BIGINT)", "LOCALDATE": "CAST(timezone('Asia/Shanghai', to_timestamp({})) AS DATE)"}


def _spelled(sql: str, words: dict[str, str]) -> str:
    while found := re.search(r"\b(SHA|EPOCH|LOCALDATE)\[([^\[\]]*)\]", sql):
        sql = sql[: found.start()] + words[found[1]].format(found[2]) + sql[found.end() :]
    return sql


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view ``sample``: counts so far of each source, which one window a source would give in five tasks."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("seen_at"), "event_type", "ts")
    bought, kind = F.when(F.col("event_type") == "purchase", 1), F.col("event_type")
    rows = running_sums(rows, "source_id", "seen_at", ["ts", "event_id"], {"processed": bought, "documents": F.when(kind.isin("purchase", "signup"), 1)})
    return rows.select("event_id", "source_id", "seen_at", "event_type", (kind == "error").alias("unavailable"), "processed", "documents")


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view ``run``: sessions of each source's events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("seen_at"), "event_type")
    numbered = sessions(rows, "source_id", "seen_at", ["seen_at", "event_id"], 3600, "run_no")
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return numbered.groupBy("source_id", "run_no").agg(
        F.min("seen_at").alias("started_at"), F.max("seen_at").alias("last_at"), F.count("*").alias("requests"), kind("error").alias("failed"), kind("purchase").alias("succeeded"),
        F.when(F.min("event_id") % 9 == 0, F.lit(None).cast("long")).otherwise(F.max("seen_at")).alias("finished_at"),
    )


#: Views that Spark builds by operators; their SQL is what DuckDB runs.
_BUILT = {"sample": _sample, "run": _run}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a view, read from the Parquet tables below ``sf_dir``."""
    if name in _BUILT:
        return _BUILT[name](spark, sf_dir)
    sql = _spelled(VIEWS[name], _SPARK)
    used = sorted(t for t in _TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql))
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(sql: str, *views: str) -> str:
    """DuckDB SQL of ``sql`` over the named views."""
    head = ", ".join(f"{v} AS ({_spelled(VIEWS[v], _DUCK)})" for v in views)
    body = _spelled(sql, _DUCK).strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
