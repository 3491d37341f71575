"""Queries on raw pages: text, fields, links, lists, identities. All of it built-in expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import page_stream as ps
from ..operators import pages as ops
from ..registry import query
from ..sources.bindings import oracle, view


def _pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


_BLOCKS, _VOID = list(ps.BLOCKS), list(ps.VOID)
_ATTRIBUTE = r"""([^\s=/>"''][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>]*)))?"""
_TOKEN = (
    r"<!--.*?-->|<!--.*$|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<(?:script|style)\b.*$|<[!?][^>]*>"
    r"""|</?[a-z][^\s/>]*(?:[^>=]|=\s*(?:"[^"]*"|''[^'']*''|[^\s>"''][^\s>]*|))*>|[^<]+|<.*$"""
)
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": " ", "&copy;": "©", "&middot;": "·"}


def _decoded(text: str) -> str:
    for name, char in _NAMED.items():
        text = f"replace({text}, '{name}', '{char}')"
    number = "list_reduce(regexp_extract_all({0}, '&#x?[0-9A-Fa-f]+;'), lambda t, e: replace(t, e, chr(CASE WHEN e[3] = 'x' THEN ('0' || e[3:-2])::INT ELSE e[3:-2]::INT END)), {0})"
    return f"replace({number.format(text)}, '&amp;', '&')"


def _attribute(of: str, name: str) -> str:
    said = f"""regexp_extract({of}, '\\s{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>"'']+)', 1, 'i')"""
    return _decoded(f"trim({said}, chr(34) || chr(39))")


def _stream(source: str) -> str:
    """The same streams by recursion over rows: a step pops one open element, or takes the next token. ``e`` has a row a
    step, in order of ``step``, with what was emitted."""
    innermost = "len(s) - coalesce(list_position(list_reverse(list_transform(s, lambda x: {})), true), len(s) + 1) + 1"
    return f"""tokens AS MATERIALIZED (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), '{_TOKEN}', 0, 'is') AS ts FROM {source}),
token AS MATERIALIZED (
  SELECT page_id, i, t, n, CASE WHEN regexp_matches(t, '^</[a-z].*>$', 'is') THEN 'close' WHEN t[1] <> '<' THEN 'text' WHEN regexp_matches(t, '^<(?:script|style)\\b', 'i') THEN 'skip'
      WHEN regexp_matches(t, '^<[a-z].*>$', 'is') THEN CASE WHEN n IN {tuple(ps.VOID)} THEN 'void' ELSE 'open' END ELSE 'skip' END AS kind,
    n IN {tuple(ps.DROPPED)} OR regexp_matches(t, '\\shidden(?:[\\s=/>]|$)', 'i') OR {_attribute('t', 'aria-hidden')} = 'true'
      OR len(list_intersect(list_transform(string_split(lower(regexp_replace({_attribute('t', 'style')}, '\\s', '', 'g')), ';'), lambda x: replace(x, '!important', '')), ['display:none', 'visibility:hidden'])) > 0
      OR len(list_intersect(string_split_regex({_attribute('t', 'class')}, '\\s+'), {list(ps.DROPPED_CLASSES)})) > 0 AS marked
  FROM (SELECT *, lower(regexp_extract(t, '^</?([A-Za-z][^\\s/>]*)', 1)) AS n FROM (SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM tokens))),
walk AS (
  SELECT page_id, 0 AS step, 1 AS i, []::VARCHAR[] AS s, 0 AS lost, '' AS kind, '' AS n, '' AS t, true AS dropped, 0 AS depth FROM tokens
  UNION ALL
  SELECT page_id, step + 1, CASE WHEN act IN ('pop', 'end') THEN i ELSE i + 1 END,
    CASE WHEN act IN ('pop', 'end', 'last') THEN s[:-2] WHEN act = 'open' THEN list_append(s, own) ELSE s END,
    CASE WHEN act IN ('pop', 'end', 'last') AND lost >= len(s) THEN 0 WHEN act = 'open' AND lost = 0 AND marked THEN len(s) + 1 ELSE lost END,
    CASE WHEN act IN ('pop', 'end', 'last') THEN 'close' WHEN act = 'none' THEN 'skip' ELSE act END,
    CASE WHEN act IN ('pop', 'end', 'last') THEN s[-1] ELSE own END, said,
    lost > 0 OR (act IN ('open', 'void') AND marked), CASE WHEN act IN ('pop', 'end', 'last') THEN len(s) - 1 ELSE len(s) END
  FROM (
    SELECT *, CASE WHEN k IS NULL THEN 'end' WHEN k = 'open' AND own IN {tuple(ps.BLOCKS)} AND block > 0
        AND (s[block] = 'p' OR {" OR ".join(f"(own = '{k}' AND s[block] IN ({', '.join(map(repr, v))}))" for k, v in ps.ENDS.items())}) THEN 'pop'
      WHEN k = 'close' THEN CASE WHEN same = 0 OR NOT (own IN {tuple(ps.BLOCKS)} OR same > block) THEN 'none' WHEN same < len(s) THEN 'pop' ELSE 'last' END ELSE k END AS act
    FROM (SELECT w.*, x.kind AS k, x.n AS own, x.t AS said, x.marked, {innermost.format(f"list_contains({_BLOCKS}, x)")} AS block, {innermost.format("x = x_n")} AS same
      FROM (SELECT w.*, coalesce(x.n, '') AS x_n FROM walk w LEFT JOIN token x ON x.page_id = w.page_id AND x.i = w.i) w LEFT JOIN token x ON x.page_id = w.page_id AND x.i = w.i)
    WHERE k IS NOT NULL OR len(s) > 0)),
e AS MATERIALIZED (
  SELECT *, CASE kind WHEN 'text' THEN t WHEN 'close' THEN '</' || n || '>' ELSE '<' || n || array_to_string(list_transform(
      list_filter(regexp_extract_all(regexp_replace(t, '^<[a-z][^\\s/>]*|>$', '', 'gi'), '{_ATTRIBUTE}'), lambda a: NOT regexp_matches(a, '^{ps.LOST}(?:\\s*=|$)', 'i')),
      lambda a: ' ' || lower(regexp_extract(a, '^[^\\s=]+')) || '="' || replace(trim(regexp_replace(a, '^[^\\s=]+\\s*=?\\s*', ''), CASE WHEN contains(a, '="') THEN chr(34) ELSE chr(39) END), '"', '&quot;') || '"'), '') || '>' END AS html,
    CASE WHEN kind = 'text' THEN CASE WHEN list_contains(s, 'pre') OR list_contains(s, 'code') THEN {_decoded('t')} ELSE regexp_replace({_decoded('t')}, '[\\s\\p{{Z}}]+', ' ', 'g') END END AS said
  FROM walk WHERE kind NOT IN ('', 'skip'))"""


_LINES = """array_to_string(list_filter(list_transform(string_split_regex(coalesce(string_agg(CASE WHEN kind = 'text' THEN said WHEN n IN ('td', 'th') THEN CASE WHEN kind = 'close' THEN chr(9) ELSE '' END
  WHEN n IN {} THEN chr(10) ELSE '' END, '' ORDER BY step) FILTER (NOT dropped), ''), '\\r\\n|[\\n\\x0b\\x0c\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
  lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x <> ''), chr(10))""".format((*ps.BLOCKS, "br"))


def _streamed(sql: str, source: str = "page", *views: str) -> str:
    """An oracle on the streams of a source."""
    found = oracle(f"WITH {_stream(source)} {sql}", *views)
    return found.replace("WITH ", "WITH RECURSIVE ", 1)


@query("page_gate", "SELECT page_id, CASE WHEN html IS NULL OR trim(html) = '' THEN 'empty_page' ELSE 'ok' END AS code FROM pages")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", F.when(F.col("html").isNull() | (F.trim("html") == ""), "empty_page").when(~F.is_valid_utf8("html"), "invalid_utf8").otherwise("ok").alias("code"))


@query("page_clean", _streamed("""SELECT page_id, CASE WHEN trim(coalesce(html, '')) = '' THEN 'empty_page' WHEN regexp_matches(ts[-1], '^<(?:!--.*[^-][^-]|(?:script|style)\\b(?:[^<]|<[^/])*|[^>]*)$', 'is') AND ts[-1][-1] <> '>' THEN 'truncated' ELSE 'ok' END AS code,
  coalesce(body, '') AS body FROM page JOIN tokens USING (page_id) LEFT JOIN (SELECT page_id, string_agg(html, '' ORDER BY step) FILTER (NOT dropped) AS body FROM e GROUP BY page_id) USING (page_id)""", "page", "page"))
def _(spark, sf):
    return ops.page_clean(view(spark, sf, "page"))


@query("page_text", _streamed(f"SELECT page_id, {_LINES} AS body_text FROM tokens LEFT JOIN e USING (page_id) GROUP BY page_id", "page", "page"))
def _(spark, sf):
    return ops.page_text(view(spark, sf, "page"))


_MEANS = """SELECT page_id, url, CASE page_id % 4 WHEN 1 THEN '<p><img src="a.png"></p>' WHEN 2 THEN '<p>. <img width="1" height="1"></p>' WHEN 3 THEN '<div hidden><div></div>x</div> &nbsp;' ELSE html END AS html FROM pages"""
_DOT = f"({_attribute('t', 'width')} = '1' AND {_attribute('t', 'height')} = '1')"


@query("page_meaningful", _streamed(f"""SELECT page_id, regexp_matches(body_text, '[\\p{{L}}\\p{{N}}]') OR images > 0 AS meaningful FROM (
SELECT page_id, {_LINES} AS body_text, count(*) FILTER (n = 'img' AND NOT dropped AND NOT {_DOT}) AS images FROM tokens LEFT JOIN e USING (page_id) GROUP BY page_id)""", f"({_MEANS})"))
def _(spark, sf):
    return ops.page_meaningful(spark.sql(_MEANS.replace("FROM pages", "FROM {pages}"), pages=_pages(spark, sf)))


_SAID = '^Date: (.*)$'


@query("page_fields", oracle(f"""SELECT page_id, title, CASE WHEN title = '' THEN 'title_missing' ELSE 'ok' END AS title_code, d AS published_date, CASE WHEN said = '' THEN 'date_missing' WHEN d IS NULL THEN 'date_invalid' ELSE 'ok' END AS date_code FROM (
SELECT *, CAST(try_strptime(CASE WHEN length(said) = 10 THEN said END, '%Y-%m-%d') AS DATE) AS d FROM (
SELECT page_id, {_decoded("trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)(?:</h1>|<[^>]*$|$)', 1), '\\s+', ' ', 'g'))")} AS title, regexp_extract(html, '<i class="date">Date: ([^<]*)(?:<|$)', 1) AS said FROM page))""", "page"))
def _(spark, sf):
    return ops.page_fields(view(spark, sf, "page"), _SAID)


def _full(h: str) -> str:
    full = f"""CASE WHEN regexp_matches({h}, '^https?://', 'i') THEN {h} WHEN starts_with({h}, '//') THEN regexp_extract(url, '^(https?:)', 1) || {h} WHEN starts_with({h}, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || {h}
WHEN starts_with({h}, '?') THEN regexp_replace(url, '[?#].*$', '') || {h} ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^:/])/[^/]*$', '\\1') || '/' || {h} END"""
    path = f"regexp_extract({full}, '^https?://[^/?#]*([^?#]*)', 1)"
    step = "lambda a, x: CASE x[1] WHEN '.' THEN a WHEN '..' THEN a[:greatest(len(a) - 1, 1)] ELSE a || x END"
    folded = f"list_reduce(list_transform(string_split({path}, '/')[2:], lambda x: [x]), {step}, [''])"
    end = f"CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN [''] ELSE [] END"
    return f"""CASE WHEN regexp_matches({path}, '/\\.\\.?(?:/|$)') THEN regexp_extract({full}, '^(https?://[^/?#]*)', 1) || array_to_string({folded} || {end}, '/') || regexp_extract({full}, '([?#].*)$', 1) ELSE {full} END"""


_WITHIN = "SELECT a.page_id, a.step, b.step AS inner_step, b.kind, b.n, b.t, b.said, b.dropped FROM {} a JOIN e b ON b.page_id = a.page_id AND b.step > a.step AND b.step < a.close"


def _closing(name: str, where: str) -> str:
    """Openings of a kind with the steps of their closings: the next row of that name at their depth."""
    return f"{name} AS (SELECT a.*, (SELECT min(b.step) FROM e b WHERE b.page_id = a.page_id AND b.step > a.step AND b.kind = 'close' AND b.n = a.n AND b.depth = a.depth) AS close FROM e a WHERE a.kind IN ('open', 'void') AND {where})"


_TEXT = "trim(regexp_replace(coalesce(string_agg(said, '' ORDER BY {0}) FILTER (kind = 'text'{1}), ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query("page_links", _streamed(f""", {_closing('anchor', "n = 'a' AND NOT dropped AND regexp_matches(t, '\\shref(?:[\\s=/>]|$)', 'i')")},
worded AS (SELECT page_id, step, {_TEXT.format('inner_step', ' AND NOT dropped')} AS text FROM ({_WITHIN.format('anchor')}) GROUP BY page_id, step),
linked AS (SELECT page_id, url, trim({_attribute('t', 'href')}) AS h, row_number() OVER (PARTITION BY page_id ORDER BY step) - 1 AS pos, coalesce(text, '') AS text FROM anchor JOIN tokens USING (page_id) LEFT JOIN worded USING (page_id, step)),
coded AS (SELECT *, CASE WHEN regexp_matches(h, '[\\x00-\\x1f\\\\ ]') OR (regexp_matches(h, '^https?:', 'i') AND NOT regexp_matches(h, '^https?://[^/?#]', 'i')) OR starts_with(h, '///') THEN 'invalid_link' ELSE 'ok' END AS code FROM linked
  WHERE h <> '' AND NOT starts_with(h, '#') AND NOT (regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(h, '^https?:', 'i')))
SELECT page_id, pos, code, CASE WHEN code = 'ok' THEN {_full('h')} END AS link, text FROM coded""", "page", "page"))
def _(spark, sf):
    return ops.page_links(view(spark, sf, "page"))


@query("page_images", _streamed(f"""SELECT page_id, pos, CASE WHEN src = '' THEN 'image_url_invalid' ELSE 'ok' END AS code, CASE WHEN src <> '' THEN {_full('src')} END AS src, alt FROM (
SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY step) - 1 AS pos, {_attribute('t', 'src')} AS src, {_attribute('t', 'alt')} AS alt FROM e JOIN tokens USING (page_id) WHERE n = 'img' AND NOT dropped AND NOT {_DOT})""", "page", "page"))
def _(spark, sf):
    return ops.page_images(view(spark, sf, "page"))


@query("page_attachments", _streamed(f""", {_closing('panel', f"n = 'div' AND list_contains(string_split_regex({_attribute('t', 'class')}, '\\s+'), 'fj')")},
lone AS (SELECT * FROM panel QUALIFY count(*) OVER (PARTITION BY page_id) = 1),
anchor AS (SELECT a.* FROM lone p JOIN (SELECT * FROM e WHERE n = 'a' AND kind = 'open') a ON a.page_id = p.page_id AND a.step > p.step AND a.step < p.close),
ended AS (SELECT a.*, (SELECT min(b.step) FROM e b WHERE b.page_id = a.page_id AND b.step > a.step AND b.kind = 'close' AND b.n = 'a' AND b.depth = a.depth) AS close FROM anchor a),
named AS (SELECT page_id, step, {_TEXT.format('inner_step', '')} AS name FROM ({_WITHIN.format('ended')}) GROUP BY page_id, step),
item AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY step) - 1 AS pos, {_attribute('t', 'href')} AS h, coalesce(name, '') AS name FROM anchor JOIN tokens USING (page_id) LEFT JOIN named USING (page_id, step)),
coded AS (SELECT *, CASE WHEN name = '' THEN 'attachment_name_missing' WHEN h = '' THEN 'attachment_url_invalid' WHEN contains(h, '/download?') AND len(regexp_extract_all(h, '[?&]file=')) > 1 THEN 'ambiguous_identity'
  WHEN contains(h, '/download?') AND NOT regexp_full_match(regexp_extract(h, '[?&]file=([^&]*)', 1), '[A-Za-z0-9]+') THEN 'identity_invalid' ELSE 'ok' END AS code FROM item)
SELECT page_id, pos, name, code, CASE WHEN code = 'ok' THEN {_full('h')} END AS url, CASE WHEN code = 'ok' AND contains(h, '/download?') THEN regexp_extract(h, '[?&]owner=([^&]*)', 1) || ':' || regexp_extract(h, '[?&]file=([^&]*)', 1) END AS attachment_id FROM coded
UNION ALL SELECT page_id, 0, '', 'panel_ambiguous', NULL, NULL FROM panel GROUP BY page_id HAVING count(*) > 1""", "page", "page"))
def _(spark, sf):
    return ops.page_attachments(view(spark, sf, "page"))


_TARGET = "SELECT page_id AS key, concat(CASE WHEN page_id % 7 = 1 THEN 'http://else.example' ELSE 'https://site.example' END, CASE page_id % 6 WHEN 0 THEN concat('/show?column=12&article=', CAST(page_id AS STRING)) WHEN 1 THEN concat('/info/12/', CAST(page_id AS STRING), '.htm') WHEN 2 THEN concat('/info/13/', CAST(page_id AS STRING), '.htm?column=13') WHEN 3 THEN concat('/info/12/0', CAST(page_id AS STRING), '.htm') WHEN 4 THEN '/else/12' ELSE concat('/info/12/', CAST(page_id AS STRING), '.htm?article=', CAST(page_id + page_id % 2 AS STRING), CASE WHEN page_id % 5 = 0 THEN '&article=1' ELSE '' END) END, CASE WHEN page_id % 11 = 3 THEN '#top' ELSE '' END) AS link FROM pages"


@query("url_class", f"""WITH t AS ({_TARGET.replace('AS STRING', 'AS VARCHAR')}), c AS (SELECT key, CASE WHEN key % 7 = 1 THEN 'external' WHEN key % 6 = 4 THEN 'unsupported_route' WHEN key % 6 = 5 AND (key % 2 = 1 OR key % 5 = 0) THEN 'ambiguous' WHEN key % 6 = 3 THEN 'invalid' WHEN key % 6 IN (0, 1) AND key = 0 THEN 'invalid' WHEN key % 6 = 2 THEN 'unsupported_column'
WHEN contains(link, '#') THEN 'unsupported_route' ELSE 'supported' END AS class FROM t) SELECT key, class, CASE WHEN class = 'supported' THEN '12:' || CAST(key AS VARCHAR) END AS identity FROM c""")
def _(spark, sf):
    return ops.url_class(spark.sql(_TARGET.replace("FROM pages", "FROM {p}"), p=_pages(spark, sf)), "site.example", "12")


#: Route, host, path, and the names of its ids in the query.
_ROUTES = [
    ("a", "site.example", r"^/info/([1-9][0-9]*)/([0-9]+)\.htm$", "column", "article"),
    ("b", "site.example", r"^/show$", "column", "article"),
    ("c", "else.example", r"^/n/([0-9]+)-([0-9]+)$", "col", "id"),
]
_ROUTED = """SELECT page_id AS key, CASE page_id % 9 WHEN 0 THEN concat('https://site.example/show?column=12&article=', CAST(page_id AS STRING)) WHEN 1 THEN concat('https://site.example/info/12/', CAST(page_id AS STRING), '.htm') WHEN 2 THEN concat('https://site.example/info/13/', CAST(page_id AS STRING), '.htm?column=13&x=1&article=', CAST(page_id + page_id % 2 AS STRING))
  WHEN 3 THEN concat('http://else.example/n/7-', CAST(page_id AS STRING), '?id=', CAST(page_id AS STRING), '#top') WHEN 4 THEN concat('http://else.example/n/7-0', CAST(page_id AS STRING)) WHEN 5 THEN concat('https://site.example/show?column=1&column=1&article=', CAST(page_id AS STRING)) WHEN 6 THEN 'https://site.example/other'
  WHEN 7 THEN concat('https://third.example/info/12/', CAST(page_id AS STRING), '.htm') ELSE 'https://site.example/show?article=5' END AS link FROM pages"""


@query("url_routes", """SELECT page_id AS key, CASE WHEN m IN (1, 2) THEN 'a' WHEN m IN (0, 5, 8) THEN 'b' WHEN m IN (3, 4) THEN 'c' END AS route,
  CASE WHEN m = 7 THEN 'external' WHEN m = 6 THEN 'unsupported_route' WHEN m = 5 OR (m = 2 AND page_id % 2 = 1) THEN 'ambiguous' WHEN m IN (4, 8) OR page_id = 0 THEN 'invalid' ELSE 'supported' END AS class,
  CASE WHEN page_id > 0 THEN CASE WHEN m IN (0, 1) THEN '12:' || page_id WHEN m = 2 AND page_id % 2 = 0 THEN '13:' || page_id WHEN m = 3 THEN '7:' || page_id END END AS identity FROM (SELECT page_id, page_id % 9 AS m FROM pages)""")
def _(spark, sf):
    routes = spark.createDataFrame(_ROUTES, "route string, host string, path string, column_key string, article_key string")
    return ops.url_identity(spark.sql(_ROUTED.replace("FROM pages", "FROM {p}"), p=_pages(spark, sf)), routes)


@query("list_rows", oracle(f"""WITH r AS (SELECT page_id, url, i AS row_index, CASE i WHEN 0 THEN '/info/12/' || page_id || '.htm' WHEN 1 THEN CASE page_id % 4 WHEN 1 THEN 'a b' WHEN 2 THEN '' ELSE 'x%41.htm' END ELSE CASE WHEN page_id % 3 = 2 THEN '' ELSE '/z' END END AS h,
CASE i WHEN 0 THEN 'One ' || page_id WHEN 1 THEN 'Two' ELSE '' END AS title, CASE i WHEN 0 THEN '2024-01-0' || (page_id % 9 + 1) WHEN 1 THEN CASE WHEN page_id % 5 <> 3 THEN '2023-12-31' END ELSE CASE WHEN page_id % 3 <> 2 THEN '2024-01-01' END END AS d FROM pages CROSS JOIN (SELECT unnest([0, 1, 2]) AS i))
SELECT page_id, row_index, CASE WHEN row_index = 2 AND page_id % 3 = 2 THEN 'entry_missing' WHEN h = '' OR h = 'a b' THEN 'detail_url_invalid' WHEN title = '' THEN 'title_missing' WHEN d IS NULL THEN 'published_date_invalid' ELSE 'ok' END AS code, {_full('h')} AS detail_url, title, CAST(d AS DATE) AS published_date FROM r"""))
def _(spark, sf):
    return ops.list_rows(view(spark, sf, "list_html"))


@query("pagination_check", """WITH p AS (SELECT page_id, page_id % 13 = 12 AS none, CASE WHEN page_id % 11 = 10 THEN NULL WHEN page_id % 7 = 6 THEN 2 ELSE 1 END AS cur, page_id % 17 = 5 AS nodot, page_id % 19 = 4 AS same, page_id % 23 = 7 AS nonext, CASE WHEN page_id % 5 = 2 THEN '/l/3.htm' ELSE '/l/2.htm' END AS nx FROM pages)
SELECT page_id, CASE WHEN none THEN 'pagination_missing' WHEN cur IS NULL THEN 'current_page_invalid' WHEN cur = 2 THEN 'first_label_not_one' WHEN nodot THEN 'gap_without_ellipsis' WHEN same THEN 'repeated_target' WHEN nonext THEN 'next_page_missing' WHEN nx <> '/l/2.htm' THEN 'next_page_mismatch' ELSE 'ok' END AS code,
CASE WHEN NOT none THEN cur END AS current_page, CASE WHEN NOT none THEN 9 END AS total_pages, CASE WHEN NOT none AND NOT nonext THEN nx END AS next_url FROM p""")
def _(spark, sf):
    return ops.pagination_check(view(spark, sf, "list_html"))


@query("url_identity", r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '/([0-9]+)(\?|$)', 1) AS article, len(regexp_extract_all(url, '[?&]page=')) AS pages,
CASE WHEN len(regexp_extract_all(url, '[?&]page=')) > 1 THEN 'ambiguous' WHEN regexp_extract(url, '/([0-9]+)(\?|$)', 1) = '' THEN 'unsupported_route' ELSE 'supported' END AS class FROM pages""")
def _(spark, sf):
    article, n = F.regexp_extract("url", r"/([0-9]+)(\?|$)", 1), F.size(F.regexp_extract_all("url", F.lit("[?&]page="), F.lit(0)))
    kind = F.when(n > 1, "ambiguous").when(article == "", "unsupported_route").otherwise("supported")
    return _pages(spark, sf).select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), article.alias("article"), n.alias("pages"), kind.alias("class"))


@query("url_candidate", r"""SELECT page_id, CASE WHEN regexp_matches(url, '[\x00-\x20\\]') THEN 'bad_character' WHEN regexp_matches(url, '^https?://[^/]*@') THEN 'credentials' WHEN regexp_matches(regexp_replace(url, '%[0-9A-Fa-f]{2}', '', 'g'), '%') THEN 'bad_escape' ELSE 'ok' END AS code,
'link:v1:' || sha256(url) AS candidate_key FROM pages""")
def _(spark, sf):
    u = F.col("url")
    code = F.when(u.rlike(r"[\x00-\x20\\]"), "bad_character").when(u.rlike("^https?://[^/]*@"), "credentials").when(F.regexp_replace(u, "%[0-9A-Fa-f]{2}", "").contains("%"), "bad_escape").otherwise("ok")
    return _pages(spark, sf).select("page_id", code.alias("code"), F.concat(F.lit("link:v1:"), F.sha2("url", 256)).alias("candidate_key"))


@query("parse_outcomes", oracle("""SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN starts_with(url, 'https:') THEN 'secure' WHEN contains(url, '/en/') THEN 'plain' ELSE 'none' END AS parser,
CASE WHEN starts_with(url, 'https:') THEN CASE WHEN NOT regexp_matches(html, '</html>', 'i') THEN 'truncated' WHEN NOT regexp_matches(html, '<h1', 'i') THEN 'title_missing' ELSE 'ok' END WHEN contains(url, '/en/') THEN CASE WHEN NOT regexp_matches(html, 'Date: ') THEN 'date_missing' ELSE 'ok' END ELSE 'parser_missing' END AS code, count(*) AS pages FROM page GROUP BY ALL""", "page"))
def _(spark, sf):
    has = lambda p: F.col("html").rlike(p)
    secure = F.when(~has("(?i)</html>"), "truncated").when(~has("(?i)<h1"), "title_missing").otherwise("ok")
    return ops.parse_outcomes(view(spark, sf, "page"), {"secure": (F.col("url").startswith("https:"), secure), "plain": (F.col("url").contains("/en/"), F.when(~has("Date: "), "date_missing").otherwise("ok"))})
