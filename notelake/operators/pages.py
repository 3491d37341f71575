"""Raw pages as a corpus: cleaning, text, fields, links, images, attachments, lists, pagination.

What depends on how elements nest reads the token stream of ``page_stream``: one pass over each page, then arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import page_stream as ps
from .responses import first_reason


def page_clean(pages: DataFrame) -> DataFrame:
    """page_id, code (of the stream) and body: balanced HTML without dropped components, handlers and vendor attributes."""
    return ps.page_stream(pages).select("page_id", "code", ps.html(F.col("nodes")).alias("body"))


def page_text(pages: DataFrame) -> DataFrame:
    """page_id and body_text: the lines of a page without dropped components."""
    return ps.page_stream(pages).select("page_id", ps.lines(F.col("nodes")).alias("body_text"))


def page_meaningful(pages: DataFrame) -> DataFrame:
    """Whether a page says anything: a letter or digit, or an image of more than one pixel."""
    nodes = F.col("nodes")
    says = ps.lines(nodes).rlike(r"[\p{L}\p{N}]") | (F.size(_images(nodes)) > 0)
    return ps.page_stream(pages).select("page_id", says.alias("meaningful"))


def page_fields(pages: DataFrame, date: str) -> DataFrame:
    """page_id, title (of the first h1) and published_date with a code each: missing, invalid (no such day) or ok.
    ``date``: pattern of the text of the element i that says the day, with the day in its group."""
    nodes = F.col("nodes")
    of = lambda n: ps.said(ps.inside(nodes, n))
    said = F.transform(ps.opened(nodes, "i"), of)
    rows = ps.page_stream(pages).select("page_id", F.coalesce(of(F.get(ps.opened(nodes, "h1"), F.lit(0))), F.lit("")).alias("title"), F.coalesce(F.get(F.filter(said, lambda x: x.rlike(date)), F.lit(0)), F.lit("")).alias("said"))
    said = F.regexp_extract("said", date, 1)
    day = F.when(said.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(said, F.lit("yyyy-MM-dd")).cast("date"))
    date_code = F.when(said == "", "date_missing").when(day.isNull(), "date_invalid").otherwise("ok")
    return rows.select("page_id", "title", F.when(F.col("title") == "", "title_missing").otherwise("ok").alias("title_code"), day.alias("published_date"), date_code.alias("date_code"))


def resolved(href: Column, url: Column) -> Column:
    """``href`` against ``url``: with scheme, of the same scheme, of the same host, or relative; dots are taken out."""
    root, scheme = F.regexp_extract(url, "^(https?://[^/?#]+)", 1), F.regexp_extract(url, "^(https?:)", 1)
    folder = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "(?<![:/])/[^/]*$", "")
    full = F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).when(href.startswith("?"), F.concat(F.regexp_replace(url, "[?#].*$", ""), href)).otherwise(F.concat(folder, F.lit("/"), href))
    return _undotted(full)


def _undotted(url: Column) -> Column:
    """Without . and .. in the path, however many there are; above the root there is nothing."""
    path = F.regexp_extract(url, "^https?://[^/?#]*([^?#]*)", 1)
    step = lambda seen, x: F.when(x == ".", seen).when(x == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(1)))).otherwise(F.array_append(seen, x))
    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    folded = F.when(path.rlike(r"/\.\.?$"), F.array_append(folded, F.lit(""))).otherwise(folded)
    clean = F.concat(F.regexp_extract(url, "^(https?://[^/?#]*)", 1), F.array_join(folded, "/"), F.regexp_extract(url, "([?#].*)$", 1))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), clean).otherwise(url)


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, code, link and text of each link of the cleaned page: anchors and other schemes are left out,
    malformed ones have a code."""
    nodes = F.col("nodes")
    found = F.transform(ps.opened(ps.kept(nodes), "a", lambda n: F.map_contains_key(n["attributes"], F.lit("href"))), lambda n: F.struct(F.trim(ps.attribute(n, "href")).alias("href"), ps.said(ps.kept(ps.inside(nodes, n))).alias("text")))
    rows = ps.page_stream(pages).select("page_id", "url", F.posexplode(found).alias("pos", "a")).select("page_id", "url", "pos", "a.*")
    h = F.col("href")
    skip = (h == "") | h.startswith("#") | (h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~h.rlike("(?i)^https?:"))
    bad = h.rlike(r"[\x00-\x1f\\ ]") | h.rlike("(?i)^https?:(?!//[^/?#])") | h.rlike("^///")
    rows = rows.where(~skip).withColumn("code", F.when(bad, "invalid_link").otherwise("ok"))
    return rows.select("page_id", "pos", "code", F.when(F.col("code") == "ok", resolved(h, F.col("url"))).alias("link"), "text")


def _images(nodes: Column) -> Column:
    """Images of the cleaned page that are not a single pixel."""
    return ps.opened(ps.kept(nodes), "img", lambda n: ~((ps.attribute(n, "width") == "1") & (ps.attribute(n, "height") == "1")))


def page_images(pages: DataFrame) -> DataFrame:
    """page_id, pos, src and alt of each image that is not a single pixel; without a source the code says so."""
    rows = ps.page_stream(pages).select("page_id", "url", F.posexplode(_images(F.col("nodes"))).alias("pos", "n"))
    src = F.trim(ps.attribute(F.col("n"), "src"))
    return rows.select("page_id", "pos", F.when(src == "", "image_url_invalid").otherwise("ok").alias("code"), F.when(src != "", resolved(src, F.col("url"))).alias("src"), ps.attribute(F.col("n"), "alt").alias("alt"))


def page_attachments(pages: DataFrame, panel: str = "fj") -> DataFrame:
    """page_id, pos, name, url, attachment_id (owner:file of a download link) and code of the links of the attachment
    panel, the div of class ``panel``. A page with several panels has one row, which says so."""
    nodes = F.col("nodes")
    outer = ps.opened(nodes, "div", lambda n: ps.has_class(n, panel))
    item = lambda n: F.struct(ps.attribute(n, "href").alias("href"), ps.said(ps.inside(nodes, n)).alias("name"))
    found = F.transform(ps.opened(ps.inside(nodes, F.get("outer", F.lit(0))), "a"), item)
    rows = ps.page_stream(pages).withColumn("outer", outer).where(F.size("outer") > 0)
    found = F.when(F.size("outer") > 1, F.array(F.struct(F.lit("").alias("href"), F.lit("").alias("name")))).otherwise(found)
    rows = rows.select("page_id", "url", (F.size("outer") > 1).alias("several"), F.posexplode(found).alias("pos", "i")).select("page_id", "url", "several", "pos", "i.*")
    value = lambda k: F.regexp_extract("href", rf"[?&]{k}=([^&]*)", 1)
    times = lambda k: F.size(F.regexp_extract_all("href", F.lit(rf"[?&]{k}="), F.lit(0)))
    download = F.col("href").contains("/download?")
    rules = [
        ("panel_ambiguous", F.col("several")), ("attachment_name_missing", F.col("name") == ""), ("attachment_url_invalid", F.col("href") == ""), ("ambiguous_identity", download & ((times("owner") > 1) | (times("file") > 1))),
        ("identity_invalid", download & ~(value("owner").rlike("^[0-9]+$") & value("file").rlike("^[A-Za-z0-9]+$"))),
    ]
    rows = rows.withColumn("code", first_reason(rules))
    good = F.col("code") == "ok"
    return rows.select("page_id", "pos", "name", "code", F.when(good, resolved(F.col("href"), F.col("url"))).alias("url"), F.when(good & download, F.concat_ws(":", value("owner"), value("file"))).alias("attachment_id"))


#: Routes of a site: host, path with column and article, and the column that is read.
ROUTE_PATH = r"^/info/([1-9][0-9]*)/([1-9][0-9]*)\.htm$"


def url_class(links: DataFrame, host: str, column: str) -> DataFrame:
    """key, class (supported, external, unsupported_route, unsupported_column, ambiguous or invalid) and identity of list
    targets. Ids that are said again in the query must agree, and must not be said twice."""
    u = F.col("link")
    path = F.regexp_extract(u, "^https?://[^/?#]+([^?#]*)", 1)
    said = lambda k: F.regexp_extract(u, rf"[?&]{k}=([^&#]*)", 1)
    times = lambda k: F.size(F.regexp_extract_all(u, F.lit(rf"[?&]{k}=[^&#]*"), F.lit(0)))
    page, show = path.startswith("/info/"), path == "/show"
    col = F.when(page, F.regexp_extract(path, ROUTE_PATH, 1)).otherwise(said("column"))
    art = F.when(page, F.regexp_extract(path, ROUTE_PATH, 2)).otherwise(said("article"))
    differs = page & (((said("column") != "") & (said("column") != col)) | ((said("article") != "") & (said("article") != art)))
    kind = first_reason([
        ("external", F.regexp_extract(u, "^https?://([^/:?#]+)", 1) != host), ("unsupported_route", ~page & ~show), ("ambiguous", (times("column") > 1) | (times("article") > 1) | differs),
        ("invalid", ~(col.rlike("^[1-9][0-9]*$") & art.rlike("^[1-9][0-9]*$"))), ("unsupported_column", col != column), ("unsupported_route", u.contains("#")),
    ], "supported")
    rows = links.withColumn("class", kind)
    return rows.select("key", "class", F.when(F.col("class") == "supported", F.concat_ws(":", col, art)).alias("identity"))


def url_identity(links: DataFrame, routes: DataFrame) -> DataFrame:
    """key, route, class and identity (column:article) of each link by a table of routes: route, host, path (a pattern with
    the column and the article in its groups, or without groups), column_key and article_key (names in the query, which
    say the ids or say them again).

    The first route of the link's host, by name, whose path it has counts. Ids that are said twice, or not alike in path
    and query, are ambiguous; ids must be numbers without leading zeros. A link of no route's host is external.
    """
    u = F.col("link")
    own = links.select("key", "link", F.regexp_extract(u, "^https?://([^/:?#]+)", 1).alias("host"), F.regexp_extract(u, "^https?://[^/?#]+([^?#]*)", 1).alias("at"), F.regexp_extract(u, r"\?([^#]*)", 1).alias("query"))
    both = own.join(routes, "host", "left").withColumn("fits", F.expr("at RLIKE path"))
    best = both.groupBy("key", "link", "at", "query").agg(F.max(F.col("route").isNotNull()).alias("known"), F.min(F.when(F.col("fits"), F.struct("route", "path", "column_key", "article_key"))).alias("r"))
    rows = best.select("key", "at", "query", "known", "r.*")
    pairs = F.transform(F.filter(F.split("query", "&"), lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v")))
    said = lambda name: F.transform(F.filter("pairs", lambda x: x["k"] == F.col(name)), lambda x: x["v"])
    grouped = F.col("path").contains("(")
    in_path = lambda i: F.when(grouped, F.expr(f"regexp_extract(at, if(path LIKE '%(%', path, '()()'), {i})"))
    rows = rows.withColumn("pairs", pairs).withColumns({"c": said("column_key"), "a": said("article_key"), "pc": in_path(1), "pa": in_path(2)})
    column, article = F.coalesce("pc", F.get("c", F.lit(0))), F.coalesce("pa", F.get("a", F.lit(0)))
    differs = lambda path, query: F.coalesce(F.col(path) != F.get(query, F.lit(0)), F.lit(False))
    number = lambda x: F.coalesce(x.rlike("^[1-9][0-9]*$"), F.lit(False))
    kind = first_reason([
        ("external", ~F.col("known")), ("unsupported_route", F.col("route").isNull()), ("ambiguous", (F.size("c") > 1) | (F.size("a") > 1) | differs("pc", "c") | differs("pa", "a")), ("invalid", ~(number(column) & number(article))),
    ], "supported")
    rows = rows.withColumn("class", kind)
    return rows.select("key", "route", "class", F.when(F.col("class") == "supported", F.concat_ws(":", column, article)).alias("identity"))


def list_rows(pages: DataFrame, listing: str = "am-list") -> DataFrame:
    """page_id, row_index, href, title, published_date and code of the rows of a list page, in order: the items of the
    first ul of class ``listing``, not those of lists inside them."""
    nodes, first = F.col("nodes"), lambda a, name: F.get(ps.opened(a, name), F.lit(0))
    text = lambda n: F.coalesce(ps.said(ps.inside(nodes, n)), F.lit(""))
    rows = ps.page_stream(pages).withColumn("list", F.get(ps.opened(nodes, "ul", lambda n: ps.has_class(n, listing)), F.lit(0)))
    items = ps.opened(ps.inside(nodes, F.col("list")), "li", lambda n: n["depth"] == F.col("list.depth") + 1)
    rows = rows.select("page_id", "url", "nodes", F.posexplode(items).alias("row_index", "item")).withColumn("x", ps.inside(nodes, F.col("item")))
    rows = rows.select("page_id", "url", "row_index", first("x", "a").alias("a"), text(first("x", "span")).alias("title"), text(first("x", "i")).alias("day"))
    href, day = F.coalesce(F.col("a.attributes")["href"], F.lit("")), F.col("day")
    date = F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"))
    rules = [("entry_missing", F.col("a").isNull()), ("detail_url_invalid", (href == "") | href.rlike(r"[\x00-\x20\x7f\\]|%(?![0-9A-Fa-f]{2})")), ("title_missing", F.col("title") == ""), ("published_date_invalid", date.isNull())]
    return rows.select("page_id", "row_index", first_reason(rules).alias("code"), resolved(href, F.col("url")).alias("detail_url"), "title", date.alias("published_date"))


def pagination_check(pages: DataFrame) -> DataFrame:
    """page_id, code, current_page, total_pages and next_url from a list page's panel: labels rise from 1, gaps need an
    ellipsis, no two labels share a target, and there is no next page exactly on the last one."""
    panel = F.regexp_extract("html", r"(?is)<div class=\"p_pages\">(.*?)</div>", 1)
    span = F.regexp_extract_all(panel, F.lit(r"(?is)<span class=\"p_(?:no|no_d|dot)\">.*?</span>"), F.lit(0))
    one = F.transform(span, lambda s: F.struct(F.regexp_extract(s, "class=\"(p_[a-z_]+)\"", 1).alias("kind"), F.regexp_extract(s, "href=\"([^\"]*)\"", 1).alias("href"), F.trim(F.regexp_replace(s, "<[^>]*>", "")).alias("label")))
    control = lambda c: F.regexp_extract(panel, rf"(?is)<span class=\"p_{c}\"><a href=\"([^\"]*)\"", 1)
    rows = pages.select("page_id", one.alias("m"), control("next").alias("next"), control("last").alias("last"))
    numbers = F.filter("m", lambda x: x["kind"] != "p_dot")
    rows = rows.withColumns({"n": numbers, "value": F.transform(numbers, lambda x: x["label"].try_cast("int")), "here": F.filter(numbers, lambda x: x["kind"] == "p_no_d")})
    steps = F.zip_with("m", F.slice("m", F.lit(2), F.size("m")), lambda a, b: F.when((a["kind"] != "p_dot") & (b["kind"] != "p_dot"), b["label"].try_cast("int") - a["label"].try_cast("int")).otherwise(F.lit(1)))
    rise = F.zip_with("value", F.slice("value", F.lit(2), F.size("value")), lambda a, b: b - a)
    current, total = F.get("here", F.lit(0))["label"].try_cast("int"), F.array_max("value")
    targets = F.filter(F.transform("n", lambda x: x["href"]), lambda h: h != "")
    of = lambda k: F.get(F.filter("n", lambda x: x["label"].try_cast("int") == k), F.lit(0))["href"]
    rules = [
        ("pagination_missing", F.size("n") == 0), ("current_page_invalid", (F.size("here") != 1) | current.isNull()), ("label_invalid", F.exists("value", lambda v: v.isNull() | (v < 1))), ("first_label_not_one", F.get("value", F.lit(0)) != 1),
        ("labels_not_rising", F.exists(rise, lambda s: s <= 0)), ("gap_without_ellipsis", F.exists(steps, lambda s: s > 1)), ("repeated_target", F.size(F.array_distinct(targets)) < F.size(targets)),
        ("last_page_has_next", (current == total) & ((F.col("next") != "") | (F.col("last") != ""))), ("next_page_missing", (current < total) & ((F.col("next") == "") | (F.col("last") == ""))),
        ("last_page_mismatch", (current < total) & (F.col("last") != of(total))), ("next_page_mismatch", (current < total) & (F.coalesce(of(current + 1), F.col("next")) != F.col("next"))),
    ]
    return rows.select("page_id", first_reason(rules).alias("code"), current.alias("current_page"), total.alias("total_pages"), F.when(F.col("next") != "", F.col("next")).alias("next_url"))


def parse_outcomes(pages: DataFrame, parsers: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Pages and parse codes of each source. ``parsers``: for each name which pages it takes, and the code it gives;
    a page that none takes has no parser."""
    name = F.coalesce(*(F.when(takes, n) for n, (takes, _) in parsers.items()), F.lit("none"))
    code = F.coalesce(*(F.when(takes, c) for takes, c in parsers.values()), F.lit("parser_missing"))
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return pages.groupBy(host.alias("host"), name.alias("parser"), code.alias("code")).agg(F.count("*").alias("pages"))
