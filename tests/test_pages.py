"""Token streams of pages: nesting, error recovery, pages cut anywhere; and what reads them."""

import random

import pytest
from pyspark.sql import functions as F

from notelake.operators import page_stream as ps
from notelake.operators import pages

URL = "https://h.example/a/b/c.htm?x=1"


def page(html):
    return ps.Page(html, frozenset(ps.DROPPED_CLASSES))


def body(html):
    return "".join(n[6] for n in page(html).nodes if not n[3])


@pytest.fixture
def table(spark):
    return lambda *htmls: spark.createDataFrame([(i, URL, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div hidden><div>in</div>still<div>in</div></div>out", "out"),
        ("<div class='x ad'><p>no<div>no</div></div>yes", "yes"),
        ("<p style='Display : NONE'>no<p>yes", "<p>yes</p>"),
        ("<p>a<b>b<p>c</b>d", "<p>a<b>b</b></p><p>cd</p>"),
        ("<ul><li>1<li>2<ul><li>x</ul><li>3</ul>", "<ul><li>1</li><li>2<ul><li>x</li></ul></li><li>3</li></ul>"),
        ("<table><tr><td>1<td>2<tr><th>3</table>", "<table><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></table>"),
        ("<div><b>1</div>2</b>3", "<div><b>1</b></div>23"),
        ("<a href=bare onclick='x()' data-k=1>t</a>", '<a href="bare">t</a>'),
        ("<a href='say \"hi\"'>", '<a href="say &quot;hi&quot;"></a>'),
        ('<a title="1>2">ok</a>', '<a title="1>2">ok</a>'),
        ("a< b <= c", "a< b <= c"),
        ("</p></div>x<br/>y<hr>", "x<br>y<hr>"),
        ("<!-- <div hidden> -->x<!doctype html><?php z ?>", "x"),
        ("<SCRIPT>if (a<b) '</div>'</SCRIPT >y<style>p{}</style>", "y"),
    ],
)
def test_recovery(html, want):
    assert body(html) == want and not page(html).truncated


@pytest.mark.parametrize("html", ["a<!-- b", "a<div", "a<div class='", "a<", "a</", "a<script>b", "a<!doctype"])
def test_cut_inside_markup_has_a_code(html):
    assert page(html).truncated and body(html) == "a"


def tree(rng, depth=0):
    """(markup, how many elements it opens less those it closes) tokens of a well-formed tree of elements."""
    out = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["text", "br", "div", "span", "ul", "hidden"])
        if kind == "text" or depth > 3:
            out.append(("", rng.choice(["some text", "&amp; &#233;", "x < y", " \n "])))
        elif kind == "br":
            out.append(("", "<br>"))
        elif kind == "ul":
            out += [("ul", "<ul>"), ("li", "<li>"), *tree(rng, depth + 1), ("/", "</li>"), ("/", "</ul>")]
        else:
            name = "div" if kind == "hidden" else kind
            out += [(name, f"<{name} hidden>" if kind == "hidden" else f'<{name} class="a">'), *tree(rng, depth + 1), ("/", f"</{name}>")]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_a_page_cut_at_any_character(seed):
    """It has the nodes of the page closed properly there, or the code of a cut inside markup."""
    tokens = tree(random.Random(seed))
    html, open_at, stack = "", [], []
    for name, text in tokens:
        open_at += [list(stack)] * len(text)
        html += text
        stack = stack[:-1] if name == "/" else [*stack, name] if name else stack
    for cut in range(len(html)):
        got = page(html[:cut])
        if got.truncated:
            assert html[:cut].rfind("<") > html[:cut].rfind(">")
        else:
            closed = page(html[:cut] + "".join(f"</{n}>" for n in reversed(open_at[cut])))
            assert closed.nodes == got.nodes and closed.end == got.end


def test_every_opening_has_its_closing():
    for seed in range(200):
        rng = random.Random(seed)
        html = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<li>", "</li>", "<td>", "x", "<nav>", "</nav>", "<br>", "<p hidden>"]) for _ in range(30))
        own = page(html)
        stack = []
        for at, (kind, name, depth, *_) in enumerate(own.nodes):
            assert depth == len(stack) - (kind == "close")
            if kind == "open":
                stack.append((name, at))
            elif kind == "close":
                opened, first = stack.pop()
                assert opened == name and own.end[first] == at
        assert not stack


def test_text_and_fields(table):
    rows = table(
        "<h1>A <i>b</i>&nbsp;c</h1><i>Date: 2024-02-29</i><p>x&#233;&#x4E2D;y<td>1<td>2</td></p><pre> a\n  b</pre>",
        "<h1>Cut",
        None,
        "",
        "<i>Date: 2023-02-29</i>",
    )
    assert [r.body_text for r in pages.page_text(rows).orderBy("page_id").collect()] == ["A b c\nDate: 2024-02-29\nxé中y\n1\t2\na\nb", "Cut", "", "", "Date: 2023-02-29"]
    got = [(r.title, r.title_code, str(r.published_date), r.date_code) for r in pages.page_fields(rows, "^Date: (.*)$").orderBy("page_id").collect()]
    assert got == [("A b c", "ok", "2024-02-29", "ok"), ("Cut", "ok", "None", "date_missing"), ("", "title_missing", "None", "date_missing"), ("", "title_missing", "None", "date_missing"), ("", "title_missing", "None", "date_invalid")]
    assert [r.code for r in pages.page_clean(rows).orderBy("page_id").collect()] == ["ok", "ok", "empty_page", "empty_page", "ok"]


def test_links_are_resolved_however_many_dots(table):
    rows = table("<a href='" + "../" * 9 + "up.htm'>u<b hidden>p</b></a><a href=./d/./e/../f?q=../z>v</a><a href=..>w</a><div hidden><a href=/no>n</a></div><a>none</a><a href='#x'>x</a>")
    got = [(r.pos, r.code, r.link, r.text) for r in pages.page_links(rows).collect()]
    assert got == [(0, "ok", "https://h.example/up.htm", "u"), (1, "ok", "https://h.example/a/b/d/f?q=../z", "v"), (2, "ok", "https://h.example/a/", "w")]


def test_images_attachments_and_lists_nest(table):
    rows = table(
        "<img src=a.png alt='x'><img src=b.png width=1 height=1><nav><img src=c.png></nav>"
        "<div class='fj'><div><div>files</div><a href='/download?owner=1&file=f'>one <i>two</i></a></div><a href=/x>three</a></div><a href=/y>no</a>"
        "<ul class='am-list'><li><a href=/1><span>One</span><i>2024-01-01</i></a><ul><li><a href=/2>in</a></li></ul><li><a href=/3><span>Three<i>2024-01-03</i></span></a></ul>"
    )
    assert [(r.pos, r.src, r.alt) for r in pages.page_images(rows).collect()] == [(0, "https://h.example/a/b/a.png", "x")]
    assert [(r.pos, r.name, r.attachment_id) for r in pages.page_attachments(rows).orderBy("pos").collect()] == [(0, "one two", "1:f"), (1, "three", None)]
    assert [(r.row_index, r.detail_url, r.title) for r in pages.list_rows(rows).orderBy("row_index").collect()] == [(0, "https://h.example/1", "One"), (1, "https://h.example/3", "Three2024-01-03")]


def test_long_and_odd_pages(spark, table):
    rows = table("<div>" * 3000 + "x" + "<p>y" * 3000, "<a " * 5000, "<" * 5000, "<b>" * 200 + "</div>" * 200)
    assert [r.code for r in pages.page_clean(rows).orderBy("page_id").collect()] == ["ok", "truncated", "truncated", "ok"]
    assert pages.page_clean(rows.limit(0)).count() == 0
    assert pages.page_text(rows.where("page_id = 0").withColumn("code", F.lit(1)).withColumn("nodes", F.lit(2))).count() == 1


def test_identity_by_a_table_of_routes(spark):
    routes = spark.createDataFrame([("b", "h.example", r"^/show$", "c", "a"), ("a", "h.example", r"^/([0-9]+)/([0-9]+)$", "c", "a"), ("z", "h.example", r"^/1/.*$", "c", "a")], "route string, host string, path string, column_key string, article_key string")
    links = ["https://h.example/1/2", "https://h.example/1/2?c=1&a=2", "https://h.example/1/2?a=3", "https://h.example/show?c=1&a=2#x", "https://h.example/show?c=1&c=1&a=2", "https://h.example/show?c=01&a=2", "https://h.example/show?c=1", "https://h.example/1/x?c=1&a=2", "https://h.example/no", "https://g.example/1/2", "", None, "https://h.example/1/2"]
    got = {r.key: (r.route, r["class"], r.identity) for r in pages.url_identity(spark.createDataFrame(list(enumerate(links)), "key long, link string"), routes).collect()}
    assert [got[i] for i in range(len(links))] == [
        ("a", "supported", "1:2"), ("a", "supported", "1:2"), ("a", "ambiguous", None), ("b", "supported", "1:2"), ("b", "ambiguous", None), ("b", "invalid", None), ("b", "invalid", None), ("z", "supported", "1:2"),
        (None, "unsupported_route", None), (None, "external", None), (None, "external", None), (None, "external", None), ("a", "supported", "1:2"),
    ]


@pytest.mark.parametrize(
    ("html", "want"),
    [("<h1>a&amp", "a&amp"), ("<h1>a&&&amp;&am", "a&&&&am"), ("<h1>&lt;&copy;&#65;&#x42;&copyx;", "<©AB&copyx;"), ("<h1>&nosuch;&amp;lt;", "&nosuch;&lt;")],
)
def test_a_title_cut_in_an_entity(table, html, want):
    """An entity needs its semicolon."""
    assert [r.title for r in pages.page_fields(table(html), "^Date: (.*)$").collect()] == [want]


def test_text_cut_in_an_entity(table):
    assert [r.body_text for r in pages.page_text(table("<p>x &amp; y &amp", "<p>&quot;a&quot<br>b&middot;")).orderBy("page_id").collect()] == ["x & y &amp", '"a&quot\nb·']


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('a<script>var t="</p>";f(1', "ok"), ('a<script>var t="</p>";</sc', "ok"), ("a<script>f(1", "truncated"), ("a<script>if (x <y", "truncated"), ("a<style>p{}</", "ok"), ("a<!-- b <p>", "ok"),
        ("a<!-- <p> -", "ok"), ("a<!-- <p> b", "truncated"), ("a<script src='x", "truncated"), ("a<script>", "ok"), ("", "empty_page"),
    ],
)
def test_code_of_a_cut_as_the_sql_has_it(table, html, want):
    assert [(r.code, r.body) for r in pages.page_clean(table(html)).collect()] == [(want, html[:1])]
