"""Boundary cases on inline frames."""

from notelake.operators import backlog, decisions, delivery, pages, rules, search, versions


def test_pointer_returns_to_an_older_text(spark):
    rows = spark.createDataFrame([(1, 10, 100, "A", "p1"), (1, 11, 200, "B", "p1"), (1, 12, 300, "A", "p1"), (1, 13, 400, "A", "p2")], "document_id long, version_id long, observed_at long, raw_sha string, parser_version string")
    assert [r.change for r in versions.version_changes(rows).orderBy("observed_at").collect()] == ["first", "changed", "changed", "same"]
    assert versions.current_pointer(rows).first().version_id == 13
    assert [r.event_seq for r in versions.event_seq(rows).orderBy("event_seq").collect()] == [1, 2, 3]


def test_slots_are_lent_without_duplicates(spark):
    rows = [("s", i, "history", i + 1) for i in range(5)] + [("s", 100 + i, "recheck", i + 1) for i in range(2)]
    ranked = spark.createDataFrame(rows, "source_id string, document_id long, grp string, rank int")
    got = backlog.slot_selection(ranked, {"foreground": 2, "history": 1, "recheck": 1}, 5).orderBy("position").collect()
    assert [r.document_id for r in got] == [0, 100, 1, 2, 3]


def test_oversized_item_does_not_block_later_ones(spark):
    rows = [(1, 7, 3, 1, 900, "digest", False), (2, 7, 3, 2, 5000, "digest", False), (3, 7, 3, 3, 200, "digest", False), (4, 7, 3, 4, 300, "digest", False)]
    events = spark.createDataFrame(rows, "event_id long, installation long, slot long, occurred_at long, item_bytes long, route string, allocated boolean")
    got = {r.event_id: (r.part, r.position) for r in delivery.digest_packing(events, 1200, 10).collect()}
    assert got == {1: (1, 1), 2: (None, None), 3: (1, 2), 4: (2, 1)}


def test_user_text_is_literal(spark):
    index = spark.createDataFrame([(1, "s", None, 1, "a.b", "x (y) \\q"), (2, "s", None, 1, "acb", "none")], "document_id long, source_id string, published_date date, version_id long, title_text string, body_text string")
    queries = spark.createDataFrame([(1, "a.b"), (2, "(y)")], "query_id long, term string")
    assert {(r.query_id, r.document_id) for r in search.search_bm25(index, queries).collect()} == {(1, 1), (2, 1)}


def test_mentions_do_not_overlap_and_count_code_points(spark):
    texts = spark.createDataFrame([(1, "body_text", "éaaaa.a"), (2, "body_text", ""), (3, "body_text", None)], "document_id long, field string, text string")
    got = rules.topic_mentions(texts, spark.createDataFrame([("r1", "x", "aa"), ("r2", "y", ".")], "rule_id string, topic string, phrase string")).collect()
    assert sorted((r.document_id, r.rule_id, r.start, r.end) for r in got) == [(1, "r1", 1, 3), (1, "r1", 3, 5), (1, "r2", 5, 6)]


def test_a_single_mismatch_decides(spark):
    facts = spark.createDataFrame([(1, "opportunity", True, True, False), (2, "information", True, True, False)], "document_id long, category string, audience_declared boolean, eligibility_complete boolean, information_incomplete boolean")
    asked = spark.createDataFrame([(1, "level", "in", ["a"]), (1, "year", "unsupported", ["b"])], "document_id long, field string, operator string, values array<string>")
    profiles = spark.createDataFrame([("p", "level", "z"), ("p", "year", "b"), ("q", "level", "a"), ("q", "year", "b")], "profile_id string, field string, actual string")
    got = {(r.document_id, r.profile_id): (r.eligibility, r.profiles) for r in decisions.eligibility(facts, asked, profiles).collect()}
    assert got == {(1, "p"): ("ineligible", 1), (1, "q"): ("unknown", 1), (2, None): ("not_required", 2)}


def test_a_constraint_that_no_profile_names_is_unknown(spark):
    facts = spark.createDataFrame([(1, "opportunity", True, True, False), (2, "information", True, True, False), (3, "information", True, True, False)], "document_id long, category string, audience_declared boolean, eligibility_complete boolean, information_incomplete boolean")
    asked = spark.createDataFrame([(1, "gpa", "unsupported", ["3"]), (2, "gpa", "unsupported", ["3"])], "document_id long, field string, operator string, values array<string>")
    profiles = spark.createDataFrame([("p", "level", "a")], "profile_id string, field string, actual string")
    got = {r.document_id: r.eligibility for r in decisions.eligibility(facts, asked, profiles).collect()}
    assert got == {1: "unknown", 2: "unknown", 3: "not_required"}


def test_a_lower_bound_before_the_next_digest_goes_at_once(spark):
    at, day = 1_000_000, 86_400
    row = ("PUSH_NOW", "activation_recent", "open", at + 600, at + 3 * day)
    rows = spark.createDataFrame([row, (*row[:3], None, at + 3 * day)], "action string, kind string, time_status string, deadline_lower_at long, deadline_at long")
    got = [r.r for r in rows.select(decisions.route(at, "hybrid", at + day).alias("r")).collect()]
    assert got == ["immediate", "digest"]


def test_only_failures_of_the_channel_pause_it(spark):
    attempts = spark.createDataFrame([(1, "permanent", "message", 50), (2, "permanent", "channel", 40)], "mail_id long, outcome string, scope string, finished_at long")
    messages = spark.createDataFrame([(1, 7), (2, 7)], "mail_id long, installation long")
    assert [tuple(r) for r in delivery.channel_pause(attempts, messages).collect()] == [(7, 40, 2)]


def test_pages(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "http://a.b/c/d.htm", '<p><img src="x.png"></p>'), (2, "http://a.b/c/", '<p>.</p><img width="1" height="1">'), (3, "http://a.b", '<a href="../../x">x</a><a HREF="?p=2">p</a><a href="javascript:0">j</a>')], "page_id long, url string, html string")
    assert [r.meaningful for r in pages.page_meaningful(rows).orderBy("page_id").collect()] == [True, False, True]
    assert [(r.page_id, r.src) for r in pages.page_images(rows).collect()] == [(1, "http://a.b/c/x.png")]
    hrefs = [("../e", "http://a.b/c/d/f.htm", "http://a.b/c/e"), ("./e", "http://a.b/c/", "http://a.b/c/e"), ("//x.y/z", "https://a.b/", "https://x.y/z"), ("?q", "http://a.b/c?p", "http://a.b/c?q")]
    got = spark.createDataFrame(hrefs, "h string, u string, want string").select(pages.resolved(F.col("h"), F.col("u")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_search_counts_overlaps_and_finds_short_terms(spark):
    index = spark.createDataFrame([(1, "s", None, 1, "aaaa", "xyz of"), (2, "s", None, 1, "b", "aa of"), (3, "s", None, 1, "", "")], "document_id long, source_id string, published_date date, version_id long, title_text string, body_text string")
    terms = spark.createDataFrame([("aa",), ("of",), ("xyz",), ("zzz",)], "t string")
    got = {(r.t, r.document_id): (r.in_title, r.in_body) for r in search.term_hits(index, terms).collect()}
    assert got == {("aa", 1): (3, 0), ("aa", 2): (0, 1), ("of", 1): (0, 1), ("of", 2): (0, 1), ("xyz", 1): (0, 1)}
    queries = spark.createDataFrame([(1, "of"), (2, "xyz of"), (3, "")], "query_id long, term string")
    assert {(r.query_id, r.document_id, r.long) for r in search.search_rank(index, queries).collect()} == {(1, 1, False), (1, 2, False), (2, 1, True)}


def test_plans_of_a_search_have_no_cross_join_of_queries_and_documents(spark):
    index = spark.createDataFrame([(1, "s", None, 1, "a", "b")], "document_id long, source_id string, published_date date, version_id long, title_text string, body_text string")
    queries = spark.createDataFrame([(1, "abc")], "query_id long, term string")
    plan = search.search_prefilter(index, queries)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_a_stream_started_again_adds_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    from notelake.streaming import jobs

    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, body string").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = lambda: spark.readStream.schema("id long, body string").parquet(str(tmp_path / "in")).select("id", F.col("body").cast("binary").alias("body"))
    assert jobs.archived(rows(), str(tmp_path / "job")).count() == 2
    spark.createDataFrame([(4, "b"), (5, "c")], "id long, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.first_id for r in jobs.archived(rows(), str(tmp_path / "job")).collect()) == [1, 2, 5]
    assert jobs.archived(rows(), str(tmp_path / "job")).count() == 3


def test_tree_digest_depends_on_order_and_content_only(spark):
    from pyspark.sql import functions as F

    from notelake.functions.text import tree_digest

    rows = spark.createDataFrame([("a", i, f"v{i}") for i in range(100)], "g string, k long, v string")
    digest = lambda df: tree_digest(df, ["g"], "k", F.col("v"), width=4).first()
    one, two, other = digest(rows), digest(rows.repartition(7)), digest(rows.where("k <> 50"))
    assert one == two and one.n == 100 and other.digest != one.digest
