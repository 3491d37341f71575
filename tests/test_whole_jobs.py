"""Searches and decisions that do their whole job: no query is refused for its words, no constraint is left out."""

import os

import duckdb
import pytest

from notelake import registry
from notelake.operators import search

DATA = "/root/testdata/sf0.01"
WHOLE = ["query_expand", "search_match", "search_prefilter", "search_bm25", "search_batch", "per_source_topk", "retrieval_metrics", "empty_set_queries", "search_compare"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


def test_every_document_meets_every_profile(spark, duck):
    """One row for each document and profile, and no constraint of a document left out."""
    rows = registry.queries()["eligibility"](spark, DATA)
    profiles = duck.sql("select count(*) from benchmark").fetchall()[0][0] + 4
    documents = duck.sql("select count(*) from documents").fetchall()[0][0]
    assert rows.count() == rows.select("document_id", "profile_id").distinct().where("profile_id IS NOT NULL").count() == documents * profiles


def test_every_constraint_has_a_result_for_every_profile(spark, duck):
    rows = registry.queries()["constraint_results"](spark, DATA)
    profiles = duck.sql("select count(*) from benchmark").fetchall()[0][0] + 4
    asked = duck.sql("select count(*) + count(*) + count(*) filter (n_chars % 23 < 3) + count(*) filter (n_chars % 29 = 4) from documents").fetchall()[0][0]
    assert rows.count() == asked * profiles and rows.where("profile_id IS NULL").count() == 0


def test_no_conflict_is_left_out(spark, duck):
    """Documents of all lengths may have conflicts."""
    want = duck.sql("""select doc_id from documents where n_chars % 29 = 4 and n_chars % 19 > 0 and lang <> 'fr'""").fetchall()
    got = registry.queries()["constraint_conflicts"](spark, DATA).collect()
    assert sorted(r.document_id for r in got) == sorted(i for (i,) in want)


def test_every_profile_is_decided_on_by_name(spark, duck):
    rows = registry.queries()["decide_from_facts"](spark, "/root/testdata/sf0.001")
    assert rows.where("profile_id IS NULL").count() == 0 and "profiles" not in rows.columns
    assert rows.groupBy("document_id").count().where("count <> 2").count() == 0


@pytest.mark.parametrize("name", WHOLE)
def test_no_query_is_refused(name):
    """The SQL answers queries of any number of words."""
    sql = registry.oracle_sql()[name]
    assert "refused" not in sql and "words" in sql


def test_long_queries_are_expanded(spark, duck):
    """A query of nine or more words has all of them as groups."""
    got = {}
    for r in registry.queries()["query_expand"](spark, DATA).collect():
        got.setdefault(r.query_id, set()).add(r.term)
    asked = duck.sql("select item_id, lower(substr(text, 1, 40)) from benchmark").fetchall()
    many = {i: set(t.replace("ß", "ss").split()) for i, t in asked if len(set(t.replace("ß", "ss").split())) > 8}
    assert many and all(got[i] == words for i, words in many.items())


def test_a_long_query_is_found(spark):
    """Every search answers a query of nine words; with a bound on words it is refused."""
    docs = [(1, "s", "a title", "one two three four five six seven eight nine ten", None, "processed", 1), (2, "s", "", "one two three four five six seven eight", None, "processed", 1)]
    index = search.indexed(search.index_rows(spark.createDataFrame(docs, "document_id long, source_id string, title string, body_text string, published_date date, status string, current_version_id long")))
    asked = spark.createDataFrame([(1, "nine eight seven six five four three two one")], "query_id long, term string")
    ways = {
        "match": lambda n: search.search_match(index, asked, most=n), "prefilter": lambda n: search.search_prefilter(index, asked, most=n), "bm25": lambda n: search.search_bm25(index, asked, most=n),
        "batch": lambda n: search.search_batch(index, asked, most=n).where("code IS NULL"), "source": lambda n: search.per_source_topk(index, asked, 2, n), "words": lambda n: search.word_rank(index, asked, n),
    }
    for name, way in ways.items():
        assert [r.document_id for r in way(None).collect()] == [1], name
        assert way(8).count() == 0, name
