"""The stored search index: counts, updates against a rebuild, refused queries, plans that move no text."""

import random

import pytest
from pyspark.sql import functions as F

from notelake.operators import search, search_index

DOCS = "document_id long, source_id string, title string, body_text string, published_date date, status string, current_version_id long"


def notice(i, version, text, status="processed"):
    return (i, "s", text[:9], text, None, status, version)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    say = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "été", "aa", "aaaa", "b", "the", "theta"], k=rng.randint(0, 30)))
    return {i: say() for i in range(80)}


@pytest.fixture(scope="module")
def queries(spark):
    asked = ["alpha", "the", "aa aaaa", "b été", "theta gamma beta", "zzz", "", "a b c d e f g h i", "alpha alpha the the aa aa b b beta", "aaaa\n été"]
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, term string")


def docs(spark, corpus, **changes):
    return spark.createDataFrame([changes.get(f"d{i}") or notice(i, 1, t) for i, t in corpus.items()], DOCS)


def found(index, queries):
    return sorted((r.query_id, r.document_id, r.title_hits, r.score) for r in search.search_rank(index, queries).collect())


def plain_hits(corpus, term):
    places = lambda text: sum(text.startswith(term, i) for i in range(len(text)))
    out = {i: (places(" ".join(t[:9].split())), places(" ".join(t.split()))) for i, t in corpus.items()}
    return {i: n for i, n in out.items() if any(n)}


def test_hits_are_those_of_a_plain_loop(spark, corpus):
    index = search_index.built(search.index_rows(docs(spark, corpus)))
    terms = ["a", "aa", "the", "aaaa", "alpha", "été g", "a b", "nowhere", "eta"]
    got = {}
    for r in search.term_hits(index, spark.createDataFrame([(t,) for t in terms], "t string")).collect():
        assert (r.t, r.document_id) not in got
        got[r.t, r.document_id] = (r.in_title, r.in_body)
    assert got == {(t, i): n for t in terms for i, n in plain_hits(corpus, t).items()}


def test_candidates_lose_nothing_when_few_grams_are_met(spark, corpus, monkeypatch):
    """The number of rare grams and the size of slices change the work, not the result."""
    index = search_index.built(search.index_rows(docs(spark, corpus)))
    terms = spark.createDataFrame([("theta",), ("alpha b",), ("gamma",), ("aaaa",)], "t string")
    want = sorted(map(tuple, search.term_hits(index, terms).collect()))
    for rare, size in ((1, 1), (20, 2)):
        monkeypatch.setattr(search, "RARE", rare)
        monkeypatch.setattr(search, "SLICE", size)
        assert sorted(map(tuple, search.term_hits(index, terms).collect())) == want


def test_update_equals_rebuild(spark, corpus, queries):
    """New, changed, withdrawn and returning versions; the index before an update goes on finding what it found."""
    first = docs(spark, corpus)
    old = search_index.built(search.index_rows(first))
    before = found(old, queries)
    second = docs(spark, corpus, d3=notice(3, 2, "theta alpha"), d4=notice(4, 1, corpus[4], "failed"), d5=notice(5, 7, ""))
    second = second.unionByName(spark.createDataFrame([notice(900, 1, "aa aaaa theta gamma beta"), notice(901, 1, "zzz", "discovered")], DOCS))
    assert sorted(map(tuple, search_index.delta(old, second).collect())) == [(3, 1, "drop"), (3, 2, "add"), (4, 1, "drop"), (5, 1, "drop"), (5, 7, "add"), (900, 1, "add")]
    new = search_index.updated(old, second)
    rebuilt = search_index.built(search.index_rows(second))
    assert found(new, queries) == found(rebuilt, queries) != before
    assert found(old, queries) == before
    held = new.postings.count()
    back = search_index.updated(new, first)  # versions that come back are not extracted again
    assert found(back, queries) == before and back.postings.count() == held
    small = search_index.compacted(new)
    assert found(small, queries) == found(new, queries)
    assert sorted(map(tuple, small.postings.collect())) == sorted(map(tuple, rebuilt.postings.collect()))


def test_nothing_to_update_reads_and_writes_nothing(spark, corpus):
    first = docs(spark, corpus)
    old = search_index.built(search.index_rows(first))
    assert search_index.updated(old, first) is old


def test_queries_of_over_eight_words_are_refused(spark, corpus, queries):
    index = search_index.built(search.index_rows(docs(spark, corpus)))
    page = search.search_batch(index, queries, 3).collect()
    assert [(r.query_id, r.rank, r.document_id) for r in page if r.code] == [(7, None, None)]
    assert {r.query_id for r in page if not r.code} >= {0, 1, 8}
    assert search.search_rank(index, queries).where("query_id = 7").count() == 0


def test_no_posting_and_no_text_is_shuffled(spark, corpus, queries):
    """Grams meet in the buckets of the postings and texts in buckets of their own; only the terms are handed out."""
    index = search_index.built(search.index_rows(docs(spark, corpus)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        hits = search.term_hits(index, queries.select(F.explode(F.split("term", " ")).alias("t")).where("t <> ''").distinct())
        plan = hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "hashpartitioning" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("body_text") and "collect_list(t" in plan  # texts meet a document's terms, not single pairs


def test_empty_corpus_and_no_queries(spark, corpus, queries):
    none = docs(spark, corpus).limit(0)
    index = search_index.built(search.index_rows(none))
    assert found(index, queries) == []
    assert found(search_index.updated(index, docs(spark, corpus)), queries) == found(search_index.built(search.index_rows(docs(spark, corpus))), queries)
    assert found(index, queries.limit(0)) == []
