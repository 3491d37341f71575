"""The pipeline's stages: on the smallest tables, each against its operator or a plain loop; and on odd rows."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from notelake.llm import byte_cnn, decontaminate, simhash
from notelake.llm.common import remainder

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and blank texts, a null id, a repeated row, one id with two texts, a very long text, other columns."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    own = [(1, "one text of a few words", "x"), (1, "one text of a few words", "x"), (1, "another text", "y"), (2, None, None), (3, "", "z"), (4, " \n\t", "z"), (None, "without an id", None), (5, long, "l"), (6, "one text of a few words", "w")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), a, a) for i, t, a in own], "doc_id long, text string, lang string, source string, n_chars long, dk string, id string")


def test_stages_on_the_given_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = [docs]
    for name in list(STAGES)[:-1]:
        out = corpus_pipeline.stored(STAGES[name](spark, kept[-1], DATA), name)
        assert out.columns == docs.columns and set(rows(out)) <= set(rows(kept[-1]))
        kept.append(out)
    scores = {r.doc_id: r.score for r in byte_cnn.quality_scores(docs, labels, remainder(4) == 2).collect()}
    assert {r.doc_id for r in kept[1].collect()} == {i for i, s in scores.items() if s >= 0.7}
    texts = {r.doc_id: r.text or "" for r in kept[1].collect()}
    shingles = {i: {bytes(h) for h in simhash.shingle_hashes(t.encode(), 5)} for i, t in texts.items()}
    stay = {r.doc_id for r in kept[2].collect()}
    alike = lambda a, b: shingles[a] == shingles[b] or len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    for i in set(texts) - stay:
        assert any(alike(i, j) for j in texts if j != i)
    clean = [decontaminate.normal(t) for (t,) in items.select("text").collect()]
    hit = {r.doc_id for r in decontaminate.benchmark_hits(kept[2], items).collect()}
    assert {r.doc_id for r in kept[3].collect()} == stay - hit
    assert all(not any(c and c in decontaminate.normal(r.text) for c in clean) for r in kept[3].collect())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for r in sorted(kept[4].collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in STAGES["token_ids"](spark, kept[4], DATA).collect()) == want


def test_stages_on_odd_rows(spark, odd):
    every = rows(odd)
    for name in list(STAGES)[:-1]:
        out = STAGES[name](spark, odd, DATA)
        assert out.columns == odd.columns and set(rows(out)) <= set(every), name
    unique = rows(STAGES["simhash"](spark, odd, DATA))
    assert max(unique.values()) == 1 and sorted((r[0] is None, r[0]) for r in unique) == [(False, 1), (False, 1), (False, 2), (False, 5), (True, None)]
    assert rows(STAGES["decontaminate"](spark, odd, DATA)) == every
    tokens = STAGES["token_ids"](spark, odd, DATA).collect()
    assert len(tokens) == 9 and sorted(r.n_tokens for r in tokens if r.doc_id in (2, 3)) == [1, 1]


def test_stages_on_empty_tables(spark, odd):
    none = odd.limit(0)
    assert all(stage(spark, none, DATA).count() == 0 for stage in STAGES.values())
