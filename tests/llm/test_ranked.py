"""Resampling, ranked search and sharding against plain loops, on odd rows; their registered queries against their SQL."""

import collections
import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake.llm import lexical_search, queries, resample, sharding, words

SCHEMA = "doc_id long, text string, rank int, score string, row long, shard string, slot int, body string, tag long, n_words long"
DATA = "/root/testdata/sf0.001"


def own_words(text):
    """By the contract's own pattern of characters, one at a time."""
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    known = ["".join(rng.choices("abCDé1", k=rng.randint(1, 4))) for _ in range(40)]
    say = lambda n: rng.choice([" ", "-", "\n", ", "]).join(rng.choices(known, k=n))
    out = [(i, say(rng.randint(0, 90))) for i in range(120)]
    out += [(i, out[3][1]) for i in range(200, 240)]  # copies: ties but for doc_id
    out += [(3, out[3][1]), (3, out[3][1]), (3, say(30)), (None, out[3][1]), (None, None), (300, ""), (301, None), (302, " .;\n"), (303, "İ ẞ ﬀ 中文 " * 20), (304, say(9_000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 5, "x", 7, "y", 1, "own", 9, None) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


ITEMS = [(1, "abC 1é abC"), (2, None), (None, "dé a"), (3, "nowhere0x"), (4, ""), (1, "C1 b")]


@pytest.fixture(scope="module")
def items(spark, rows):
    longer = [(7, " ".join(sorted({w for _, t in rows for w in own_words(t)}))), (8, rows[3][1])]  # over 64 terms at once with the next
    extra = [(9, rows[40][1] + " " + " ".join(f"unseen{i}" for i in range(200)))]
    return [*ITEMS, *longer, *extra]



def resampled(rows, target, percent):
    k = 10_000
    runs = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % k
    s = collections.Counter(bucket(f) for _, t in rows for f in runs(own_words(t)))
    t = collections.Counter(bucket(f) for x in target for f in runs(own_words(x)))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + k) / ((s[b] + 1) * (total_t + k))))
    out = []
    for doc_id, text in rows:
        own = runs(own_words(text))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        out.append([doc_id, len(own_words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return collections.Counter(map(tuple, out))


@pytest.mark.parametrize("percent", [0, 5, 50, 100])
def test_importance_resample(spark, rows, docs, percent):
    target = [rows[3][1], "abC abC é", None, ""]
    got = resample.importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == resampled(rows, target, percent)


def test_importance_resample_empty(spark, docs, empty, rows):
    none = spark.createDataFrame([], "text string")
    assert resample.importance_resample(empty, none).count() == 0
    assert collections.Counter(map(tuple, resample.importance_resample(docs, none).collect())) == resampled(rows, [], 5)


def test_drawn_texts(spark, docs):
    ranks = resample.importance_resample(docs, docs, 20)
    ids = {r[0] for r in ranks.where("rank IS NOT NULL").collect()}
    got = resample.drawn_texts(docs, ranks)
    assert got.columns == docs.columns and {r[0] for r in got.select("doc_id").collect()} == ids


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_cutoff_is_exact(spark, parts):
    """All ranks of a small table with ties, however its keys are spread over tasks."""
    rng = random.Random(parts)
    rows = [(rng.choice([None, *range(9)]), tag, rng.randint(-3, 3)) for tag in range(60)]
    ordered = sorted((-s, 2**63 - 1 if d is None else d, t) for d, t, s in rows)
    keys = spark.createDataFrame(rows, "doc_id long, tag long, score long").repartitionByRange(parts, "score")
    for k in (1, 2, 30, 59, 60):
        assert resample.cutoff(keys, k) == ordered[k - 1]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB1 é-\n", max_size=60), st.integers(1, 20))
def test_stretches_change_nothing(text, size):
    body = text.encode()
    assert b"".join(words.stretches(body, size)) == body
    assert [w.decode() for own in words.words(body, size) for w in own] == own_words(text)
    whole = sorted(np.concatenate([b for _, b in resample.features(body)] or [np.zeros(0, int)]).tolist())
    assert sorted(np.concatenate([b for _, b in resample.features(body, size)] or [np.zeros(0, int)]).tolist()) == whole


def searched(rows, items, k=10):
    own = [(d, own_words(t)) for d, t in rows]
    own = [(d, w, collections.Counter(w)) for d, w in own if w]
    n, total = len(own), sum(len(w) for _, w, _ in own)
    df = collections.Counter(t for _, _, c in own for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, w, c in own:
            m = 25 + 75 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own_words(text) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(found)[:k])]
    return collections.Counter(out)


@pytest.mark.parametrize(("k", "block", "rows_a_slice"), [(10, 2_000_000, 2_048), (3, 40, 16), (500, 2_000_000, 7)])
def test_lexical_search(spark, rows, docs, items, monkeypatch, k, block, rows_a_slice):
    monkeypatch.setattr(lexical_search, "SLICE", rows_a_slice)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = lexical_search.lexical_search(docs, asked, k, block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == searched(rows, items, k)


def test_lexical_search_empty(spark, docs, empty, items):
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.lexical_search(empty, asked).count() == 0
    assert lexical_search.lexical_search(docs, asked.limit(0)).count() == 0


def test_masks_stop_early():
    """Of many documents only those whose mask can still win are scored."""
    n, scored = 1_000, []
    doc_terms = [np.array([t for t in range(70) if (d + 1) % (t + 2) == 0] or [0]) for d in range(n)]
    lengths = np.array([len(t) for t in doc_terms])
    terms = np.concatenate(doc_terms).astype(np.int64)
    own = lexical_search.Slice(list(range(n)), [50] * n, lengths, terms, np.ones(len(terms), np.int64), np.arange(70, dtype=np.int64) + 1, n, 50 * n)
    plain = own.scores
    own.scores = lambda docs, times: scored.append(len(docs)) or plain(docs, times)
    wanted, times, best = np.arange(70), np.ones(70, np.int64), lexical_search.Best(10)
    own.search(wanted, times, times, best)
    full = plain(np.arange(n), times)
    assert [(-s, d) for s, _, d in best.found] == sorted(zip(full.tolist(), range(n), strict=True), key=lambda x: (-x[0], x[1]))[:10]
    assert sum(scored) < n / 4


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 256, 257, 1000, 5001])
def test_permutation(n):
    at = np.arange(n)
    places = sharding.permuted(at, n, seed=3)
    assert sorted(places.tolist()) == at.tolist()
    assert (sharding.restored(places, n, seed=3) == at).all()
    shard, slot = sharding.place_of(at, n, 8, 3)
    assert (sharding.row_of(shard, slot, n, 8, 3) == at).all()
    if n > 100:
        assert abs(np.corrcoef(at, places)[0, 1]) < 0.2 and (places != sharding.permuted(at, n, seed=4)).mean() > 0.9


def test_large_domain():
    """Row numbers far beyond 32 bits; a part of the domain is moved and brought back."""
    n = 3 * 10**15 + 1
    at = np.arange(n - 1_000, n)
    places = sharding.permuted(at, n)
    assert len(set(places.tolist())) == 1_000 and places.min() >= 0 and places.max() < n
    assert (sharding.restored(places, n) == at).all()


@pytest.mark.parametrize("shards", [1, 8, 500])
def test_sharded(docs, rows, shards):
    got = sharding.sharded(docs, shards)
    assert got.columns == [*docs.columns, "row_", "shard_", "slot_"]
    found = got.collect()
    assert collections.Counter((r.doc_id, r.text) for r in found) == collections.Counter(rows)
    order = sorted(found, key=lambda r: r.row_)
    assert [r.row_ for r in order] == list(range(len(rows)))
    keys = [(r.doc_id is not None, r.doc_id or 0, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in order]
    assert keys == sorted(keys)
    shard, slot = sharding.place_of(np.arange(len(rows)), len(rows), shards)
    assert [(r.shard_, r.slot_) for r in order] == list(zip(shard.tolist(), slot.tolist(), strict=True))
    sizes = collections.Counter(r.shard_ for r in found)
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot_ for r in found if r.shard_ == s) == list(range(sizes[s]))


def test_sharded_is_reproducible(docs, rows):
    """The rows decide, not their files: equal keys take each other's places only."""
    slim = docs.select("doc_id", "text")
    one, two = (sharding.sharded(d) for d in (slim.coalesce(1), slim.repartition(7)))
    assert collections.Counter(map(tuple, one.select("doc_id", F.coalesce("text", F.lit("")), "shard", "slot").collect())) == collections.Counter(map(tuple, two.select("doc_id", F.coalesce("text", F.lit("")), "shard", "slot").collect()))


def test_sharded_empty(empty):
    assert sharding.sharded(empty).count() == 0


def test_written_shards(spark, docs, tmp_path):
    rows = sharding.sharded(docs.select("doc_id", "text"))
    sharding.write_shards(rows, str(tmp_path / "out"), rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.shard, r.slot) for r in back.collect()) == sorted((r.shard, r.slot) for r in rows.collect())


@pytest.mark.parametrize("name", ["op11_resample", "op12_lexical_search", "op13_sharding"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t[:-8]} as select * from '{DATA}/{t}'")
    got, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert collections.Counter(tuple(r[c] for c in columns) for r in got.collect()) == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall())
