"""The operators of the llm folder against plain loops, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notelake.llm import byte_cnn, chat_format, decontaminate, lm_score, mixing, quality_rules, simhash, substring_dedup, suffix_dedup, token_ids
from notelake.llm.common import remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dk int, body string, k long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(60)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    shared = [say(90), say(30)]
    out = [(i, f"{say(rng.randint(0, 60))} {rng.choice([*shared, ''])} {say(rng.randint(0, 40))}") for i in range(60)]
    out += [(60, out[3][1]), (61, out[3][1]), (62, None), (63, ""), (64, " \n\t "), (65, "x" * 3000), (66, "go " * 900), (None, shared[0]), (3, out[3][1]), (67, say(20_000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None if i == 5 else "en", "s", 1, 7, "own", 9) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(60)] + [(1, 0, 0), (900, 1, 0)], "doc_id long, quality int, toxic int")


def bodies(rows):
    return [(i, (t or "").encode()) for i, t in rows]


def tuples(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("settings", [{}, {"hot_group": 1}])
def test_suffix_dedup(docs, rows, settings):
    at = collections.Counter(b[i : i + 400] for _, b in bodies(rows) for i in range(len(b) - 399))
    want = []
    for i, b in bodies(rows):
        gone = bytearray(len(b))
        for j in range(len(b) - 399):
            if at[b[j : j + 400]] > 1:
                gone[j : j + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert tuples(suffix_dedup.suffix_dedup(docs, **settings)) == collections.Counter(want)


def test_substring_dedup(docs, rows):
    seen, want = set(), []
    order = sorted({(-1 if i is None else i, b) for i, b in bodies(rows)}, key=lambda x: x[0])
    result = {}
    for i, b in order:
        w, gone = b.split(), set()
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            gone.update(range(j, j + 20)) if key in seen else seen.add(key)
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        result[i, b] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    want = [(i, *result[-1 if i is None else i, b]) for i, b in bodies(rows)]
    assert tuples(substring_dedup.substring_dedup(docs)) == collections.Counter(want)


def test_lm_scores(docs, rows):
    count = collections.Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, b in bodies(rows):
        if not held(i):
            count.update([*b.lower().split(), b" "])
    n, v = sum(count.values()), len(count)
    got = lm_score.lm_scores(docs, remainder(5) == 1, head=10).collect()
    want = sorted((str(i), held(i), len(b.split()) + 1, sum(count[w] > 0 for w in [*b.lower().split(), b" "]), n, round(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*b.lower().split(), b" "]), 5)) for i, b in bodies(rows))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_filter_never_counts_too_low():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    n = np.arange(5000) % 40 + 1
    bits = np.zeros(1 << 16, np.uint8)
    for level in range(1, 7):
        for at in lm_score._bits(keys[lm_score.levels(n) >= level], level, len(bits) * 8):
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(int), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    assert (lm_score.probe(bits, keys) >= lm_score.levels(n)).all()
    assert (lm_score.probe(bits, keys) == lm_score.levels(n)).mean() > 0.9


def test_chat_format_long_roles(spark):
    """No pattern may recurse over a role: one bad row must not end an executor."""
    roles = ["\\\\:" * 33_000, ":\\b\\c: ", "x: y", "\\", "\\c", "#" * 100_000, ": " * 50_000, "\\:" * 50_000 + "b", "### Assistant: </turn> ok"]
    turns = spark.createDataFrame([(i, k, r, "\\:: " * 1_000 + r[:50]) for i, r in enumerate(roles) for k in (0, 1)], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.chat_examples(turns)).collect()}
    assert [[(t.role, t.text) for t in back[i].turns] for i in range(len(roles))] == [[(r, "\\:: " * 1_000 + r[:50])] * 2 for r in roles]


def test_chat_format(spark):
    control = "\\### Assistant: </turn> ok\n</turn>\n### x: \\"
    rows = [(1, 0, "user", control), (1, 1, "assistant", control), (1, 2, "user", None), (2, 0, None, ""), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, None, "a: b#", "z"), (None, 1, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.chat_examples(turns)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [x[1:] for x in own]
        assert "".join(back[conv].trained) == "".join(x[2] for x in own if x[1] == "assistant")
    assert chat_format.chat_examples(turns.limit(0)).count() == 0


def test_simhash(docs, rows):
    def brute(b):
        w = b.lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))

    prints = [(i, brute(b)) for i, b in bodies(rows)]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    want = [(i, f"{f:016x}", min((x for (x, _), g in zip(prints, group, strict=True) if g == own and x is not None), default=None)) for (i, f), own in zip(prints, group, strict=True)]
    assert tuples(simhash.simhash_groups(docs)) == collections.Counter(want)


def test_simhash_unique_removes_similar_texts_only(docs, rows):
    """Against Jaccard similarities of all pairs: nothing else goes, and of two similar texts one does."""
    texts = sorted({(-1 if i is None else i, b) for i, b in bodies(rows)})
    sets = [{bytes(h) for h in simhash.shingle_hashes(b, 5)} for _, b in texts]
    same = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if same(sets[a], sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    kept = simhash.simhash_unique(docs)
    assert kept.columns == docs.columns
    got = collections.Counter((-1 if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in kept.collect())
    assert max(got.values()) == 1 and set(got) <= set(texts)
    assert {group[texts.index(t)] for t in got} == set(group) and len(got) == len(set(group))


def test_simhash_unique_finds_edited_copies(spark):
    """Copies with 3 % of their words changed fall to one; unrelated texts stay."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    base = [rng.choices(words, k=300) for _ in range(30)]
    texts = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        edited = list(w)
        for _ in range(3):  # about 15 of 296 shingles differ on either side
            edited[rng.randrange(300)] = "edited"
        texts.append((100 + i, " ".join(edited)))
    kept = {r.doc_id for r in simhash.simhash_unique(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert set(range(30)) <= kept and len(kept) <= 32


@pytest.mark.parametrize("group", [4096, 8])
def test_near_links_join_what_is_near(spark, group):
    """Connected as by comparing all pairs, whether groups are searched whole or cut into blocks by Gray order."""
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    prints = {int(c) for c in centre}
    while len(prints) < 150:
        x = int(rng.choice(centre))
        for bit in rng.integers(0, 64, rng.integers(1, 9)):
            x ^= 1 << int(bit)
        prints.add(x)
    prints = sorted(prints)
    want = {x: x for x in prints}
    for i, x in enumerate(prints):
        for y in prints[:i]:
            if (x ^ y).bit_count() <= 4 and want[x] != want[y]:
                old, new = want[x], want[y]
                want = {k: new if v == old else v for k, v in want.items()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.near_links(spark.createDataFrame([(signed(x),) for x in prints], "fp long"), group=group).collect()
    got = {x: x for x in prints}
    for a, b in links:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        if got[a] != got[b]:
            old, new = got[a], got[b]
            got = {k: new if v == old else v for k, v in got.items()}
    parts = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert parts(got) == parts(want)


@pytest.mark.parametrize("group", [4_096, 64])
def test_near_links_of_a_large_group_are_few(spark, group):
    """A group of near copies gives about a link a copy, each once, not one for each choice of blocks or pair of cuts."""
    rng, prints = np.random.default_rng(7), set()
    while len(prints) < 400:
        x = 0x123456789ABCDEF
        for bit in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(bit)
        prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(signed(x),) for x in prints], "fp long"), 8, 10, group).collect()]
    assert len({frozenset(x) for x in links}) == len(links) <= 2 * len(prints)


def test_mixing(docs, labels):
    domains = labels.select("doc_id", mixing.domain_of_labels().alias("domain"))
    rates = mixing.mixing_rates(docs, domains).collect()
    assert len(rates) == docs.count() and all(r.rate >= 0 for r in rates)
    total = sum(r.rate * r.n_tokens for r in rates)
    assert abs(total - sum(r.n_tokens for r in rates)) < 0.1 * total
    copies = sum(r.copies for r in rates)
    out = mixing.mixed(docs, domains)
    assert out.columns == docs.columns and out.count() == copies


def edits(a, b):
    """Least distance of ``a`` to any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontaminate(spark):
    rng = random.Random(3)
    item = "".join(rng.choices("abcdefgh ", k=120))
    texts = []
    for n in range(12):
        own = list(item)
        for _ in range(n):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], ["z"], ["z", own[at]]])
        texts.append("start " + "".join(own) + " end " + "".join(rng.choices("abcdefgh ", k=50)))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item.upper()), (2, ""), (3, None), (None, item)], "item_id long, text string")
    clean = decontaminate.normal(item)
    want = {i: d for i, t in enumerate(texts) if (d := edits(clean, decontaminate.normal(t))) <= decontaminate.budget(len(clean), decontaminate.ERROR_RATE)}
    got = decontaminate.benchmark_hits(docs, items).collect()
    assert {r.doc_id: r.distance for r in got} == want and {r.item_id for r in got} == {1}
    for r in got:
        assert edits(clean, decontaminate.normal(texts[r.doc_id])[r.start : r.end]) == r.distance
    assert {r.doc_id for r in decontaminate.decontaminated(docs, items).collect()} == set(range(14)) - set(want)


def test_quality_rules(docs, rows, labels):
    want = []
    for i, t in rows:
        t = t or ""
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        again = {x for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for x in range(j, j + 8)}
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    got = quality_rules.quality_verdicts(docs, labels)
    assert tuples(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == collections.Counter(want)
    assert got.where("kept AND base_failed").count() == 0


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    for x, n, p in [(0, 10, 0.1), (3, 500, 0.02), (40, 3000, 0.0125)]:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(x), F.lit(n), p).alias("t")).first().t
        assert got == pytest.approx(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)), rel=1e-9)


def test_byte_cnn_learns():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdef", k=5))
    text = lambda bad: " ".join(word() + ("##" if bad and rng.random() < 0.3 else "") for _ in range(rng.randint(5, 120))).encode()
    train, test = [(text(i % 2), i % 2) for i in range(120)], [(text(i % 2), i % 2) for i in range(60)]
    model = byte_cnn.ByteCnn().fit([t for t, _ in train], np.array([1 - b for _, b in train], np.float32), np.ones(120, np.float32), updates=80)
    scores = model.scores([t for t, _ in test] + [b"", b"a" * 200_000])
    assert np.mean((scores[:60] > 0.5) == np.array([b == 0 for _, b in test])) > 0.95
    assert np.allclose(scores[:60], np.concatenate([model.scores([t]) for t, _ in test]), atol=1e-5)


def test_byte_cnn_gradients():
    """Against differences of the loss, with texts of one and of many blocks."""
    rng = random.Random(3)
    texts = [bytes(rng.choices(range(97, 110), k=n)) for n in (0, 3, 40, 900, 5000)]
    y, w = np.array([0, 1, 1, 0, 1], np.float32), np.array([1, 0.5, 2, 1, 1], np.float32)
    model = byte_cnn.ByteCnn()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        z = model.pooled(texts)["features"] @ model.p["out"] + model.p["shift"]
        return float(np.mean(w * (np.logaddexp(0, z) - y * z)))

    g = model.gradients(texts, y, w)
    for name in model.p:
        flat, own = model.p[name].reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(own))[:3]:
            step, kept = 1e-3, flat[i]
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            slope = (up - loss()) / (2 * step)
            flat[i] = kept
            assert own[i] == pytest.approx(slope, rel=0.05, abs=1e-4), name


def test_byte_cnn_long_texts_block_by_block(monkeypatch):
    texts = [bytes(random.Random(i).choices(range(97, 120), k=n)) for i, n in enumerate((70_000, 1, 3_000))]
    whole = byte_cnn.ByteCnn().scores(texts)
    monkeypatch.setattr(byte_cnn, "CHUNKS", 3)
    assert np.allclose(byte_cnn.ByteCnn().scores(texts), whole, atol=1e-6)


def test_held_out_labels_have_no_part(spark):
    """Neither texts nor frequencies: with all held-out labels turned round, every score is the same."""
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    docs = spark.createDataFrame([(i, f"{'good' if i % 3 else 'bad##'} text {i}") for i in range(120)], "doc_id long, text string")
    label = lambda turn: spark.createDataFrame([(i, int(bool(i % 3)) ^ int(turn and held(i))) for i in range(120)], "doc_id long, quality int")
    one, two = (sorted(tuple(r) for r in byte_cnn.quality_scores(docs, label(turn), remainder(4) == 2).collect()) for turn in (False, True))
    assert one == two
    conflicting = label(False).union(spark.createDataFrame([(0, 0), (0, 1), (1, None)], "doc_id long, quality int"))
    assert byte_cnn.learnable(docs, conflicting, remainder(4) != 2).where("doc_id = 0").count() == 0


def test_quality_scores_without_labels(docs, labels, rows):
    got = byte_cnn.quality_scores(docs, labels.limit(0), remainder(4) == 2)
    assert got.count() == len(rows) and {r.score for r in got.collect()} == {0.5}


def test_token_ids(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    files = token_ids.token_files(docs, path, shard_tokens=700)
    got = sorted(token_ids.read_tokens(files).collect(), key=lambda r: r.start)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    want = collections.Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_encoder_on_odd_text():
    e, rng = token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2), random.Random(2)
    parts = ["a", "é", "ж", "字", "1", "²", " ", "  ", "\n", "\n\n", "\t", " x", ",", ".", "'s", "<|endoftext|>", " ", "́", " the", ".\nX", "\r\n", "\x85", "\x1c"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(5000)]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_encoder_gives_the_library_each_stem_once(monkeypatch):
    e, given = token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2), []
    encoded = e._encoded
    monkeypatch.setattr(e, "_encoded", lambda words, *rest: (given.extend(words), encoded(words, *rest))[1])
    stems, signs = ["tea", "été", "字ж", "Straße"], ["", ".", "!!", "###", "'", "''", "_", "'-", "<|>", ",***"]
    texts = [" ".join(s + x for s in stems) + "\n" + x + " a1" + x + "\ntea" + x for x in signs]
    for _ in range(2):
        for t, ids in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]
    assert sorted(w for w in given if w.startswith(tuple(stems))) == sorted(stems)


def test_portions_are_bounded_by_rows_and_bytes():
    bodies = [b"x" * n for n in (3, 4, 2, 50, 0, 1, 9, 9, 1)]
    batch = pa.RecordBatch.from_pydict({"body": pa.array(bodies, pa.binary())})
    got = [p["body"].to_pylist() for p in token_ids.portions(iter([batch, batch.slice(0, 0)]), 6, 10)]
    assert [b for p in got for b in p] == bodies
    assert all(len(p) <= 6 and sum(map(len, p[1:])) < 10 for p in got)


def test_wavelet_matrix_reads_few_blocks():
    ids = np.random.default_rng(4).integers(0, 50_000, 400_000).astype("<u2")
    m = token_ids.unpacked(token_ids.packed([1], [400_000], ids, 16))[2]
    assert m.access(250_000) == ids[250_000] and all(len(p._open) == 1 for p in m.planes)
    assert m.select(int(ids[399_999]), m.count(int(ids[399_999])) - 1) == 399_999 or ids[399_999] in ids[399_999:]
    assert token_ids.unpacked(token_ids.packed([], [], ids[:0], 16))[2].decoded().tolist() == []


def test_other_tokenizers_get_whole_texts():
    e = token_ids.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    texts = ["one two  three", "", "a,b\n c"]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, e.kind).tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_wavelet_matrix():
    ids = np.random.default_rng(4).integers(0, 300, 2000).astype("<u2")
    m = token_ids.unpacked(token_ids.packed([1, None], [1500, 500], ids, 16))[2]
    assert (m.decoded() == ids).all()
    for i in (0, 7, 8, 1999):
        assert m.access(i) == ids[i]
    for v in (0, 17, 299, 301, 65_536):
        places = np.flatnonzero(ids == v)
        assert m.count(v) == len(places) and m.rank(v, 1001) == (places < 1001).sum()
        assert [m.select(v, k) for k in range(len(places))] == places.tolist()


def test_columns_with_clashing_names_are_handed_on(spark):
    """Removal and mixing give back every column, also those with names that they might use themselves."""
    names = ("id", "ID_", "dk", "_dk", "_id", "node", "copies")
    rows = [(i, f"word{i % 7} and some more words of text {i % 7}", *(f"{n}{i}" for n in ("a", "b", "c", "d", "e", "f", "g"))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(i, "clean" if i % 2 else "low") for i in range(20)], "doc_id long, domain string")
    want = {tuple(r) for r in rows}
    for out in (simhash.simhash_unique(docs), mixing.mixed(docs, labels), byte_cnn.accepted(docs, labels.selectExpr("doc_id", "1 AS quality"), remainder(4) == 2, 0.0)):
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= want
    assert simhash.simhash_unique(docs).count() == 7


def test_mixing_rates_meet_domain_targets(spark):
    """On a table: expected tokens of each domain, summed by hand, against what was asked for."""
    rng = random.Random(6)
    word = {"clean": "aa ab ac ad ae".split(), "low": "ba bb bc bd be".split(), "toxic": "ca cb cc cd ce".split()}
    kind = [rng.choices(list(word), (0.7, 0.2, 0.1))[0] for _ in range(600)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(word[k], k=rng.randint(5, 60)))) for i, k in enumerate(kind)] + [(None, None), (5, "aa ab")], "doc_id long, text string")
    domains = spark.createDataFrame([(i, k) for i, k in enumerate(kind) if i % 2] + [(1, "low"), (1, "toxic"), (700, "clean"), (3, None)], "doc_id long, domain string")
    rows = mixing.mixing_rates(docs, domains).collect()
    tokens = sum(r.n_tokens for r in rows)
    for d, share in mixing.TARGETS.items():
        got = sum(r.rate * r.n_tokens * r[d] for r in rows)
        assert got == pytest.approx(share * tokens, rel=3e-3, abs=2e-3 * tokens if share == 0 else 0)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)


def test_join_with_hot_keys(spark):
    from notelake.llm.common import met

    rows = spark.createDataFrame([(i % 50 if i % 3 else 0, i) for i in range(3000)], "k long, v long")
    keys = rows.groupBy("k").count().selectExpr("k", "count AS n", "'p' AS payload")
    got = met(rows, keys, ["k"], "n", hot=100)
    assert sorted(got.columns) == ["k", "payload", "v"] and sorted(r.v for r in got.collect()) == list(range(3000))


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from notelake.llm.common import shared_dir

    session = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_empty_tables(empty, labels, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    domains = labels.select("doc_id", mixing.domain_of_labels().alias("domain"))
    for df in (
        suffix_dedup.suffix_dedup(empty), substring_dedup.substring_dedup(empty), lm_score.lm_scores(empty, remainder(5) == 1), simhash.simhash_groups(empty), simhash.simhash_unique(empty),
        mixing.mixing_rates(empty, domains), mixing.mixed(empty, domains), decontaminate.benchmark_hits(empty, items), quality_rules.quality_verdicts(empty, labels),
        byte_cnn.quality_scores(empty, labels, remainder(4) == 2), token_ids.read_tokens(token_ids.token_files(empty, public_tokenizers.path("byte_bpe_50k.json"))),
    ):
        assert df.count() == 0


@pytest.mark.parametrize("settings", [{}, {"head": 1}, {"task_tokens": 20_000}])
def test_lm_scores_hold_every_pair(spark, settings):
    """More words than any fixed vocabulary, all equally frequent: each pair counts, however it is kept."""
    texts = [" ".join([" ".join(f"w{d * 100 + i}" for i in range(100))] * 2) for d in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    word, pair = collections.Counter(), collections.Counter()
    for t in texts:
        w = [" ", *t.split(), " "]
        word.update(w[1:])
        pair.update(zip(w, w[1:], strict=False))
    unit = sum(word.values()) + 0.5 * (len(word) + 1)
    mid = lambda n: float(lm_score.level_count(lm_score.levels(np.array([n])))[0])

    def plain(t):
        w = [" ", *t.split(), " "]
        return sum(np.log10((min(mid(pair[a, b]), mid(word[a])) + lm_score.MU * (mid(word[b]) + 0.5) / unit) / (mid(word[a]) + lm_score.MU)) for a, b in zip(w, w[1:], strict=False))

    got = {r.doc_id: r.score for r in lm_score.lm_scores(docs, remainder(5) == 9, **settings).collect()}
    for d in range(0, 700, 70):  # a level too high by a false positive here and there
        assert got[d] == pytest.approx(plain(texts[d]), rel=0.02)


@pytest.mark.parametrize("sharp", [40.0, 4.0])
def test_mixing_meets_targets_of_a_rare_domain(spark, sharp):
    rng = np.random.default_rng(7)
    domain = rng.choice(3, 8000, p=[0.84, 0.15, 0.01])
    odds = rng.normal(0, 1, (8000, 3)) + sharp / 4 * np.eye(3)[domain]
    p = np.exp(odds) / np.exp(odds).sum(1, keepdims=True)
    n = rng.integers(1, 400, 8000)
    members = spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(n, p, strict=True)], "n_tokens long, " + ", ".join(f"{d} double" for d in mixing.DOMAINS))
    targets = dict(zip(mixing.DOMAINS, (0.6, 0.2, 0.2), strict=True))
    got = (mixing.rates_after(p, mixing.fitted_moves(members, targets)) * n) @ p / n.sum()
    assert np.abs(got - list(targets.values())).max() <= 1e-3


def test_mixing_settles_where_targets_are_out_of_reach(spark):
    p = np.array([[0.7, 0.2, 0.1], [0.6, 0.2, 0.2]] * 50)
    members = spark.createDataFrame([(10, *map(float, q)) for q in p], "n_tokens long, " + ", ".join(f"{d} double" for d in mixing.DOMAINS))
    got = (10 * mixing.rates_after(p, mixing.fitted_moves(members, {"clean": 0.97, "low": 0.01, "toxic": 0.02}))) @ p / 1000
    least = max(0.0, p[0] @ [0.97, 0.01, 0.02] / (p[0] @ p[0])) * p[0]  # on the nearest ray
    assert np.abs(got - least).max() < 1e-3


@pytest.mark.parametrize("targets", [(0.5, 0.3, 0.2), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (0.3, 0.69, 0.01)])
def test_mixing_against_a_plain_solver(spark, targets):
    """Domain totals of the fit against nonnegative least squares by coordinate descent, one document at a time."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet((2.0, 0.5, 0.2), 80)
    n = rng.integers(0, 300, 80).astype(float)
    a, wanted, r = p * n[:, None], np.array(targets) * n.sum(), np.ones(80)
    for _ in range(3000):
        for i in np.flatnonzero(n):
            r[i] = max(0.0, r[i] - a[i] @ (r @ a - wanted) / (a[i] @ a[i]))
    members = spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(n, p, strict=True)], "n_tokens long, " + ", ".join(f"{d} double" for d in mixing.DOMAINS))
    rates = mixing.rates_after(p, mixing.fitted_moves(members, dict(zip(mixing.DOMAINS, targets, strict=True))))
    assert rates.min() >= 0
    assert np.abs(rates @ a - r @ a).max() < 3e-3 * n.sum()


def test_rates_of_equal_texts_are_equal_and_clipped_ones_can_return():
    p = np.array([[1.0, 0, 0], [0, 1.0, 0], [1.0, 0, 0]])
    got = mixing.rates_after(p, [np.array([2.0, 0.5, 0]), np.array([-0.25, 0, 0])])
    assert got.tolist() == [0.25, 0.5, 0.25]


def test_byte_cnn_forward_by_hand():
    """Scores against a filter moved over every fourth byte by loops: chunks of positions, maxima, their mean and maximum."""
    rng = random.Random(4)
    model = byte_cnn.ByteCnn()
    model.p["bias"] = np.linspace(-0.3, 0.3, byte_cnn.FILTERS).astype(np.float32)
    bodies = [b"", b"a", b"abcd", bytes(rng.randrange(256) for _ in range(5_000)), "é中".encode() * 700, b"xyz " * byte_cnn.CHUNK, b"q" * (byte_cnn.CHUNK * byte_cnn.STEP + 1)]
    p = {k: v.astype(float) for k, v in model.p.items()}
    for body, got in zip(bodies, model.scores(bodies), strict=True):
        data = body + b"\0" * (byte_cnn.STEP + -len(body) % byte_cnn.STEP) if body else b"\0" * 2 * byte_cnn.STEP
        starts, kernel = range(0, len(data) - byte_cnn.STEP, byte_cnn.STEP), np.concatenate((p["near"], p["far"]))
        response = [np.concatenate([p["embed"][c] for c in data[i : i + 2 * byte_cnn.STEP]]) @ kernel + p["bias"] for i in starts]
        tops = np.array([np.maximum(np.max(response[i : i + byte_cnn.CHUNK], axis=0), 0) for i in range(0, len(response), byte_cnn.CHUNK)])
        z = np.concatenate((tops.mean(0), tops.max(0))) @ p["out"] + p["shift"][0]
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_byte_cnn_learns_beside_a_text_over_the_bound(spark):
    """A labelled text that alone is longer than the sample may be is passed over, and so do not all scores become one."""
    texts = [(i, ("good words here " if i % 2 else "zzz qqq ") * (i % 7 + 3)) for i in range(80)] + [(500 + i, ("zzz qqq " if i else "good words here ") * 400) for i in (0, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(500, 1), (501, 0)], "doc_id long, quality int")
    model = byte_cnn.trained(docs, labels, F.lit(True), most_bytes=2_000)
    scores = model.scores([b"good words here " * 5, b"zzz qqq " * 5])
    assert scores[0] > 0.8 and scores[1] < 0.2


def test_quality_rules_by_hand(spark):
    """Cutoffs on the 1,000 given documents, chosen again in plain Python from the measures."""
    from math import comb, log, log1p

    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.measured(docs).withColumn("testing", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 1).collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    held = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert all(sum(r.testing for r in held if r.stratum == s) * log1p(-0.03) > log(0.05 / 2) for s in {r.stratum for r in held})  # all strata are thin: one is shared
    first, second = [r for r in held if not r.testing], [r for r in held if r.testing]
    bad = lambda r, rule, c: r[rule.removeprefix("min_")] < c if rule.startswith("min_") else r[rule] > c
    chosen = {}
    for share, looser in quality_rules.STEPS:
        choice = {}
        for rule, cuts in quality_rules.RULES.items():
            at = next((i for i, c in enumerate(cuts) if sum(bad(r, rule, c) for r in first) <= share * len(first)), None)
            if at is not None:
                choice[rule] = cuts[min(at + looser, len(cuts) - 1)]
        x, n = sum(any(bad(r, rule, c) for rule, c in choice.items()) for r in second), len(second)
        if not x < 0.03 * n or sum(comb(n, k) * 0.03**k * 0.97 ** (n - k) for k in range(x + 1)) > 0.05:
            break
        chosen = choice
    assert chosen  # the rules decide here
    want = {r.doc_id: not r.base_failed and not any(bad(r, rule, c) for rule, c in chosen.items()) for r in rows}
    assert {r.doc_id: r.kept for r in quality_rules.quality_verdicts(docs, labels).collect()} == want


def test_quality_rules_decide(spark):
    """With 1,600 good rows in one language, and as many in two thin ones together, rules are on everywhere."""
    clean = lambda i: " ".join(f"{chr(97 + j)}{i:04d}" for j in range(25))
    bad = " ".join(f"#{chr(97 + j)}##$" for j in range(25))
    rows = [(i, clean(i), "en" if i < 1600 else "fr" if i < 2500 else "de") for i in range(3200)]
    rows += [(9001, bad, "en"), (9002, bad, "fr"), (9003, bad, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(docs, labels).collect()}
    assert all(got[i].kept for i in range(3200))
    assert all("symbol_ratio" in got[i].failed and not got[i].kept for i in (9001, 9002, 9003))


def test_added_tokens_as_the_library_gives_them():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), token_ids.Encoder(path, 2)
    texts = ["one two", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n y", "one two"]
    assert 50256 in t.encode(texts[1], add_special_tokens=False).ids
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, e.kind).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]
