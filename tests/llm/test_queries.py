"""Registered queries on the smallest tables, against plain loops over the whole of them."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from notelake.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bodies(spark):
    return sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())


def result(spark, name, *columns):
    return sorted(tuple(r) for r in queries.queries()[name](spark, DATA).select(*columns).collect())


def test_op1(spark, bodies):
    at = collections.Counter(hashlib.blake2b(b[i : i + 400], digest_size=16).digest() for _, b in bodies for i in range(len(b) - 399))
    want = []
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, np.int64)
        for j in range(len(b) - 399):
            if at[hashlib.blake2b(b[j : j + 400], digest_size=16).digest()] > 1:
                gone[j] += 1
                gone[j + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((i, len(b), int(gone.sum()), len(re.findall(b"\1+", gone.tobytes())), hashlib.sha256(kept).hexdigest()))
    assert result(spark, "op1_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op2_base(spark, bodies):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in bodies}
    count = collections.Counter(w for i, b in bodies if not held[i] for w in [*b.lower().split(), b" "])
    n, v = sum(count.values()), len(count)
    got = result(spark, "op2_lm_score", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    for row, (i, b) in zip(got, bodies, strict=True):
        own = [*b.lower().split(), b" "]
        assert row[:5] == (i, held[i], len(own), sum(count[w] > 0 for w in own), n)
        assert row[5] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))


def test_op3(spark, bodies):
    seen, want = set(), []
    for i, b in bodies:
        w, gone = b.split(), set()
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            gone.update(range(j, j + 20)) if key in seen else seen.add(key)
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    assert result(spark, "op3_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_op5(spark, bodies):
    prints = []
    for i, b in bodies:
        w = b.lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 4]), 42) for j in range(max(1, len(w) - 3))] if w else []
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0) * 2 > len(h)
        prints.append((i, int(np.packbits(bits, bitorder="little").view("<u8")[0]) if h else 0))
    group = dict(prints) and {i: i for i, _ in prints}
    for k, (i, x) in enumerate(prints):
        for j, y in prints[:k]:
            if (x ^ y).bit_count() <= 4 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {a: new if g == old else g for a, g in group.items()}
    assert result(spark, "op5_simhash", "doc_id", "fingerprint", "component_id") == [(i, f"{x:016x}", group[i]) for i, x in prints]


def test_op10(spark, bodies):
    t, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, b in bodies:
        ids = [*t.encode(b.decode(), add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert result(spark, "op10_token_ids", "doc_id", "start", "n_tokens", "ids_crc32") == want
