"""Operator 10: token ids in wavelet matrices, one compressed file per shard.

Documents are dealt by ranges of doc_id and sorted within a range, so shards follow each other in doc_id order. A task
encodes its documents one after another and closes a shard at SHARD_TOKENS ids. A shard is one self-contained file:
header, doc_ids, lengths, and 16 or so bit planes of a wavelet matrix, each with a directory of its ones by blocks,
and each block compressed by itself. From it alone come any token (access), the number of times an id occurs before a
place (rank, count) and the place of an occurrence (select), in one step and one or two unpacked blocks a plane.

Files are kept as rows (shard number and content) of a table in the shared folder: Spark's commit protocol then makes
a shard appear once, however often a task is repeated, on any file system that Spark can write.
"""

from __future__ import annotations

import json
import string
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import keyed, slices, stored

SHARD_TOKENS = 1 << 20
END = 2
MAGIC = b"NLWM0002"
#: Bits of a plane that are compressed, and counted in the directory, together.
BLOCK_BITS = 1 << 16
#: Entries at which a worker's cache of encoded strings forgets those it has not met again; at most twice as many are
#: held, of words and of other strings each (about 250 bytes an entry).
CACHE = 250_000
#: Texts, and about so many bytes of them, that are cut and encoded in one call.
ROWS, SIZE = 1024, 8 << 20

_FILES = "part int, seq int, before long, n_tokens long, content binary"
_DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Plane:
    """Bits in blocks of BLOCK_BITS, with the ones before each block: the directory that rank and select start from. A
    block is unpacked when it is asked for."""

    def __init__(self, before: np.ndarray, block: Callable[[int], bytes]):
        self.before, self.ones = before, int(before[-1])
        self._block, self._open = block, {}

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        data = np.packbits(bits, bitorder="little").tobytes()
        each = BLOCK_BITS // 8
        blocks = [data[i : i + each] for i in range(0, len(data), each)]
        return cls(np.cumsum([0, *(int(np.bitwise_count(np.frombuffer(x, np.uint8)).sum(dtype=np.int64)) for x in blocks)]), blocks.__getitem__)

    def block(self, i: int) -> np.ndarray:
        if i not in self._open:
            self._open[i] = np.frombuffer(self._block(i), np.uint8)
        return self._open[i]

    def bit(self, i: int) -> int:
        return int(self.block(i // BLOCK_BITS)[i % BLOCK_BITS >> 3]) >> (i & 7) & 1

    def rank(self, i: int) -> int:
        """Ones among the first i bits."""
        at, rest = divmod(i, BLOCK_BITS)
        ones = int(self.before[at])
        if rest:
            own = self.block(at)
            ones += int(np.bitwise_count(own[: rest >> 3]).sum(dtype=np.int64))
            ones += (int(own[rest >> 3]) & ((1 << (rest & 7)) - 1)).bit_count() if rest & 7 else 0
        return ones

    def select(self, k: int, one: int, n: int) -> int:
        """Place of bit ``one`` number k (from 0) among n bits."""
        ends = np.minimum(np.arange(len(self.before)) * BLOCK_BITS, n)
        count = self.before if one else ends - self.before
        at = int(np.searchsorted(count, k, "right")) - 1
        bits = np.unpackbits(self.block(at), bitorder="little")[: int(ends[at + 1] - ends[at])]
        return int(ends[at]) + int(np.flatnonzero(bits == one)[k - int(count[at])])

    def whole(self) -> np.ndarray:
        return np.frombuffer(b"".join(self._block(i) for i in range(len(self.before) - 1)), np.uint8)


class WaveletMatrix:
    """Succinct sequence of unsigned integers below 2 ** len(planes)."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes  # the highest bit first
        self.zeros = [n - p.ones for p in planes]

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, now = [], ids
        for b in range(bits - 1, -1, -1):
            one = (now & (1 << b)).astype(bool)
            planes.append(Plane.of(one))
            now = np.concatenate((now.compress(~one), now.compress(one)))  # much faster than now[one]
        return cls(len(ids), planes)

    def access(self, i: int) -> int:
        value = 0
        for level, plane in enumerate(self.planes):
            one, ones = plane.bit(i), plane.rank(i)
            value = value << 1 | one
            i = self.zeros[level] + ones if one else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        a, b = 0, end
        if value >> len(self.planes):
            return 0, 0
        for level, plane in enumerate(self.planes):
            p, q = plane.rank(a), plane.rank(b)
            a, b = (self.zeros[level] + p, self.zeros[level] + q) if value >> (len(self.planes) - 1 - level) & 1 else (a - p, b - q)
        return a, b

    def rank(self, value: int, end: int) -> int:
        """Occurrences of ``value`` before place ``end``."""
        a, b = self._range(value, end)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Place of occurrence k (from 0) of ``value``."""
        a, b = self._range(value, self.n)
        if not 0 <= k < b - a:
            raise IndexError("no such occurrence")
        i = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - level) & 1
            i = self.planes[level].select(i - self.zeros[level] if one else i, one, self.n)
        return i

    def decoded(self) -> np.ndarray:
        """All values in order, from the lowest plane upwards."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for b, level in enumerate(range(len(self.planes) - 1, -1, -1)):
            one = np.unpackbits(self.planes[level].whole(), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~one)] = values[: self.zeros[level]]
            above[np.flatnonzero(one)] = values[self.zeros[level] :] | kind(1 << b)
            values = above
        return values


def packed(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """A shard's file: magic, numbers of documents, ids and planes; compressed doc_ids and lengths; for each plane its
    directory (ones before each block, size of each block) and its blocks, each compressed by itself."""
    press = zstandard.ZstdCompressor(level=1).compress
    there = np.array([d is not None for d in doc_ids], bool)
    head = [press(x) for x in (np.packbits(there, bitorder="little").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<i8").tobytes())]
    out = [MAGIC, struct.pack("<QQI3Q", len(doc_ids), len(ids), bits, *map(len, head)), *head]
    for plane in WaveletMatrix.of(ids, bits).planes:
        blocks = [press(plane.block(i).tobytes()) for i in range(len(plane.before) - 1)]
        out += [plane.before.astype("<u8").tobytes(), np.array([len(x) for x in blocks], "<u4").tobytes(), *blocks]
    return b"".join(out)


def _stored_plane(content: bytes, before: np.ndarray, places: np.ndarray) -> Plane:
    free = zstandard.ZstdDecompressor().decompress
    return Plane(before, lambda i: free(content[places[i] : places[i + 1]]))


def unpacked(content: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, lengths and ids of a shard's file; of the ids no more is unpacked than is asked for."""
    if content[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, n, bits, *sizes = struct.unpack_from("<QQI3Q", content, 8)
    at, head, free = 8 + struct.calcsize("<QQI3Q"), [], zstandard.ZstdDecompressor().decompress
    for s in sizes:
        head.append(free(content[at : at + s]))
        at += s
    there = np.unpackbits(np.frombuffer(head[0], np.uint8), count=docs, bitorder="little")
    doc_ids = [d if ok else None for d, ok in zip(np.frombuffer(head[1], "<i8").tolist(), there.tolist(), strict=True)]
    planes, blocks = [], -(-n // BLOCK_BITS)
    for _ in range(bits):
        before = np.frombuffer(content, "<u8", blocks + 1, at).astype(np.int64)
        own = np.frombuffer(content, "<u4", blocks, at + 8 * (blocks + 1))
        places = at + 8 * (blocks + 1) + 4 * blocks + np.concatenate(([0], np.cumsum(own, dtype=np.int64)))
        planes.append(_stored_plane(content, before, places))
        at = int(places[-1])
    return doc_ids, np.frombuffer(head[2], "<i8"), WaveletMatrix(n, planes)


#: A text with one of these is cut more carefully: doubled white space, and any but the space and the line break.
_ODD = ("  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))


def byte_letters() -> dict[int, str]:
    """The character by which a byte-level vocabulary spells each byte: itself where it can be printed in Latin-1, the
    others those from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Cache:
    """Ids of strings. Past ``size`` entries those not asked for since the last time this happened are forgotten."""

    def __init__(self, size: int):
        self.size, self.ids, self.old = size, {}, {}

    def missing(self, words: list[str]) -> list[str]:
        """Those of ``words`` (each once) whose ids are not here; the others are, until the next ``turn``."""
        ids, old, new = self.ids, self.old, []
        for w in words:
            if w not in ids:
                if (again := old.get(w)) is None:
                    new.append(w)
                else:
                    ids[w] = again
        return new

    def turn(self) -> None:
        if len(self.ids) > self.size:
            self.ids, self.old = {}, self.ids


class Encoder:
    """The tokenizer, behind a cache of words. A byte-level pre-tokenizer always splits before a space that is followed
    by something else, and round a lone line break; so texts are cut there into units, a word with the space or the line
    break before it, and each unit is encoded once. Arrow cuts many texts in one call and finds the distinct units; ids
    are then copied by place. Texts with other white space are cut at plain spaces only, and texts that hold an added
    token not at all. Other kinds of tokenizers get whole texts."""

    def __init__(self, path: str, end: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bits = max(1, (max(self.tokenizer.get_vocab_size(), end + 1) - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.end = np.array([end], self.kind).tobytes()
        self.known = Cache(CACHE)  # of units: a word stands for itself with a space before it
        self.exact = Cache(CACHE)  # of other strings
        parts = json.loads(self.tokenizer.to_str())
        pre = parts.get("pre_tokenizer") or {}
        plain = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)
        self.line = self._ids("\n")
        self.by_words = plain and parts["model"]["type"] == "BPE" and not parts.get("normalizer") and not parts["model"].get("dropout") and len(self.line) == 1
        self.model, self.letters = self.tokenizer.model, byte_letters()

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Any text, cut where one space stands between characters that are not white space."""
        parts = text.split(" ")
        out = parts[:1]
        for before, p in zip(parts, parts[1:]):  # noqa: B905
            if p and before and not p[0].isspace() and not before[-1].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _one(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _encoded(self, words: list[str], into: dict[str, bytes], before: str = "") -> None:
        """Words without white space, many in one text; the line breaks between them come back as ids of their own."""
        size, tokens, code = self.kind.itemsize, self.model.tokenize, self.kind.char
        space = before.encode().decode("latin-1").translate(self.letters)
        for w in words:  # letters alone are one piece, which the model can be given as it is
            if w.isalpha():
                into[w] = array(code, [t.id for t in tokens(space + (w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)))]).tobytes()
        words = [w for w in words if not w.isalpha()]
        for at in range(0, len(words), 1_000):
            some = words[at : at + 1_000]
            ids = np.array(self.tokenizer.encode_batch_fast([before + ("\n" + before).join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.append(np.flatnonzero(ids == self.line[0]), len(ids)) * size
            if len(ends) != len(some):
                into.update((w, self._one(before + w)) for w in some)
                continue
            ids, ends = ids.tobytes(), ends.tolist()
            into.update((w, ids[a:b]) for w, a, b in zip(some, [0, *(e + size for e in ends)], ends, strict=False))

    def _learn(self, units: list[str]) -> None:
        """Ids of units, each given once: a word with a space before it, or a line break and what follows it."""
        known, line = self.known, self.line.tobytes()
        new, ended, stems, signs = [], [], [], []
        for u in known.missing(units):  # letters, and signs after them, are two pieces
            stem = u.rstrip(string.punctuation)
            if len(stem) < len(u) and stem.removeprefix("\n").isalpha():
                ended.append(u)
                stems.append(stem)
                signs.append(u[len(stem) :])
            else:
                new.append(u)
        new += known.missing(list(set(stems).difference(new)))
        lined: dict[str, bytes] = {"": b""}
        self._encoded([u for u in new if u[0] != "\n"], known.ids, " ")
        self._encoded([u[1:] for u in new if u[0] == "\n" and len(u) > 1], lined)
        for u in new:
            if u[0] == "\n":
                known.ids[u] = line + lined[u[1:]]
        self._learn_exact(list(set(signs)))
        for u, stem, own in zip(ended, stems, signs, strict=True):
            known.ids[u] = known.ids[stem] + self.exact.ids[own]

    def _learn_exact(self, strings: list[str]) -> None:
        for w in self.exact.missing(strings):
            self.exact.ids[w] = self._one(w)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not self.by_words or any(map(t.__contains__, self.added)):
                out[i] = self._one(t) + self.end
            elif any(map(t.__contains__, _ODD)) or t[:1].isspace() or t[-1:].isspace():
                own = self.pieces(t)
                self._learn_exact(own)
                out[i] = b"".join(map(self.exact.ids.__getitem__, own)) + self.end
            else:
                plain.append(i)
        for i, ids in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
            out[i] = ids
        self.known.turn()
        self.exact.turn()
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose white space is lone spaces and line breaks between words. Each text gets a line break
        before it, so that its first word has no space; the end id of the text before takes that line break's place."""
        if not texts:
            return []
        lines = pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string())
        cut = pc.split_pattern(lines, " ")
        coded = cut.flatten().dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.ids.get, units))
        new = [i for i, ids in enumerate(found) if ids is None]
        self._learn([units[i] for i in new])
        for i in new:
            found[i] = self.known.ids[units[i]]
        flat = np.frombuffer(b"".join(found), self.kind)
        length = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        unit = coded.indices.to_numpy()
        n = length[unit]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(length) - length)[unit] - (ends - n), n) + np.arange(ends[-1])]
        stops = ends[np.cumsum(cut.value_lengths().to_numpy()) - 1]
        ids[stops[:-1]] = np.frombuffer(self.end, self.kind)
        data, places = ids[1:].tobytes() + self.end, (stops * self.kind.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *places[:-1]], places, strict=True)]


@lru_cache(maxsize=1)
def _encoder(path: str, end: int) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
    return Encoder(path, end)


def portions(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = SIZE) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: those of a portion after its first take less than ``size`` bytes together."""
    for batch in slices(batches, rows):
        ends = np.cumsum(pc.binary_length(batch["body"]).to_numpy(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            yield batch.slice(a, b - a)


def _written(path: str, end: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path, end), TaskContext.get().partitionId()
        width = encoder.kind.itemsize
        doc_ids, lengths, own, held, before, seq = [], [], [], 0, 0, 0

        def file() -> pa.RecordBatch:
            content = packed(doc_ids, lengths, np.frombuffer(b"".join(own), encoder.kind), encoder.bits)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, seq, before, held, content), kinds, strict=True)], names=["part", "seq", "before", "n_tokens", "content"])

        for batch in portions(batches):
            encoded = encoder.encode([b.decode("utf-8", "replace") for b in batch["body"].to_pylist()])
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoded, strict=True):
                doc_ids.append(doc_id)
                lengths.append(len(ids) // width)
                own.append(ids)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield file()
                    before, seq = before + held, seq + 1
                    doc_ids, lengths, own, held = [], [], [], 0
        if held:
            yield file()

    return run


def token_files(docs: DataFrame, path: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The stored files of all of ``docs``: part and seq (their order), before (ids of the part before the file),
    n_tokens, content. A null text is empty and has its end id alone; null doc_ids come first; rows with one doc_id
    are ordered by a hash of their text. Columns other than doc_id and text are not read."""
    ordered = keyed(docs).repartitionByRange("doc_id", "dk").sortWithinPartitions("doc_id", "dk")
    return stored(ordered.mapInArrow(_written(path, end, shard_tokens), _FILES), "tokens")


def _read(starts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, content in zip(*(batch[c].to_pylist() for c in ("part", "before", "content")), strict=True):
                doc_ids, lengths, matrix = unpacked(content)
                ids = matrix.decoded().astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ends - lengths + starts[part] + before), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens (with the end id) and
    ids_crc32 (of its ids as little-endian 32-bit integers). The driver sees one number a partition."""
    sizes = sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect())
    starts, at = {}, 0
    for part, n in sizes:
        starts[part] = at
        at += n
    return files.select("part", "before", "content").mapInArrow(_read(starts), _DECODED)
