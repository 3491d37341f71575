"""Operator 6: mixing to target weights with soft membership.

Domains come from a labelled table (label a document 'toxic', 'low' or 'clean'). A naive Bayes classifier, its word
counts kept in BUCKETS hash buckets, predicts every document's domain probabilities; its log odds are divided by the
square root of the text's length, as words of a text are far from independent. It learns from about SAMPLE labelled
rows (all, if there are fewer; chosen by a hash of doc_id), whose ids are broadcast, so no text is shuffled.

Then document rates r >= 0 are fitted by distributed projected gradient least squares: with a_i = tokens_i * p_i
(expected tokens of each domain) the residual is off = sum_i r_i a_i - targets * budget, and a step takes r_i to
max(0, r_i - p_i . move), for all documents at once. The move is the gradient off itself, or the gradient
preconditioned by the inverse of the Gram matrix of the documents whose rate is not 0, which is what makes a rare
domain converge; of both and several lengths the one with the least residual is taken. The gradient is scaled by a
document's tokens, so its rate depends on what a text is, not how long it is.

Rates start at 1 and are a function of the moves so far, so they are never stored: a task replays the moves for its
own rows. In one pass each partition adds up, for each way to go on, its domain totals and Gram matrix, and only these
few numbers reach the driver. The fit ends when every domain is close to its target, or when nothing gets closer:
then the targets are out of reach, the least squares are kept and a warning names what is missing. A fit that does
neither in STEPS passes fails.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, stored, utf8

BUCKETS = 1 << 18
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.97, "low": 0.01, "toxic": 0.02}
#: Labelled rows that the classifier learns from, about.
SAMPLE = 100_000
#: Passes after which a fit that has not settled fails.
STEPS = 200
#: Residual of a domain, as a share of what it shall have (at least of LEAST of the budget), that ends the fit.
CLOSE = 2e-3
LEAST = 1e-3
#: Share of the residual by which a pass must get closer, or nothing does.
SETTLED = 1e-4
#: Lengths that one pass tries: of the preconditioned gradient, and of the gradient over its Lipschitz constant.
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)
PLAIN = (1.0, 10.0, 100.0)
RATE = "rate"


def domain_of_labels() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def _buckets(words: list[bytes], known: dict[bytes, int], buckets: int) -> np.ndarray:
    if len(known) > 200_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w) % buckets
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, known = np.zeros((len(DOMAINS), buckets), np.int64), np.zeros(len(DOMAINS), np.int64), {}
        for batch in slices(batches):
            for domain, body in zip(batch["domain"].to_pylist(), batch["body"].to_pylist(), strict=True):
                d = DOMAINS.index(domain)
                rows[d] += 1
                np.add.at(total[d], _buckets(body.lower().split(), known, buckets), 1)
        for d in np.flatnonzero(rows).tolist():
            at = np.flatnonzero(total[d])
            n = np.append(total[d][at], rows[d])  # bucket -1: rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), d, np.int32)), pa.array(np.append(at, -1)), pa.array(n)], names=["d", "bucket", "n"])

    return run


def classifier(docs: DataFrame, domains: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(log priors, log probabilities of each bucket in each domain) from labelled rows. ``domains``: doc_id, domain.
    Counts add up by bucket before they leave a task; the driver gets at most domains * buckets of them."""
    agreed = domains.where(F.col("domain").isin(*DOMAINS)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"), F.max("domain").alias("other"))
    agreed = agreed.where("domain = other").drop("other")
    share = sample / max(sample, agreed.count())
    some = agreed.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) < int(share * (1 << 40)))
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body")).join(F.broadcast(some), "doc_id").select("domain", "body")
    table = labelled.mapInArrow(_counted(buckets), "d int, bucket long, n long").groupBy("d", "bucket").agg(F.sum("n").alias("n")).toArrow()
    count, rows = np.zeros((len(DOMAINS), buckets)), np.zeros(len(DOMAINS))
    d, bucket, n = (table[c].to_numpy() for c in ("d", "bucket", "n"))
    count[d[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    rows[d[bucket < 0]] = n[bucket < 0]
    word = np.log(count + 0.5) - np.log(count.sum(1, keepdims=True) + 0.5 * buckets)
    return np.log((rows + 0.5) / (rows.sum() + 0.5 * len(DOMAINS))), (word - word.mean(0)).astype(np.float32)


def _posterior(model):
    prior, word = model.value
    word = np.ascontiguousarray(word.T)
    names = ["doc_id", "dk", "n_tokens", *DOMAINS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches):
            sizes, odds = [], []
            for body in batch["body"]:
                words = body.as_py().lower().split()
                sizes.append(len(words))
                odds.append(prior + (word[_buckets(words, known, len(word))].sum(0, dtype=np.float64) / np.sqrt(len(words)) if words else 0))
            z = np.array(odds).reshape(len(sizes), len(DOMAINS))
            p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
            p = p / p.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["dk"], pa.array(np.array(sizes, np.int64)), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(len(DOMAINS)))], names=names)

    return run


def memberships(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row of ``docs``: doc_id, dk (hash of the text), n_tokens (words) and a probability for each domain."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("dk"), utf8().alias("body"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda batches: _posterior(sent)(batches), "doc_id long, dk long, n_tokens long, " + ", ".join(f"{d} double" for d in DOMAINS))


def rates_after(p: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with domain probabilities ``p``."""
    r = np.ones(len(p))
    for move in moves:
        r = np.maximum(0.0, r - p @ move)
    return r


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch[d].to_numpy() for d in DOMAINS], 1) if batch.num_rows else np.zeros((0, len(DOMAINS)))


def _totals(moves: list[np.ndarray], ways: list[np.ndarray]):
    """For each of ``ways`` to go on: all tokens, each domain's tokens, Gram matrix of rows whose rate is not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(DOMAINS)
        total = np.zeros((len(ways), 1 + k + k * k))
        for batch in batches:
            p, n = _matrix(batch), batch["n_tokens"].to_numpy()
            weighted, so_far = p * n[:, None], rates_after(p, moves)
            for i, way in enumerate(ways):
                r = np.maximum(0.0, so_far - p @ way)
                total[i, 0] += n.sum()
                total[i, 1 : k + 1] += r @ weighted
                total[i, k + 1 :] += (weighted[r > 0].T @ p[r > 0]).ravel()
        at, place = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(place.ravel()), pa.array(total.ravel())], names=["i", "place", "x"])

    return run


def fitted_moves(members: DataFrame, targets: dict[str, float], budget: float | None = None, passes: int = STEPS, close: float = CLOSE) -> list[np.ndarray]:
    """The moves that ``rates_after`` turns into rates."""
    k = len(DOMAINS)
    moves: list[np.ndarray] = []

    def tried(ways: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(ways), 1 + k + k * k))
        sums = members.mapInArrow(_totals(moves, ways), "i long, place long, x double").groupBy("i", "place").agg(F.sum("x").alias("x"))
        for i, place, x in sums.collect():
            out[i, place] = x
        return out

    now = tried([np.zeros(k)])[0]
    tokens = now[0]
    if tokens == 0:
        return moves
    wanted = np.array([targets[d] for d in DOMAINS]) / sum(targets.values()) * (tokens if budget is None else budget)
    whole, steepest = max(wanted.sum(), 1e-9), np.linalg.eigvalsh(now[k + 1 :].reshape(k, k))[-1]  # of all rows
    for _ in range(passes):
        off = now[1 : k + 1] - wanted
        if (np.abs(off) <= close * np.maximum(wanted, LEAST * whole)).all():
            return moves
        along = np.linalg.solve(now[k + 1 :].reshape(k, k) + 1e-9 * tokens * np.eye(k), off)
        ways = [x * along for x in LENGTHS] + [x / steepest * off for x in PLAIN]
        found = tried(ways)
        left = np.linalg.norm(found[:, 1 : k + 1] - wanted, axis=1)
        best = int(np.argmin(left))
        if left[best] >= (1 - SETTLED) * np.linalg.norm(off):
            logging.getLogger(__name__).warning("mixing targets are out of reach; shares of the budget too many: %s", dict(zip(DOMAINS, (off / whole).round(4).tolist(), strict=True)))
            return moves
        moves, now = [*moves, ways[best]], found[best]
    raise RuntimeError(f"mixing rates did not settle in {passes} passes; residual {(off / whole).tolist()} of the budget")


def _rated(moves: list[np.ndarray], seed: int):
    names = ["doc_id", "dk", "n_tokens", *DOMAINS, RATE, "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = rates_after(_matrix(batch), moves)
            part = [xxhash.xxh3_64_intdigest(f"{a} {b}", seed) / 2**64 for a, b in zip(batch["doc_id"].to_pylist(), batch["dk"].to_pylist(), strict=True)]
            copies = (np.floor(r) + (np.array(part) < r - np.floor(r))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:-2]), pa.array(r), pa.array(copies)], names=names)

    return run


def mixing_rates(docs: DataFrame, domains: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, seed: int = 1) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, a probability for each domain, rate, and copies (rate rounded up or down
    by a hash of the row, so that copies are as many as rates on average).

    ``domains``: doc_id, domain; other domains, and ids with two, teach nothing; without any every document has the
    same probabilities and rate. A null or blank text has the prior probabilities and no tokens. ``budget`` (tokens;
    default: as many as there are) times a target weight is what a domain shall have. Repeated rows get one rate each.
    """
    return _with_rates(docs, domains, targets, budget, seed).drop("dk")


def _with_rates(docs: DataFrame, domains: DataFrame, targets: dict[str, float], budget: float | None, seed: int) -> DataFrame:
    members = stored(memberships(docs, classifier(docs, domains)), "memberships")
    moves = fitted_moves(members, targets, budget)
    schema = "doc_id long, dk long, n_tokens long, " + ", ".join(f"{d} double" for d in DOMAINS) + ", rate double, copies int"
    return members.mapInArrow(_rated(moves, seed), schema)


def mixed(docs: DataFrame, domains: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, seed: int = 1) -> DataFrame:
    """``docs``, all columns, each row as often as its copies say. A row's decision is made again from its own text in
    one pass, so texts are not shuffled. Null and empty texts, repeated rows and odd labels: as in ``mixing_rates``; an
    empty table stays empty; other columns, whatever their names, are handed on unread."""
    model = classifier(docs, domains)
    members = stored(memberships(docs, model), "memberships")
    moves = fitted_moves(members, targets, budget)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names, dk = docs.columns, fresh("dk", docs)
    keyed = docs.withColumn(dk, F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _posterior(sent)
        for batch in slices(batches):
            bodies = pa.array([(t or "").encode() for t in batch["text"].to_pylist()], pa.binary())
            slim = pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch[dk], bodies], names=["doc_id", "dk", "body"])
            copies = next(_rated(moves, seed)(score(iter([slim]))))["copies"].to_numpy()
            yield batch.select(names).take(pa.array(np.repeat(np.arange(batch.num_rows), copies)))

    return keyed.mapInArrow(run, docs.schema)
