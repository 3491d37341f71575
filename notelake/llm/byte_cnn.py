"""Operator 9: a byte-level convolutional quality classifier in numpy.

A text's UTF-8 bytes are embedded, and FILTERS learned filters of 8 bytes are slid over all of it with step 4. The
responses are max-pooled within chunks of CHUNK positions; neighbouring chunks overlap by the 4 bytes that a filter
reaches beyond its step, so no stretch is cut. Mean and maximum of the chunks' pooled responses, over the whole
document, are combined into one probability.

Training runs on the driver, on the whole texts of at most SAMPLE_ROWS labelled rows of each label, SAMPLE_BYTES bytes
of each at most in all (rows in the order of a hash of doc_id, so whether a row is taken does not depend on its own
length); everything is scored, in full, by the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, utf8

SAMPLE_ROWS = 1_500
SAMPLE_BYTES = 64_000_000
FILTERS = 32
EMBED = 8
STEP = 4
CHUNK = 128
#: Batches of BATCH rows seen in training, whatever the sample's size.
UPDATES = 700
RATE = 0.01
BATCH = 32
#: Bytes scored at once, and chunks convolved at once: a text may be longer than memory holds responses for.
BLOCK = 1 << 18
CHUNKS = 512


def _padded(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by 4 to 7 zero bytes so that its length is a multiple of STEP; lengths in steps."""
    parts = [b + b"\0" * (STEP + -len(b) % STEP) if len(b) else b"\0" * 2 * STEP for b in bodies]
    return np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) // STEP for p in parts])


def _layout(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps that no filter starts at, first step of each chunk, and first chunk of each text."""
    end = np.cumsum(steps)  # the last step of a text is only reached by the filter before it
    chunks = -(-(steps - 1) // CHUNK)
    text_chunk = np.cumsum(chunks) - chunks
    within = np.arange(chunks.sum()) - np.repeat(text_chunk, chunks)
    return end[:-1] - 1, np.repeat(end - steps, chunks) + within * CHUNK, text_chunk


class ByteCnn:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": normal(256, EMBED, scale=0.5),
            "near": normal(STEP * EMBED, FILTERS, scale=0.2),
            "far": normal(STEP * EMBED, FILTERS, scale=0.2),
            "bias": np.zeros(FILTERS, np.float32),
            "out": normal(2 * FILTERS, scale=0.1),
            "shift": np.zeros(1, np.float32),
        }

    def pooled(self, bodies: list[bytes], peaks: bool = False) -> dict:
        """Features of each text, and what they come from; ``peaks``: also where in each chunk each filter peaked."""
        p, (data, steps) = self.p, _padded(bodies)
        no_start, chunk, text = _layout(steps)
        ends = np.append(chunk, steps.sum() - 1)[1:]
        top, peak = np.empty((len(chunk), FILTERS), np.float32), []
        for a in range(0, len(chunk), CHUNKS):
            first, last = chunk[a], ends[min(a + CHUNKS, len(chunk)) - 1]
            x = p["embed"][data[first * STEP : (last + 1) * STEP]].reshape(-1, STEP * EMBED)
            response = x[:-1] @ p["near"]
            response += x[1:] @ p["far"]
            response += p["bias"]
            response[no_start[(no_start >= first) & (no_start < last)] - first] = -np.inf
            own = chunk[a : a + CHUNKS] - first
            top[a : a + CHUNKS] = np.maximum(np.maximum.reduceat(response, own), 0)
            if peaks:
                peak += [s + first + response[s:e].argmax(0) for s, e in zip(own, np.append(own[1:], len(response)), strict=True)]
        count = np.diff(np.append(text, len(chunk)))
        mean = np.add.reduceat(top, text) / count[:, None].astype(np.float32)
        most = np.maximum.reduceat(top, text)
        return {"data": data, "text": text, "top": top, "count": count, "peaks": peak, "features": np.concatenate((mean, most), 1)}

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        out, own, held = [], [], 0
        for i, b in enumerate(bodies):
            own.append(b)
            held += len(b)
            if held >= BLOCK or i == len(bodies) - 1:
                out.append(self.pooled(own)["features"] @ self.p["out"] + self.p["shift"])
                own, held = [], 0
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def gradients(self, bodies: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.pooled(bodies, peaks=True)
        score = 1 / (1 + np.exp(-np.clip(f["features"] @ p["out"] + p["shift"], -40, 40)))
        d = ((score - labels) * weights / len(bodies)).astype(np.float32)
        g = {"out": f["features"].T @ d, "shift": d.sum(keepdims=True)}
        mean, most = np.split(d[:, None] * p["out"], 2, axis=1)
        of = np.repeat(np.arange(len(bodies)), f["count"])
        top = f["top"]
        share = (mean / f["count"][:, None])[of]
        peak = top == np.maximum.reduceat(top, f["text"])[of]
        ties = np.add.reduceat(peak.astype(np.float32), f["text"])[of]
        share = (share + np.where(peak, most[of] / ties, 0)) * (top > 0)
        # A chunk's gradient goes to the position where each filter peaked.
        step = np.stack(f["peaks"])
        g["bias"] = share.sum(0)
        bytes_at, backs = [], []
        for name, rows in (("near", step), ("far", step + 1)):
            read = f["data"].reshape(-1, STEP)[rows]
            g[name] = np.einsum("cfk,cf->kf", p["embed"][read].reshape(*rows.shape, STEP * EMBED), share)
            backs.append((share[:, :, None] * p[name].T).reshape(-1, EMBED))
            bytes_at.append(read.ravel())
        at, back = np.concatenate(bytes_at), np.concatenate(backs)
        g["embed"] = np.stack([np.bincount(at, back[:, e], 256) for e in range(EMBED)], 1)
        return g

    def fit(self, bodies: list[bytes], labels: np.ndarray, weights: np.ndarray, updates: int = UPDATES, seed: int = 11) -> ByteCnn:
        rng, t = np.random.default_rng(seed), 0
        epochs = max(1, round(updates * BATCH / len(bodies)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(bodies))
            for at in range(0, len(order), BATCH):
                own, t = order[at : at + BATCH], t + 1
                for k, g in self.gradients([bodies[i] for i in own], labels[own], weights[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def learnable(docs: DataFrame, labels: DataFrame, may_learn: Column) -> DataFrame:
    """``doc_id, quality`` of the labels that may be learned from: one of 0 and 1, not contradicted, of a document
    where ``may_learn`` holds. Nothing else of ``labels`` has a part in the model."""
    agreed = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    return agreed.where("quality = other").drop("other").join(docs.where(may_learn).select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")


def trained(docs: DataFrame, labels: DataFrame, may_learn: Column, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> ByteCnn:
    """Fitted on rows of ``docs`` where ``may_learn`` holds, of which there are as many of each label as
    ``learnable`` counts. Labels other than 0 and 1, and those that differ for one doc_id, are left out, and so are
    texts that alone are over ``most_bytes``; texts of over a sixteenth of it are taken after all others. Without rows
    of both labels every text scores as the label there is, or 0.5."""
    agreed = learnable(docs, labels, may_learn)
    counts = {r[0]: r[1] for r in agreed.groupBy("quality").count().collect()}
    pool, order = docs.where(may_learn).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body")), (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = []
    for label in (0, 1):
        # Ids first, texts of the chosen ones after.
        ids = agreed.where(F.col("quality") == label).select("doc_id").orderBy(*order).limit(rows)
        turn = (F.length("body") > most_bytes // 16, *order, "body")
        own = pool.join(F.broadcast(ids), "doc_id").where(F.length("body") <= most_bytes).orderBy(*turn).limit(rows)
        held = F.sum(F.length("body")).over(W.orderBy(*turn).rowsBetween(W.unboundedPreceding, 0))  # over ``rows`` rows
        chosen += [(bytes(r["body"]), label) for r in own.withColumn("held", held).where(F.col("held") <= most_bytes).collect()]
    model = ByteCnn()
    y = np.array([c[1] for c in chosen], np.float32)
    if len(set(y.tolist())) < 2:
        model.p["out"][:] = 0
        model.p["shift"][:] = 0 if not len(y) else 40 * (2 * y[0] - 1)
        return model
    # Weights bring the two samples back to the labels' frequencies.
    total = sum(counts.values())
    w = np.where(y == 1, counts[1] / total / y.mean(), counts[0] / total / (1 - y.mean())).astype(np.float32)
    return model.fit([c[0] for c in chosen], y, w)


def _scored(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = model.value.scores(batch["body"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def _accepted(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = model.value.scores([(t or "").encode() for t in batch["text"].to_pylist()])
            yield batch.filter(pa.array(score >= threshold))

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (probability of label 1) and predicted (1 from ``threshold`` on).

    A null text is empty; empty texts have a score too. Rows where ``held_out`` is true (null: false) are not learned
    from. Repeated rows get a row each; columns other than doc_id and text are not read.
    """
    held = F.coalesce(held_out, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, ~held))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), utf8().alias("body"))
    return rows.mapInArrow(_scored(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """``docs``, all columns, without the rows that score below ``threshold``."""
    held = F.coalesce(held_out, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, ~held))
    return docs.mapInArrow(_accepted(model, threshold), docs.schema)
