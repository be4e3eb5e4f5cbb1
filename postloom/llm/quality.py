"""A quality classifier from weak labels.

Each of the heuristic labellers below looks at one property of the whole text and votes good (1),
bad (-1) or nothing (0). How far each is right isn't known: expectation-maximisation estimates for
each labeller how often it casts each vote on good and on bad documents, and the share of good
ones, from how often each combination of votes occurs. All documents count; the combinations are
counted where they are, so at most 3 ** labellers counts reach the driver.

The posterior label of each document then trains a linear scorer on hashed words and word shapes
(logistic loss on soft labels, one task), so that a score also reads what no labeller looks at.
The scorer is fitted on a bounded sample: the ``SAMPLE`` distinct hashes of doc_id and text that are
least, one row of each. Every row is scored on its whole text, in the pass that casts its votes
again, so nothing has to be joined.

Nulls, empty texts: an empty text is scored like any other (it has no words). Null doc_ids and
repeated rows keep their rows; equal rows are one to the sample. A score of exactly KEEP is kept. A text of any length is read whole.
An empty table gives an empty result. Other columns are left aside.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, rows_of
from .words import LOWER, UPPER

SAMPLE = 8_000
BITS = 16
KEEP = 0.5
PASSES = 6
#: Words of a worker whose features are remembered.
KNOWN = 300_000
MARKS = b"!\"#$%&()*+/:;<=>?@[]^_`{|}~"
STOPS = b".?!"


def between(x: float, good: tuple[float, float], bad_below: float, bad_above: float) -> int:
    return 1 if good[0] <= x <= good[1] else -1 if x < bad_below or x > bad_above else 0


def vote(raw: bytes | None) -> list[int]:
    """-1, 0 or 1 of each labeller. One that has nothing to go by (too few words or lines)
    abstains. Sizes are in bytes."""
    text = raw or b""
    words = text.split()
    n, size = len(words), len(text)
    many = max(1, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    short = sum(1 for w in words if len(w) <= 3) / many
    stops = sum(1 for w in words if w[-1] in STOPS) / many
    loose = sum(1 for w in words if len(w) == 1 and w in MARKS) / many
    marks = (size - len(text.translate(None, MARKS))) / max(1, size)
    upper = (size - len(text.translate(None, UPPER.encode()))) / max(1, size - len(text.translate(None, (UPPER + LOWER).encode())))
    return [
        1 if n >= 30 else -1 if n < 5 else 0,
        0 if n < 10 else between(short, (0.2, 0.7), 0.1, 0.85),
        0 if n < 20 else between(stops, (0.02, 0.2), 0.005, 0.4),
        0 if n < 50 or n > 2000 else between(len(set(words)) / many, (0.4, 1.0), 0.25, 2.0),
        0 if n < 10 else between(loose, (0.0, 0.01), -1.0, 0.08),
        0 if n < 10 else between(size / many, (3.5, 9.0), 2.5, 12.0),
        between(marks, (0.0, 0.03), -1.0, 0.1),
        0 if size < 20 else between(upper, (0.0, 0.15), -1.0, 0.4),
        0 if len(lines) < 3 else between(len(set(lines)) / len(lines), (0.95, 1.0), 0.7, 2.0),
    ]


def votes(docs: DataFrame) -> DataFrame:
    """The votes of every row of docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, ("text",)):
            yield pa.record_batch([pa.array([vote(t) for t in part["text"]], pa.list_(pa.int32()))], ["votes"])

    return docs.select("text").mapInArrow(run, "votes array<int>")


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, np.ndarray]:
    """The share of good rows and, for (class, labeller, vote + 1), the chance of each vote."""
    if not patterns:
        return 0.5, np.full((2, 1, 3), 1 / 3)
    v = np.array([p for p, _ in patterns]) + 1
    n = np.array([c for _, c in patterns], float)
    one = np.eye(3)[v]
    good = 1 / (1 + np.exp(-1.0 * (v - 1).sum(axis=1) - 0.5))
    share, chance = 0.5, np.full((2, v.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        mass = np.stack([n * (1 - good), n * good])
        share = float(np.clip(mass[1].sum() / n.sum(), 1e-3, 1 - 1e-3))
        chance = np.einsum("cp,pjv->cjv", mass, one) + 0.5
        chance /= chance.sum(axis=2, keepdims=True)
        odds = np.log(share / (1 - share)) + np.einsum("pjv,jv->p", one, np.log(chance[1] / chance[0]))
        now = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(now - good).max() < 1e-7:
            break
        good = now
    return share, chance


def posterior(share: float, chance: np.ndarray, cast: list[list[int]]) -> np.ndarray:
    """The chance that a document with these votes is good, for each of them."""
    if not cast:
        return np.empty(0)
    weight = np.log(chance[1] / chance[0])
    at = np.array(cast) + 1
    odds = np.log(share / (1 - share)) + weight[np.arange(weight.shape[0]), at].sum(axis=1)
    return 1 / (1 + np.exp(-odds))


CLASSES = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


REPEATS = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    return REPEATS.sub(rb"\1", word.translate(CLASSES)) + (b"+" if len(word) > 9 else b"")


class Features:
    """Hashed features of a text: its distinct words, and its word shapes by how common they are."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, int]] = {}

    def of(self, raw: bytes | None) -> np.ndarray:
        words = (raw or b"").split()
        known, pairs = self.known, []
        for w in words:
            got = known.get(w)
            if got is None:
                got = (zlib.crc32(w) & ((1 << BITS) - 1), zlib.crc32(b"\0" + shape(w)) & ((1 << BITS) - 1))
                if len(known) < KNOWN:
                    known[w] = got
            pairs.append(got)
        if not pairs:
            return np.array([zlib.crc32(b"\0\0empty") & ((1 << BITS) - 1)], np.int32)
        ids = np.array(pairs, np.int32)
        shapes, n = np.unique(ids[:, 1], return_counts=True)
        level = np.minimum(6, np.log2(n * 64 / len(words)).clip(0).astype(np.int64))
        mixed = (shapes.astype(np.int64) * 31 + (level + 1) * 40503) & ((1 << BITS) - 1)
        return np.unique(np.concatenate([ids[:, 0], mixed, mixed[level > 2] ^ 1]).astype(np.int32))


def train(rows: list[np.ndarray], targets: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) by AdaGrad on the logistic loss."""
    w, g = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-3)
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            ids = rows[i]
            x = 1 / np.sqrt(len(ids))
            p = 1 / (1 + np.exp(-np.clip(w[ids].sum() * x + w[-1], -30, 30)))
            e = (p - targets[i]) * x
            g[ids] += e * e
            w[ids] -= 0.3 * (e / np.sqrt(g[ids]) + 1e-5 * w[ids])
            g[-1] += (p - targets[i]) ** 2
            w[-1] -= 0.3 * (p - targets[i]) / np.sqrt(g[-1])
    return w.astype(np.float32)


def scorer(sampled: DataFrame, share: float, chance: np.ndarray) -> np.ndarray:
    """Trains on sampled(hash, text): votes and features where the rows are, then one task for the
    fit, with one row for each hash."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for rows in rows_of(batches, ("text",)):
            cols = [pa.array(rows["hash"], pa.int64()), pa.array([features.of(t) for t in rows["text"]], pa.list_(pa.int32())), pa.array(posterior(share, chance, [vote(t) for t in rows["text"]]))]
            yield pa.record_batch(cols, ["hash", "ids", "posterior"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, targets = [], []
        for batch in batches:
            rows += [np.array(x.as_py(), np.int32) for x in batch.column("ids")]
            targets += batch.column("posterior").to_pylist()
        if rows:
            order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes()))
            weights = train([rows[i] for i in order], np.array([targets[i] for i in order]))
            yield pa.record_batch([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    found = sampled.mapInArrow(told, "hash long, ids array<int>, posterior double").groupBy("hash").agg(F.first("ids").alias("ids"), F.first("posterior").alias("posterior"))
    got = found.select("ids", "posterior").repartition(1).mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(got[0].weights, np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, posterior, score, keep) for every row of docs."""
    patterns = [(tuple(r.votes), r["count"]) for r in votes(docs).groupBy("votes").count().collect()]
    share, chance = estimate(sorted(patterns))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("hash"), "text")
    bound = keyed.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    sampled = keyed.filter(F.col("hash") <= bound) if bound is not None else keyed.limit(0)
    weights = docs.sparkSession.sparkContext.broadcast(scorer(sampled, share, chance))  # 2 ** BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), weights.value.astype(np.float64)
        for rows in rows_of(batches, ("text",)):
            z = [w[ids].sum() / np.sqrt(len(ids)) + w[-1] for ids in map(features.of, rows["text"])]
            good = posterior(share, chance, [vote(t) for t in rows["text"]])
            yield pa.record_batch([pa.array(rows["doc_id"], pa.int64()), pa.array(good, pa.float64()), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))], ["doc_id", "posterior", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, posterior double, score double")
    return scored.withColumn("keep", F.col("score") >= KEEP)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))
