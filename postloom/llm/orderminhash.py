"""Order MinHash fingerprints.

A text's k-mers are K consecutive code points, numbered by occurrence so that repeats count. For
each of SKETCHES hash functions the PICKED k-mers of least hash are taken, put back in text order
and hashed as a tuple. Two texts agree in an entry if they share those k-mers in the same order,
which tells reordered text from equal text and follows the edit distance; the likeness of two
fingerprints is the share of equal entries.

The query also fingerprints each text with its last third replaced by the beginning of the next
document in descending doc_id order. Rows are dealt by ranges of (doc_id, hash of the text, row) and
stream through sorted with one document held, so a doc_id may have any number of rows. The first
and the last document of each range are kept besides; a second, small step compares the last of
each range with the first of the next that has rows (after the last: the first).

Nulls: a null text is an empty one; a null doc_id comes last. Empty texts have the fingerprint of
no k-mers and are like each other. A text shorter than K is one k-mer. Rows with equal doc_ids
follow each other by the hash of their texts. A text of any length is read whole; its worker holds
some numbers for each of its code points. One row is its own successor; an empty table gives an empty result.
Other columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, rows_of, store
from .tokenfiles import in_ranges

K = 6
PICKED = 2
SKETCHES = 32
PRIME = np.uint64(0x100000001B3)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd multiplier for each hash function.
FUNCTIONS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * ODD) | np.uint64(1)


def numbered_kmers(text: str) -> np.ndarray:
    """A hash of each (k-mer, number of its occurrences before), in text order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(points):
        return points
    n = max(1, len(points) - K + 1)
    h = np.full(n, len(points) if len(points) < K else K, np.uint64)
    for j in range(min(K, len(points))):
        h = (h ^ points[j : j + n]) * PRIME
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    at = np.arange(n)
    seen = np.empty(n, np.uint64)
    seen[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mixed(h + seen * ODD)


def signature(text: str) -> np.ndarray:
    """SKETCHES entries of 32 bits."""
    h = numbered_kmers(text)
    if not len(h):
        return np.zeros(SKETCHES, np.uint32)
    picks = np.empty((SKETCHES, PICKED), np.int64)
    for j, a in enumerate(FUNCTIONS):
        v = h * a
        for p in range(PICKED):
            picks[j, p] = at = int(v.argmin())
            v[at] = ~np.uint64(0)
    picks.sort(axis=1)
    out = FUNCTIONS.copy()
    for p in range(PICKED):
        out = mixed((out ^ h[picks[:, p]]) * ODD)
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, after: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def compared(doc_id: int | None, text: str, own: np.ndarray, after: str, its: np.ndarray) -> tuple:
    """A row of the result for a text and the next document's, with their signatures."""
    changed = edited(text, after)
    other = own if changed == text else signature(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, its)


def neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, its edited text and the next document's, compared."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None  # doc_id, text, signature
        ends: list[tuple] = []

        def told(found: list[tuple], ends: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(list(c) + [None] * len(ends), k) for c, k in zip(zip(*found, strict=True) if found else [()] * len(KINDS), KINDS, strict=True)]
            more = zip(*ends, strict=True) if ends else [()] * 4
            cols += [pa.array([None] * len(found) + list(c), k) for c, k in zip(more, (pa.int32(), pa.bool_(), pa.int64(), pa.string()), strict=True)]
            return pa.record_batch(cols, [*NAMES, "part", "is_last", "end_id", "text"])

        for cols in rows_of(batches):
            found: list[tuple] = []
            for doc, text in zip(cols["doc_id"], cols["text"], strict=True):
                own = held[2] if held is not None and held[1] == text else signature(text)
                if held is not None:
                    found.append(compared(*held, text, own))
                else:
                    ends.append((part, False, doc, text))
                held = doc, text, own
            yield told(found, [])
        if held is not None:
            yield told([], [*ends, (part, True, held[0], held[1])])

    found = store(in_ranges(rows, descending=True).mapInArrow(run, f"{SCHEMA}, part int, is_last boolean, end_id long, text string"), "compared")
    firsts = found.filter("part IS NOT NULL AND NOT is_last").select("part", F.col("text").alias("after"))
    lasts = found.filter("part IS NOT NULL AND is_last").select("part", F.col("end_id").alias("doc_id"), "text")
    # A number for each range that has rows: few, and without their texts.
    follows = firsts.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("least"))
    follows = follows.select("part", F.coalesce("next", "least").alias("next"))
    pairs = lasts.join(follows, "part").join(firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in rows_of(batches):
            out = [compared(doc, text, signature(text), after, signature(after)) for doc, text, after in zip(cols["doc_id"], cols["text"], cols["after"], strict=True)]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(KINDS), KINDS, strict=True)], NAMES)

    return found.filter("part IS NULL").select(*NAMES).unionByName(pairs.mapInArrow(close, SCHEMA))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(documents(spark, sf_dir))
