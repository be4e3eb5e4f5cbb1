"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic labelled text. Rows marked
toxic are ordinary prose for the most part, so the toxic dictionary is trained on the passages in
which they differ: runs of byte sequences (of ``GRAMS`` bytes) that recur in toxic rows and that
ordinary rows hardly have. What such passages have most in common is the trainer's choice. A window
is compressed with the ordinary dictionary, and with the toxic one laid before the ordinary one;
as both end with the same bytes, a window that holds nothing toxic compresses to the same length
with either, and what it saves with the toxic dictionary is evidence.

Texts are folded to lower-case words, cut into windows of ``WINDOW`` words and compressed with both,
whole. The largest saving of a window, their sum and their sum for each window are turned into a
probability by a logistic fit on labelled rows that no dictionary has seen; ``CUT`` is the threshold.

The sample of labelled rows is bounded: at most ``TOXIC`` and ``ORDINARY`` rows, the least by hash
of doc_id and of the text. Dictionaries and calibration read the whole texts of these and all their
windows, as scores read the whole texts of all rows.

Nulls, empty texts: an empty text is one empty window and gets a score. Null doc_ids and repeated
rows keep their rows; a null doc_id isn't held out. An empty table gives an empty result; without labels of both classes every
score is the share of toxic labels (0 if there are none). A document with several labels counts
once for each. Other columns are left aside.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents, rows_of

TOXIC, ORDINARY = 1500, 4000
WINDOW = 16
CUT = 0.3
CONTENT = 65_536
#: Of the toxic dictionary: its size, and the trainer's segment and match lengths.
TOXIC_CONTENT, SEGMENT, MATCH = 4096, 12, 6
GRAMS = (6, 8)
#: A sequence tells toxic text from ordinary text if so large a share of the toxic rows has it, and so many times the share of the ordinary ones.
RECURS, TIMES = 0.02, 30
SLOTS = 1 << 24
SEPARATORS = bytes((c if chr(c).isalnum() else 32) if c < 128 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(SEPARATORS).split()


def joined(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def windows(words: list[bytes]) -> list[bytes]:
    return [joined(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)] or [b" "]


def slots(text: bytes, gram: int) -> np.ndarray:
    """A number below SLOTS for each sequence of gram bytes of a text."""
    raw = np.frombuffer(text, np.uint8)
    n = max(0, len(raw) - gram + 1)
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = h << np.uint64(8) | raw[k : k + n]
    return (((h ^ np.uint64(gram)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)


def differing(rows: list[tuple[list[bytes], int]]) -> list[bytes]:
    """The passages in which toxic rows differ from ordinary ones."""
    held = [np.zeros(SLOTS, np.uint16), np.zeros(SLOTS, np.uint16)]  # rows that have a sequence
    number = [0, 0]
    for found, label in rows:
        text = joined(found)
        held[label][np.unique(np.concatenate([slots(text, g) for g in GRAMS]))] += 1
        number[label] += 1
    often = np.flatnonzero(held[1] >= max(3.0, RECURS * number[1]))
    telling = np.zeros(SLOTS, bool)
    telling[often[held[1][often] * (number[0] / max(1, number[1])) >= TIMES * held[0][often].astype(float)]] = True
    out = []
    for found, label in rows:
        if label:
            text = joined(found)
            inside = np.zeros(len(text) + 1, np.int64)
            for g in GRAMS:
                at = np.flatnonzero(telling[slots(text, g)])
                np.add.at(inside, at, 1)
                np.add.at(inside, at + g, -1)
            edge = np.flatnonzero(np.diff(np.cumsum(inside) > 0, prepend=False))
            out += [text[s:e] for s, e in zip(edge[::2], edge[1::2], strict=True)]
    return out


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def trained(size: int, samples: list[bytes], **how: int) -> bytes:
    random.Random(5).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself is the dictionary
        return b"".join(samples)[-size:].rjust(8)


def dictionaries(rows: list[tuple[list[bytes], int]]) -> tuple[bytes, bytes]:
    ordinary = trained(CONTENT, [w for found, label in rows if not label for w in windows(found)])
    toxic = trained(TOXIC_CONTENT, differing(rows), k=SEGMENT, d=MATCH)
    # zstandard indexes a dictionary in steps: the shared part has to begin on one.
    return ordinary, toxic.rjust(-(-len(toxic) // 48) * 48, b"\0") + ordinary


@lru_cache(maxsize=2)
def compressors(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, ...]:
    how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=18, chain_log=18, min_match=5, strategy=zstandard.STRATEGY_DFAST, target_length=1, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    out = []
    for content in (ordinary, toxic):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how))
    return tuple(out)


def evidence(text: list[bytes], ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> tuple[float, float, float, float]:
    saved = [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)]
    total = sum(x for x in saved if x > 0)
    return 1.0, math.log1p(max(0, *saved, 0)), math.log1p(total), total / len(saved)


def logistic(x: np.ndarray, y: np.ndarray, worth: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """``worth``: how much each row counts."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (worth * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (worth * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def fitted(rows: list[tuple[int, str, int]], stands: tuple[float, float] = (1.0, 1.0)) -> Model:
    """From labelled rows (doc_id, text, toxic). Two thirds make the dictionaries that calibrate on
    the rest; the dictionaries of the model are then made from all rows. ``stands``: how many
    labelled rows a row of each class stands for, so that scores mean the same however the sample
    was bounded."""
    known: dict[bytes, bytes] = {}  # equal words are held once
    told = [(fold(i) // 4 % 3, [known.setdefault(w, w) for w in words_of(t)], y) for i, t, y in sorted(rows)]
    total = sum(stands[y] for _, _, y in told)
    base = sum(stands[y] for _, _, y in told if y) / max(1, total)
    if not 0 < base < 1:
        return Model(b"", b"", (base,))
    halves = dictionaries([(w, y) for f, w, y in told if f])
    pair = compressors(*halves)
    held = [(evidence(w, *pair), y) for f, w, y in told if not f]
    x, y = np.array([e for e, _ in held]), np.array([v for _, v in held], float)
    worth = np.array([stands[v] for _, v in held]) * len(told) / total
    weights = logistic(x, y, worth) if 0 < y.mean() < 1 else np.array([math.log(base / (1 - base)), 0.0, 0.0, 0.0])
    return Model(*dictionaries([(w, y) for _, w, y in told]), tuple(weights.tolist()))


def drawn(docs: DataFrame, labels: DataFrame, learn: bool) -> tuple[DataFrame, dict[int, int]]:
    """The bounded sample (doc_id, text, toxic), rows of both classes in proportion until a bound is
    met, and how many rows of each class are labelled."""
    rows = labels.select("doc_id", "toxic").filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
    if not learn:
        rows = rows.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2")
    count = {int(r.toxic): r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = min(1.0, TOXIC / max(1, count.get(1, 0)), ORDINARY * 4 / max(1, count.get(0, 0)))
    want = {1: math.ceil(count.get(1, 0) * share), 0: min(ORDINARY, math.ceil(count.get(0, 0) * share))}
    parts = []
    for y, n in want.items():
        taken = rows.filter(F.col("toxic") == y).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")  # at most n ids
        # An id may have any number of rows: the bound holds for what is drawn.
        held = texts.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(n)
        parts.append(held.select(F.col("doc_id").cast("long"), "text", F.lit(y).alias("toxic")))
    return parts[0].unionByName(parts[1]), count


def stands_for(rows: list[tuple[int, str, int]], count: dict[int, int]) -> tuple[float, float]:
    """How many labelled rows a row of each class stands for."""
    held = [sum(y == k for _, _, y in rows) for k in (0, 1)]
    return tuple(count[k] / max(1, held[k]) if count.get(k) else 1.0 for k in (0, 1))


def sample(docs: DataFrame, labels: DataFrame, learn: bool) -> tuple[list[tuple[int, str, int]], tuple[float, float]]:
    """The rows of the bounded sample and what they stand for, on the driver."""
    held, count = drawn(docs, labels, learn)
    got = [tuple(r) for r in held.collect()]
    return got, stands_for(got, count)


def learned(docs: DataFrame, labels: DataFrame, learn: bool = False) -> Model:
    """The model fitted to the sample in a task of its own: the driver gets the dictionaries, no text."""
    held, count = drawn(docs, labels, learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for rows in rows_of(batches) for x in zip(rows["doc_id"], rows["text"], rows["toxic"], strict=True)]
        model = fitted(got, stands_for(got, count))
        cols = [pa.array([model.ordinary], pa.binary()), pa.array([model.toxic], pa.binary()), pa.array([list(model.weights)], pa.list_(pa.float64()))]
        yield pa.record_batch(cols, ["ordinary", "toxic", "weights"])

    made = held.repartition(1).mapInArrow(run, "ordinary binary, toxic binary, weights array<double>").first()
    return Model(bytes(made.ordinary), bytes(made.toxic), tuple(made.weights)) if made else fitted([])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score) for every row of docs, the row as a struct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model.ordinary, model.toxic) if len(model.weights) > 1 else ()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                if pair:
                    z = sum(a * b for a, b in zip(evidence(words_of(text.as_py()), *pair), model.weights, strict=True))
                    out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                else:
                    out.append(model.weights[0])
            yield pa.record_batch([batch.column("row"), pa.array(out, pa.float64())], ["row", "score"])

    told = docs.select(F.struct("*").alias("row"), "text")
    return told.mapInArrow(run, StructType([told.schema["row"], StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labelled: DataFrame, labels: DataFrame, learn: bool = False) -> DataFrame:
    """Scores docs with a model fitted to rows of ``labelled`` that ``labels(doc_id, toxic)`` mark.
    ``learn``: whether rows of the held-out fold may be learned from too."""
    return scored(docs, learned(labelled, labels, learn))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    told = toxicity(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.expr("coalesce(crc32(cast(cast(row.doc_id AS string) AS binary)) % 4 = 2, false)").alias("held_out")
    return told.select("row.doc_id", held_out, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
