"""Groups of texts that share at least ``LEAST`` of their shingles.

A text is the set of its ``SHINGLE``-word shingles (lower case, white space apart), a shorter one
a single shingle. Two texts are linked if the Jaccard similarity of their sets is ``LEAST`` or
more; the groups are the connected components of the links.

Candidates are SimHash's: ``alike_links`` (see ``simhash``) looks up several fingerprints of each
set in Gray-order indexes. What hangs together by candidates is a cluster: links are told by exact
set sizes (of 64-bit hashes). A cluster of more than ``TILE`` texts is cut into tiles, and each pair
of tiles is a task of its own, so a worker holds two tiles' sets at most, however large the cluster;
the comparisons may grow with the square of a cluster's different texts. Pairs that a task has
connected already aren't looked at again, and pairs whose fingerprints differ in more than ``FAR`` of
their bits (5 standard deviations above a pair of four and five shingles at 0.8) aren't compared. Texts
of the same words (told by 128 bits) are one text from the start, so exact copies of any number cost a
row each and no comparison.

Nulls, empty texts: no shingles, one group. A null doc_id keeps its row and links like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, rows_of, spread_join, store

SEED = 42
SHINGLE = 5
LEAST = 0.8
FAR = 0.28
TILE = 512
#: Pairs compared at a time, and shingles counted at a time (in a byte).
CHUNK, COUNT = 2048, 255

#: Of each of a text's fingerprints, an odd factor that draws its hash.
TURNS = np.random.default_rng(SEED).integers(0, 1 << 63, 64, np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(words: list[bytes]) -> np.ndarray:
    """The sorted distinct hashes of the shingles."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=False)], np.uint64))


def words_of_bits(hashes: np.ndarray, number: int) -> np.ndarray:
    """``number`` fingerprints of the set: 64 majority bits each, of as many hashes of its shingles."""
    x = hashes[:, None] * TURNS[:number]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    ones = np.zeros(64 * number, np.int64)
    raw = x.astype("<u8").view(np.uint8)
    for at in range(0, len(raw), COUNT):
        ones += np.unpackbits(raw[at : at + COUNT], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def folded(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


def sketched(docs: DataFrame, number: int) -> DataFrame:
    """(uid, doc_id, text1, text2, fps) for every row of docs(uid, doc_id, text): 128 bits that tell the folded
    text, and ``number`` fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, ("text",)):
            told, fps = [], []
            for raw in rows["text"]:
                words = folded(raw)
                told.append(xxhash.xxh3_128_digest(b" ".join(words), SEED))
                fps.append(words_of_bits(shingles(words), number).view(np.int64) if words else [])
            bits = np.frombuffer(b"".join(told), np.int64).reshape(-1, 2)
            cols = [pa.array(rows["uid"], pa.int64()), pa.array(rows["doc_id"], pa.int64()), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(fps, pa.list_(pa.int64()))]
            yield pa.record_batch(cols, ["uid", "doc_id", "text1", "text2", "fps"])

    return docs.select("uid", "doc_id", "text").mapInArrow(run, "uid long, doc_id long, text1 long, text2 long, fps array<long>")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both) - 1e-9


def linked(sets: list[np.ndarray], sketches: np.ndarray, tiles: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all members that are connected by similar pairs: any pairs if all are of
    one tile, else those between tiles."""
    across = len(np.unique(tiles)) > 1
    up = list(range(len(sets)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sizes = np.array([len(s) for s in sets])
    out = []
    for i in range(1, len(sets)):
        fits = np.minimum(sizes[:i], sizes[i]) >= LEAST * np.maximum(sizes[:i], sizes[i]) - 1e-9
        js = np.flatnonzero(fits & (tiles[:i] != tiles[i]) if across else fits)
        bits = np.concatenate([np.bitwise_count(sketches[js[at : at + CHUNK]] ^ sketches[i]).sum(axis=1) for at in range(0, len(js), CHUNK)] or [np.empty(0)])
        near = bits <= FAR * 64 * sketches.shape[1]
        for j in js[near][np.argsort(bits[near], kind="stable")].tolist():
            a, b = top(i), top(j)
            if a != b and similar(sets[i], sets[j]):
                up[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def similar_links(docs: DataFrame, texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b): links between ``texts(node, fps)``, of the pairs that ``candidates(a, b)`` connect; a node is
    the uid of a row of docs(uid, text)."""
    clusters = store(connected(candidates), "clusters")
    nodes = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root")).distinct()
    large = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE).select("root", F.ceil(F.col("n") / TILE).cast("int").alias("t"))
    tiles = spread_join(nodes, large, ["root"], "node").select("node", "t", F.pmod(F.xxhash64("node"), F.col("t")).cast("int").alias("own"))
    placed = nodes.join(tiles, "node", "left").withColumns({"t": F.coalesce("t", F.lit(1)), "own": F.coalesce("own", F.lit(0))})
    known = placed.join(texts, "node")
    held = docs.select(F.col("uid").alias("node"), "text").join(known, "node").select("root", "t", "own", "node", "text", "fps")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in rows_of(batches, ("text",)):
            found = [shingles(folded(raw)) for raw in got["text"]]
            cols = [pa.array(got["root"], pa.int64()), pa.array(got["t"], pa.int32()), pa.array(got["own"], pa.int32()), pa.array(got["node"], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
            cols.append(pa.array([np.array(fps, np.int64).tobytes() for fps in got["fps"]], pa.binary()))
            yield pa.record_batch(cols, ["root", "t", "own", "node", "shingles", "sketch"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved() -> pa.RecordBatch:
            pairs = linked(members, np.array(sketches), np.array(tiles)) if len(members) > 1 else []
            return pa.record_batch([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], ["a", "b"])

        cell, ids, tiles, members, sketches = None, [], [], [], []
        for got in rows_of(batches):
            for root, i, j, own, node, raw, sketch in zip(*[got[c] for c in ("root", "i", "j", "own", "node", "shingles", "sketch")], strict=True):
                if (root, i, j) != cell:
                    yield solved()
                    cell, ids, tiles, members, sketches = (root, i, j), [], [], [], []
                ids.append(node)
                tiles.append(own)
                members.append(np.frombuffer(raw, np.uint64))
                sketches.append(np.frombuffer(sketch, np.uint64))
        yield solved()

    cells = (
        held.mapInArrow(sets, "root long, t int, own int, node long, shingles binary, sketch binary")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
        .select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "shingles", "sketch")
    )
    cell = ["root", "i", "j"]
    return cells.repartition(*cell).sortWithinPartitions(*cell, "node").mapInArrow(links, "a long, b long")


def similar_rows(docs: DataFrame, number: int, alike_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(uid, doc_id, root) for every row of the stored table docs(uid, doc_id, text): rows of a group share root.
    ``alike_links`` gives candidates (a, b) among (node, fps), texts with ``number`` fingerprints."""
    rows = store(sketched(docs, number), "sketched")
    # A text is known by the first row that has it.
    texts = store(rows.groupBy("text1", "text2").agg(F.min_by("fps", "uid").alias("fps"), F.min("uid").alias("node")), "texts")
    known = texts.filter(F.size("fps") > 0).select("node", "fps")
    roots = connected(store(similar_links(docs, known, alike_links(known)), "similar"))
    told = texts.select("text1", "text2", "node").join(roots, "node", "left").select("text1", "text2", F.coalesce("root", "node").alias("root"))
    return spread_join(rows.select("uid", "doc_id", "text1", "text2"), told, ["text1", "text2"], "uid").select("uid", "doc_id", "root")
