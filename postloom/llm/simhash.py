"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: 64 majority bits of the XXH64 (seed 42) of every 4-word shingle. Two texts are
linked if their fingerprints differ in at most ``radius`` bits; the groups are the connected
components of the links.

The join has three steps. Distinct fingerprints are dealt by the bits on which any linked pair
must agree (with radius 4 and m blocks, at least m - 4 blocks agree; m grows with the number of
fingerprints so that a bucket stays small). Inside a bucket the fingerprints are sorted by Gray
rank and indexed as a tree: each upper node holds the bits that all fingerprints below share, so
a search adds up differences on the way down and leaves a whole group as soon as they exceed the
radius; a group whose undecided bits can't exceed it any more is linked whole. A bucket beyond
``tile`` fingerprints is cut into tiles, and each pair of tiles is a task of its own. From each
task only a spanning forest leaves, never all pairs of a dense group.

``one_of_each`` wants texts whose shingle sets are similar to 0.8. Two such sets' fingerprints differ
in 15 % of their bits: too far for a radius of one fingerprint, so each text has several (``plan_for``),
and texts are dealt by every block of every fingerprint. Inside a bucket the tree finds the fingerprints
within ``WIDE`` bits, two more fingerprints confirm a hit (``SURE`` bits of the three), and exact set
sizes decide (see ``resemblance``). A pair at exactly 0.8 is found with probability 1 - 1e-7 at least
(computed for long texts; for sets of four and five shingles, the worst, 1 - 5e-6 up to 400,000 texts
and 1 - 1e-4 beyond 1.8 million), a more similar one more surely.

Nulls, empty texts: no words, fingerprint zero, linked like any other. A null doc_id keeps its
row; it never becomes a component_id unless its whole component has none. Repeated rows and ids
each keep a row. A text of any length is one fingerprint of its whole; a worker holds its words.
An empty table gives an empty result. Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected, documents, rows_of, store
from .resemblance import similar_rows

SEED = 42
FAN = 16
TILE = 8192
#: Fingerprints that a bucket should hold on average at most, if they were random.
BUCKET = 16384
#: For similar texts: bits in which fingerprints of a bucket may differ, and they and two more.
WIDE, SURE = 20, 56
#: Blocks of a fingerprint and fingerprints of a text, each for up to so many texts; a bucket holds 256 random ones.
PLANS = ((1 << 16, 8, 10), (400_000, 6, 18), (1_800_000, 5, 30), (1 << 63, 4, 64))
#: Fingerprints looked up at a time, so that their shuffle stays small; texts of a bucket that are compared in one task.
ROUND, CELL = 5, 2048


def fingerprint(raw: bytes | None, shingle: int = 4) -> int:
    words = (raw or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, ("text",)):
            fps = np.array([fingerprint(x, shingle) for x in rows["text"]], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(rows["doc_id"], pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the Gray sequence, in which neighbours differ in one bit."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """A static tree over Gray-sorted fingerprints. ``levels[0]`` are the fingerprints; a node
    above covers FAN nodes below: ``mask`` marks bits that all of them share and ``own`` those
    that its parent doesn't share yet, so that differences add up along a path."""

    def __init__(self, fps: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        ands, ors, masks = self.fps, self.fps, np.full(len(fps), ~np.uint64(0))
        self.levels = [(ands, masks)]
        while len(ands) > FAN:
            cut = np.arange(0, len(ands), FAN)
            ands, ors = np.bitwise_and.reduceat(ands, cut), np.bitwise_or.reduceat(ors, cut)
            masks = ~(ands ^ ors)
            self.levels.append((ands & masks, masks))
        self.own = [m & ~np.repeat(up[1], FAN)[: len(m)] for (_, m), up in zip(self.levels, self.levels[1:], strict=False)] + [self.levels[-1][1]]

    def links(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in ``fps``) that connect every query with all that it reaches: a
        pair for each hit, but one for a group that is within the radius as a whole and whose
        members are connected by an earlier query."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        whole: set[tuple[int, int]] = set()
        step = max(64, (1 << 21) // max(1, len(self.fps)))
        for at in range(0, len(queries), step):
            q = np.arange(at, min(at + step, len(queries)))
            top = len(self.levels) - 1
            n = len(self.levels[top][0])
            who, node, acc = np.repeat(q, n), np.tile(np.arange(n), len(q)), np.zeros(len(q) * n, np.int64)
            for level in range(top, -1, -1):
                pattern, mask = self.levels[level]
                acc = acc + np.bitwise_count((queries[who] ^ pattern[node]) & self.own[level][node])
                near = acc <= radius
                who, node, acc = who[near], node[near], acc[near]
                if level == 0:
                    found.append((who, node))
                    break
                open_bits = 64 - np.bitwise_count(mask[node]).astype(np.int64)
                sure = acc + open_bits <= radius
                if sure.any():
                    width = FAN**level
                    found.append((who[sure], node[sure] * width))
                    for first, k in zip(*np.unique(node[sure], return_index=True), strict=True):
                        if (level, int(first)) not in whole:
                            whole.add((level, int(first)))
                            rest = np.arange(first * width, min((first + 1) * width, len(self.fps)))
                            found.append((np.full(len(rest), who[sure][k]), rest))
                    who, node, acc = who[~sure], node[~sure], acc[~sure]
                below = len(self.levels[level - 1][0])
                who, acc = np.repeat(who, FAN), np.repeat(acc, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < below
                who, node, acc = who[real], node[real], acc[real]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (query, place in ``fps``) within the radius, some queries at a time."""
        step = max(16, (1 << 20) // max(1, len(self.fps)))
        for at in range(0, len(queries), step):
            q = np.arange(at, min(at + step, len(queries)))
            n = len(self.levels[-1][0])
            who, node, acc = np.repeat(q, n), np.tile(np.arange(n), len(q)), np.zeros(len(q) * n, np.uint8)
            for level in range(len(self.levels) - 1, -1, -1):
                acc = acc + np.bitwise_count((queries[who] ^ self.levels[level][0][node]) & self.own[level][node])
                hit = acc <= radius
                who, node, acc = who[hit], node[hit], acc[hit]
                if level:
                    who, acc = np.repeat(who, FAN), np.repeat(acc, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    real = node < len(self.levels[level - 1][0])
                    who, node, acc = who[real], node[real], acc[real]
            yield who, node


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    up = np.arange(n)
    while len(a):
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        if (low == high).all():
            break
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
    return up


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp of its component's first) among ``left``, or between it and ``right``."""
    fps = left if right is None else np.concatenate([left, right])
    if len(fps) < 2:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    index = GrayIndex(left if right is None else right)
    who, place = index.links(left, radius)
    up = roots(len(fps), who, index.order[place] + (0 if right is None else len(left)))
    moved = up != np.arange(len(fps))
    return fps[moved], fps[up[moved]]


def blocks_for(fps: int, radius: int) -> int:
    """The least number of blocks whose agreeing bits make buckets of BUCKET random words."""
    m = radius + 1
    while m < radius + 4 and fps / 2 ** (64 * (m - radius) // m) > BUCKET:
        m += 1
    return m


def masks_for(m: int, radius: int) -> list[int]:
    cuts = [64 * i // m for i in range(m + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(m)]
    return [sum(block[i] for i in keep) for keep in combinations(range(m), m - radius)]


def near_links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps(fp)``, enough to connect all that are
    within the radius of each other."""
    masks = [x - (1 << 64) if x >> 63 else x for x in masks_for(blocks_for(fps.count(), radius), radius)]
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(x)).alias("bits")) for i, x in enumerate(masks)])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    large = dealt.groupBy("table", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
    tiles = F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("t")).cast("int")
    placed = (
        dealt.join(large, ["table", "bits"], "left").withColumn("t", tiles).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
        .select("table", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(cols: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
            out = []
            i, j, own, fp = cols[2], cols[3], cols[4], cols[5].view(np.uint64)
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s > 1:
                    first = own[s:e] == i[s]
                    out.append(forest(fp[s:e], None, radius) if i[s] == j[s] else forest(fp[s:e][first], fp[s:e][~first], radius))
            a = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.uint64)
            b = np.concatenate([y for _, y in out]) if out else np.empty(0, np.uint64)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(cols[0]):
                new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
                cuts = np.concatenate([[0], new])
                if len(cuts) > 1:
                    yield solved([c[: cuts[-1]] for c in cols], cuts)
                held = [c[cuts[-1] :] for c in cols]
        if held is not None and len(held[0]):
            yield solved(held, np.array([0, len(held[0])]))

    group = ["table", "bits", "i", "j"]
    return placed.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def plan_for(texts: int) -> tuple[int, int]:
    """Blocks of a fingerprint, and fingerprints of a text."""
    return next((m, number) for most, m, number in PLANS if texts <= most)


def alike(fps: np.ndarray, first: int, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, smaller root) between the components of rows of three fingerprints each, by pairs among
    all rows, or between the ``first`` ones and the others."""
    names, label = np.unique(root, return_inverse=True)
    up = np.arange(len(names))
    if len(names) > 1:
        index = GrayIndex(fps[first:, 0])
        for who, place in index.near(fps[:first, 0] if first else fps[:, 0], WIDE):
            other = index.order[place] + first
            new = (who < other) & (up[label[who]] != up[label[other]])
            who, other = who[new], other[new]
            sure = np.bitwise_count(fps[who] ^ fps[other]).sum(axis=1) <= SURE
            up = roots(len(names), up[label[who[sure]]], up[label[other[sure]]])[up]
    moved = np.flatnonzero(up != np.arange(len(names)))
    return names[moved], names[up[moved]]


def alike_links(texts: DataFrame, m: int, number: int, cell: int = CELL) -> DataFrame:
    """(a, b): links between ``texts(node, fps)``, ``number`` fingerprints each, enough to connect all
    texts of which a block agrees and three fingerprints hardly differ.

    A group of n texts is in every bucket of theirs, and each would link it anew, a pair of tiles too. So the
    first fingerprint's tiles are solved one by one, which gives at most ``m`` links a text, and all others and the
    pairs of tiles only look for links between the components of these."""
    cuts = [64 * i // m for i in range(m + 1)]
    group = ["key", "i", "j"]
    columns = ["own", "root", "fp", "more1", "more2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(cols: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            i, j, own, root = cols[1:5]
            fps = np.stack(cols[5:], axis=1).view(np.uint64)
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                at, first = np.arange(s, e), 0
                if i[s] != j[s]:
                    left = own[s:e] == i[s]
                    at, first = np.concatenate([at[left], at[~left]]), int(left.sum())
                    if first in (0, e - s):
                        continue
                if e - s > 1:
                    high, low = alike(fps[at], first, root[at])
                    a.append(high)
                    b.append(low)
            return pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(cols[0]):
                new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
                cuts = np.concatenate([[0], new])
                if len(cuts) > 1:
                    yield solved([c[: cuts[-1]] for c in cols], cuts)
                held = [c[cuts[-1] :] for c in cols]
        if held is not None and len(held[0]):
            yield solved(held, np.array([0, len(held[0])]))

    def dealt(rooted: DataFrame, some: range) -> DataFrame:
        """Texts by every block of some fingerprints, each with its tile of the bucket."""
        keys = []
        for w in some:
            fp, more = F.col("fps")[w], [F.col("fps")[(w + k) % number].alias(f"more{k}") for k in (1, 2)]
            for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
                block = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
                keys.append(F.struct((block + F.lit((w * m + k) << 32)).alias("key"), fp.alias("fp"), *more))
        blocks = rooted.select("node", "root", F.explode(F.array(*keys)).alias("k")).select("node", "root", "k.*")
        large = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("root") == F.max("root")).alias("one")).filter(F.col("n") > cell)
        # A bucket of one component has no link to add.
        return (
            blocks.join(large, "key", "left").filter("one IS NULL OR NOT one")
            .withColumn("t", F.coalesce(F.ceil(F.col("n") / cell), F.lit(1)).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("t")).cast("int"))
        )

    def links(placed: DataFrame) -> DataFrame:
        return store(placed.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long").distinct(), "alike")

    alone = dealt(texts.withColumn("root", F.col("node")), range(1))
    begun = store(connected(links(alone.select("key", F.col("own").alias("i"), F.col("own").alias("j"), *columns))), "begun")
    rooted = store(texts.join(begun, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    found = begun.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for at in range(0, number, ROUND):
        pairs = (
            dealt(rooted, range(at, min(at + ROUND, number)))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
            .filter((F.col("key") >= m << 32) | (F.col("own") != F.col("other")))
            .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns)
        )
        found = found.unionByName(links(pairs))
    return store(found.distinct(), "alike")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    rows = store(fingerprints(docs, shingle), "fingerprints")
    first = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = store(near_links(first.select("fp"), radius, tile), "near")
    nodes = connected(links)
    tagged = first.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = tagged.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(tagged.join(least, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of similar texts (see ``resemblance``: 0.8 of
    their 5-word shingles): of each group the row with the smallest doc_id stays (null after all
    others; of rows that share it, the one with the smallest text). Rows are told apart by a number
    of their own, so rows whose doc_ids clash are each judged in their own group."""
    held = store(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")
    texts = held.select("uid", F.col("row")["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.col("row")["text"], F.lit("")).alias("text"))
    m, number = plan_for(held.count())
    found = store(similar_rows(texts, number, lambda known: alike_links(known, m, number)), "groups")
    by_id = found.groupBy("root", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid"))
    first = by_id.groupBy("root").agg(F.min_by(F.struct("doc_id", "n", "uid"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("f")).select("root", "f.*")
    first = store(first, "firsts")
    # A group whose smallest doc_id several rows have: their texts decide.
    tied = first.filter("n > 1").select(F.col("root").alias("r"), F.col("doc_id").alias("d"))
    among = found.join(tied, (F.col("root") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("root", "uid")
    won = texts.select("uid", "text").join(among, "uid").groupBy("root").agg(F.min_by("uid", F.struct("text", "uid")).alias("uid"))
    stay = first.filter("n = 1").select("uid").unionByName(won.select("uid"))
    return held.join(stay, "uid", "left_semi").select("row.*")
