"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is WINDOW consecutive words of one document. A word goes if a window that covers it also
starts in a document with a smaller doc_id; windows are judged on the input.

1. Anchors. Of the GRAM-word grams in a window the one of least hash is its anchor; equal windows
   have equal anchors, and neighbouring windows mostly share theirs, so a document has about two
   anchors in ten words. Anchors are shuffled and sorted by hash, and those met in one text only
   drop out while they stream past.
2. Segments. A text that occurs several times counts once, for its smallest doc_id; its copies
   lose every window as a whole. Around each anchor left, the words of all windows that it anchors
   are one segment: the part of the document that has to stream through the shard of that anchor.
   Equal segments are merged before the shuffle, with the smallest doc_id of their documents, so
   that a passage that a third of all documents share becomes one row.
3. Automata. Segments are sharded by anchor; an anchor with more than HOT different segments is dealt
   by window over as many shards as it needs, so what a worker compiles at once is bounded. A shard
   confirms which windows recur, compiles these into an automaton (pyahocorasick, words as integers)
   and streams its segments through by ascending doc_id. The document that a window is first found
   in owns it; each later occurrence that the automaton finds reads that owner.
4. Every occurrence of a segment reads the owners of its windows (an equi-join that AQE splits
   where a segment is hot) and the windows with a smaller owner go.

Occurrences are matched on the words themselves; equal texts are told by SHA-256 and equal segments
by 128 bits beside their anchor. Nulls: a null text has no words; a row with a null doc_id neither
loses words nor takes any. Rows with equal doc_ids don't take each other's words, and repeated rows
get the same result. Empty texts keep nothing to remove. A text of any length is read whole; its
worker holds its words and some numbers for each. An empty table gives an empty result. Extra
columns pass through ``deduplicated`` in a struct, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SLICE, documents, rows_of, store

WINDOW = 13
GRAM = 5
#: Segments that a worker compiles into one automaton, but for the last anchor among them.
BLOCK = 20_000
#: Different segments beyond which an anchor is dealt by window.
HOT = 2_000
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each gram, and for each window the place of its anchor (the first of the least)."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    n = len(words) - gram + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(gram):
        mixed = (mixed ^ h[k : k + n]) * MIX
        mixed ^= mixed >> np.uint64(29)
    wide = window - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(mixed, wide)
    return mixed, view.argmin(axis=1) + np.arange(len(view))


def recurring(rows: DataFrame) -> DataFrame:
    """(uid, anchors): the anchors of rows(uid, text) that other rows have too.

    A row sends each of its anchors once, routed by the anchor. Of an anchor that many rows of a
    slice have, two rows tell all others that it recurs; the rest are routed apart (their route
    isn't the anchor), so that an anchor in a third of all rows is no hot key."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, ("text",)):
            hashes, uids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for uid, text in dict(zip(part["uid"], part["text"], strict=True)).items():
                words = (text or b"").split()
                if len(words) >= WINDOW:
                    mixed, at = anchors(words)
                    hashes.append(np.unique(mixed[at]))
                    uids.append(np.full(len(hashes[-1]), uid))
            anchor, uid = np.concatenate(hashes), np.concatenate(uids)
            order = np.argsort(anchor, kind="stable")
            anchor, uid = anchor[order], uid[order]
            first = np.concatenate([[True], anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, bool)
            rank = np.arange(len(anchor)) - np.maximum.accumulate(np.where(first, np.arange(len(anchor)), 0))
            apart = (anchor ^ uid.view(np.uint64)) * MIX
            route = np.where(rank < 2, anchor, apart ^ (apart >> np.uint64(31)))
            yield pa.record_batch([pa.array(route.view(np.int64)), pa.array(uid), pa.array(anchor.view(np.int64))], ["route", "uid", "anchor"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by route. Held back: the run of the last route, while it has one uid."""
        last, several, held = None, False, [np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            route, uid, anchor = (c.to_numpy() for c in batch.columns)
            if last is not None and route[0] == last and not several:
                route = np.concatenate([np.full(len(held[0]), last), route])
                uid, anchor = np.concatenate([held[0], uid]), np.concatenate([held[1], anchor])
            known = several and route[0] == last
            cuts = np.concatenate([[0], np.flatnonzero(route[1:] != route[:-1]) + 1])
            many = np.minimum.reduceat(uid, cuts) != np.maximum.reduceat(uid, cuts)
            many[0] |= known
            keep = np.repeat(many, np.diff([*cuts, len(route)])) | (route != anchor)
            last, several = route[-1], bool(many[-1])
            held = [uid[cuts[-1] :], anchor[cuts[-1] :]]
            yield pa.record_batch([pa.array(uid[keep]), pa.array(anchor[keep])], ["uid", "anchor"])

    found = rows.mapInArrow(emit, "route long, uid long, anchor long")
    kept = found.repartition("route").sortWithinPartitions("route").mapInArrow(shared, "uid long, anchor long")
    return kept.groupBy("uid").agg(F.collect_set("anchor").alias("anchors"))


def segments(rows: DataFrame) -> DataFrame:
    """(uid, doc_id, anchor, first, key, key2, words): for each recurring anchor the words of its
    windows and the place of the first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, ("text",)):
            out: list[tuple] = []
            for uid, doc, text, wanted in zip(part["uid"], part["doc_id"], part["text"], part["anchors"], strict=True):
                words = text.split()
                mixed, at = anchors(words)
                runs = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
                told = np.isin(mixed[at[runs[:-1]]].view(np.int64), np.array(wanted, np.int64))
                for s, e in zip(runs[:-1][told].tolist(), runs[1:][told].tolist(), strict=True):
                    out.append((uid, doc, int(mixed[at[s]].view(np.int64)), s, b" ".join(words[s : e - 1 + WINDOW])))
            yield from keyed(out)

    return rows.join(recurring(rows), "uid").mapInArrow(cut, CELLS)


CELLS = "uid long, doc_id long, anchor long, first int, key long, key2 long, words binary"


def keyed(rows: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """CELLS of (uid, doc_id, anchor, first, words), with 128 bits that tell the words."""
    if rows:
        *cols, words = zip(*rows, strict=True)
        bits = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.int64).reshape(-1, 2)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
        yield pa.record_batch([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(words, pa.binary())], ["uid", "doc_id", "anchor", "first", "key", "key2", "words"])


def dealt(found: DataFrame, hot: int | None = None) -> DataFrame:
    """found with the segments of anchors that have more than HOT different ones cut into their
    windows; equal windows share a new anchor, others of theirs are dealt over as many as needed."""
    hot = hot or HOT
    often = store(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("anchor"), "often")
    if often.isEmpty():
        return found
    kinds = found.join(often, "anchor").select("anchor", "key", "key2").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    wide = store(kinds.filter(F.col("n") > hot).select("anchor", F.ceil(F.col("n") * (WINDOW - GRAM + 1) / hot).cast("int").alias("shards")), "hot")
    if wide.isEmpty():
        return found

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            out = []
            for uid, doc, anchor, first, raw, shards in zip(part["uid"], part["doc_id"], part["anchor"], part["first"], part["words"], part["shards"], strict=True):
                words = raw.split(b" ")
                for i in range(len(words) - WINDOW + 1):
                    window = b" ".join(words[i : i + WINDOW])
                    cell = xxhash.xxh64_intdigest(b"%d %d" % (anchor, xxhash.xxh64_intdigest(window) % shards))
                    out.append((uid, doc, cell - (1 << 64) if cell >> 63 else cell, first + i, window))
            yield from keyed(out)

    columns = ["uid", "doc_id", "anchor", "first", "key", "key2", "words"]
    return found.join(wide, "anchor", "left_anti").select(*columns).unionByName(store(found.join(wide, "anchor").mapInArrow(cut, CELLS), "windows"))


def recurring_windows(coded: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """The different windows that more than one of the segments (words as numbers) has."""
    sizes = np.array([len(c) for c in coded])
    flat = np.fromiter((x for c in coded for x in c), np.uint64, sizes.sum())
    n = len(flat) - WINDOW + 1
    bits = [np.zeros(n, np.uint64), np.ones(n, np.uint64)]
    for k in range(WINDOW):
        for j, factor in enumerate((MIX, MIX2)):
            bits[j] = (bits[j] ^ flat[k : k + n]) * factor
            bits[j] ^= bits[j] >> np.uint64(29)
    ends = np.cumsum(sizes)
    segment = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(np.arange(n) + WINDOW <= ends[segment[:n]])
    order = at[np.lexsort((segment[at], bits[1][at], bits[0][at]))]
    first = np.concatenate([[True], (bits[0][order][1:] != bits[0][order][:-1]) | (bits[1][order][1:] != bits[1][order][:-1])])
    cuts = np.flatnonzero(first)
    last = np.concatenate([cuts[1:], [len(order)]]) - 1
    several = segment[order[cuts]] != segment[order[last]]
    starts = ends - sizes
    return [coded[i][p - starts[i] : p - starts[i] + WINDOW] for p in order[cuts[several]].tolist() for i in (segment[p],)]


def located(texts: list[bytes], docs: list[int]) -> list[list[int]]:
    """For each segment the owner of each of its windows. Segments of an anchor come by ascending
    doc_id, and different ones."""
    number: dict[bytes, int] = {}
    coded = [tuple([number.setdefault(w, len(number) + 1) for w in t.split(b" ")]) for t in texts]
    out = [[d] * (len(words) - WINDOW + 1) for d, words in zip(docs, coded, strict=True)]
    found = recurring_windows(coded)
    if found:
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i, window in enumerate(found):
            machine.add_word(window, i)
        machine.make_automaton()
        owner: list[int | None] = [None] * len(found)
        for k, words in enumerate(coded):
            for end, i in machine.iter(words):
                if owner[i] is None:
                    owner[i] = docs[k]
                out[k][end - WINDOW + 1] = owner[i]
    return out


def owners(found: DataFrame) -> DataFrame:
    """(anchor, key, key2, owners): for each distinct segment the smallest doc_id with each window."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Before the shuffle: one row for equal segments of a batch, with the smallest doc_id."""
        for batch in batches:
            anchor, key, key2, doc = (batch.column(c).to_numpy() for c in ("anchor", "key", "key2", "doc_id"))
            order = np.lexsort((doc, key2, key, anchor))
            cols = [x[order] for x in (anchor, key, key2)]
            first = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in cols], axis=0)]) if len(order) else np.zeros(0, bool)
            yield batch.take(pa.array(order[first]))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks end where an anchor ends. Of equal segments the first, with the smallest doc_id, is enough."""
        rows: list[tuple[int, int, int, int, bytes]] = []
        last, seen = None, set()

        def flush() -> pa.RecordBatch:
            told = located([r[4] for r in rows], [r[3] for r in rows])
            return pa.record_batch([*[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array(told, pa.list_(pa.int64()))], ["anchor", "key", "key2", "owners"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "key", "key2", "doc_id", "words")], strict=True):
                if row[0] != last:
                    last, seen = row[0], set()
                    if len(rows) >= BLOCK:
                        yield flush()
                        rows = []
                if row[1:3] not in seen:
                    seen.add(row[1:3])
                    rows.append(row)
        if rows:
            yield flush()

    merged = found.select("anchor", "key", "key2", "doc_id", "words").mapInArrow(merge, "anchor long, key long, key2 long, doc_id long, words binary")
    return merged.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(locate, "anchor long, key long, key2 long, owners array<long>")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(row, kept, n_words, n_removed) for every row of docs: the row as a struct, the words kept
    (joined by one space) and the counts."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2("text", 256)).alias("sha"))
    named = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("sha", "doc_id", "text")
    firsts = store(named.groupBy("sha").agg(F.min("doc_id").alias("first_id")).withColumn("uid", F.monotonically_increasing_id()), "texts")
    # On both columns, so that the copies of a text don't meet in one task.
    once = named.join(firsts.withColumnRenamed("first_id", "doc_id"), ["sha", "doc_id"]).select("uid", "doc_id", "text")
    found = dealt(store(segments(once), "segments"))
    told = found.select("uid", "doc_id", "anchor", "key", "key2", "first").join(owners(found), ["anchor", "key", "key2"])
    gone = F.expr("transform(filter(transform(owners, (o, i) -> struct(o < doc_id AS gone, first + i AS at)), x -> x.gone), x -> x.at)")
    starts = store(told.select("uid", gone.alias("at")).filter("size(at) > 0").groupBy("uid").agg(F.flatten(F.collect_set("at")).alias("starts")), "starts")
    marks = firsts.join(starts, "uid", "left").drop("uid")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                batch = whole.slice(begin, SLICE)
                kept, total, gone = [], [], []
                for text, at, copy in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts").to_pylist(), batch.column("copy").to_pylist(), strict=True):
                    words = (text or b"").split()
                    if copy and len(words) >= WINDOW:
                        at = [*range(0, len(words) - WINDOW, WINDOW), len(words) - WINDOW]
                    stay = np.ones(len(words), bool)
                    for s in at or ():
                        stay[s : s + WINDOW] = False
                    left = [w for w, ok in zip(words, stay, strict=True) if ok] if at else words
                    kept.append(b" ".join(left))
                    total.append(len(words))
                    gone.append(len(words) - len(left))
                yield pa.record_batch([batch.column("row"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["row", "kept", "n_words", "n_removed"])

    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("copy")
    at = F.when(F.col("doc_id").isNotNull(), F.col("starts")).alias("starts")
    joined = rows.join(marks, "sha", "left").select("row", "text", at, copy)
    return joined.mapInArrow(apply, StructType([rows.schema["row"], StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())]))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return told.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


WORDS_SQL = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
     s AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS t(i)),
     f AS (SELECT win, min(doc_id) AS owner FROM s WHERE doc_id IS NOT NULL GROUP BY win),
     g AS (SELECT DISTINCT r, i + k AS p FROM s JOIN f USING (win), range({WINDOW}) AS t(k) WHERE owner < doc_id),
     n AS (SELECT r, count(*) AS gone, list(p) AS ps FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
                   ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN n USING (r)
"""
