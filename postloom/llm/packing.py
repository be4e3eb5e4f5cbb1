"""Packing by minimum bin slack.

A document's ids (with the end id) are cut at every ``CAPACITY`` ids; whole pieces are sequences
of their own. What is left over has fewer than CAPACITY lengths, so all that the plan needs is
how many remainders have each length: a table of at most 4095 counts at any size of the corpus.

The plan fills one window at a time. The longest remaining length is set; a subset-sum table over
the other lengths (a Python integer as a bitset, one shift-or for each binary part of a count)
shows which fills are possible, and the fill with the least slack is traced back to counts. The
same choice is repeated as often as the counts allow, which uses up at least one length, so there
are at most as many choices as lengths.

Then every piece is numbered among those of its length (gapless, in hash cells, so that a length
that a third of all pieces share is no hot task) and reads its sequence and offset from the plan.

Nulls: a null text is an empty one (the end id alone); null doc_ids keep their pieces. Repeated
rows are packed as often as they occur. A text of any length is encoded as a whole, by one worker.
Pieces of equal length take their places by doc_id hash, start and row. An empty table gives an
empty result. Other columns are left aside.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import documents, number_rows, parts_for, rows_of, store
from .encoding import encoder, tokenizer_path

CAPACITY = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
CELL_ROWS = 50_000
#: Pieces whose ids a worker keeps between batches; workers outlive their stage, and later ones need the memory.
KEPT = 900_000
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
#: One of these for each length: the pieces numbered from ``first`` go to the sequences from
#: ``sequence``, ``times`` in each, from ``offset``.
Plan = dict[int, list[tuple[int, int, int, int]]]


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (no more of each than counts) whose sum is the nearest to room."""
    reach, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length) if length <= room else 0
        part = 1
        while left:
            k = min(part, left)
            after = reach | (reach << (k * length)) & limit
            if after != reach:
                steps.append((length, k, reach))
                reach = after
            left -= k
            part *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += k
            total -= k * length
    return chosen


def plan_of(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Plan, int]:
    """Where the pieces of each length go, and the number of sequences."""
    left, used, plan, sequences = {n: c for n, c in counts.items() if c}, Counter(), defaultdict(list), 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = best_fill({n: c for n, c in rest.items() if c}, capacity - longest)
        chosen[longest] += 1
        times = min(left[n] // k for n, k in chosen.items())
        offset = 0
        for n in sorted(chosen, reverse=True):
            k = chosen[n]
            plan[n].append((used[n], sequences, k, offset))
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
            offset += k * n
        sequences += times
    return dict(plan), sequences


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, kept: int = KEPT) -> DataFrame:
    """The pieces of every document, without their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, False, kept)
        end = np.array([end_id], enc.dtype).tobytes()
        for rows in rows_of(batches):
            out: list[tuple] = []
            for doc, ids in zip(rows["doc_id"], enc.ids(rows["text"]), strict=True):
                whole = np.frombuffer(ids + end, enc.dtype).astype("<u4")
                for at in range(0, len(whole), capacity):
                    part = whole[at : at + capacity]
                    out.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(whole)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``items`` (a stored table with a length from 1 to capacity and a
    uid that tells equal pieces apart)."""
    counts = {r[0]: r[1] for r in items.groupBy("length").count().collect()}
    plan, _ = plan_of(counts, capacity)
    cells = parts_for(sum(counts.values()), CELL_ROWS, 8)
    numbered = number_rows(items, ["length"], [F.lit(0), F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("uid")], "_number", cells)
    kept = [c for c in items.columns if c != "uid"]
    shared = items.sparkSession.sparkContext.broadcast(plan)  # at most capacity lists, as many entries as all choices have lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {n: [x[0] for x in entries] for n, entries in shared.value.items()}
        for batch in batches:
            sequence, offset = [], []
            for n, i in zip(batch.column("length").to_pylist(), batch.column("_number").to_pylist(), strict=True):
                first, base, times, at = shared.value[n][bisect_right(firsts[n], i) - 1]
                sequence.append(base + (i - first) // times)
                offset.append(at + (i - first) % times * n)
            yield pa.record_batch([*[batch.column(c) for c in kept], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*kept, "sequence_id", "offset"])

    kinds = [items.schema[c] for c in kept]
    return numbered.mapInArrow(run, StructType([*kinds, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, kept: int = KEPT) -> DataFrame:
    found = pieces(docs, path or tokenizer_path(VOCABULARY), END_ID, capacity, kept)
    return pack(store(found.withColumn("uid", F.monotonically_increasing_id()), "pieces"), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
