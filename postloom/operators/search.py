"""Full-text search: postings, boolean matching by joins, BM25 ranking, snippets of the hits.

The segments of a stored index are sorted by term, so a search reads the row groups of its terms alone,
and it keeps each row's length and their sum, so nothing but hits is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.query import Both, Near, Phrase, understood
from ..functions.snippet import snippet
from ..functions.terms import COLUMNS, postings

K1, B = 1.2, 0.75


@dataclass
class Index:
    """Postings (id, col, pos, term), lengths (id, dl) if they are kept, and the numbers of rows and of postings."""

    postings: DataFrame
    lengths: DataFrame | None
    rows: int
    total: int

    def lengths_of(self, ids: DataFrame) -> DataFrame:
        """The number of terms of each id."""
        if self.lengths is not None:
            return self.lengths
        return self.postings.join(ids, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("dl"))


#: Characters of text in a segment of the index, and bytes of its row groups.
SEGMENT, GROUP = 32_000_000, 8 << 20


def build(rows: DataFrame, folder: str) -> Index:
    """Writes the index of rows below a folder, as segments: each holds all postings of some rows,
    sorted by term, so terms are found once and only texts are dealt out. A search reads the row
    groups of its terms in every segment."""
    held = rows.select("id", *[c for c in COLUMNS if c in rows.columns])
    size = reduce(lambda a, b: a + b, [F.coalesce(F.length(c), F.lit(0)) for c in held.columns[1:]], F.lit(0)).cast("long")
    n, chars = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    segments = max(rows.sparkSession.sparkContext.defaultParallelism, -(-chars // SEGMENT))
    told = postings(held.repartition(segments, "id")).sortWithinPartitions("term")
    told.write.option("parquet.block.size", GROUP).parquet(f"{folder}/postings")
    found = rows.sparkSession.read.parquet(f"{folder}/postings")
    found.groupBy("id").agg(F.count(F.lit(1)).alias("dl")).write.parquet(f"{folder}/lengths")
    return Index(found, rows.sparkSession.read.parquet(f"{folder}/lengths"), n, found.count())


def index_of(rows: DataFrame, held: DataFrame | Index | None) -> Index:
    """An index as it is, of kept postings, or made on the way."""
    if isinstance(held, Index):
        return held
    found = held if held is not None else postings(rows)
    return Index(found, None, rows.count(), found.count())


def phrase_hits(index: DataFrame, p: Phrase) -> DataFrame:
    """(id, col, pos): where a phrase begins. Each term is a filter on ``term`` that reaches the
    scan; terms of a phrase are joined on their places."""
    out = None
    for i, term in enumerate(p.terms):
        same = F.col("term").startswith(term) if p.prefix and i == len(p.terms) - 1 else F.col("term") == term
        rows = index.filter(same & F.col("col").isin(*p.columns)).select("id", "col", (F.col("pos") - i).alias("pos")).distinct()
        out = rows if out is None else out.join(rows, ["id", "col", "pos"], "left_semi")
    if out is None or not p.columns:
        out = index.filter("false").select("id", "col", "pos")
    return out.filter("pos = 0") if p.first else out


def near_hits(index: DataFrame, n: Near) -> list[DataFrame]:
    """The hits of each phrase that has the others within the distance."""
    found = [phrase_hits(index, p) for p in n.phrases]
    sizes = [len(p.terms) for p in n.phrases]
    joined = reduce(lambda a, b: a.join(b, ["id", "col"]), [h.withColumnRenamed("pos", f"p{i}") for i, h in enumerate(found)])
    starts = F.greatest(*[F.col(f"p{i}") for i in range(len(found))]) if len(found) > 1 else F.col("p0")
    ends = F.least(*[F.col(f"p{i}") + s for i, s in enumerate(sizes)]) if len(found) > 1 else F.col("p0")
    close = joined.filter(starts - ends <= n.distance)
    return [close.select("id", "col", F.col(f"p{i}").alias("pos")).distinct() for i in range(len(found))]


def matches(index: DataFrame, node: object) -> tuple[DataFrame, list[DataFrame]]:
    """The ids that a query matches, and the hits of each of its phrases that count for the rank."""
    if isinstance(node, Phrase):
        hits = phrase_hits(index, node)
        return hits.select("id").distinct(), [hits]
    if isinstance(node, Near):
        hits = near_hits(index, node)
        return hits[0].select("id").distinct(), hits
    assert isinstance(node, Both)
    (a, x), (b, y) = matches(index, node.left), matches(index, node.right)
    if node.kind == "NOT":
        return a.join(b, "id", "left_anti"), x
    if node.kind == "OR":
        return a.union(b).distinct(), x + y
    return a.join(b, "id", "left_semi"), x + y


def ranked(index: Index, text: str) -> DataFrame:
    """(id, rank): matching rows with their BM25 rank; the more negative, the better. Every phrase
    of the query counts, a repeated one again, by its hits in its columns; a row's length is that
    of all its columns."""
    ids, phrases = matches(index.postings, understood(text))
    parts = []
    for hits in phrases:
        tf = hits.groupBy("id").agg(F.count(F.lit(1)).alias("tf"))
        parts.append(tf.crossJoin(F.broadcast(tf.agg(F.count(F.lit(1)).alias("df")))))  # one row on the right
    each = reduce(DataFrame.unionByName, parts).join(ids, "id", "left_semi").join(index.lengths_of(ids), "id")
    idf = F.greatest(F.log((F.lit(index.rows) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / (index.total / max(1, index.rows)))
    return each.groupBy("id").agg((-F.sum(idf * F.col("tf") * (K1 + 1) / norm)).alias("rank"))


def search(rows: DataFrame, text: str, limit: int = 20, index: DataFrame | Index | None = None) -> DataFrame:
    """The best rows for a query, ties by id. 0 means the default limit, a negative one none."""
    understood(text)
    found = ranked(index_of(rows, index), text)
    return found if limit < 0 else found.orderBy("rank", "id").limit(limit or 20)


#: Tokens shown of each column.
SHOWN = {"subject": 15, "body_text": 25}


def results(rows: DataFrame, text: str, limit: int = 20, index: DataFrame | Index | None = None) -> DataFrame:
    """The best rows with what a reader sees: (id, rank, shown_date, shown_subject, subject_snippet,
    body_text_snippet). Only hits are cut into snippets."""
    node = understood(text)
    found = search(rows, text, limit, index)
    held = [c for c in SHOWN if c in rows.columns]
    dates = [c for c in ("internal_date_ms", "date") if c in rows.columns]
    hits = rows.select("id", *held, *dates).join(found, "id")
    told = [f"{c}_snippet" for c in held]
    kind = pa.schema([("id", pa.string()), *[(t, pa.string()) for t in told]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [[snippet(t, node, c, SHOWN[c]) for t in batch.column(c).to_pylist()] for c in held]
            yield pa.record_batch([batch.column("id").cast(pa.string()), *[pa.array(c, pa.string()) for c in cut]], schema=kind)

    cut = hits.select("id", *held).mapInArrow(run, ", ".join(f"{f.name} string" for f in kind))
    when = [F.when(F.coalesce("internal_date_ms", F.lit(0)) != 0, F.date_format(F.timestamp_millis("internal_date_ms"), "yyyy-MM-dd HH:mm:ss 'UTC'"))] if "internal_date_ms" in dates else []
    when += [F.col("date")] if "date" in dates else []
    titles = [F.nullif(F.col(c), F.lit("")) for c in ("subject_snippet", "subject") if c in held or c in told]
    out = hits.join(cut, "id").select("id", "rank", F.coalesce(*when, F.lit("Unknown date")).alias("shown_date"), F.coalesce(*titles, F.lit("(No Subject)")).alias("shown_subject"), *told)
    return out.orderBy("rank", "id") if limit >= 0 else out
