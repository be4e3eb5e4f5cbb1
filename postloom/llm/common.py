"""Helpers that the training-data operators share.

``shared_dir`` and ``store`` cut lineage in the folder that the cluster shares, ``number_rows``
gives gapless numbers inside groups of any size, ``spread_join`` brings one row for each key to any
number of rows, ``connected`` finds connected components with joins only, and ``rows_of`` walks
Arrow batches in small slices so that a batch of very long texts doesn't need several copies of
itself in a Python worker.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a Python worker holds as Python objects at once.
SLICE = 256
#: Tasks over which the rows of one key are dealt.
SALTS = 32
#: Spark deletes an execution's shuffle files when it ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where none is set and all runs on one machine (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    held = jsc.getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not jsc.isLocal():
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them see")
        named = "file://" + tempfile.mkdtemp(prefix="postloom-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path under the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def store(df: DataFrame, kind: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, a lost executor
    costs a re-read instead of a recomputation, and the shuffle files of the step are deleted."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def folders_of(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def delete(spark: SparkSession, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        for folder in folders_of(df):
            delete(df.sparkSession, folder)


#: Tables that ``store`` wrote, by application.
_stored: dict[str, list[str]] = {}


def release(docs: DataFrame) -> DataFrame:
    """Deletes all tables stored so far but those that docs itself reads. For the beginning of a
    stage whose input was written: what made it isn't read again."""
    spark = docs.sparkSession
    held = _stored.pop(spark.sparkContext.applicationId, [])
    kept = {f.rstrip("/").rpartition("/")[2] for f in folders_of(docs)} if held else set()
    for path in held:
        if path.rpartition("/")[2] not in kept:
            delete(spark, path)
    _stored[spark.sparkContext.applicationId] = [p for p in held if p.rpartition("/")[2] in kept]
    return docs


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(batches: Iterator[pa.RecordBatch], binary: tuple[str, ...] = ()) -> Iterator[dict[str, list]]:
    """Slices of at most SLICE rows as lists by column. ``binary`` columns of strings come as
    their UTF-8 bytes, without a pass through ``str``."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield {
                name: (part.column(i).cast(pa.binary()) if name in binary else part.column(i)).to_pylist()
                for i, name in enumerate(part.schema.names)
            }


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-rows // per_part))


def number_rows(df: DataFrame, by: list[str], order: list[Column], name: str, buckets: int) -> DataFrame:
    """Numbers the rows of each group of ``by`` from 0 without gaps, in the order of the first
    ``order`` column (few distinct values, or none) and then of hash buckets.

    A group may hold any share of the rows: its rows are dealt over ``buckets`` hash buckets,
    only (group, bucket) counts are summed over a window, and rows are numbered inside their
    bucket. Ties are broken by all columns given in ``order``.
    """
    cells = [*by, "_rank", "_cell"]
    lead, *rest = order
    dealt = df.withColumns({"_rank": lead, "_cell": F.pmod(F.xxhash64(*rest), F.lit(buckets)).cast("int")})
    before = Window.partitionBy(*by).orderBy("_rank", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*cells).orderBy(*rest)
    numbered = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    joined = numbered.join(offsets, cells)
    return joined.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_rank", "_cell", "_before", "_at")


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows joined with ``one``, which has at most a row for each key. A key may have any share of
    the rows: they are dealt over SALTS tasks by ``by``, and its one row goes to those of them that
    have some."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    told = dealt.select(*keys, "_salt").distinct().join(one, keys)
    return dealt.join(told, [*keys, "_salt"]).drop("_salt")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root the smallest node.

    Large-star and small-star passes in turn. Each pass is one minimum per node (combined before
    the shuffle) and one equi-join over salted nodes, so a hub's neighbours are never gathered
    anywhere. Links stay on the executors; the driver sees two sums.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.filter("a != b").distinct()

    def least(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links with their salt, and for each (a, salt) of them the least b of a."""
        dealt = df.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
        cells = dealt.groupBy("a", "salt").agg(F.min("b").alias("m"))
        found = cells.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
        return dealt, found

    def large(df: DataFrame) -> DataFrame:
        dealt, found = least(df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        told = found.select("a", F.least("m", "a").alias("m"), F.explode("salts").alias("salt"))
        return tidy(dealt.join(told, ["a", "salt"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small(df: DataFrame) -> DataFrame:
        dealt, found = least(df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        moved = dealt.join(found.select("a", "m", F.explode("salts").alias("salt")), ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return tidy(moved.unionByName(found.select("a", F.col("m").alias("b"))))

    def seen(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = store(small(large(edges.select("a", "b"))), "links")
    was = None
    for _ in range(rounds):
        mark = seen(now)
        if mark == was or not mark[0]:
            break
        was, before = mark, now
        now = store(small(large(now)), "links")
        drop(before)
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
