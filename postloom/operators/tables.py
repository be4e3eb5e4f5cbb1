"""Keyed tables as snapshots: last-writer-wins upsert, replacement by key, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_of_each(batch: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last row of each key in order of arrival; of rows from files that came at once, the one
    of the last path."""
    order = Window.partitionBy(key).orderBy(F.desc(seq), *([F.desc("path")] if "path" in batch.columns else []))
    return batch.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def upsert(current: DataFrame, batch: DataFrame, key: str = "id", keep: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """current with the batch's last rows put in. Columns in ``keep`` stay as first written. A batch
    known to have each key once (``unique``) isn't sorted for its last rows."""
    new = (batch if unique else last_of_each(batch, key)).drop("seq").withColumn("_new", F.lit(True))
    both = current.alias("c").join(new.alias("b"), key, "full_outer")
    pick = [
        F.coalesce(F.col(f"c.{c}"), F.col(f"b.{c}")).alias(c) if c in keep else F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"c.{c}")).alias(c)
        for c in current.columns
        if c != key
    ]
    return both.select(key, *pick)


def replace_rows(current: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """current with all rows of the given keys replaced by the new ones."""
    return current.join(keys.select(key), key, "left_anti").unionByName(new)


def insert_or_ignore(current: DataFrame, parts: list[DataFrame], key: str = "id") -> DataFrame:
    """current with the rows of the parts whose key it lacks; of a key that several parts have, the
    row of the first part (and of its least row, if it has the key twice) is taken."""
    tagged = [p.select(*current.columns).withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in current.columns if c != key]
    first = both.groupBy(key).agg(F.min(F.struct("_part", *rest)).alias("_first")).select(key, *[F.col("_first")[c].alias(c) for c in rest])
    return current.unionByName(first.join(current.select(key), key, "left_anti"))


def resume(candidates: DataFrame, ledger: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The next n candidates in key order that the ledger doesn't have."""
    return candidates.join(ledger.select(key), key, "left_anti").orderBy(key).limit(n)


def differences(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """(key, field, left_value, right_value) for each field that differs; a row that only one
    side has is the field ``<row>``."""
    fields = [c for c in left.columns if c != key]
    both = left.withColumn("_l", F.lit(True)).alias("l").join(right.withColumn("_r", F.lit(True)).alias("r"), key, "full_outer")
    told = [F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").cast("string").alias("left_value"), F.col(f"r.{f}").cast("string").alias("right_value"), (F.col("_l") & F.col("_r") & ~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}"))).alias("differs")) for f in fields]
    row = F.struct(F.lit("<row>").alias("field"), F.when(F.col("_l"), "present").alias("left_value"), F.when(F.col("_r"), "present").alias("right_value"), (F.col("_l").isNull() | F.col("_r").isNull()).alias("differs"))
    return both.select(key, F.inline(F.array(row, *told))).filter("differs").drop("differs")


def pair_unique(left: DataFrame, right: DataFrame, on: list[str], key: str = "id") -> DataFrame:
    """Pairs of rows whose fields ``on`` are equal (null equals null) and unique on either side."""

    def alone(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(name)).filter("_n = 1").drop("_n")

    a, b = alone(left, "left_id").alias("a"), alone(right, "right_id").alias("b")
    return a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on])).select("left_id", "right_id")
