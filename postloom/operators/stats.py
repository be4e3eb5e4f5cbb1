"""Summary statistics over the mail model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import Mail

TOP = 15


def summary(messages: DataFrame) -> DataFrame:
    """Counts of messages and threads, and the first and the last time of sending and of fetching (UTC)."""
    fetched = F.col("fetched_at") if "fetched_at" in messages.columns else F.lit(None).cast("timestamp")
    shown = [F.date_format(f(fetched), "yyyy-MM-dd HH:mm:ss").alias(n) for n, f in (("first_fetched", F.min), ("last_fetched", F.max))]
    return messages.agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("thread_id").alias("threads"), F.min("internal_date_ms").alias("first_ms"), F.max("internal_date_ms").alias("last_ms"), *shown)


def top_labels(messages: DataFrame, labels: DataFrame, n: int = TOP) -> DataFrame:
    """Counted by id, cut, and only then given names."""
    counts = messages.filter("label_ids <> ''").select(F.explode(F.split("label_ids", ",")).alias("label_id")).groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "label_id").limit(n)
    return top.join(labels.withColumnRenamed("id", "label_id"), "label_id", "left").select("label_id", F.coalesce("name", "label_id").alias("name"), "n")


def per_folder(messages: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, n) for each label, and their total in a row whose name is null."""
    each = messages.filter("label_ids <> ''").select(F.explode(F.split("label_ids", ",")).alias("label_id")).groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
    named = each.join(labels.withColumnRenamed("id", "label_id"), "label_id", "left").select(F.coalesce("name", "label_id").alias("name"), "n")
    return named.rollup("name").agg(F.sum("n").alias("n"))


def top_addresses(addresses: DataFrame, role: str, n: int = TOP) -> DataFrame:
    counts = addresses.filter(F.col("role") == role).groupBy("address").agg(F.max("name").alias("name"), F.count(F.lit(1)).alias("n"))
    shown = F.when(F.coalesce("name", F.lit("")) != "", F.format_string("%s <%s>", "name", "address")).otherwise(F.col("address"))
    return counts.orderBy(F.desc("n"), "address").limit(n).select("address", shown.alias("shown"), "n")


def attachments(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("attachments"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def of(mail: Mail, messages: DataFrame) -> Mail:
    """The mail tables reduced to some messages."""
    ids = messages.select(F.col("id").alias("message_id"))
    return Mail(messages, mail.labels, mail.addresses.join(ids, "message_id", "left_semi"), mail.attachments.join(ids, "message_id", "left_semi"))
