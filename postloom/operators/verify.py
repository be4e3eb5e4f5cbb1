"""Comparison of two archives in normal forms: what a round trip may change is left out of account."""

from __future__ import annotations

from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ..functions import mail, normalise
from . import tables

HEADERS = ("sender", "recipient", "cc", "bcc")


def header(value: Column) -> Column:
    """White space as single spaces, none at the ends; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


@F.pandas_udf(StringType())
def address_list(values: pd.Series) -> pd.Series:
    """An address header as its sorted ``name <address>`` pairs; comments and quotes don't count."""

    def one(v: str | None) -> str | None:
        told = sorted((" ".join(n.split()), a.replace('"', "").lower()) for n, a in mail.people([mail.decoded(v)]) if a)
        return "; ".join(f"{n} <{a}>" for n, a in told) or None

    return values.map(one, na_action="ignore").astype(object)


@F.pandas_udf(LongType())
def date_ms(values: pd.Series) -> pd.Series:
    """A Date header as epoch milliseconds, null if it is none."""

    def one(v: str) -> int | None:
        try:
            return int(parsedate_to_datetime(v).timestamp() * 1000)
        except ValueError:
            return None

    return pd.Series([one(v) if v is not None else None for v in values], dtype="Int64")


def address_rows(messages: DataFrame) -> DataFrame:
    """(message_id, role, address, name) from the address headers that messages have, one for each
    role and address, the first name kept."""
    held = [(r, c) for r, c in zip(mail.ROLES, HEADERS, strict=True) if c in messages.columns]
    kind = pa.schema([(n, pa.string()) for n in ("message_id", "role", "address", "name")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                seen = set()
                for role, column in held:
                    for name, address in mail.people([mail.decoded(r[column])]) if r[column] else ():
                        key = address.strip().lower()
                        if key and (role, key) not in seen:
                            seen.add((role, key))
                            out.append({"message_id": r["id"], "role": role, "address": key, "name": name.strip() or None})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return messages.select("id", *[c for _, c in held]).mapInArrow(run, "message_id string, role string, address string, name string")


FORMS = {"subject": header, "body_text": lambda c: F.nullif(normalise.body(c), F.lit("")), "body_html": lambda c: F.nullif(normalise.html(c), F.lit("")), "date": date_ms} | dict.fromkeys(HEADERS, address_list)


def normal(messages: DataFrame, *more: str) -> DataFrame:
    """The columns of messages that messages have, in normal form, and more as they are."""
    same = [c for c in ("thread_id", "internal_date_ms", "body_mime_type") if c in messages.columns]
    return messages.select("id", *same, *[f(F.col(c)).alias(c) for c, f in FORMS.items() if c in messages.columns], *more)


def message_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, field, left_value, right_value) over the columns that both have."""
    both = [c for c in left.columns if c in right.columns]
    return tables.differences(normal(left.select(*both)), normal(right.select(*both)))


#: Copies of a row that are made at once.
COPIES = 4096


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with ``side``, as often as it has them more."""
    columns = left.columns
    both = left.withColumn("_n", F.lit(1)).unionByName(right.select(*columns).withColumn("_n", F.lit(-1)))
    more = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    told = more.withColumn("side", F.when(F.col("_n") > 0, "left").otherwise("right")).withColumn("_n", F.abs("_n"))
    each = told.withColumn("_k", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {COPIES}"))))
    return each.select(*columns, "side", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("_n") - F.col("_k") * COPIES).cast("int"))).alias("_k")).drop("_k")


def label_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, missing, extra) over (id, label_names)."""
    both = left.select("id", F.col("label_names").alias("_l")).join(right.select("id", F.col("label_names").alias("_r")), "id")
    return both.select("id", F.array_sort(F.array_except("_l", "_r")).alias("missing"), F.array_sort(F.array_except("_r", "_l")).alias("extra")).filter("size(missing) + size(extra) > 0")


def attachment_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(message_id, filename, content_id, n, field): the n-th attachments of the same trimmed name
    and Content-ID are compared by size and content hash; a lone one has the field ``<row>``."""
    key = ["message_id", "filename", "content_id"]

    def placed(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.select("message_id", F.coalesce(F.trim("filename"), F.lit("")).alias("filename"), F.coalesce("content_id", F.lit("")).alias("content_id"), "size", "content_sha256", *(["ord"] if "ord" in rows.columns else []))
        order = Window.partitionBy(*key).orderBy(*(["ord"] if "ord" in rows.columns else ["content_sha256", "size"]))
        return rows.withColumn("n", F.row_number().over(order)).select(*key, "n", F.struct("size", "content_sha256").alias(side))

    both = placed(left, "_l").join(placed(right, "_r"), [*key, "n"], "full_outer")
    lone = F.col("_l").isNull() | F.col("_r").isNull()
    field = F.when(lone, "<row>").when(~F.col("_l.content_sha256").eqNullSafe(F.col("_r.content_sha256")), "content").when(~F.col("_l.size").eqNullSafe(F.col("_r.size")), "size")
    return both.select(*key, "n", field.alias("field")).filter("field IS NOT NULL")


TRIED = ("sender", "recipient", "cc", "bcc", "body_text", "body_mime_type", "body_html", "internal_date_ms")


def mailbox_differences(sent: DataFrame, back: DataFrame, run_prefix: str) -> DataFrame:
    """(id, back_id, field, left_value, right_value) between messages (with ``label_names``) that were
    put into a mailbox and what was read back. Their ids differ, so they are paired by subject and
    time; a message without a pair has the field ``<row>``. The label of the run, told by its prefix,
    has to be the only one more."""
    held = [c for c in TRIED if c in sent.columns and c in back.columns]
    pairs = tables.pair_unique(sent, back, ["subject", "internal_date_ms"]).select(F.col("left_id").alias("id"), F.col("right_id").alias("_to"))
    left = sent.select("id", F.struct(*held, "label_names").alias("_l")).join(pairs, "id", "left")
    right = back.select(F.col("id").alias("back_id"), F.struct(*held, "label_names").alias("_r"))
    # A message without a pair has a key of its own, as null keys would all meet in one task.
    to = F.struct("_to", F.when(F.col("_to").isNull(), F.col("id")).otherwise("").alias("lone"))
    both = left.join(right, to == F.struct(F.col("back_id").alias("_to"), F.lit("").alias("lone")), "full_outer")
    # Normal forms only of values that differ as they stand.
    for c in held:
        same = F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) | F.col("_l").isNull() | F.col("_r").isNull()
        for side in ("_l", "_r"):
            both = both.withColumn(f"{side}_{c}", FORMS.get(c, lambda x: x)(F.when(~same, F.col(f"{side}.{c}"))))
    missing, extra = F.array_sort(F.array_except("_l.label_names", "_r.label_names")), F.array_sort(F.array_except("_r.label_names", "_l.label_names"))
    run = (F.size(missing) == 0) & (F.size(extra) == 1) & F.startswith(F.get(extra, F.lit(0)), F.lit(run_prefix))
    wrong = ((F.size(missing) + F.size(extra) > 0) & ~run) | (F.array_sort("_l.label_names") == F.array_sort("_r.label_names"))
    lone = F.col("_l").isNull() | F.col("_r").isNull()

    def told(field: str, left_value: Column, right_value: Column, differs: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), left_value.cast("string").alias("left_value"), right_value.cast("string").alias("right_value"), differs.alias("differs"))

    fields = [told(c, F.col(f"_l_{c}"), F.col(f"_r_{c}"), ~lone & ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))) for c in held]
    fields.append(told("labels", F.array_join(missing, ","), F.array_join(extra, ","), ~lone & wrong))
    fields.append(told("<row>", F.when(F.col("_l").isNotNull(), "present"), F.when(F.col("_r").isNotNull(), "present"), lone))
    return both.select("id", "back_id", F.inline(F.array(*fields))).filter("differs").drop("differs")


def tree_differences(left: DataFrame, right: DataFrame, run_prefix: str = "") -> DataFrame:
    """(id, field, left_value, right_value) between two trees of exported messages
    (``sources.mail.exported_tree`` with contents): headers, bodies, labels without those of a run, and
    attachments, inline ones included, by name, type and content."""

    def told(rows: DataFrame) -> DataFrame:
        files = F.array_join(F.array_sort(F.transform("attachments", lambda a: F.concat_ws("|", a["filename"], a["content_id"], a["mime_type"], F.sha2(a["content"], 256)))), ";")
        names = F.array_sort(F.filter("label_names", lambda n: ~F.startswith(n, F.lit(run_prefix)))) if run_prefix else F.array_sort("label_names")
        held = rows.select("id", "subject", "date", *HEADERS, "body_text", "body_html", files.alias("files"), F.array_join(names, ",").alias("labels"))
        return normal(held, "files", "labels")  # at once: the files are read and parsed for each use of rows

    return tables.differences(told(left), told(right))
