"""Messages as files of a tree: where they go, what they hold, and how sizes and types are shown."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compose
from .filters import Mail, label_rows

UNSAFE = r'[/\\:*?"<>|]'
LONGEST = 120
#: Main types whose attachments keep their own type, and units of size.
KEPT_TYPES = ("image", "audio", "video", "application")
#: Bytes of messages in a batch.
BATCH_BYTES = 4 << 20
UNITS = ("B", "KB", "MB", "GB")


def bucket(ms: Column) -> Column:
    """YYYY/MM in UTC; a null or zero time is unknown."""
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "unknown").otherwise(F.date_format(F.timestamp_millis(ms), "yyyy/MM"))


def safe_name(key: Column) -> Column:
    return F.when(F.length(key) > LONGEST, F.sha2(key, 256)).otherwise(F.regexp_replace(key, UNSAFE, "_"))


def manifest(messages: DataFrame, suffix: str = ".md") -> DataFrame:
    return messages.select("id", bucket(F.col("internal_date_ms")).alias("bucket"), F.concat(safe_name(F.col("id")), F.lit(suffix)).alias("file"))


def shown_size(size: Column) -> Column:
    out = F.format_string(f"%.1f {UNITS[-1]}", size / float(1024 ** (len(UNITS) - 1)))
    for i in range(len(UNITS) - 2, -1, -1):
        out = F.when(size < 1024 ** (i + 1), F.format_string(f"%.1f {UNITS[i]}", size / float(1024**i))).otherwise(out)
    return out


def lossless_type(mime: Column) -> Column:
    """Text would be recoded on the way, so anything but the kept types travels as bytes."""
    part = F.split(F.coalesce(mime, F.lit("")), "/", 2)
    kept = part[0].isin(*KEPT_TYPES) & (F.coalesce(F.get(part, F.lit(1)), F.lit("")) != "")
    return F.when(kept, mime).otherwise("application/octet-stream")


def nested_attachments(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Each message with its attachments as an ordered list (empty if none)."""
    each = attachments.groupBy(F.col("message_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("filename", "mime_type", "size"))).alias("attachments"))
    return messages.select("id").join(each, "id", "left").withColumn("attachments", F.coalesce("attachments", F.array().cast(each.schema["attachments"].dataType)))


NESTED = "array<struct<filename string, mime_type string, size long, content_sha256 string, content_id string, content binary>>"
FIELDS = ("id", "thread_id", "sender", "recipient", "cc", "bcc", "subject", "date", "internal_date_ms", "body_text", "body_mime_type", "body_html")


def candidates(mail: Mail, blobs: DataFrame | None = None) -> DataFrame:
    """Each message with its label names in order and its attachments, ready to be written. Columns
    that the messages lack are null. ``blobs`` (content_sha256, content) gives contents."""
    held = mail.messages
    names = label_rows(held, mail.labels).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("label_names"))
    files = mail.attachments
    if blobs is not None and "content" not in files.columns:
        files = files.join(blobs.select("content_sha256", "content").dropDuplicates(["content_sha256"]), "content_sha256", "left")
    order = ["ord"] if "ord" in files.columns else []
    fields = ["filename", "mime_type", "size", "content_sha256", "content_id", "content"]
    each = F.struct(*order, *[F.col(c) if c in files.columns else F.lit(None).cast("binary" if c == "content" else "string").alias(c) for c in fields])
    nested = files.groupBy(F.col("message_id").alias("id")).agg(F.array_sort(F.collect_list(each)).alias("_a"))
    rows = held.select(*[F.col(c) if c in held.columns else F.lit(None).cast("string").alias(c) for c in FIELDS]).withColumn("internal_date_ms", F.col("internal_date_ms").cast("long"))
    rows = rows.join(names, "id", "left").join(nested, "id", "left")
    list_of = F.transform("_a", lambda a: F.struct(*[a[c].alias(c) for c in fields])).cast(NESTED)
    return rows.withColumn("label_names", F.coalesce("label_names", F.array().cast("array<string>"))).withColumn("attachments", F.coalesce(list_of, F.array().cast(NESTED))).drop("_a")


def as_eml(rows: DataFrame, prefix: str = compose.PREFIX) -> DataFrame:
    """(id, label_names, raw): the candidates as EML bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for r in batch.to_pylist():
                held.append({"id": r["id"], "label_names": r["label_names"], "raw": compose.eml(r, r["label_names"], r["attachments"], prefix)})
                size += len(held[-1]["raw"])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=kind)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=kind)

    kind = pa.schema([("id", pa.string()), ("label_names", pa.list_(pa.string())), ("raw", pa.binary())])
    return rows.mapInArrow(run, "id string, label_names array<string>, raw binary")


def write_tree(rows: DataFrame, uri: str, form: str = "eml", prefix: str = compose.PREFIX) -> DataFrame:
    """Writes each candidate as ``YYYY/MM/<id>.eml`` or ``.md`` below a URI and returns (id, path,
    size). The plan runs when the result does. A task that runs again writes the same files again;
    Markdown gets its attachments' contents in a folder beside it, equal names one after another."""
    if form not in ("eml", "md"):
        raise ValueError(f"unknown form {form!r}")
    placed = rows.withColumn("_file", F.concat_ws("/", bucket(F.col("internal_date_ms")), safe_name(F.col("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)

        made: set[str] = set()

        def put(path: str, data: bytes) -> None:
            if (at := path.rpartition("/")[0]) not in made:
                store.create_dir(at, recursive=True)
                made.add(at)
            with store.open_output_stream(path) as out:
                out.write(data)

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                data = compose.eml(r, r["label_names"], r["attachments"], prefix) if form == "eml" else compose.markdown(r, r["label_names"], r["attachments"])
                put(f"{root}/{r['_file']}.{form}", data)
                for a in r["attachments"] if form == "md" else ():
                    if a["content"] is not None:
                        name = re.sub(UNSAFE, "_", a["filename"] or "attachment")
                        name = name if len(name) <= LONGEST and name not in (".", "..") else hashlib.sha256(name.encode()).hexdigest()
                        put(f"{root}/{r['_file']}.attachments/{name}", a["content"])
                done.append({"id": r["id"], "path": f"{r['_file']}.{form}", "size": len(data)})
            yield pa.RecordBatch.from_pylist(done, schema=kind)

    kind = pa.schema([("id", pa.string()), ("path", pa.string()), ("size", pa.int64())])
    return placed.mapInArrow(run, "id string, path string, size long")
