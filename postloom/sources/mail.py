"""Mail archives as tables of nested message rows.

``mbox``: a Python data source over mbox stores (a file, a profile folder, or a ZIP of one). The
driver only lists stores; a task reads a byte range of a store (a ZIP member is one task), and a
message belongs to the range in which its From line begins. ``eml_tree``: EML files through
Spark's own binary reader. ``seq`` is the order of arrival, the same in every run.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import compose, mail
from ..functions.normalise import IGNORED

SCHEMA = (
    "id string, thread_id string, sender string, recipient string, cc string, bcc string, subject string, date string, internal_date_ms long, snippet string, label_ids string, "
    "body_text string, body_mime_type string, body_html string, addresses array<struct<role string, address string, name string>>, "
    "attachments array<struct<ord int, attachment_id string, filename string, mime_type string, size long, content_sha256 string, content_id string, content binary>>, seq long"
)
CHUNK = 64 << 20
#: seq of a message: the number of its store and the place of its From line there.
STORE_BITS = 42


def folder_of(path: str) -> str:
    """The folder that a store's path inside an archive stands for."""
    flat = path.replace("\\", "/")
    for prefix in ("Mail/", "ImapMail/"):
        if flat.startswith(prefix):
            flat = flat[len(prefix) :]
            break
    *above, last = flat.split("/")
    parts = [p[:-4] if p.lower().endswith(".sbd") else p for p in above]
    return "/".join(p for p in [*parts, last] if p)


def label_of(folder: str) -> str:
    return "thunderbird_folder:" + hashlib.sha1(folder.encode()).hexdigest()[:16]


def folder_labels(uri: str) -> list[tuple[str, str]]:
    """(id, name) of the labels that an archive's folders stand for."""
    return sorted({(label_of(s[2]), s[2]) for s in MboxReader({"path": uri}).stores()})


def is_store(path: str) -> bool:
    name = PurePosixPath(path).name
    return bool(name) and not name.startswith(".") and PurePosixPath(name).suffix.lower().lstrip(".") not in IGNORED


@dataclass
class Store(InputPartition):
    number: int
    path: str
    member: str
    folder: str
    start: int
    end: int


def whole(lines: list[bytes]) -> bytes:
    """A message without the blank line that parts it from the next."""
    return b"".join(lines[:-1] if lines and lines[-1] in (b"\n", b"\r\n") else lines)


def split_messages(lines: Iterator[bytes], at: int, start: int, end: int) -> Iterator[tuple[int, str, bytes]]:
    """(place, From line, message) of each message that begins from start to before end. The lines
    begin at ``at``. A From line counts at the top of a store or after a blank line."""
    place, head, held, blank = -1, "", [], at == 0
    for line in lines:
        if blank and line.startswith(b"From "):
            if place >= 0:
                yield place, head, whole(held)
                place = -1
            if at >= end:
                return
            if at < start:
                blank = False
                at += len(line)
                continue
            place, head, held = at, line[5:].decode("utf-8", "replace").strip(), []
        elif place >= 0:
            held.append(line)
        blank = line in (b"\n", b"\r\n")
        at += len(line)
    if place >= 0:
        yield place, head, whole(held)


#: Rows, and bytes of text and contents, of a batch.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def in_batches(rows: Iterator[dict], schema: StructType) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, which Spark takes as they are."""
    kind, held, size = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        size += len(row["body_text"] or "") + len(row["body_html"] or "") + sum(len(a["content"] or b"") for a in row["attachments"])
        if len(held) == BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=kind)


class MboxReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.content = options.get("withattachments", "false").lower() == "true"
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.chunk = int(options.get("chunk", CHUNK))

    def stores(self) -> list[tuple[str, str, str, int]]:
        """(path, member of a ZIP, folder, size) of each store, in the order of their folders."""
        store, root = fs.FileSystem.from_uri(self.uri)
        info = store.get_file_info(root)
        found: list[tuple[str, str, str, int]] = []
        if info.type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
                inner = f.path[len(root.rstrip("/")) + 1 :]
                if f.type == fs.FileType.File and is_store(inner):
                    found.append((f.path, "", folder_of(inner), f.size))
        else:
            with store.open_input_file(root) as file:
                if file.read(4) == b"PK\x03\x04":
                    file.seek(0)
                    for z in zipfile.ZipFile(file).infolist():
                        if not z.is_dir() and z.filename.startswith(("Mail/", "ImapMail/")) and is_store(z.filename):
                            found.append((root, z.filename, folder_of(z.filename), z.file_size))
                else:
                    found.append((root, "", PurePosixPath(root).name, info.size))
        return sorted(found, key=lambda x: (x[2], x[0]))

    def partitions(self) -> list[Store]:
        out = []
        for number, (path, member, folder, size) in enumerate(self.stores()):
            step = max(1, size) if member else self.chunk
            out += [Store(number, path, member, folder, at, min(size, at + step)) for at in range(0, size, step)]
        return out

    def read(self, part: Store | None) -> Iterator[tuple]:
        if part is None:  # no stores
            return
        store, _ = fs.FileSystem.from_uri(self.uri)
        with store.open_input_file(part.path) as file:
            if part.member:
                raw, at = zipfile.ZipFile(file).open(part.member), 0
            else:
                # Reading begins early enough to see a blank line before the first From line.
                at = max(0, part.start - 4)
                file.seek(at)
                raw = io.BufferedReader(file, 1 << 20)
                if at:
                    at += len(raw.readline())
            label = label_of(part.folder)
            for place, head, text in split_messages(raw, at, part.start, part.end):
                message = mail.parsed(text)
                for one in mail.with_inner(message) if self.recursive else (message,):
                    found = mail.row(one, label, part.number << STORE_BITS | place, from_line=head if one is message else "", content=self.content)
                    yield tuple(as_structs(found).values())


def as_structs(row: dict) -> dict:
    return row | {"addresses": [tuple(a.values()) for a in row["addresses"]], "attachments": [tuple(a.values()) for a in row["attachments"]]}


class MboxSource(DataSource):
    """``spark.read.format("mbox").load("file:///mail/profile")``; options withAttachments,
    recursive, chunk."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MboxReader({k.lower(): v for k, v in self.options.items()})


def mbox(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    spark.dataSource.register(MboxSource)
    return spark.read.format("mbox").options(**options).load(uri)


def eml_tree(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """The messages of a tree of EML files, with their ``path``, by which rows with one id are ordered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eml").load(path)

    kind = arrow_schema(SCHEMA + ", path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [mail.row(mail.parsed(raw), "", 0, prefix="eml:", content=content) | {"seq": 0, "path": p} for p, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return files.select("path", "content").mapInArrow(run, SCHEMA + ", path string")


def rows_back(files: DataFrame, prefix: str = compose.PREFIX, content: bool = False) -> DataFrame:
    """The rows, with ``label_names``, of EML bytes ``raw`` that ``export`` made. Files without an
    id header are left out."""
    ddl = SCHEMA + ", label_names array<string>, path string"
    kind = arrow_schema(ddl)
    files = files.select("raw", F.col("path") if "path" in files.columns else F.lit(None).cast("string").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pylist()
                rows = [(compose.read_back(mail.parsed(f["raw"]), prefix, content), f["path"]) for f in part]
                yield pa.RecordBatch.from_pylist([row | {"seq": 0, "path": p} for row, p in rows if row is not None], schema=kind)

    return files.mapInArrow(run, ddl)


def exported_tree(spark: SparkSession, path: str, prefix: str = compose.PREFIX, content: bool = False) -> DataFrame:
    """The messages of a tree that ``export.write_tree`` wrote."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eml").load(path)
    return rows_back(files.select("path", F.col("content").alias("raw")), prefix, content)


def label_ids_of(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``label_ids`` for their label names, and the labels that had to be made for it
    (``import-eml:`` and the name). Labels are few: AQE broadcasts them."""
    names = rows.select("id", F.posexplode("label_names").alias("pos", "name"))
    known = labels.groupBy("name").agg(F.min("id").alias("label_id"))
    told = names.join(known, "name", "left").withColumn("_new", F.col("label_id").isNull()).withColumn("label_id", F.coalesce("label_id", F.concat(F.lit("import-eml:"), "name")))
    ids = told.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label_id"))), lambda x: x["label_id"]), ",").alias("label_ids"))
    made = told.filter("_new").select(F.col("label_id").alias("id"), "name").distinct()
    return rows.drop("label_ids").join(ids, "id", "left").withColumn("label_ids", F.coalesce("label_ids", F.lit(""))), made


def detect(uri: str) -> str:
    """What a path holds: pst, thunderbird_pcv, thunderbird_profile, eml, msg, mbox or unknown; by
    its suffix, its first bytes, then the names inside."""
    store, root = fs.FileSystem.from_uri(uri)
    info = store.get_file_info(root)
    marks = ("Mail", "ImapMail", "prefs.js")
    if info.type == fs.FileType.Directory:
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(root))]
        return "thunderbird_profile" if any(n in marks or n.endswith(".sbd") for n in names) else "unknown"
    if info.type != fs.FileType.File:
        return "unknown"
    suffix = PurePosixPath(root).suffix.lower()
    with store.open_input_file(root) as file:
        magic = file.read(4)
        if suffix == ".pst" or magic == b"!BDN":
            return "pst"
        if magic == b"PK\x03\x04":
            file.seek(0)
            if any(n.startswith(("Mail/", "ImapMail/")) or n.endswith(".sbd") or n == "prefs.js" for n in zipfile.ZipFile(file).namelist()):
                return "thunderbird_pcv"
    return suffix[1:] if suffix in (".eml", ".msg", ".mbox") else "unknown"


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))
