"""Mail archives made of the driver's tables, for the queries that read them back.

They are written below the folder that the cluster shares and go when the driver ends. Writing is
spread like the rows are, except for a personal folder file, which one process writes (of ``nation``,
whose 25 rows don't grow).
"""

from __future__ import annotations

import base64
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import format_datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.api import drawer
from ..sources.pst_writer import Writer

#: Seconds of the first message, and the stores of a folder.
START, STORES = 1_700_000_000, 8
#: FILETIME of START.
FILETIME = 116444736000000000 + START * 10**7


def folder(spark: SparkSession, kind: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them see")
        base = "file://" + tempfile.mkdtemp(prefix="postloom-")
    path = f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def put(uri: str, data: bytes, below: str = "") -> None:
    """Writes a file, at a path below the URI if one is given (a path may hold what a URI can't)."""
    store, path = fs.FileSystem.from_uri(uri)
    path += below
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks, some for each core: a small table is a single task otherwise."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def each(rows: DataFrame, write: Callable[[dict], None]) -> int:
    """Calls write for every row, where the rows are; their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                write(row)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def b64(text: str) -> str:
    return base64.encodebytes(text.encode()).decode()


def store_message(doc_id: int, text: str) -> bytes:
    """A document as a message of an mbox store: every third has its time in the From line alone,
    every second is plain 8-bit text, every fourth has an attachment; the sender's name breaks
    the address grammar."""
    when = datetime.fromtimestamp(START + 60 * doc_id, tz=UTC)
    heads = [
        f"From - {when:%a %b %d %H:%M:%S %Y}", f"Message-ID: <doc{doc_id}@x.example>", f"Subject: =?utf-8?B?{base64.b64encode(f'Dokument é {doc_id}'.encode()).decode()}?=",
        f"From: Doe, J (x) [y] @z <Doc{doc_id}@Mail.example>", f"To: a{doc_id % 7}@b.example, Plain Name <p@q.example>, A{doc_id % 7}@B.example",
    ]
    if doc_id % 3:
        heads.append(f"Date: {format_datetime(when)}")
    plain = doc_id % 2 == 1 and "\r" not in text and "From " not in text
    body = ["Content-Type: text/plain; charset=utf-8", f"Content-Transfer-Encoding: {'8bit' if plain else 'base64'}", "", text if plain else b64(text)]
    if doc_id % 4:
        lines = heads + body
    else:
        rows = ["Content-Type: text/csv", "Content-Transfer-Encoding: base64", "Content-Disposition: attachment; filename=rows.csv", "", b64(f"n,{doc_id}\n")]
        lines = [*heads, "Content-Type: multipart/mixed; boundary=cut-here", "", "--cut-here", *body, "--cut-here", *rows, "--cut-here--"]
    return ("\n".join(lines) + "\n\n").encode()


def write_profile(docs: DataFrame, uri: str) -> None:
    """documents as the stores of a mail profile, STORES for each source."""
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", F.pmod("doc_id", F.lit(STORES)).alias("store"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        key, out = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["source"], r["store"]) != key:
                    if out:
                        out.close()
                    key = r["source"], r["store"]
                    at = f"{root}/Mail/Local Folders/{key[0]}.sbd"
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(f"{at}/{key[1]}")
                out.write(store_message(r["doc_id"], r["text"]))
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])
        if out:
            out.close()

    kept.repartition("source", "store").sortWithinPartitions("source", "store", "doc_id").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    put(uri, b"From - \n", "/Mail/Local Folders/skipped.msf")
    put(uri, b"", "/prefs.js")


def api_message(key: int, name: str, nation: int, segment: str, text: str, prefix: str = "c") -> dict:
    def part(kind: str, body: str) -> dict:
        return {"mimeType": kind, "body": {"data": base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")}}

    heads = {"From": f"{name} <{name.lower().replace('#', '.')}@{segment}.example>", "To": f"n{nation}@x.example, N{nation}@X.example", "Subject": f"Account {key}"}
    return {
        "id": f"{prefix}{key}", "threadId": f"t{nation}", "internalDate": str((START + key) * 1000), "labelIds": [segment, "INBOX"], "snippet": text[:9],
        "payload": {"mimeType": "multipart/alternative", "headers": [{"name": k, "value": v} for k, v in heads.items()], "parts": [part("text/plain", text), part("text/html", f"<p>{text}</p>")]},
    }


def write_box(customers: DataFrame, uri: str, word: str, prefix: str = "c") -> None:
    """customer as the messages of a recorded mailbox, by as many tasks as there are cores, however few
    files the table has."""
    rows = customers.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        made = set()
        for batch in batches:
            for r in batch.to_pylist():
                key = f"{prefix}{r['c_custkey']}"
                at = f"{root}/messages/{drawer(key)}"
                if at not in made:
                    store.create_dir(at, recursive=True)
                    made.add(at)
                with store.open_output_stream(f"{at}/{key}.json") as out:
                    out.write(json.dumps(api_message(r["c_custkey"], r["c_name"], r["c_nationkey"], r["c_mktsegment"], f"{word} ÿ {r['c_custkey']}", prefix)).encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    spread(rows).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def personal_folders(nations: list[tuple[int, str, int]]) -> bytes:
    """nation as a personal folder file: a folder for each region."""
    w, text, raw = Writer(), 0x1F, 0x102
    ids = {n: 0x200004 + 32 * i for i, (n, _, _) in enumerate(nations)}
    regions = sorted({r for *_, r in nations})
    w.nodes[0x122] = w.properties({0x3001: (text, "")})
    w.nodes[0x12D] = w.table_of([(0x67F2, 3)], [(0x1002 + 32 * r,) for r in regions])
    for r in regions:
        w.nodes[0x1002 + 32 * r] = w.properties({0x3001: (text, f"Region {r}")})
        w.nodes[0x100E + 32 * r] = w.table_of([(0x67F2, 3)], [(ids[n],) for n, _, region in nations if region == r])
    for n, name, _ in nations:
        people = w.table_of([(0x67F2, 3), (0x0C15, 3), (0x3001, text), (0x39FE, text)], [(1, 1, "To É", f"To{n}@X.example"), (2, 2, "", f"cc{n}@x.example")])
        file = w.properties({0x370E: (text, "text/csv"), 0x3707: (text, f"{name}.csv"), 0x3701: (raw, f"n,{n}\n".encode()), 0x0E20: (3, 0)})
        files = w.table_of([(0x67F2, 3)], [(0x8005,)])
        props = {0x0037: (text, f"\x01\x05Re: {name}"), 0x1000: (text, f"Body é of {name}"), 0x0039: (0x40, FILETIME + n * 10**7), 0x0C1A: (text, f"{name.lower()}@who.example" if n % 2 else name), 0x1035: (text, f"<n{n}@x>")}
        w.nodes[ids[n]] = w.properties(props | ({} if n % 2 else {0x0C1F: (text, f"{name}@Where.example")}), {0x692: people, 0x671: files, 0x8005: file})
    return w.file()
