"""Token ids in Arrow stream files of fixed-size lists.

A file is an Arrow IPC stream. Each record batch but the last holds ``BATCH`` sequences of
``LENGTH`` ids: column ``ids`` is a fixed-size list of unsigned integers, column ``mask`` a
fixed-size list of booleans that are false on the padding at the end of a file. As all batches
have the same layout, sequence i is row i mod BATCH of batch i div BATCH, and on a memory map
both columns are views of the file: no copy is made to reach any sequence. A second stream beside
it says which document begins where (doc_id, start, n_tokens, positions in the file's stream).

Rows are dealt by ranges of (doc_id, hash of the text, row), so that one doc_id or null may have any
number of rows; a task writes a file for each ``FILE_ROWS`` documents of its range, under names of
its own try. The table of the names that tasks reported is the dataset, so a lost or repeated task
leaves nothing in it. A file's place in the whole stream is the sum of the sizes before it.

Nulls: a null text is an empty one, a null doc_id comes first. Empty texts: the end id alone.
Repeated rows are written as often as they occur, rows with equal doc_ids in the order of their
texts' hashes. A text of any length is encoded as a whole, by one worker, and its sequences go out
as they fill. An empty table gives no files. Other columns are left aside.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_folder, parts_for, rows_of, store
from .encoding import encoder, tokenizer_path

LENGTH = 2048
BATCH = 64
FILE_ROWS = 8192
VOCABULARY = "byte_bpe_50k.json"
MANIFEST = "part int, number int, file string, n_docs long, n_tokens long"
#: Rows of a range on average at most.
RANGE_ROWS = 65_536


def in_ranges(rows: DataFrame, descending: bool = False) -> DataFrame:
    """rows(doc_id, text) in sorted partitions that follow each other by doc_id (null first, or last
    if descending), then by the texts' hashes, then as they were read."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(rows.count(), RANGE_ROWS))
    told = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    first = F.col("doc_id").desc_nulls_last() if descending else F.col("doc_id").asc_nulls_first()
    order = [first, F.col("_hash"), F.col("_row")]
    return told.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_hash", "_row")


class StreamFile:
    """Writes one token file and its index."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int = LENGTH, batch: int = BATCH) -> None:
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.path = f"{root}/{name}.arrow"
        self.length, self.batch, self.dtype = length, batch, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.places = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [self.store.open_output_stream(p) for p in (self.path, f"{self.path}.index")]
        self.data = pa.ipc.new_stream(self.files[0], self.schema)
        self.index = pa.ipc.new_stream(self.files[1], self.places)
        self.held: list[bytes] = []
        self.size = self.tokens = self.docs = 0

    def add(self, doc_ids: list[int | None], ids: list[bytes]) -> None:
        sizes = [len(x) // self.dtype.itemsize for x in ids]
        starts = self.tokens + np.cumsum([0, *sizes[:-1]])
        self.index.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=self.places))
        self.held += ids
        self.size += sum(map(len, ids))
        self.tokens += sum(sizes)
        self.docs += len(ids)
        full = self.length * self.batch * self.dtype.itemsize
        if self.size >= full:
            rest = b"".join(self.held)
            cut = len(rest) // full * full
            for at in range(0, cut, full):
                self.put(np.frombuffer(rest, self.dtype, self.length * self.batch, at))
            self.held, self.size = [rest[cut:]], len(rest) - cut

    def put(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        held = np.zeros(rows * self.length, self.dtype)
        held[: len(ids)] = ids
        mask = np.arange(rows * self.length) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (held, mask)]
        self.data.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            self.put(np.frombuffer(b"".join(self.held), self.dtype))
        for x in (self.data, self.index, *self.files):
            x.close()


class TokenFile:
    """Random access to the sequences of a token file; zero-copy if the file can be mapped, else
    (in a remote store) the file, of FILE_ROWS documents, is held."""

    def __init__(self, uri: str) -> None:
        self.store, self.path = fs.FileSystem.from_uri(uri)
        source = pa.memory_map(self.path) if isinstance(self.store, fs.LocalFileSystem) else self.store.open_input_file(self.path)
        self.batches = list(pa.ipc.open_stream(source))
        self.batch = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        row = self.batches[i // self.batch], i % self.batch
        return row[0].column("ids")[row[1]].values.to_numpy(zero_copy_only=True), row[0].column("mask")[row[1]].values

    def stream(self, start: int, n: int) -> bytes:
        """n ids from a place of the file's stream."""
        if not n:
            return b""
        length = self.batches[0].column("ids").type.list_size
        per = length * self.batch
        out = []
        for k in range(start // per, (start + n - 1) // per + 1):
            flat = self.batches[k].column("ids").values.to_numpy(zero_copy_only=True)
            out.append(flat[max(0, start - k * per) : start + n - k * per].tobytes())
        return b"".join(out)

    def documents(self) -> Iterator[pa.RecordBatch]:
        with self.store.open_input_file(f"{self.path}.index") as source:
            yield from pa.ipc.open_stream(source)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 0, spaced: bool = True, file_rows: int = FILE_ROWS) -> DataFrame:
    """Writes the token files of docs(doc_id, text) under folder; returns their table."""
    ordered = in_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, out = encoder(path, spaced), TaskContext.get().partitionId(), None
        end = np.array([end_id], enc.dtype).tobytes()
        done: list[StreamFile] = []
        for rows in rows_of(batches):
            ids, at = [x + end for x in enc.ids(rows["text"])], 0
            while at < len(ids):
                if out is None:
                    out = StreamFile(folder, f"part-{part:06d}-{len(done):06d}-{uuid.uuid4().hex}", enc.dtype)
                take = min(file_rows - out.docs, len(ids) - at)
                out.add(rows["doc_id"][at : at + take], ids[at : at + take])
                at += take
                if out.docs == file_rows:
                    out.close()
                    done.append(out)
                    out = None
        if out is not None:
            out.close()
            done.append(out)
        told = [{"part": part, "number": k, "file": o.path.rpartition("/")[2], "n_docs": o.docs, "n_tokens": o.tokens} for k, o in enumerate(done)]
        yield pa.RecordBatch.from_pylist(told, schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return store(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all from the files. The order of files is by part;
    their table has a row for each file, so its running sum is over few rows."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            for name, base in zip(rows["file"], rows["base"], strict=True):
                file = TokenFile(f"{folder}/{name}")
                for b in file.documents():
                    ids, starts, sizes = (c.to_pylist() for c in b.columns)
                    kind = file.batches[0].column("ids").type.value_type.to_pandas_dtype()
                    crc = [zlib.crc32(np.frombuffer(file.stream(s, n), kind).astype("<u4").tobytes()) for s, n in zip(starts, sizes, strict=True)]
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([base + s for s in starts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, manifest.count())
    return files.repartition(tasks, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    folder = new_folder(spark, "tokens")
    return read_documents(write_tokens(documents(spark, sf_dir), folder, path or tokenizer_path(VOCABULARY)), folder)
