"""Messages put into a mailbox behind an API: in order, throttled, and resumed from a ledger."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compose
from ..sources.api import ApiError, client, patiently
from . import export, store, tables

CALLS_PER_SECOND = 8
LARGEST = 25 << 20
#: Messages between two writes of the ledger: a run that dies repeats at most as many.
BATCH = 2000
LEDGER = "id string, remote_id string, dropped int, error string, run string, stored_at timestamp"


def ledger(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(uri) if store.exists(uri) else spark.createDataFrame([], LEDGER)


def candidates_left(spark: SparkSession, rows: DataFrame, ledger_uri: str, run: str = "", limit: int = BATCH) -> DataFrame:
    """(id): the next ones in order that aren't stored and haven't failed in this run."""
    told = ledger(spark, ledger_uri).filter((F.col("remote_id").isNotNull()) | (F.col("run") == run))
    return tables.resume(rows.select("id"), told, limit)


def put_all(rows: DataFrame, factory: str, argument: str, ids: dict[str, str], run: str, rate: float = CALLS_PER_SECOND, largest: int = LARGEST) -> DataFrame:
    """The ledger's rows for EML rows (id, label_names, raw). One task, as the API allows so few
    calls a second. What is too large or refused is tried once more without its attachments."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        api, free = client(factory, argument), 0.0

        def send(raw: bytes, labels: list[str]) -> str:
            nonlocal free
            time.sleep(max(0.0, free - time.monotonic()))
            free = time.monotonic() + 1 / rate
            return patiently(api.put, raw, labels)

        for batch in batches:
            for r in batch.to_pylist():
                labels = list(dict.fromkeys([ids[n] for n in r["label_names"]] + [ids[run]]))
                remote, error = None, None
                for form in ("whole", "bare"):
                    made = (r["raw"], []) if form == "whole" else compose.without_attachments(r["raw"])
                    if made is None:
                        break
                    raw, gone = made
                    if len(raw) > largest:
                        error = f"{len(raw)} bytes are too many"
                        continue
                    try:
                        remote, error = send(raw, labels), None
                        break
                    except (ApiError, OSError) as e:
                        error = str(e)
                dropped = len(gone) if remote else 0
                yield pa.RecordBatch.from_pylist([{"id": r["id"], "remote_id": remote, "dropped": dropped, "error": error, "run": run, "stored_at": datetime.now(UTC)}], schema=kind)

    kind = pa.schema([("id", pa.string()), ("remote_id", pa.string()), ("dropped", pa.int32()), ("error", pa.string()), ("run", pa.string()), ("stored_at", pa.timestamp("us", "UTC"))])
    return rows.coalesce(1).sortWithinPartitions("id").mapInArrow(go, LEDGER)


def store_messages(spark: SparkSession, rows: DataFrame, factory: str, argument: str, ledger_uri: str, limit: int | None = None, batch: int = BATCH, rate: float = CALLS_PER_SECOND, largest: int = LARGEST) -> dict[str, int]:
    """Puts all candidates (``export.candidates``) that the ledger lacks, at most ``limit``, and
    counts them. A run keeps its label until it has gone through all candidates."""
    api, state = client(factory, argument), store.KeyValues(ledger_uri.rstrip("/") + "_state.json")
    ids = {x["name"]: x["id"] for x in api.labels()}
    done = {"stored": 0, "failed": 0}
    run = state.get("run")
    while limit is None or done["stored"] < limit:
        size = batch if limit is None else min(batch, limit - done["stored"])
        # The batch's ids are held fast: the ledger grows while they are worked on.
        keys = [r.id for r in candidates_left(spark, rows, ledger_uri, run or "", size).collect()]  # at most BATCH short ids
        if not keys:
            state.put("run", "")
            break
        if not run:
            run = f"archive-store-{datetime.now(UTC):%Y-%m-%dT%H-%M-%SZ}"
            state.put("run", run)
        chosen = rows.filter(F.col("id").isin(keys))
        names = {n.name for n in chosen.select(F.explode("label_names").alias("name")).distinct().collect()}  # labels of a batch
        for name in sorted(names | {run}):
            if name not in ids:
                ids[name] = patiently(api.create_label, name)
        put_all(export.as_eml(chosen), factory, argument, ids, run, rate, largest).write.mode("append").parquet(ledger_uri)
        told = ledger(spark, ledger_uri).filter((F.col("run") == run) & F.col("id").isin(keys)).agg(F.count("remote_id").alias("a"), F.count(F.lit(1)).alias("n")).first()
        done["stored"] += told.a
        done["failed"] += told.n - told.a
    return done
