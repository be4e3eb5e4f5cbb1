"""Incremental sync: a stream of added messages, upserted into an archive batch by batch."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from ..operators.store import Archive
from ..sources import api

SINCE = "history"


def labels_of(spark: SparkSession, factory: str, argument: str):
    held = [(x["id"], x["name"]) for x in api.client(factory, argument).labels()]
    return spark.createDataFrame(held, "id string, name string")


def full(archive: Archive, factory: str, argument: str, **options: str) -> None:
    """The whole mailbox. The point from which changes are read later is taken before the listing.
    A listing with a query (``q``) leaves that point as it is."""
    point = api.client(factory, argument).profile()["historyId"]
    archive.take(api.mailbox(archive.spark, factory, argument, **options), labels_of(archive.spark, factory, argument))
    if not options.get("q"):
        archive.state.put(SINCE, int(point))


def sync(archive: Archive, factory: str, argument: str, checkpoint: str, **options: str) -> str:
    """Takes in what was added since the last time and tells how: ``full`` at first and when the
    history has expired, else ``changes``. Batches may repeat; the upsert makes that harmless."""
    since = archive.state.get(SINCE)
    if since is None:
        full(archive, factory, argument, **options)
        return "full"
    latest: list[int] = []
    point = int(api.client(factory, argument).profile()["historyId"])

    def put(batch, number: int) -> None:
        if not batch.isEmpty():
            archive.take(batch, labels_of(archive.spark, factory, argument))
        latest.append(number)

    rows = api.changes(archive.spark, factory, argument, int(since), **options)
    try:
        # A checkpoint for each starting point: its offsets are only good for one.
        query = rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{checkpoint}/{since}").trigger(availableNow=True).start()
        query.awaitTermination()
    except PySparkException as e:  # Spark's own error, with that of the source in its text
        if "HistoryExpired" not in str(e):
            raise
        full(archive, factory, argument, **options)
        return "full"
    archive.state.put(SINCE, point)
    return "changes"
