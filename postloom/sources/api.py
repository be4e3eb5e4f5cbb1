"""A mailbox behind a mail API, as a batch table and as a stream of what is added to it.

The client is made on every executor by a factory named ``module:callable`` with one string
argument, so no connection is ever shipped. The driver lists ids; tasks fetch the messages.
``Recorded`` is a mailbox kept as JSON files, for offline use and tests.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module
from typing import Any, Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.mail import ROLES
from ..functions.mail import people as people_of
from .mail import SCHEMA, in_batches

#: Messages of a page; a task fetches a page's worth, of large mailboxes up to so many.
CHUNK, MOST = 500, 4000
ID_PREFIX = "gmail:"


class ApiError(RuntimeError):
    """A refused call; ``status`` is that of HTTP."""

    def __init__(self, status: int, reason: str = "") -> None:
        super().__init__(f"{status} {reason}")
        self.status, self.reason = status, reason


class HistoryExpired(RuntimeError):
    """The change feed no longer reaches back to the given point; read the whole mailbox again."""


class MailApi(Protocol):
    def profile(self) -> dict: ...
    def ids(self, query: str | None, page: str | None) -> tuple[list[str], str | None]:
        """Without what is in spam or trash."""

    def added(self, since: int, upto: int, page: str | None) -> tuple[list[str], str | None]: ...
    def message(self, key: str) -> dict: ...
    def attachment(self, key: str, attachment: str) -> bytes: ...
    def labels(self) -> list[dict]: ...
    def create_label(self, name: str) -> str: ...
    def delete_label(self, key: str) -> None: ...
    def trash(self, key: str) -> None: ...

    def put(self, raw: bytes, label_ids: list[str]) -> str:
        """Takes a message in as it is: its time is that of its Date header, and it is never spam."""


def client(factory: str, argument: str) -> MailApi:
    module, _, name = factory.partition(":")
    return getattr(import_module(module), name)(argument)


def patiently(call: Callable, *args: Any, tries: int = 12, wait: float = 2.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's result; rate limits, server and network errors are tried again, ever more slowly."""
    for attempt in range(1, tries + 1):
        try:
            return call(*args)
        except (ApiError, OSError) as e:
            again = not isinstance(e, ApiError) or e.status == 429 or e.status >= 500 or (e.status == 403 and "rate" in e.reason.lower())
            if not again or attempt == tries:
                raise
            sleep(min(longest, wait * 2 ** (attempt - 1)))
    raise AssertionError


def pages(listing: Callable[[str | None], tuple[list[str], str | None]]) -> Iterator[str]:
    """Every id of a paged listing, each once."""
    page, seen = None, set()
    while True:
        found, page = patiently(listing, page)
        for key in found:
            if key not in seen:
                seen.add(key)
                yield key
        if not page:
            return


# Rows ------------------------------------------------------------------------------------------

def unpacked(data: str) -> bytes:
    return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))


def parts(payload: dict) -> Iterator[dict]:
    """A part and all below it, in document order."""
    yield payload
    for part in payload.get("parts") or ():
        yield from parts(part)


def heads(part: dict) -> dict[str, str]:
    """By lower-case name; of headers given twice the last counts."""
    return {h["name"].lower(): h["value"] for h in part.get("headers") or ()}


def projected(raw: dict) -> dict:
    """The nested row of an API message. The body is the first text part that isn't empty. Address
    headers are read as they stand."""
    payload = raw.get("payload") or {}
    head = heads(payload)
    texts = [(p["mimeType"], unpacked(p["body"]["data"]).decode("utf-8", "replace")) for p in parts(payload) if p.get("mimeType") in ("text/plain", "text/html") and (p.get("body") or {}).get("data")]
    kind, body = next(((k, t) for k, t in texts if t), (None, ""))
    people: dict[tuple[str, str], dict] = {}
    for role in ROLES:
        for name, address in people_of([head[role]], repair=False) if head.get(role) else ():
            if key := address.strip().lower():
                people.setdefault((role, key), {"role": role, "address": key, "name": name.strip() or None})
    files = []
    for p in parts(payload):
        held, cid = p.get("body") or {}, heads(p).get("content-id") if p is not payload or "content-id" in head else None
        if p.get("filename") or cid or held.get("attachmentId"):
            files.append({"ord": len(files), "attachment_id": held.get("attachmentId"), "filename": p.get("filename") or None, "mime_type": p.get("mimeType"), "size": held.get("size"), "content_sha256": None, "content_id": cid, "content": None})
    ms = raw.get("internalDate")
    return {
        "id": ID_PREFIX + raw["id"], "thread_id": raw.get("threadId"), "sender": head.get("from"), "recipient": head.get("to"), "cc": head.get("cc"), "bcc": head.get("bcc"), "subject": head.get("subject"), "date": head.get("date"),
        "internal_date_ms": int(ms) if ms else None, "snippet": raw.get("snippet"), "label_ids": ",".join(raw.get("labelIds") or ()), "body_text": body, "body_mime_type": kind, "body_html": next((t for k, t in texts if k == "text/html" and t), None),
        "addresses": list(people.values()), "attachments": files,
    }


def attached(raw: dict) -> Iterator[dict]:
    """Messages inside a message, as messages of its thread, time and labels."""
    inner = [p for p in parts(raw.get("payload") or {}) if ((p.get("mimeType") or "").lower() == "message/rfc822" or (p.get("filename") or "").lower().endswith(".eml")) and (p.get("parts") or p.get("headers"))]
    for i, part in enumerate(inner, 1):
        yield {"id": f"{raw['id']}_att{i}", "threadId": raw.get("threadId"), "internalDate": raw.get("internalDate"), "labelIds": raw.get("labelIds") or [], "snippet": None, "payload": part}


# Readers ---------------------------------------------------------------------------------------

@dataclass
class Keys(InputPartition):
    keys: list[str]
    first: int


class Fetching:
    def __init__(self, options: dict, schema: StructType) -> None:
        self.schema = schema
        self.factory, self.argument = options["client"], options.get("path", "")
        self.query = options.get("q") or None
        self.content = options.get("withattachments", "false").lower() == "true"
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.chunk = int(options.get("chunk", 0))
        self.start = int(options.get("starthistory", 0))

    def api(self) -> MailApi:
        return client(self.factory, self.argument)

    def cut(self, keys: list[str], first: int = 0) -> list[Keys]:
        step = self.chunk or max(CHUNK, min(MOST, len(keys) // CHUNK))
        return [Keys(keys[i : i + step], first + i) for i in range(0, len(keys), step)]

    def read(self, part: Keys | None) -> Iterator[pa.RecordBatch]:
        if part is not None:  # an empty listing
            yield from in_batches(self.rows(part), self.schema)

    def rows(self, part: Keys) -> Iterator[dict]:
        api = self.api()
        for i, key in enumerate(part.keys):
            raw = patiently(api.message, key)
            for j, one in enumerate([raw, *(attached(raw) if self.recursive else ())]):
                row = projected(one) | {"seq": (part.first + i) << 12 | j}
                for a in row["attachments"] if self.content else ():
                    if a["attachment_id"]:
                        data = patiently(api.attachment, key, a["attachment_id"])
                        a |= {"content": data, "size": len(data), "content_sha256": hashlib.sha256(data).hexdigest()}
                yield row


class BatchReader(Fetching, DataSourceReader):
    def partitions(self) -> list[Keys]:
        api = self.api()
        return self.cut(list(pages(lambda page: api.ids(self.query, page))))


class ChangeReader(Fetching, DataSourceStreamReader):
    """Messages added since ``startHistory``. The end of a batch is fixed before it is listed, and what
    arrives meanwhile comes in the next one. A batch that is tried again comes again: at least once,
    for an upsert by id."""

    def initialOffset(self) -> dict:
        return {"history_id": self.start}

    def latestOffset(self) -> dict:
        return {"history_id": int(self.api().profile()["historyId"])}

    def partitions(self, start: dict, end: dict) -> list[Keys]:
        if start == end:
            return []
        api = self.api()
        return self.cut(list(pages(lambda page: api.added(start["history_id"], end["history_id"], page))), start["history_id"] << 20)


class ApiSource(DataSource):
    """``format("mailapi")``; options client, path, q, startHistory, withAttachments, recursive, chunk."""

    @classmethod
    def name(cls) -> str:
        return "mailapi"

    def schema(self) -> str:
        return SCHEMA

    def _lower(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(self._lower(), schema)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeReader(self._lower(), schema)


def mailbox(spark: SparkSession, factory: str, argument: str = "", **options: str) -> DataFrame:
    spark.dataSource.register(ApiSource)
    return spark.read.format("mailapi").options(client=factory, **options).load(argument)


def changes(spark: SparkSession, factory: str, argument: str, since: int, **options: str) -> DataFrame:
    """A stream; an expired history raises ``HistoryExpired`` inside Spark's own error."""
    spark.dataSource.register(ApiSource)
    return spark.readStream.format("mailapi").options(client=factory, startHistory=str(since), **options).load(argument)


def drawer(key: str) -> str:
    """The folder of a large recorded mailbox that a message is in."""
    return f"{zlib.crc32(key.encode()) % 256:02x}"


class Recorded:
    """A mailbox as JSON files below a URI: ``messages/<id>.json`` or ``messages/<drawer>/<id>.json``,
    ``history.json`` (a list of [history id, message id], oldest first), ``labels.json``,
    ``profile.json``; attachments are ``attachments/<id>`` and messages that are put go to ``put/``."""

    def __init__(self, uri: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(uri)
        #: Of the listing under way: the query, its folders, and the names in the folder it is at.
        self.listing: tuple[str | None, list[str], tuple[int, list[str]]] | None = None

    def _get(self, name: str, default: Any = None) -> Any:
        path = f"{self.root}/{name}"
        if self.store.get_file_info(path).type != fs.FileType.File:
            return default
        with self.store.open_input_stream(path) as f:
            return json.loads(f.read())

    def _set(self, name: str, data: bytes) -> None:
        path = f"{self.root}/{name}"
        self.store.create_dir(path.rpartition("/")[0], recursive=True)
        with self.store.open_output_stream(path) as f:
            f.write(data)

    def profile(self) -> dict:
        return self._get("profile.json", {"historyId": max([h for h, _ in self._get("history.json", [])], default=0)})

    def ids(self, query: str | None, page: str | None) -> tuple[list[str], str | None]:
        """A folder is listed when its first page is asked for, not once for each page."""
        k, at = map(int, page.split(".")) if page else (0, 0)
        if not page or not self.listing or self.listing[0] != query:
            top = self.store.get_file_info(fs.FileSelector(f"{self.root}/messages"))
            self.listing = query, ["", *sorted(f.base_name for f in top if f.type == fs.FileType.Directory)], (-1, [])
        _, folders, (listed, names) = self.listing
        if listed != k:
            names = self.names(folders[k], query)
            self.listing = query, folders, (k, names)
        after = f"{k}.{at + CHUNK}" if at + CHUNK < len(names) else f"{k + 1}.0" if k + 1 < len(folders) else None
        return names[at : at + CHUNK], after

    def names(self, folder: str, query: str | None) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(f"{self.root}/messages/{folder}".rstrip("/")))
        hidden = set(self._get("hidden.json", []))
        names = sorted({f.base_name.removesuffix(".json") for f in found if f.type == fs.FileType.File} - hidden)
        return [n for n in names if self.answers(n, query)] if query else names

    def answers(self, key: str, query: str) -> bool:
        """``label:`` with a label's id or name, ``subject:``, or any text."""
        kind, _, value = query.lower().partition(":")
        held = self.message(key)
        if kind == "label":
            ids = {x["id"] for x in self.labels() if value in (x["name"].lower(), x["id"].lower())}
            return bool(ids & set(held.get("labelIds") or ())) or value in map(str.lower, held.get("labelIds") or ())
        if kind == "subject":
            return value in heads(held.get("payload") or {}).get("subject", "").lower()
        return query.lower() in json.dumps(held).lower()

    def added(self, since: int, upto: int, page: str | None) -> tuple[list[str], str | None]:
        told = self._get("history.json", [])
        if told and since < told[0][0] - 1:
            raise HistoryExpired(f"history {since} is no longer kept")
        return [m for h, m in told if since < h <= upto], None

    def message(self, key: str) -> dict:
        found = self._get(f"messages/{drawer(key)}/{key}.json")
        if found is None:
            found = self._get(f"messages/{key}.json")
        if found is None:
            raise ApiError(404, key)
        return found

    def attachment(self, key: str, attachment: str) -> bytes:
        with self.store.open_input_stream(f"{self.root}/attachments/{attachment}") as f:
            return f.read()

    def labels(self) -> list[dict]:
        return self._get("labels.json", [])

    def create_label(self, name: str) -> str:
        held = self.labels()
        key = f"Label_{len(held) + 1}"
        self._set("labels.json", json.dumps([*held, {"id": key, "name": name}]).encode())
        return key

    def delete_label(self, key: str) -> None:
        self._set("labels.json", json.dumps([x for x in self.labels() if x["id"] != key]).encode())

    def trash(self, key: str) -> None:
        """``hidden.json`` lists what is in spam or trash."""
        self._set("hidden.json", json.dumps(sorted({*self._get("hidden.json", []), key})).encode())

    def put(self, raw: bytes, label_ids: list[str]) -> str:
        key = hashlib.sha1(raw).hexdigest()[:16]
        self._set(f"put/{key}.json", json.dumps({"raw": base64.urlsafe_b64encode(raw).decode(), "labelIds": label_ids}).encode())
        return key
