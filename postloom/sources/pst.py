"""Personal folder files ([MS-PST], wide and narrow) as nested message rows.

The driver walks the folders and lists message ids; a task opens the file and looks its messages up
in the file's own B-trees. Byte permutation needs its 256-byte table (see ``permutation`` below).
"""

from __future__ import annotations

import email
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import format_datetime
from functools import cached_property
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import mail
from .mail import SCHEMA, as_structs

CHUNK = 2000
ROOT_FOLDER = 0x122
#: Fixed values of the format: node types, property ids, and the roles of recipients.
HIERARCHY, CONTENTS, ATTACHMENTS, RECIPIENTS = 0x0D, 0x0E, 0x11, 0x12
SUBJECT, SUBMITTED, HEADERS, SENDER_NAME, RECIPIENT_TYPE, SENDER_ADDRESS, DELIVERED = 0x0037, 0x0039, 0x007D, 0x0C1A, 0x0C15, 0x0C1F, 0x0E06
BODY, HTML, MESSAGE_ID, NAME, ADDRESS, SMTP, SENDER_SMTP, CODEPAGE, CHARSET = 0x1000, 0x1013, 0x1035, 0x3001, 0x3003, 0x39FE, 0x5D01, 0x3FFD, 0x3FDE
DATA, FILE, LONG_FILE, MIME, CONTENT_ID, SIZE, ROW_ID = 0x3701, 0x3704, 0x3707, 0x370E, 0x3712, 0x0E20, 0x67F2
ROLE_OF = {1: "to", 2: "cc", 3: "bcc"}
SMALL = {0x2: "<h", 0x3: "<i", 0x4: "<f", 0xA: "<i", 0xB: "<?"}
LARGE = {0x5: "<d", 0x14: "<q", 0x40: "<Q"}
CODEPAGES = {65001: "utf-8", 20127: "ascii", 1200: "utf-16-le", 28591: "latin-1"}
EPOCH = 116444736000000000


class PstError(ValueError):
    """Not a file that can be read."""


@dataclass
class Node:
    data: int
    sub: int


class Pst:
    """The file's nodes and blocks."""

    def __init__(self, file: BinaryIO, table: bytes | None = None) -> None:
        self.file = file
        head = self.at(0, 564)
        if head[:4] != b"!BDN" or head[8:10] != b"SM":
            raise PstError("no personal folder file")
        version = struct.unpack_from("<H", head, 10)[0]
        if version not in (14, 15) and version < 23:
            raise PstError(f"unknown version {version}")
        self.wide = version >= 23
        self.word, self.id = (8, "Q") if self.wide else (4, "I")
        self.nodes, self.blocks = (struct.unpack_from(f"<{self.id}", head, o)[0] for o in ((224, 240) if self.wide else (188, 196)))
        method = head[513 if self.wide else 461]
        if method > 1:
            raise PstError(f"encoding {method} is not supported")
        if method and table is None:
            raise PstError("the file's bytes are permuted: give the table of the format as option permutation")
        self.table = table if method else None

    def at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def look_up(self, page: int, key: int) -> bytes | None:
        """The leaf entry of a key, from the page at the top of its tree down."""
        while True:
            raw = self.at(page, 512)
            count, _, size, level = raw[488:492] if self.wide else raw[496:500]
            entries = [raw[i * size : (i + 1) * size] for i in range(count)]
            keys = [int.from_bytes(e[: self.word], "little") for e in entries]
            if level == 0:
                # The two low bits of a block's id are flags.
                return next((e for e, k in zip(entries, keys, strict=True) if k == key or k & ~1 == key), None)
            below = [e for e, k in zip(entries, keys, strict=True) if k <= key]
            if not below:
                return None
            page = int.from_bytes(below[-1][2 * self.word : 3 * self.word], "little")

    def node(self, nid: int) -> Node | None:
        entry = self.look_up(self.nodes, nid)
        return Node(*struct.unpack_from(f"<{self.id}{self.id}", entry, self.word)) if entry else None

    def block(self, bid: int) -> bytes:
        entry = self.look_up(self.blocks, bid & ~1)
        if entry is None:
            raise PstError(f"no block {bid:#x}")
        raw = self.at(int.from_bytes(entry[self.word : 2 * self.word], "little"), struct.unpack_from("<H", entry, 2 * self.word)[0])
        return raw if bid & 2 or self.table is None else raw.translate(self.table)

    def data(self, bid: int) -> list[bytes]:
        """The data blocks below a block, in order."""
        if not bid:
            return []
        raw = self.block(bid)
        if not bid & 2:
            return [raw]
        if raw[0] != 1:
            raise PstError(f"block {bid:#x} holds no data")
        count = struct.unpack_from("<H", raw, 2)[0]
        return [b for child in struct.unpack_from(f"<{count}{self.id}", raw, 8) for b in self.data(child)]

    def below(self, bid: int) -> dict[int, Node]:
        """The nodes of a subnode tree."""
        if not bid:
            return {}
        raw = self.block(bid)
        count, start = struct.unpack_from("<H", raw, 2)[0], 8 if self.wide else 4
        if raw[1]:
            pairs = struct.iter_unpack(f"<2{self.id}", raw[start : start + count * 2 * self.word])
            return {k: n for _, child in pairs for k, n in self.below(child).items()}
        return {nid & 0xFFFFFFFF: Node(data, sub) for nid, data, sub in struct.iter_unpack(f"<3{self.id}", raw[start : start + count * 3 * self.word])}


class Heap:
    """A node's heap with the tables in it."""

    def __init__(self, pst: Pst, node: Node) -> None:
        self.pst, self.pages = pst, pst.data(node.data)
        if not self.pages or self.pages[0][2] != 0xEC:
            raise PstError("no heap")
        self.root = struct.unpack_from("<I", self.pages[0], 4)[0]
        self.sub = node.sub

    @cached_property
    def children(self) -> dict[int, Node]:
        return self.pst.below(self.sub)

    def item(self, hid: int) -> bytes:
        index, page = (hid >> 5 & 0x7FF) - 1, self.pages[hid >> 16]
        top = struct.unpack_from("<H", page)[0]
        begin, end = struct.unpack_from("<HH", page, top + 4 + 2 * index)
        return page[begin:end]

    def content(self, hnid: int) -> list[bytes]:
        """What an id names: an item of the heap, or the blocks of a subnode."""
        if not hnid:
            return []
        if not hnid & 0x1F:
            return [self.item(hnid)]
        child = self.children.get(hnid)
        return self.pst.data(child.data) if child else []

    def tree(self, hid: int) -> Iterator[bytes]:
        """The leaf records of a B-tree on the heap."""
        _, key, rest, levels, root = struct.unpack("<BBBBI", self.item(hid)[:8])

        def walk(at: int, level: int) -> Iterator[bytes]:
            raw, size = self.item(at) if at else b"", key + (4 if level else rest)
            for i in range(0, len(raw) - size + 1, size):
                if level:
                    yield from walk(struct.unpack_from("<I", raw, i + key)[0], level - 1)
                else:
                    yield raw[i : i + size]

        yield from walk(root, levels)

    def value(self, kind: int, cell: bytes, page: str) -> object:
        """A property's value from its cell; what doesn't fit in the cell is elsewhere."""
        if kind in SMALL:
            return struct.unpack_from(SMALL[kind], cell)[0]
        if kind in LARGE and len(cell) >= 8:
            return struct.unpack_from(LARGE[kind], cell)[0]
        raw = b"".join(self.content(struct.unpack_from("<I", cell)[0]))
        if kind in LARGE:
            return struct.unpack_from(LARGE[kind], raw)[0] if len(raw) >= 8 else None
        if kind == 0x1F:
            return raw.decode("utf-16-le", "replace")
        return text_of(raw, page) if kind == 0x1E else raw

    def properties(self) -> dict[int, object]:
        cells = {struct.unpack_from("<H", r)[0]: r[2:] for r in self.tree(self.root)}
        number = next((struct.unpack_from("<I", cells[p], 2)[0] for p in (CODEPAGE, CHARSET) if p in cells), 1252)
        page = CODEPAGES.get(number, f"cp{number}")
        return {p: self.value(struct.unpack_from("<H", c)[0], c[2:], page) for p, c in cells.items()} | {CHARSET: page}

    def rows(self, page: str = "cp1252") -> list[dict[int, object]]:
        """A table's rows, narrow text in the code page given. A row never runs over two blocks; cells are read whatever the row's
        bitmap says, as many writers leave it unset."""
        raw = self.item(self.root)
        count, width, where = raw[1], struct.unpack_from("<H", raw, 8)[0], struct.unpack_from("<I", raw, 14)[0]
        columns = [struct.unpack_from("<HHHB", raw, 22 + 8 * i) for i in range(count)]
        out = []
        for block in self.content(where):
            for at in range(0, len(block) - width + 1, width):
                row = block[at : at + width]
                out.append({p: self.value(kind, row[o : o + size].ljust(4, b"\0"), page) for kind, p, o, size in columns})
        return out


def text_of(raw: bytes, page: str) -> str:
    try:
        return raw.decode(page)
    except (LookupError, UnicodeDecodeError):
        return raw.decode("utf-8", "replace")


def folders(pst: Pst, nid: int = ROOT_FOLDER, path: str = "") -> Iterator[tuple[str, list[int]]]:
    """(path, message ids) of a folder and of those below; the root's path is empty."""

    def ids(kind: int) -> list[int]:
        node = pst.node(nid & ~0x1F | kind)
        return [r[ROW_ID] & 0xFFFFFFFF for r in Heap(pst, node).rows()] if node and node.data else []

    yield path, ids(CONTENTS)
    for child in ids(HIERARCHY):
        node = pst.node(child)
        if node is not None:
            name = Heap(pst, node).properties().get(NAME) or f"(unnamed {child:#x})"
            yield from folders(pst, child, f"{path}/{name}" if path else str(name))


def written(people: list[dict], role: str) -> str | None:
    return ", ".join(f"{p['name']} <{p['address']}>" if p["name"] else p["address"] for p in people if p["role"] == role) or None


def rows_of(pst: Pst, node: Node, label: str, content: bool, recursive: bool) -> Iterator[dict]:
    """A message's row, and those of the messages inside it."""
    heap = Heap(pst, node)
    held = heap.properties()
    page = str(held[CHARSET])

    def tables(kind: int) -> list[tuple[dict[int, object]]]:
        return [r for nid, n in heap.children.items() if nid & 0x1F == kind and n.data for r in Heap(pst, n).rows(page)]

    raw = held.get(HEADERS) or ""
    head = email.message_from_string(str(raw)) if raw else email.message.Message()
    subject = str(held.get(SUBJECT) or "")
    # A subject may begin with a mark and the length of its prefix.
    subject = subject[2:] if subject[:1] == "\x01" else subject
    given = mail.decoded(head.get("Message-ID")).strip() or str(held.get(MESSAGE_ID) or "").strip()
    key = "outlook:" + (given or "sha1:" + hashlib.sha1(str(raw or subject).encode("utf-8", "replace")).hexdigest())

    people = mail.addresses(head)
    if not people:
        told = [("from", held.get(SENDER_NAME), held.get(SENDER_SMTP), held.get(SENDER_ADDRESS), held.get(SENDER_NAME))]
        told += [(ROLE_OF.get(r.get(RECIPIENT_TYPE)), r.get(NAME), r.get(SMTP), r.get(ADDRESS)) for r in tables(RECIPIENTS)]
        found: dict[tuple[str, str], dict] = {}
        for role, name, *places in told:
            # Internal directory names aren't addresses.
            address = next((str(a).strip().lower() for a in places if a and "@" in str(a)), None)
            if role and address:
                found.setdefault((role, address), {"role": role, "address": address, "name": str(name or "").strip() or None})
        people = list(found.values())
    heads = {c: mail.quoted_names(mail.decoded(head.get(h))) or written(people, r) for c, h, r in (("sender", "From", "from"), ("recipient", "To", "to"), ("cc", "Cc", "cc"), ("bcc", "Bcc", "bcc"))}
    heads["sender"] = heads["sender"] or held.get(SENDER_NAME) or None

    when = held.get(SUBMITTED) or held.get(DELIVERED)
    ms = (when - EPOCH) // 10000 if when else None
    date = mail.decoded(head.get("Date")) or (format_datetime(datetime.fromtimestamp(ms / 1000, tz=UTC)) if ms is not None else None)
    html = held.get(HTML)
    html = text_of(html, page) if isinstance(html, bytes) else html
    body, kind = (held[BODY], "text/plain") if held.get(BODY) else (html, "text/html") if html else ("", None)

    files, inside = [], []
    for r in tables(ATTACHMENTS):
        child = heap.children.get(r[ROW_ID] & 0xFFFFFFFF)
        own = Heap(pst, child) if child and child.data else None
        told = r | (own.properties() if own else {})
        data = told.get(DATA)
        cell = next((c for c in own.tree(own.root) if struct.unpack_from("<H", c)[0] == DATA), None) if own else None
        if cell is not None and struct.unpack_from("<H", cell, 2)[0] == 0xD:
            inner = own.children.get(struct.unpack_from("<I", data)[0]) if data else None
            inside += [inner] if inner else []
            data = None
        cid = str(told.get(CONTENT_ID) or "").strip()
        files.append({
            "ord": len(files), "attachment_id": None, "filename": told.get(LONG_FILE) or told.get(FILE) or None, "mime_type": told.get(MIME) or None, "size": len(data) if data is not None and content else told.get(SIZE),
            "content_sha256": hashlib.sha256(data).hexdigest() if data is not None and content else None, "content_id": (cid if cid.startswith("<") else f"<{cid}>") if cid else None, "content": data if content else None,
        })
    yield {"id": key, "thread_id": None, **heads, "subject": mail.decoded(head.get("Subject")) or subject or None, "date": date, "internal_date_ms": ms, "snippet": None, "label_ids": label, "body_text": body, "body_mime_type": kind, "body_html": html, "addresses": people, "attachments": files}
    for inner in inside if recursive else ():
        yield from rows_of(pst, inner, label, content, recursive)


@dataclass
class Range(InputPartition):
    first: int
    messages: list[tuple[str, int]]


class PstReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.content, self.recursive = (options.get(o, "false").lower() == "true" for o in ("withattachments", "recursive"))
        self.chunk = int(options.get("chunk", CHUNK))
        self.permutation = options.get("permutation")

    def table(self) -> bytes | None:
        if not self.permutation:
            return None
        store, path = fs.FileSystem.from_uri(self.permutation)
        with store.open_input_stream(path) as f:
            table = f.read()
        if sorted(table) != list(range(256)):
            raise PstError("the permutation table must hold each byte once")
        return table

    def partitions(self) -> list[Range]:
        store, path = fs.FileSystem.from_uri(self.uri)
        with store.open_input_file(path) as f:
            found = [("outlook:" + folder if folder else "", nid) for folder, ids in folders(Pst(f, self.table())) for nid in ids]
        return [Range(i, found[i : i + self.chunk]) for i in range(0, len(found), self.chunk)]

    def read(self, part: Range | None) -> Iterator[tuple]:
        if part is None:  # no messages
            return
        store, path = fs.FileSystem.from_uri(self.uri)
        with store.open_input_file(path) as f:
            pst = Pst(f, self.table())
            for i, (label, nid) in enumerate(part.messages):
                node = pst.node(nid)
                for j, row in enumerate(rows_of(pst, node, label, self.content, self.recursive) if node else ()):
                    yield tuple(as_structs(row | {"seq": (part.first + i) << 20 | j}).values())


class PstSource(DataSource):
    """``format("pst")``; options withAttachments, recursive, chunk, and permutation: the URI of a
    file with the 256 bytes that stored bytes stand for."""

    @classmethod
    def name(cls) -> str:
        return "pst"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PstReader({k.lower(): v for k, v in self.options.items()})


def pst(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    spark.dataSource.register(PstSource)
    return spark.read.format("pst").options(**options).load(uri)
