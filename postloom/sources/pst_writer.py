"""Writes small personal folder files, for tests and for the query that reads one back."""

from __future__ import annotations

import struct

FAN = 10


class Writer:
    """Lays blocks, then the trees of nodes and blocks, FAN entries to a page."""

    def __init__(self, wide: bool = True, table: bytes | None = None) -> None:
        self.wide, self.w, self.f = wide, 8 if wide else 4, "Q" if wide else "I"
        self.table, self.body, self.blocks, self.nodes, self.next = table, bytearray(1024), [], {}, 4

    def block(self, raw, inner=False):
        bid = self.next | (2 if inner else 0)
        self.next += 4
        if self.table and not inner:
            raw = bytes(self.table.index(b) for b in raw)
        self.blocks.append((bid, len(self.body), len(raw)))
        self.body += raw
        self.body += bytes(-len(self.body) % 64 + 64)
        return bid

    def data(self, raw, most=8000):
        cut = [raw[i : i + most] for i in range(0, len(raw), most)] or [b""]
        bids = [self.block(c) for c in cut]
        return bids[0] if len(bids) == 1 else self.block(struct.pack("<BBHI", 1, 1, len(bids), len(raw)) + struct.pack(f"<{len(bids)}{self.f}", *bids), True)

    def subs(self, nodes):
        if not nodes:
            return 0
        rows = b"".join(struct.pack(f"<3{self.f}", nid, d, s) for nid, (d, s) in sorted(nodes.items()))
        return self.block(struct.pack("<BBH", 2, 0, len(nodes)) + (bytes(4) if self.wide else b"") + rows, True)

    def heap(self, kind, items, root):
        at, places, raw = 12, [], b""
        for i in items:
            places.append(at + len(raw))
            raw += i
        places.append(at + len(raw))
        raw += bytes(len(raw) % 2)
        return struct.pack("<HBBII", at + len(raw), 0xEC, kind, (root + 1) << 5, 0) + raw + struct.pack("<HH", len(items), 0) + struct.pack(f"<{len(places)}H", *places)

    def value(self, items, kind, v):
        if kind in (0x3, 0xB):
            return int(v)
        items.append(v.encode("utf-16-le") if kind == 0x1F else v.encode("cp1252") if kind == 0x1E else struct.pack("<Q", v) if kind == 0x40 else v)
        return len(items) << 5

    def properties(self, props, subs=()):
        subs, items = dict(subs), [b"", b""]
        rows = [struct.pack("<HHI", p, k, v[1] if isinstance(v, tuple) else self.value(items, k, v)) for p, (k, v) in sorted(props.items())]
        items[0], items[1] = struct.pack("<BBBBI", 0xB5, 2, 6, 0, 2 << 5), b"".join(rows)
        return self.data(self.heap(0xBC, items, 0), 8000), self.subs(subs)

    def table_of(self, columns, rows):
        """columns: (id, kind); the first is the row's id. Rows lie in blocks of a subnode."""
        items, width = [b""], 4 * len(columns) + 1
        cells = [b"".join(struct.pack("<I", r[0] if i == 0 else self.value(items, k, r[i])) for i, (_, k) in enumerate(columns)) + b"\0" for r in rows]
        each = 3
        blocks = [self.block(b"".join(cells[i : i + each]) + bytes(width // 2)) for i in range(0, len(cells), each)]
        top = blocks[0] if len(blocks) == 1 else self.block(struct.pack("<BBHI", 1, 1, len(blocks), 0) + struct.pack(f"<{len(blocks)}{self.f}", *blocks), True)
        items[0] = struct.pack("<BBHHHHIII", 0x7C, len(columns), 0, 0, 0, width, 0, 0x3F, 0) + b"".join(struct.pack("<HHHBB", k, p, 4 * i, 4, i) for i, (p, k) in enumerate(columns))
        return self.data(self.heap(0x7C, items, 0)), self.subs({0x3F: (top, 0)})

    def tree(self, entries):
        def page(rows, level):
            place = len(self.body)
            size = len(rows[0])
            raw = b"".join(rows)
            tail = bytes((len(rows), len(rows), size, level))
            self.body += (raw.ljust(488, b"\0") + tail).ljust(512, b"\0") if self.wide else (raw.ljust(496, b"\0") + tail).ljust(512, b"\0")
            return place

        while len(self.body) % 512:
            self.body += b"\0"
        rows, level = entries, 0
        while True:
            cut = [rows[i : i + FAN] for i in range(0, len(rows), FAN)]
            pages = [page(c, level) for c in cut]
            if len(pages) == 1:
                return pages[0]
            rows = [struct.pack(f"<3{self.f}", int.from_bytes(c[0][: self.w], "little"), 0, p) for c, p in zip(cut, pages, strict=True)]
            level += 1

    def file(self) -> bytes:
        f = self.f
        nodes = self.tree([struct.pack(f"<3{f}", n, d, s) + bytes(8 if self.wide else 4) for n, (d, s) in sorted(self.nodes.items())])
        blocks = self.tree([struct.pack(f"<2{f}HH", b, at, n, 1) + bytes(4 if self.wide else 0) for b, at, n in sorted(self.blocks)])
        self.body[:12] = b"!BDN" + bytes(4) + b"SM" + struct.pack("<H", 23 if self.wide else 15)
        for o, v in zip((224, 240) if self.wide else (188, 196), (nodes, blocks), strict=True):
            struct.pack_into(f"<{f}", self.body, o, v)
        self.body[513 if self.wide else 461] = int(self.table is not None)
        return bytes(self.body)
