"""Personal folder files written here block by block, read back as tables."""

from __future__ import annotations

import random
import struct

import pytest

from postloom.sources import pst as source
from postloom.sources.pst_writer import Writer


def sample(wide, table=None):
    w = Writer(wide, table)
    u, b = (0x1F, 0x102) if wide else (0x1E, 0x102)
    time = 133801632000000000  # 2025-01-01
    ids = lambda *n: [(i,) for i in n]
    w.nodes[0x122] = w.properties({0x3001: (u, "")})
    w.nodes[0x12D] = w.table_of([(0x67F2, 3)], ids(0x142))
    w.nodes[0x142] = w.properties({0x3001: (u, "Inbox")})
    inner = w.properties({0x0037: (u, "Inner"), 0x1035: (u, "<inner@x>"), 0x1000: (u, "in")})
    plain = w.properties({0x370E: (u, "image/png"), 0x3707: (u, "ü.png"), 0x3701: (b, (None, 0x5F)), 0x3712: (u, "c@d"), 0x0E20: (3, 20011)}, {0x5F: (w.data(b"\x89png" * 5000), 0)})
    items = {0x3704: (u, "IN.MSG"), 0x3701: (0xD, struct.pack("<II", 0x84, 9))}
    nested = w.properties(items, {0x84: inner})
    people = w.table_of([(0x67F2, 3), (0x0C15, 3), (0x3001, u), (0x3003, u)], [(i, 1 + i % 3, f"P {i}", f"P{i}@x.y" if i < 6 else "/o=dir") for i in range(7)])
    files = w.table_of([(0x67F2, 3)], ids(0x8005, 0x8025))
    first = {0x0037: (u, "\x01\x05Re: Hi"), 0x1000: (u, "hé\n" * 9000 if wide else "hé"), 0x1013: (b, b"<b>x</b>"), 0x0039: (0x40, time), 0x0C1A: (u, "Jane"), 0x0C1F: (u, "J@x.y"), 0x1035: (u, "<1@x>")}
    if wide:  # too long for a heap
        first[0x1000] = (u, (None, 0x7F))
    w.nodes[0x200004] = w.properties(first, {0x692: people, 0x671: files, 0x8005: plain, 0x8025: nested} | ({0x7F: (w.data(("hé\n" * 9000).encode("utf-16-le")), 0)} if wide else {}))
    head = "From: Doe, J <d@e.f>\r\nTo: =?utf-8?q?=C3=A9?= <t@u.v>\r\nSubject: S\r\nMessage-ID: <2@x>\r\nDate: Wed, 01 Jan 2025 00:00:00 +0000\r\n"
    w.nodes[0x200024] = w.properties({0x007D: (u, head), 0x0E06: (0x40, time + 10**7)})
    rest = range(0x200044, 0x200044 + 32 * 25, 32)
    for n in rest:
        w.nodes[n] = w.properties({0x0037: (u, f"bare {n}")})
    w.nodes[0x14E] = w.table_of([(0x67F2, 3)], ids(0x200004, 0x200024, *rest))
    return w


@pytest.mark.parametrize("wide, permuted", [(True, False), (False, False), (True, True)])
def test_pst(spark, tmp_path, wide, permuted):
    table = None
    more = {}
    if permuted:
        order = list(range(256))
        random.Random(3).shuffle(order)
        table = bytes(order)
        (tmp_path / "table").write_bytes(table)
        more = {"permutation": f"file://{tmp_path}/table"}
    (tmp_path / "a.pst").write_bytes(sample(wide, table).file())
    rows = source.pst(spark, f"file://{tmp_path}/a.pst", withAttachments="true", recursive="true", chunk="4", **more).orderBy("seq").collect()
    assert [r.id for r in rows[:3]] == ["outlook:<1@x>", "outlook:<inner@x>", "outlook:<2@x>"] and len(rows) == 28 and all(r.id.startswith("outlook:sha1:") for r in rows[3:])
    r = rows[0]
    assert (r.subject, r.body_text, r.body_html, r.internal_date_ms, r.label_ids) == ("Re: Hi", "hé\n" * 9000 if wide else "hé", "<b>x</b>", 1735689600000, "outlook:Inbox")
    assert r.date == "Wed, 01 Jan 2025 00:00:00 +0000" and r.sender == "Jane <j@x.y>" and r.cc == "P 1 <p1@x.y>, P 4 <p4@x.y>"
    assert [(a.role, a.address) for a in r.addresses] == [("from", "j@x.y")] + [(("to", "cc", "bcc")[i % 3], f"p{i}@x.y") for i in range(6)]
    assert [(a.filename, a.mime_type, a.size, a.content_id) for a in r.attachments] == [("ü.png", "image/png", 20000, "<c@d>"), ("IN.MSG", None, None, None)] and bytes(r.attachments[0].content) == b"\x89png" * 5000
    assert rows[1].body_text == "in" and rows[1].label_ids == "outlook:Inbox"
    assert rows[2].sender == '"Doe, J" <d@e.f>' and rows[2].addresses[1].name == "é" and rows[2].internal_date_ms == 1735689601000


def test_other_files(tmp_path):
    for raw in (b"", b"!BDN" + bytes(600), b"!BDN" + bytes(4) + b"SM" + struct.pack("<H", 19) + bytes(600)):
        (tmp_path / "x").write_bytes(raw)
        with (tmp_path / "x").open("rb") as f, pytest.raises(source.PstError):
            source.Pst(f)
