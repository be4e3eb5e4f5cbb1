"""Messages written as files and read back."""

from __future__ import annotations

import email
import json
from email import policy

import pytest
from hypothesis import given
from hypothesis import strategies as st

from postloom.functions import compose
from postloom.operators import export
from postloom.operators.filters import Mail
from postloom.sources import mail as sources

BASE = {"id": "gmail:1", "thread_id": "t", "sender": "Jané, D <j@x.y>", "recipient": "a@b.c", "cc": None, "bcc": "", "subject": "Über\r\nalles", "date": None, "internal_date_ms": 1735689600123, "body_text": "hé\nlo", "body_mime_type": "text/plain", "body_html": None}
FILES = [
    {"filename": "r.pdf", "mime_type": "application/pdf", "size": 4, "content_sha256": "x", "content_id": None, "content": b"%PDF"},
    {"filename": "i.png", "mime_type": "image/png", "size": 3, "content_sha256": "y", "content_id": "<c@d>", "content": b"\x89\r\n"},
    {"filename": "n.txt", "mime_type": "text/plain", "size": 2, "content_sha256": "z", "content_id": None, "content": b"\r\n"},
    {"filename": "lost (1).doc", "mime_type": "application/msword", "size": 77, "content_sha256": None, "content_id": None, "content": None},
]


def parsed(raw):
    return email.message_from_bytes(raw, policy=policy.compat32)


@pytest.mark.parametrize("text, kind, html", [("hé\nlo", "text/plain", None), ("plain", "text/plain", "<b>rich</b>"), ("<b>rich</b>", "text/html", "<b>rich</b>"), ("<i>x</i>", "text/html", None), (None, None, None)])
def test_eml_reads_back(text, kind, html):
    row = BASE | {"body_text": text, "body_mime_type": kind, "body_html": html}
    raw = compose.eml(row, ["Work", "A b"], FILES)
    back = compose.read_back(parsed(raw), content=True)
    assert {k: back[k] for k in ("id", "thread_id", "internal_date_ms", "label_names", "recipient", "subject")} == {"id": "gmail:1", "thread_id": "t", "internal_date_ms": 1735689600123, "label_names": ["Work", "A b"], "recipient": "a@b.c", "subject": "Über alles"}
    assert back["body_text"].rstrip("\n") == (text or "") and back["body_mime_type"] == (kind or "text/plain")
    assert (back["body_html"] or "").rstrip("\n") == (html or (text if kind == "text/html" else "") or "")
    assert back["addresses"][0] == {"role": "from", "address": "j@x.y", "name": "Jané, D"}
    told = {a["filename"]: a for a in back["attachments"]}
    assert {n: a["content"] for n, a in told.items()} == {f["filename"]: f["content"] for f in FILES}
    assert told["n.txt"]["mime_type"] == "application/octet-stream" and told["lost (1).doc"]["size"] == 77
    assert told["i.png"]["content_id"] == ("<c@d>" if html or kind == "text/html" else None)
    assert b"Date: Wed, 01 Jan 2025" in raw and compose.read_back(parsed(b"Subject: x\n\ny")) is None


@given(st.text(), st.text(), st.one_of(st.none(), st.integers(0, 4 * 10**12)))
def test_any_subject_and_text(subject, text, ms):
    safe = "".join(c for c in text if c.isprintable() or c == "\n")
    line = " ".join("".join(c for c in subject if c.isprintable()).split())
    back = compose.read_back(parsed(compose.eml(BASE | {"subject": line, "body_text": safe, "internal_date_ms": ms}, [], [])))
    assert back["body_text"].rstrip("\n") == safe.rstrip("\n") and back["internal_date_ms"] == (ms or 0)
    assert (back["subject"] or "").replace(" ", "") == line.replace(" ", "")


def test_attachments_are_taken_out():
    raw, gone = compose.without_attachments(compose.eml(BASE, ["L"], FILES))
    assert sorted(gone) == ["i.png", "n.txt", "r.pdf"] and compose.without_attachments(raw) is None
    back = compose.read_back(parsed(raw))
    assert back["id"] == "gmail:1" and back["body_text"].startswith("hé\nlo") and "r.pdf" in back["body_text"]


def test_markdown():
    text = compose.markdown(BASE, ["Work"], FILES[:1]).decode()
    head = dict(line.split(": ", 1) for line in text.split("---\n")[1].splitlines())
    assert json.loads(head["labels"]) == ["Work"] and json.loads(head["internal_date"]) == "2025-01-01T00:00:00.123000+00:00" and "bcc" not in head
    assert text.endswith("---\n\nhé\nlo\n") and json.loads(head["attachments"])[0]["size"] == 4


def test_tree(spark, tmp_path):
    rows = [(f"gmail:{i}", "s@t.u", f"S {i}", 1735689600000 if i % 2 else None, "L1,L2" if i % 3 else None, f"body {i}") for i in range(12)]
    messages = spark.createDataFrame(rows, "id string, sender string, subject string, internal_date_ms long, label_ids string, body_text string")
    labels = spark.createDataFrame([("L1", "Work")], "id string, name string")
    files = spark.createDataFrame([("gmail:1", "a:b.bin", "image/png", 2, "h1", None), ("gmail:1", "gone", None, 9, None, None)], "message_id string, filename string, mime_type string, size long, content_sha256 string, content_id string")
    blobs = spark.createDataFrame([("h1", bytearray(b"ok"))], "content_sha256 string, content binary")
    held = Mail(messages, labels, spark.createDataFrame([], "message_id string, role string, address string, name string"), files)
    ready = export.candidates(held, blobs)
    told = {r.id: r.path for r in export.write_tree(ready, f"file://{tmp_path}/e").collect()}
    assert told["gmail:0"] == "unknown/gmail_0.eml" and told["gmail:1"] == "2025/01/gmail_1.eml"
    back = sources.exported_tree(spark, f"file://{tmp_path}/e", content=True)
    got = {r.id: r for r in back.collect()}
    assert len(got) == 12 and got["gmail:1"].label_names == ["Work", "L2"] and got["gmail:3"].label_names == []
    assert [(a.filename, a.size, bytes(a.content) if a.content else None) for a in got["gmail:1"].attachments] == [("gone", 9, None), ("a:b.bin", 2, b"ok")]
    resolved, made = sources.label_ids_of(back, labels)
    assert {r.id: r.label_ids for r in resolved.select("id", "label_ids").collect()}["gmail:1"] == "L1,import-eml:L2"
    assert [tuple(r) for r in made.collect()] == [("import-eml:L2", "L2")]
    assert export.write_tree(ready, f"file://{tmp_path}/m", "md").count() == 12
    assert (tmp_path / "m/2025/01/gmail_1.attachments/a_b.bin").read_bytes() == b"ok"


def test_detect(tmp_path):
    for name, data, kind in (("a.pst", b"", "pst"), ("b", b"!BDN1", "pst"), ("c.mbox", b"From ", "mbox"), ("d.eml", b"", "eml"), ("e.txt", b"x", "unknown")):
        (tmp_path / name).write_bytes(data)
        assert sources.detect(f"file://{tmp_path}/{name}") == kind
    assert sources.detect(f"file://{tmp_path}") == "unknown"
    (tmp_path / "prefs.js").write_text("")
    assert sources.detect(f"file://{tmp_path}") == "thunderbird_profile" and sources.detect(f"file://{tmp_path}/none") == "unknown"
