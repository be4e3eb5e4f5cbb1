"""The mail API source, the sync and the store loop over a recorded mailbox."""

from __future__ import annotations

import base64
import json

import pytest

from postloom import cli
from postloom.functions import compose
from postloom.operators import export, search, storing
from postloom.operators.filters import Mail
from postloom.operators.store import Archive
from postloom.sources import api
from postloom.streaming import sync

CLIENT = "postloom.sources.api:Recorded"


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def message(key, **more):
    inner = {"mimeType": "message/rfc822", "filename": "in.eml", "headers": [{"name": "Subject", "value": "Inner"}], "parts": [{"mimeType": "text/plain", "body": {"data": b64("inside")}}]}
    parts = [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": b64(f"text ~ {key} ÿ")}}, {"mimeType": "text/html", "body": {"data": b64("<b>t</b>")}}]}, {"mimeType": "application/pdf", "filename": "r.pdf", "body": {"attachmentId": "A1", "size": 9}}]
    heads = {"From": "Jane <J@x.y>", "To": "a@b.c, A@B.c", "Subject": f"Hello {key}"}
    return {"id": key, "threadId": "t", "internalDate": "1735689600000", "labelIds": ["INBOX"], "snippet": "s", "payload": {"mimeType": "multipart/mixed", "headers": [{"name": k, "value": v} for k, v in heads.items()], "parts": parts + ([inner] if more.get("inner") else [])}}


@pytest.fixture
def box(tmp_path):
    def put(name, what):
        path = tmp_path / "box" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(what if isinstance(what, bytes) else json.dumps(what).encode())

    for i in range(7):
        put(f"messages/m{i}.json", message(f"m{i}", inner=i == 3))
    put("attachments/A1", b"%PDF")
    put("labels.json", [{"id": "INBOX", "name": "INBOX"}])
    put("history.json", [[5, "m6"]])
    return put, f"file://{tmp_path}/box"


def test_mailbox(spark, box):
    rows = {r.id: r for r in api.mailbox(spark, CLIENT, box[1], recursive="true", withAttachments="true", chunk="2").collect()}
    assert len(rows) == 8 and rows["gmail:m3_att1"].subject == "Inner" and rows["gmail:m3_att1"].body_text == "inside" and rows["gmail:m3_att1"].thread_id == "t"
    r = rows["gmail:m0"]
    assert (r.body_text, r.body_mime_type, r.body_html, r.label_ids, r.internal_date_ms) == ("text ~ m0 ÿ", "text/plain", "<b>t</b>", "INBOX", 1735689600000)
    assert [(a.role, a.address, a.name) for a in r.addresses] == [("from", "j@x.y", "Jane"), ("to", "a@b.c", None)]
    assert bytes(r.attachments[0].content) == b"%PDF" and r.attachments[0].size == 4
    assert api.mailbox(spark, CLIENT, box[1], q="hello m2").count() == 1


def test_sync(spark, box, tmp_path):
    put, uri = box
    archive = Archive(spark, f"file://{tmp_path}/archive")
    assert sync.sync(archive, CLIENT, uri, f"file://{tmp_path}/cp", withAttachments="true") == "full"
    first = {r.id: r.fetched_at for r in archive.read("messages").collect()}
    assert len(first) == 7 and archive.read("blobs").count() == 1 and archive.read("addresses").count() == 14
    put("messages/m9.json", message("m9"))
    put("messages/m1.json", message("m1") | {"snippet": "new"})
    put("history.json", [[5, "m6"], [6, "m9"], [7, "m1"], [8, "m9"]])
    assert sync.sync(archive, CLIENT, uri, f"file://{tmp_path}/cp") == "changes"
    rows = {r.id: r for r in archive.read("messages").collect()}
    assert len(rows) == 8 and rows["gmail:m1"].snippet == "new" and rows["gmail:m1"].fetched_at == first["gmail:m1"]
    assert archive.read("attachments").count() == 9 and archive.state.get("history") == 8
    got = search.results(archive.read("messages"), "m9", index=archive.read("postings")).collect()
    assert [r.id for r in got] == ["gmail:m9"]
    put("history.json", [[50, "m0"]])
    assert sync.sync(archive, CLIENT, uri, f"file://{tmp_path}/cp") == "full"
    assert archive.migrate_ids("gmail:") == 0


def test_store(spark, box, tmp_path):
    archive = Archive(spark, f"file://{tmp_path}/archive")
    archive.take(api.mailbox(spark, CLIENT, box[1], withAttachments="true"), spark.createDataFrame([("INBOX", "Work")], "id string, name string"))
    ready = export.candidates(Mail(*[archive.read(t) for t in ("messages", "labels", "addresses", "attachments")]), archive.read("blobs"))
    book = f"file://{tmp_path}/ledger"
    go = lambda **k: storing.store_messages(spark, ready, CLIENT, box[1], book, batch=2, rate=1e6, **k)
    assert go(limit=3) == {"stored": 3, "failed": 0}
    assert storing.candidates_left(spark, ready, book).count() == 4
    assert go() == {"stored": 4, "failed": 0} and go() == {"stored": 0, "failed": 0}
    sent = [json.loads(p.read_text()) for p in (tmp_path / "box" / "put").iterdir()]
    assert len(sent) == 7 and all(len(s["labelIds"]) == 2 for s in sent)
    assert {x["name"] for x in api.Recorded(box[1]).labels()} > {"INBOX", "Work"} and len(api.Recorded(box[1]).labels()) == 3
    book = f"file://{tmp_path}/ledger2"
    assert go(largest=10) == {"stored": 0, "failed": 7} and storing.candidates_left(spark, ready, book).count() == 7
    smallest = min(len(r.raw) for r in export.as_eml(ready).collect())
    assert go(largest=smallest - 1) == {"stored": 7, "failed": 0}
    assert storing.ledger(spark, book).filter("remote_id IS NOT NULL AND dropped > 0").count() == 7


def test_source_is_read_once(spark, box, tmp_path):
    put, uri = box
    archive = Archive(spark, f"file://{tmp_path}/archive")
    rows = api.mailbox(spark, "tests.test_api:Counting", uri, withAttachments="true")
    archive.take(rows)
    archive.take(rows)
    assert sorted((tmp_path / "box" / "calls").read_text().split()) == sorted([f"m{i}" for i in range(7)] * 2)
    assert archive.read("messages").count() == 7 and archive.read("blobs").count() == 1


class Counting(api.Recorded):
    """Notes each message that is fetched."""

    def message(self, key):
        with open(f"{self.root}/calls", "a") as f:
            f.write(key + "\n")
        return super().message(key)


def test_clean_up(spark, box, capsys):
    put, uri = box
    account = ["--client", CLIENT, "--account", uri]
    assert cli.main(["clean-up", "INBOX", *account]) == 0 and "7 messages and 1 labels to remove" in capsys.readouterr().out
    assert cli.main(["clean-up", "INBOX", "--apply", *account]) == 0
    assert api.Recorded(uri).labels() == [] and api.mailbox(spark, CLIENT, uri).count() == 0
    assert cli.main(["account", *account]) == 0 and "Labels: 0" in capsys.readouterr().out


def test_waiting():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise api.ApiError(403, "rateLimitExceeded")
        return 7

    assert api.patiently(call, sleep=waits.append) == 7 and waits == [2.0, 4.0, 8.0]
    with pytest.raises(api.ApiError):
        api.patiently(lambda: (_ for _ in ()).throw(api.ApiError(400, "bad")), sleep=waits.append)
