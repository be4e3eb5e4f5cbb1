"""Mail archives written with the standard library, read back as tables."""

from __future__ import annotations

import hashlib
import mailbox
import zipfile
from email import message_from_bytes
from email.message import EmailMessage
from email.utils import getaddresses

import pytest

from postloom.functions import mail
from postloom.sources import mail as sources


def message(i, **more):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = f"Jane {i} <J{i}@x.y>", "a@b.c, D <d@e.f>", f"Subject {i} é"
    m["Message-ID"], m["Date"] = f"<{i}@x>", "Wed, 01 Jan 2025 00:00:00 +0000"
    m.set_content(f"text {i}\n\nFrom the body\n" * (1 + i % 5))
    if more.get("pdf"):
        m.add_attachment(b"%PDF" + bytes([i]), maintype="application", subtype="pdf", filename="r.pdf")
    return m


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    path = tmp_path_factory.mktemp("mail") / "INBOX"
    box = mailbox.mbox(path)
    for i in range(40):
        box.add(message(i, pdf=i % 4 == 0))
    box.flush()
    return path


@pytest.mark.parametrize("chunk", ["64000000", "700", "333"])
def test_ranges_read_every_message_once(spark, store, chunk):
    rows = sources.mbox(spark, f"file://{store}", chunk=chunk).orderBy("seq").collect()
    assert [r.id for r in rows] == [f"thunderbird:<{i}@x>" for i in range(40)]
    assert [len(r.attachments) for r in rows] == [int(i % 4 == 0) for i in range(40)]
    assert rows[4].subject == "Subject 4 é" and rows[4].internal_date_ms == 1735689600000 and rows[4].attachments[0].size == 5
    assert [(a.role, a.address, a.name) for a in rows[0].addresses] == [("from", "j0@x.y", "Jane 0"), ("to", "a@b.c", None), ("to", "d@e.f", "D")]
    assert rows[3].body_text == "text 3\n\n>From the body\n" * 4 and rows[3].body_mime_type == "text/plain"


def test_zip_and_profile(spark, store, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.pcv", "w") as z:
        for name in ("ImapMail/acc/INBOX", "Mail/Local Folders/Archive.sbd/2026", "Mail/Local Folders/INBOX.msf", "prefs.js"):
            z.writestr(name, store.read_bytes())
    rows = sources.mbox(spark, f"file://{tmp_path}/a.pcv", withAttachments="true")
    assert rows.count() == 80 and rows.select("label_ids").distinct().count() == 2
    assert rows.filter("exists(attachments, a -> a.content IS NOT NULL)").count() == 20
    assert sources.folder_of("Mail/Local Folders/Archive.sbd/2026") == "Local Folders/Archive/2026"


def test_an_empty_profile(spark, tmp_path):
    (tmp_path / "Mail").mkdir()
    assert sources.mbox(spark, f"file://{tmp_path}").collect() == []


def test_eml_tree(spark, tmp_path):
    for i in range(3):
        (tmp_path / "2025" / "01").mkdir(parents=True, exist_ok=True)
        (tmp_path / "2025" / "01" / f"{i}.eml").write_bytes(message(i).as_bytes())
    rows = sources.eml_tree(spark, f"file://{tmp_path}").orderBy("path").collect()
    assert [r.id for r in rows] == [f"eml:<{i}@x>" for i in range(3)] and rows[0].addresses[0].address == "j0@x.y"


@pytest.mark.parametrize(
    "header, pairs",
    [
        ("a@b.c <x@y.z>", [("a@b.c", "x@y.z")]), ("Doe, Jane <j@x.y>, bob@z.w", [("Doe, Jane", "j@x.y"), ("", "bob@z.w")]), ("[list] name <l@m>", [("[list] name", "l@m")]),
        ('Jane (work) <j@x>, "A, B" <q@r>', [("Jane (work)", "j@x"), ("A, B", "q@r")]), ("plain <p@q>", [("plain", "p@q")]),
    ],
)
def test_names_are_quoted(header, pairs):
    assert getaddresses([mail.quoted_names(header)]) == pairs
    assert mail.quoted_names(mail.quoted_names(header)) == mail.quoted_names(header)


def test_encoded_words():
    assert mail.decoded("=?utf-8?B?Q2Fmw6kgVGVzdA==?=") == "Café Test" and mail.decoded("a\r\n b") == "a b" and mail.decoded("=?x-none?Q?=E9?=") == "�" and mail.decoded(None) == ""


def test_ids_and_times_without_headers():
    raw = b"Subject: =?utf-8?q?=C3=A9?=\nFrom: a@b\n\nbody\n"
    m = message_from_bytes(raw)
    line = "- Thu Jan 15 16:42:05 2009"
    want = hashlib.sha1(("=?utf-8?q?=C3=A9?=" + "a@b" + line + "body\n").encode()).hexdigest()
    assert mail.message_id(m, line, "thunderbird:") == f"thunderbird:sha1:{want}"
    assert mail.sent(m, line) == ("Thu, 15 Jan 2009 16:42:05 +0000", 1232037725000) and mail.sent(m, "-") == (None, None)
