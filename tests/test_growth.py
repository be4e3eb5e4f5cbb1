"""Steps that once grew faster than their input, or ran as a single task."""

from __future__ import annotations

import json
from collections import Counter
from email import message_from_bytes, policy
from email.message import EmailMessage
from email.utils import getaddresses

import pytest
from pyspark.sql import functions as F

from postloom.functions import compose, mail
from postloom.operators import search, verify
from postloom.plans import archived
from postloom.sources import api


class Lists:
    """A file system that counts its listings."""

    def __init__(self, store):
        self.store, self.n = store, 0

    def get_file_info(self, what):
        self.n += not isinstance(what, str)
        return self.store.get_file_info(what)

    def __getattr__(self, name):
        return getattr(self.store, name)


def test_a_folder_is_listed_once_not_for_each_page(tmp_path, monkeypatch):
    monkeypatch.setattr(api, "CHUNK", 3)
    for i in range(20):
        at = tmp_path / "messages" / (api.drawer(f"m{i}") if i % 2 else "")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"m{i}.json").write_text(json.dumps({"id": f"m{i}"}))
    box = api.Recorded(f"file://{tmp_path}")
    box.store = Lists(box.store)
    folders = len({api.drawer(f"m{i}") for i in range(1, 20, 2)})
    assert sorted(api.pages(lambda page: box.ids(None, page))) == sorted(f"m{i}" for i in range(20))
    assert box.store.n == 2 + folders
    assert [box.message(f"m{i}")["id"] for i in range(20)] == [f"m{i}" for i in range(20)]
    # A page is also found by a client that has listed nothing yet.
    first, page = box.ids(None, None)
    assert api.Recorded(f"file://{tmp_path}").ids(None, page) == box.ids(None, page)


SUBJECTS = ("1-URGENT order 7", "a  b", "é", "=?utf-8?q?x?=", "x: y; z", " a", "")
SENDERS = ("C#1 <c.1@x.example>", "a@b.c, D E <d@e.f>", "Doe, J (x) <j@x>", '"A, B" <q@r>', "é <e@f>", "=?utf-8?q?x?= <a@b>", "a@b,c@d", "")
BODIES = ("Segment X", "", "a\nb\n\n", "a\r\nb\rc", "ÿ" * 39, "ÿ" * 40, "x" * 79, "From me")


@pytest.mark.parametrize("sender", SENDERS)
def test_single_parts_are_written_and_read_as_by_the_library(sender, monkeypatch):
    for subject in SUBJECTS:
        for body in BODIES:
            row = {"id": "gmail:1", "sender": sender, "subject": subject, "internal_date_ms": 820540800000, "body_text": body}
            files = [{"filename": "part.bin", "mime_type": "a/b", "size": 4, "content": None}]
            raw = compose.eml(row, ["F", "Flags/Urgent"], files)
            with monkeypatch.context() as m:
                m.setattr(compose, "single", lambda *_: None)
                assert raw == compose.eml(row, ["F", "Flags/Urgent"], files)
            for held in (raw, raw.replace(b"\n", b"\r\n"), b"From x\n" + raw, raw.replace(b"Subject", b"Subject "), raw.replace(b": ", b":\n ", 2), raw.replace(b"text/plain", b"message/rfc822")):
                want, got = message_from_bytes(held, policy=policy.compat32), mail.parsed(held)
                assert want.items() == got.items() and want.as_bytes() == got.as_bytes() and mail.row(want, "", 0) == mail.row(got, "", 0)
    assert mail.people([sender]) == getaddresses([mail.quoted_names(sender)])


def test_a_plain_message_needs_no_tree_of_parts(monkeypatch):
    monkeypatch.setattr(EmailMessage, "set_content", None)
    monkeypatch.setattr(mail, "message_from_bytes", None)
    raw = compose.eml({"id": "gmail:1", "sender": SENDERS[0], "subject": SUBJECTS[0], "internal_date_ms": 5, "body_text": "é"}, [], [])
    assert compose.read_back(mail.parsed(raw))["body_text"] == "é\n"


def test_a_segment_of_the_index_holds_whole_rows_sorted_by_term(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SEGMENT", 400)
    rows = spark.createDataFrame([(f"d{i}", f"Title {i}", f"license apache {'é ж'[i % 3]} word{i % 5} license") for i in range(60)], "id string, subject string, body_text string")
    index = search.build(rows, f"file://{tmp_path}")
    files = index.postings.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    assert {r.n for r in files.groupBy("id").agg(F.count_distinct("file").alias("n")).collect()} == {1}
    assert files.select("file").distinct().count() >= 8
    held = files.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("t")).collect()
    assert all(r.t == sorted(r.t) for r in held)
    assert (index.rows, index.total, index.lengths.agg(F.sum("dl")).first()[0]) == (60, index.postings.count(), index.total)
    for text in ("license", "lic* NOT word3", '"apache ж"', "NEAR(title license, 3)"):
        assert sorted(search.search(rows, text, -1, index).collect()) == sorted(search.search(rows, text, -1).collect())


def leaves(rows):
    return rows._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def kept(spark, rows, path):
    """Rows as a table, which a plan shows each use of."""
    rows.write.parquet(f"file://{path}")
    return spark.read.parquet(f"file://{path}")


def test_row_differences_go_over_each_side_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(verify, "COPIES", 7)
    left = kept(spark, spark.createDataFrame([("a", None)] * 30 + [("b", 1)] * 3 + [("c", 2)] * 7 + [(None, None)], "x string, y int"), tmp_path / "l")
    right = kept(spark, spark.createDataFrame([("a", None)] + [("b", 1)] * 10 + [("d", 4)] * 15 + [(None, None)], "x string, y int"), tmp_path / "r")
    got = verify.row_differences(left, right)
    want = left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
    assert Counter(got.collect()) == Counter(want.collect()) and leaves(got) == 2 and got.columns == want.columns


def test_a_mailbox_is_compared_in_one_join(spark, tmp_path):
    kind = "id string, subject string, internal_date_ms long, sender string, body_text string, label_names array<string>"
    sent = [("a", "s1", 1, "J <J@x>", "t", ["L"]), ("b", "s2", 1, "x@y", "t", ["L"]), ("c", "s3", None, "x@y", "t", []), ("d", "s3", None, "x@y", "t", []), ("e", None, 5, None, None, ["L"]), ("f", "s6", 6, "x@y", "t", ["L", "M"]), ("g", "s7", 7, "x@y", "t", None), ("h", "s8", 8, "x@y", "t", [])]
    back = [("A", "s1", 1, 'j <"j"@X>', "t\r\n", ["run-1", "L"]), ("B", "s2", 1, "x@z", "u", ["L"]), ("C", "s3", None, "x@y", "t", []), ("E", None, 5, None, "", ["L", "run-1"]), ("F", "s6", 6, "x@y", "t", ["L", "run-1"]), ("G", "s7", 7, "x@y", "t", ["run-1"]), ("H", "s8", 8, "x@y", "t", ["other"]), ("I", "s9", 9, "x@y", "t", [])]
    got = verify.mailbox_differences(kept(spark, spark.createDataFrame(sent, kind), tmp_path / "s"), kept(spark, spark.createDataFrame(back, kind), tmp_path / "b"), "run-")
    assert leaves(got) == 4
    assert Counter(map(tuple, got.collect())) == Counter([
        ("a", "A", "sender", "J <j@x>", "j <j@x>"), ("b", "B", "sender", " <x@y>", " <x@z>"), ("b", "B", "body_text", "t", "u"), ("b", "B", "labels", "", ""), ("f", "F", "labels", "M", "run-1"), ("h", "H", "labels", "", "other"),
        ("c", None, "<row>", "present", None), ("d", None, "<row>", "present", None), (None, "C", "<row>", None, "present"), (None, "I", "<row>", None, "present"),
    ])


def test_trees_are_written_by_many_tasks_and_read_once(spark, tmp_path, monkeypatch):
    tasks = []
    monkeypatch.setattr(archived.generated, "each", lambda rows, _: tasks.append(rows.rdd.getNumPartitions()))
    monkeypatch.setattr(archived.sources, "exported_tree", lambda *_, **__: None)
    archived.tree_of(spark.createDataFrame([("a", "s", 1, "x@y", "t", "text/plain", "A")], "id string, subject string, internal_date_ms long, sender string, body_text string, body_mime_type string, label_ids string"))
    assert tasks == [4 * spark.sparkContext.defaultParallelism]
    ddl = "id string, subject string, date string, sender string, recipient string, cc string, bcc string, body_text string, body_html string, attachments array<struct<filename string, mime_type string, content_id string, content binary>>, label_names array<string>"
    a, b = [("a", "s", None, "J <j@x>", None, None, None, "t", None, [], ["L"])], [("a", "s", None, "J <k@x>", None, None, None, "t\n", None, [], ["M"])]
    got = verify.tree_differences(kept(spark, spark.createDataFrame(a, ddl), tmp_path / "a"), kept(spark, spark.createDataFrame(b, ddl), tmp_path / "b"))
    assert leaves(got) == 2 and sorted(map(tuple, got.collect())) == [("a", "labels", "L", "M"), ("a", "sender", "J <j@x>", "J <k@x>")]


def test_rows_of_a_source_are_no_union_with_an_empty_table(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(archived.Archive, "take", lambda _, rows: taken.append(rows))
    archived.taken(spark, "/root/testdata/sf0.001")
    assert ["LogicalRDD" in rows._jdf.queryExecution().optimizedPlan().toString() for rows in taken] == [False, False]
