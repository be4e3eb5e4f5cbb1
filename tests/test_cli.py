"""Whole runs of the command line, schedules and comparison."""

from __future__ import annotations

import logging
import mailbox
from email.message import EmailMessage

import pytest

from postloom import cli
from postloom.functions import logs, schedule
from postloom.operators import verify
from postloom.operators.store import Archive
from postloom.sources import mail


def test_commands(spark, tmp_path, capsys):
    folder = tmp_path / "profile" / "Mail" / "Local Folders"
    folder.mkdir(parents=True)
    box = mailbox.mbox(folder / "Inbox")
    for i in range(5):
        m = EmailMessage()
        m["From"], m["To"], m["Subject"], m["Message-ID"], m["Date"] = f"Jane <j{i % 2}@x.y>", "a@b.c", f"Invoice {i}", f"<{i}@x>", "Wed, 01 Jan 2025 00:00:00 +0000"
        m.set_content(f"body {i}")
        if i == 4:
            inner = EmailMessage()
            inner["Subject"], inner["Message-ID"] = "Inner", "<in@x>"
            inner.set_content("inside")
            m.add_attachment(inner)
            m.add_attachment(b"%PDF", maintype="application", subtype="pdf", filename="r.pdf")
        box.add(m)
    box.flush()
    db = ["--db", f"{tmp_path}/db"]
    go = lambda *words: (cli.main([*words, *db]), capsys.readouterr().out)
    assert go("import", f"{tmp_path}/profile", "--with-attachments", "--recursive")[0] == 0
    told = go("stats", "--filter", "has:attachment")[1]
    assert "Messages: 1\n" in told and "Local Folders/Inbox" in told
    assert "«Invoice» «3»" in go("search", "invoice 3")[1] and "No matching" in go("search", "nothing")[1]
    assert go("stats", "--filter", "what:x")[0] == 1
    assert go("export", f"{tmp_path}/out", "--format", "eml")[1] == "6 messages written\n"
    first = Archive(spark, f"file://{tmp_path}/db")
    assert cli.main(["import-eml", f"{tmp_path}/out", "--db", f"{tmp_path}/db2"]) == 0
    second = Archive(spark, f"file://{tmp_path}/db2")
    columns = ["id", "subject", "sender", "recipient", "date", "internal_date_ms", "body_text"]
    rows = first.read("messages").filter("sender IS NOT NULL").select(*columns)
    assert verify.message_differences(rows, second.read("messages").filter("subject <> 'Inner'").select(*columns)).collect() == []
    held = [a.read("attachments").filter("filename = 'r.pdf'") for a in (first, second)]
    assert verify.attachment_differences(*held).collect() == [] and held[1].count() == 1
    assert [r.field for r in verify.attachment_differences(held[0], held[1].limit(0)).collect()] == ["<row>"]
    assert [r.side for r in verify.row_differences(first.read("addresses"), second.read("addresses").filter("address <> 'a@b.c'")).distinct().collect()].count("left") >= 1


def test_compare_migrate_and_log(spark, tmp_path, capsys):
    schema = "id string, subject string, seq long"
    for name, subject in (("one", "a"), ("two", "b")):
        rows = spark.createDataFrame([("x1", subject, 0), ("outlook:2", "c", 0)], schema)
        Archive(spark, f"file://{tmp_path}/{name}").take(spark.createDataFrame([], mail.SCHEMA).unionByName(rows, allowMissingColumns=True))
    go = lambda *words: (cli.main(list(words)), capsys.readouterr().out)
    told = go("--log-file", f"{tmp_path}/logs/a.log", "compare", f"{tmp_path}/two", "--db", f"{tmp_path}/one")[1]
    assert told == "[WARN ] x1: subject: 'a', 'b'\n1 differences\n"
    assert (tmp_path / "logs" / "a.log").read_text().splitlines()[1].endswith("[INFO ] 1 differences")
    assert go("migrate-ids", "--db", f"{tmp_path}/one", "--debug")[1] == "1 ids to migrate\n"
    assert go("migrate-ids", "--db", f"{tmp_path}/one", "--apply")[1].startswith("1 ids migrated")
    archive = Archive(spark, f"file://{tmp_path}/one")
    assert sorted(r.id for r in archive.read("messages").collect()) == ["gmail:x1", "outlook:2"] and not archive.empty() and archive.empty("labels")
    kept = next((tmp_path / "one" / "_backup").iterdir())
    assert sorted(r.id for r in Archive(spark, f"file://{kept}").read("messages").collect()) == ["outlook:2", "x1"]


def test_log_lines():
    record = logging.LogRecord("postloom", logging.WARNING, "", 0, "two\nlines", (), None)
    record.created = 0
    assert logs.Lines(True).format(record) == "1970-01-01 00:00:00 [WARN ] two\n" + " " * 28 + "lines" and logs.Lines(False).format(record) == "[WARN ] two\n        lines"


def test_windows_tasks():
    words = schedule.windows_task("a", 30, "py.exe", ["import", "p q"])
    assert words[-6:] == ["/SC", "MINUTE", "/MO", "30", "/TR", 'py.exe -m postloom.cli import "p q"'] and schedule.windows_without("a")[-1] == words[4]
    for minutes, command in ((0, ["import"]), (1500, ["import"]), (30, ["stats"])):
        with pytest.raises(schedule.ScheduleError):
            schedule.windows_task("a", minutes, "py", command)


def test_forms(spark):
    rows = spark.createDataFrame([(" a \n b ", '"B, A" <B@x>, c@d', "Wed, 01 Jan 2025 01:00:00 +0100"), (None, None, None), ("", "", "never")], "h string, a string, d string")
    got = rows.select(verify.header("h").alias("h"), verify.address_list("a").alias("a"), verify.date_ms("d").alias("d")).collect()
    assert [tuple(r) for r in got] == [("a b", " <c@d>; B, A <b@x>", 1735689600000), (None, None, None), (None, None, None)]
    labels = [spark.createDataFrame([("x", list(v))], "id string, label_names array<string>") for v in ("ab", "bc")]
    assert [tuple(r) for r in verify.label_differences(*labels).collect()] == [("x", ["a"], ["c"])]


@pytest.mark.parametrize("minutes, fields", [(1, "*/1 * * * *"), (30, "*/30 * * * *"), (60, "0 */1 * * *"), (720, "0 */12 * * *"), (1440, "0 0 */1 * *"), (4320, "0 0 */3 * *"), (0, None), (7, None), (90, None), (300, None), (1500, None)])
def test_schedules(minutes, fields):
    if fields is None:
        with pytest.raises(schedule.ScheduleError):
            schedule.cron_fields(minutes)
        return
    line = schedule.cron_line("a", minutes, "py", "/x y", "/l", ["import", "p q"])
    assert line.startswith(fields + " cd '/x y' && py -m postloom.cli import 'p q' >> /l") and schedule.jobs([line]) == ["a"]
    assert schedule.without([line, line + "b"], "a") == [line + "b"]
    with pytest.raises(schedule.ScheduleError):
        schedule.cron_line("a", minutes, "py", "/", "/l", ["stats"])


def test_inner_messages():
    assert mail.folder_of("ImapMail/a/INBOX") == "a/INBOX"
