"""The command line: import, search, statistics, export, storing and schedules of an archive."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compose, logs, schedule
from .functions.query import QueryError
from .operators import export, filters, search, stats, storing, verify
from .operators.filters import Mail
from .operators.store import Archive
from .sources import api, mail, pst
from .streaming import sync

VERSION = "0.1.0"


def uri_of(path: str) -> str:
    return path if "://" in path else Path(path).absolute().as_uri()


def session() -> SparkSession:
    builder = SparkSession.builder.appName("postloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    return builder.getOrCreate()


def held(archive: Archive, text: str | None) -> Mail:
    """The archive's tables, reduced by a filter."""
    whole = Mail(*[archive.read(t) for t in ("messages", "labels", "addresses", "attachments")])
    return stats.of(whole, filters.matching(whole, text)) if text else whole


def folder_labels(rows: DataFrame) -> DataFrame:
    ids = rows.filter("label_ids <> ''").select(F.col("label_ids").alias("id")).distinct()
    return ids.withColumn("name", F.regexp_replace("id", "^outlook:", ""))


def import_(archive: Archive, a: argparse.Namespace) -> None:
    kind = mail.detect(uri_of(a.source))
    options = {"withAttachments": str(a.with_attachments).lower(), "recursive": str(a.recursive).lower()}
    if kind == "pst":
        rows = pst.pst(archive.spark, uri_of(a.source), **options, **({"permutation": uri_of(a.permutation)} if a.permutation else {}))
        labels = folder_labels(rows)
    elif kind in ("thunderbird_pcv", "thunderbird_profile"):
        rows = mail.mbox(archive.spark, uri_of(a.source), **options)
        labels = archive.spark.createDataFrame(mail.folder_labels(uri_of(a.source)), "id string, name string")
    else:
        raise SystemExit(f"{a.source}: {kind} files can't be imported this way")
    archive.take(rows, labels)
    for r in stats.per_folder(archive.read("messages"), archive.read("labels")).orderBy("name").toLocalIterator():
        logs.LOG.info("%8d  %s", r.n or 0, r.name or "in all folders")


def import_eml(archive: Archive, a: argparse.Namespace) -> None:
    rows = mail.exported_tree(archive.spark, uri_of(a.source), a.prefix, content=True)
    rows, made = mail.label_ids_of(rows, archive.read("labels"))
    archive.take(rows.drop("label_names"), made)


def import_api(archive: Archive, a: argparse.Namespace) -> None:
    options = {"withAttachments": str(a.with_attachments).lower(), "recursive": str(a.recursive).lower()}
    if a.filter:
        sync.full(archive, a.client, a.account, q=a.filter, **options)
    else:
        print(sync.sync(archive, a.client, a.account, f"{archive.uri}/_checkpoints", **options))


def show_stats(archive: Archive, a: argparse.Namespace) -> None:
    some = held(archive, a.filter)
    s, f = stats.summary(some.messages).first(), stats.attachments(some.attachments).first()
    size = some.attachments.sparkSession.range(1).select(export.shown_size(F.lit(f.bytes)).alias("v")).first().v
    print(f"Messages: {s.messages}\nThreads: {s.threads}\nAttachments: {f.attachments} ({size})\nFirst fetched: {s.first_fetched or '-'}\nLast fetched: {s.last_fetched or '-'}\nHistory: {archive.state.get(sync.SINCE, '-')}")
    width = len(str(s.messages + f.attachments)) + 2
    sections = [("Top labels", stats.top_labels(some.messages, some.labels), "name")] + [(f"Top {r}", stats.top_addresses(some.addresses, r), "shown") for r in ("from", "to", "cc", "bcc")]
    for title, rows, column in sections:
        found = rows.orderBy(F.desc("n"), column).collect()  # at most 15
        if found:
            print(f"\n{title}:")
        for r in found:
            print(f"  {r.n:>{width}}  {r[column]}")


def show_search(archive: Archive, a: argparse.Namespace) -> None:
    rows = search.results(archive.read("messages"), a.query, a.limit, archive.read("postings"))
    n = 0
    for n, r in enumerate(rows.toLocalIterator(), 1):
        print(f"[{r.shown_date}] {r.shown_subject}\n  {r.id}\n  {r.body_text_snippet}\n")
    if not n:
        print("No matching messages found.")


def export_(archive: Archive, a: argparse.Namespace) -> None:
    some = held(archive, a.filter)
    print(export.write_tree(export.candidates(some, archive.read("blobs")), uri_of(a.target), a.format, a.prefix).agg(F.count(F.lit(1)).alias("n")).first().n, "messages written")


def store_(archive: Archive, a: argparse.Namespace) -> None:
    rows = export.candidates(held(archive, a.filter), archive.read("blobs"))
    book = f"{archive.uri}/_stored"
    if a.dry_run:
        left = storing.candidates_left(archive.spark, rows, book, limit=a.max_messages or 2**31 - 1)
        for r in left.toLocalIterator():
            print("Would store", r.id)
        return
    print(storing.store_messages(archive.spark, rows, a.client, a.account, book, a.max_messages))


def compare(archive: Archive, a: argparse.Namespace) -> None:
    """The differences from another archive, or between two trees of exported messages."""
    if a.trees:
        sides = [mail.exported_tree(archive.spark, uri_of(p), a.prefix, content=True) for p in (a.other, a.trees)]
        told = verify.tree_differences(*sides, a.run_prefix or "")
    else:
        other = Archive(archive.spark, uri_of(a.other))
        told = verify.message_differences(archive.read("messages").drop("fetched_at"), other.read("messages").drop("fetched_at"))
        files = verify.attachment_differences(archive.read("attachments"), other.read("attachments"))
        told = told.unionByName(files.select(F.col("message_id").alias("id"), F.concat(F.lit("attachment "), "filename", F.lit(": "), "field").alias("field"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")))
    n = 0
    for n, r in enumerate(told.orderBy("id", "field").toLocalIterator(), 1):
        logs.LOG.warning("%s: %s: %r, %r", r.id, r.field, r.left_value, r.right_value)
    logs.LOG.info("%d differences", n)


def migrate(archive: Archive, a: argparse.Namespace) -> None:
    n = archive.migrate_ids(a.prefix, apply=a.apply)
    logs.LOG.info("%d ids %s", n, "migrated, after a backup" if a.apply and n else "to migrate")


def account(a: argparse.Namespace) -> None:
    """What an account answers to: its address and how much it holds."""
    who = api.client(a.client, a.account)
    told = who.profile()
    logs.LOG.info("Account: %s\nMessages: %s\nHistory: %s\nLabels: %d", told.get("emailAddress", "-"), told.get("messagesTotal", "-"), told.get("historyId", "-"), len(who.labels()))


def clean_up(a: argparse.Namespace) -> None:
    """Moves a label's messages to the trash and deletes the label; tells what it would do, unless ``--apply``."""
    who = api.client(a.client, a.account)
    keys = [x["id"] for x in who.labels() if x["name"] == a.label]
    found = list(api.pages(lambda page: who.ids(f"label:{a.label}", page))) if keys else []
    for key in found if a.apply else ():
        api.patiently(who.trash, key)
    for key in keys if a.apply else ():
        who.delete_label(key)
    logs.LOG.info("%d messages and %d labels %s", len(found), len(keys), "removed" if a.apply else "to remove")


def crontab(change) -> list[str]:
    told = subprocess.run(["crontab", "-l"], capture_output=True, text=True, check=False)
    lines = told.stdout.splitlines() if told.returncode == 0 else []
    new = change(lines)
    if new != lines:
        subprocess.run(["crontab", "-"], input="".join(x + "\n" for x in new), text=True, check=True)
    return new


def schedule_(a: argparse.Namespace) -> None:
    if os.name == "nt":
        subprocess.run(schedule.windows_task(a.name, a.interval_minutes, sys.executable, a.command), check=True)
        return
    line = schedule.cron_line(a.name, a.interval_minutes, sys.executable, os.getcwd(), a.log, a.command)
    crontab(lambda lines: [*schedule.without(lines, a.name), line])
    print(line)


def parser() -> argparse.ArgumentParser:
    # Global options stand before or after the command; there they have no default that would undo the former.
    shared = argparse.ArgumentParser(add_help=False, argument_default=argparse.SUPPRESS)
    top = argparse.ArgumentParser("postloom")
    for p in (shared, top):
        p.add_argument("--log-file", help="a file that gets the log too")
        p.add_argument("--debug", action="store_true", help="log more")
    top.add_argument("--version", action="version", version=VERSION)
    sub = top.add_subparsers(dest="what", required=True)

    def command(name: str, run, *words: str, db: bool = True, **flags) -> argparse.ArgumentParser:
        p = sub.add_parser(name, parents=[shared])
        for w in words:
            p.add_argument(w)
        if db:
            p.add_argument("--db", required=True, help="the archive's folder or URI")
        for flag, more in flags.items():
            p.add_argument("--" + flag.replace("_", "-"), **more)
        p.set_defaults(run=run, db_needed=db)
        return p

    yes, text, prefix = {"action": "store_true"}, {}, {"default": compose.PREFIX}
    account_flags = {"client": {"required": True, "help": "module:factory of the API's client"}, "account": {"default": ""}}
    command("import", import_, "source", with_attachments=yes, recursive=yes, permutation=text)
    command("import-eml", import_eml, "source", prefix=prefix)
    command("import-api", import_api, with_attachments=yes, recursive=yes, filter=text, **account_flags)
    command("stats", show_stats, filter=text)
    command("search", show_search, "query", limit={"type": int, "default": 20})
    command("export", export_, "target", filter=text, format={"choices": ("md", "eml"), "default": "md"}, prefix=prefix)
    command("store", store_, filter=text, dry_run=yes, max_messages={"type": int}, **account_flags)
    command("compare", compare, "other", trees=text, run_prefix=text, prefix=prefix)
    command("migrate-ids", migrate, prefix={"default": api.ID_PREFIX}, apply=yes)
    command("account", account, db=False, **account_flags)
    command("clean-up", clean_up, "label", db=False, apply=yes, **account_flags)
    p = command("schedule", schedule_, "name", db=False, interval_minutes={"type": int, "required": True}, log={"default": "/dev/null"})
    p.add_argument("command", nargs=argparse.REMAINDER)
    command("unschedule", lambda a: subprocess.run(schedule.windows_without(a.name), check=True) if os.name == "nt" else crontab(lambda lines: schedule.without(lines, a.name)), "name", db=False)
    command("schedules", lambda a: print("\n".join(schedule.jobs(crontab(lambda lines: lines)))), db=False)
    return top


def main(words: list[str] | None = None) -> int:
    a = parser().parse_args(words)
    logs.set_up(a.log_file, a.debug)
    try:
        if a.db_needed:
            a.run(Archive(session(), uri_of(a.db)), a)
        else:
            a.run(a)
    except (filters.FilterError, QueryError, schedule.ScheduleError, pst.PstError, api.HistoryExpired) as e:
        logs.LOG.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
