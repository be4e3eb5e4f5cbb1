"""The mail operators against DuckDB, SQLite's full-text search and plain Python."""

from __future__ import annotations

import sqlite3
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from postloom.functions import query as language
from postloom.functions.terms import postings, terms
from postloom.operators import filters, search, tables
from postloom.operators.filters import FilterError, Token, parse_filter
from postloom.plans import (
    archived,  # noqa: F401  puts its queries into the catalog
    catalog,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(got.select(*cols).collect()) == text(want.project(", ".join(cols)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["address", "shown", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_grammar():
    assert parse_filter('FROM:Jane "two words" label: after:2025/1/1') == [Token("from", "Jane"), Token("", "two words"), Token("label", ""), Token("after", "2025/1/1")]
    for bad in ('"re: hello"', "http://x", ":x", "don't", "after:today", "has:nothing"):
        with pytest.raises(FilterError):
            parse_filter(bad)


@pytest.fixture(scope="module")
def inbox(spark):
    messages = spark.createDataFrame([("m1", "t", "Quarterly 100% report", "Body", "INBOX,Label_1", 1735689600000), ("m2", None, None, None, "", 0), ("m3", "t", "lunch", None, None, None)], "id string, thread_id string, subject string, body_text string, label_ids string, internal_date_ms long")
    labels = spark.createDataFrame([("Label_1", "Work/Big")], "id string, name string")
    addresses = spark.createDataFrame([("m1", "from", "jane@x.com", "Jane Doe"), ("m1", "from", "bob@y.org", None), ("m2", "to", "jane@x.com", None)], "message_id string, role string, address string, name string")
    attachments = spark.createDataFrame([("m1", "a.pdf", 3), ("m1", "b.pdf", 4)], "message_id string, filename string, size long")
    return filters.Mail(messages, labels, addresses, attachments)


@pytest.mark.parametrize(
    "text, ids",
    [
        ("", ["m1", "m2", "m3"]), ("100%", ["m1"]), ("10_%", []), ("label:work", ["m1"]), ("label:inbox", ["m1"]), ("label:label_1", []), ("label:", ["m1"]),
        ("from:doe", ["m1"]), ("from:doe from:bob", ["m1"]), ("to:jane", ["m2"]), ("after:2025/01/01", ["m1"]), ("before:2025/01/01", []), ("before:2026/01/01", ["m1"]), ("has:attachment LUNCH", []), ("has:ATTACHMENT body", ["m1"]),
    ],
)
def test_filters(inbox, text, ids):
    assert sorted(r.id for r in filters.matching(inbox, text).collect()) == ids


def test_tables(spark):
    now = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "id string, v int, first string")
    batch = spark.createDataFrame([("a", 5, "new", 1), ("a", None, "new", 2), ("c", 7, "new", 1)], "id string, v int, first string, seq long")
    assert sorted(map(tuple, tables.upsert(now, batch, keep=("first",)).collect())) == [("a", None, "old"), ("b", 2, "old"), ("c", 7, "new")]
    other = spark.createDataFrame([("a", 1, None), ("c", 2, "old")], "id string, v int, first string")
    assert sorted(map(tuple, tables.differences(now, other).collect())) == [("a", "first", "old", None), ("b", "<row>", "present", None), ("c", "<row>", None, "present")]


ROWS = [("d1", "Quarterly financial report", "The café opened. Invoice, invoice and more invoices"), ("d2", "Lunch", "restaurant at noon; reply to the invoice"), ("d3", "Å report", "straße financial lunch report lunch"), ("d4", "", ""), ("d5", "report", "nothing here but a quarterly thing")]
QUERIES = ["report", "quarterly report", "financial OR lunch", "report NOT lunch", "inv*", '"financial report"', "financial + report", "subject:report", "{subject body_text}:lunch", "^report", "NEAR(lunch report, 2)", "(cafe OR restaurant) AND invoice", "lunch lunch", "-subject:report", "a", "report OR lunch NOT quarterly"]


@pytest.fixture(scope="module")
def sqlite():
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, subject, body_text, tokenize='unicode61 remove_diacritics 2')")
    c.executemany("INSERT INTO f VALUES (?, ?, ?)", ROWS)
    return c


@pytest.mark.parametrize("text", QUERIES)
def test_search_equals_sqlite(spark, sqlite, text):
    rows = spark.createDataFrame(ROWS, "id string, subject string, body_text string")
    got = {r.id: r.rank for r in search.search(rows, text, -1).collect()}
    want = dict(sqlite.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", (text,)).fetchall())
    assert got.keys() == want.keys()
    if not text.startswith("NEAR"):
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


@pytest.mark.parametrize("text", ["jane@c.com", "invoice,", "don't", "NOT a", "AND", "*", "", "foo:bar", "a -x"])
def test_bad_queries_are_quoted(text):
    with pytest.raises(language.QueryError):
        language.parse(text)
    if text in ("AND", ""):
        with pytest.raises(language.QueryError):
            language.understood(text)
    elif text != "NOT a":
        language.understood(text)


def test_latin_rows_are_cut_as_all_others(spark):
    """Spark's expressions and Python agree on every character that the former take, and between them."""
    letters = [chr(c) for c in (*range(1, 0x250), *range(0x2000, 0x2070))]
    rows = [(f"r{i}", f"a{c}b {c} x{c}{d} Ab{c}") for i, (c, d) in enumerate(zip(letters, letters[1:] + letters[:1], strict=True))]
    rows += [("wide", "日本 a\ue000b Ünïcode ΑΣ İstanbul"), ("none", None), ("blank", "")]
    got = {}
    for r in postings(spark.createDataFrame(rows, "id string, subject string")).collect():
        got.setdefault(r.id, []).append((r.pos, r.term))
    assert {i: [t for _, t in sorted(v)] for i, v in got.items()} == {i: terms(t) for i, t in rows if terms(t)}


def test_terms():
    assert terms("a\ue000b") == ["a\ue000b"]
    assert terms("Café_Å don't straße 42") == ["cafe", "a", "don", "t", "straße", "42"]
