"""Snippets against SQLite's own."""

from __future__ import annotations

import random
import sqlite3

import pytest

from postloom.functions import query, snippet
from postloom.operators import search

WORDS = ["invoice", "Café", "report:", "lunch.", "a", "the", "don't", "x_y", "—", "quarterly", "financial,", "42"]
QUERIES = ["invoice", "invoice cafe", '"invoice report"', "inv*", "lunch OR quarterly", "report NOT lunch", "^invoice", "body_text:cafe", "a the", '"a a"']


@pytest.mark.parametrize("text", QUERIES)
def test_snippet_equals_sqlite(text):
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choices(WORDS, k=draw.randint(0, 30))), " ".join(draw.choices(WORDS, k=draw.randint(0, 120)))) for i in range(60)]
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, subject, body_text, tokenize='unicode61 remove_diacritics 2')")
    c.executemany("INSERT INTO f VALUES (?, ?, ?)", rows)
    node = query.understood(text)
    found = c.execute("SELECT id, subject, body_text, snippet(f, 1, '«', '»', '...', 15), snippet(f, 2, '«', '»', '...', 25) FROM f WHERE f MATCH ?", (text,)).fetchall()
    assert found
    for _, subject, body, s, b in found:
        assert snippet.snippet(subject, node, "subject", 15) == s
        assert snippet.snippet(body, node, "body_text", 25) == b


def test_results(spark):
    rows = spark.createDataFrame([("a", "", "an invoice here", 1735689600000), ("b", "Invoice two", None, None), ("c", "other", "x", 0)], "id string, subject string, body_text string, internal_date_ms long")
    got = {r.id: tuple(r)[2:] for r in search.results(rows, "invoice").collect()}
    assert got == {"a": ("2025-01-01 00:00:00 UTC", "(No Subject)", "", "an «invoice» here"), "b": ("Unknown date", "«Invoice» two", "«Invoice» two", "")}
