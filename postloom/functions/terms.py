"""Search terms: runs of letters, digits and private-use characters, without marks, in lower case.

Rows of Latin text alone are cut into terms by Spark's own expressions, others in Python; both follow
the same rule.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("subject", "body_text", "sender", "recipient")
WORD = re.compile("(?:[^\\W_]|[\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd])+")
#: The blocks whose letters fold to one letter each, and punctuation.
LATIN = "^[\\x00-\\u024F\\u2000-\\u206F]*$"


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFD", text)
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def terms(text: str | None) -> list[str]:
    return WORD.findall(folded(text)) if text else []


MARKED = [c for c in map(chr, range(0x80, 0x250)) if folded(c) != c.lower()]
PLAIN = [unicodedata.normalize("NFD", c)[0] for c in MARKED]


def latin_terms(text: Column) -> Column:
    """The terms of a text of LATIN characters."""
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(text, F.lit("")), "".join(MARKED), "".join(PLAIN))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def postings(rows: DataFrame, key: str = "id") -> DataFrame:
    """(id, col, pos, term) for each term of the searchable columns that rows has."""
    held = [c for c in COLUMNS if c in rows.columns]
    latin = F.lit(True)
    for c in held:
        latin = latin & F.coalesce(F.col(c), F.lit("")).rlike(LATIN)
    rows = rows.select(key, *held)
    each = F.array(*[F.struct(F.lit(c).alias("col"), latin_terms(F.col(c)).alias("terms")) for c in held])
    plain = rows.filter(latin).select(F.col(key).alias("id"), F.inline(each)).select("id", "col", F.posexplode("terms").alias("pos", "term"))
    return plain.unionByName(other_postings(rows.filter(~latin), held, key))


def other_postings(rows: DataFrame, held: list[str], key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, cols, places, found = [], [], [], []
                for name in held:
                    for i, text in zip(part.column(key).to_pylist(), part.column(name).to_pylist(), strict=True):
                        got = terms(text)
                        ids += [i] * len(got)
                        cols += [name] * len(got)
                        places += range(len(got))
                        found += got
                yield pa.record_batch([pa.array(ids, pa.string()), pa.array(cols, pa.string()), pa.array(places, pa.int32()), pa.array(found, pa.string())], ["id", "col", "pos", "term"])

    return rows.mapInArrow(run, "id string, col string, pos int, term string")
