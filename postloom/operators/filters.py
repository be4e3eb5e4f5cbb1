"""The message filter language, compiled to predicates and semi-joins.

A filter is a list of words and ``key:value`` tokens, all of which must hold. Everything that can
be wrong with a filter is found while it is compiled, before any row is read.
"""

from __future__ import annotations

import shlex
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("from", "to", "cc", "bcc")
KEYS = ("subject", "label", "after", "before", "has", *ROLES)


class FilterError(ValueError):
    """A filter that can't be understood."""


@dataclass(frozen=True)
class Token:
    key: str  # "" for a bare word
    value: str


def parse_filter(text: str) -> list[Token]:
    try:
        words = shlex.split(text)
    except ValueError as e:
        raise FilterError(f"{text!r}: {e}") from e
    out = []
    for word in words:
        key, colon, value = word.partition(":")
        if not colon:
            out.append(Token("", word))
        elif key.lower() not in KEYS:
            raise FilterError(f"unknown filter {key!r} in {word!r}")
        else:
            token = Token(key.lower(), value)
            if token.key in ("after", "before"):
                day_ms(value)
            if token.key == "has" and value.lower() != "attachment":
                raise FilterError(f"unknown value in {word!r}")
            out.append(token)
    return out


def day_ms(value: str) -> int:
    """UTC midnight of YYYY/MM/DD in epoch milliseconds."""
    try:
        return int(datetime.strptime(value, "%Y/%m/%d").replace(tzinfo=UTC).timestamp()) * 1000
    except ValueError as e:
        raise FilterError(f"not a date: {value!r}") from e


def holds(column: Column, value: str) -> Column:
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(value.lower()))


@dataclass(frozen=True)
class Mail:
    """The tables that a filter reads."""

    messages: DataFrame
    labels: DataFrame
    addresses: DataFrame
    attachments: DataFrame


def label_rows(messages: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, pos, label_id, name): a row for each label of a message, the id standing in for a
    name that isn't known. Null and empty lists have none."""
    each = messages.filter("label_ids <> ''").select("id", F.posexplode(F.split("label_ids", ",")).alias("pos", "label_id"))
    named = labels.select(F.col("id").alias("label_id"), "name")
    return each.join(named, "label_id", "left").withColumn("name", F.coalesce("name", "label_id"))


def matching(mail: Mail, text: str) -> DataFrame:
    """The messages that a filter lets through. Row predicates come first, so that they reach the
    scan; each token on another table is one semi-join on its distinct message ids."""
    tokens = parse_filter(text)
    rows = mail.messages
    for t in tokens:
        if t.key in ("after", "before"):
            ms, bound = F.col("internal_date_ms"), F.lit(day_ms(t.value))
            rows = rows.filter((ms >= bound if t.key == "after" else ms < bound) & (ms != 0))
        elif t.key == "subject":
            rows = rows.filter(holds(F.col("subject"), t.value))
        elif not t.key:
            rows = rows.filter(holds(F.col("subject"), t.value) | holds(F.col("body_text"), t.value))
    for t in tokens:
        if t.key in ROLES:
            who = mail.addresses.filter((F.col("role") == t.key) & (holds(F.col("address"), t.value) | holds(F.col("name"), t.value)))
            rows = rows.join(who.select(F.col("message_id").alias("id")), "id", "left_semi")
        elif t.key == "has":
            rows = rows.join(mail.attachments.select(F.col("message_id").alias("id")), "id", "left_semi")
        elif t.key == "label":
            # One row with the labels that have names, which are few, and those of them that match.
            named = F.col("name").isNotNull()
            found = mail.labels.agg(F.collect_set(F.when(named, F.col("id"))).alias("_named"), F.collect_set(F.when(named & holds(F.col("name"), t.value), F.col("id"))).alias("_hits"))
            hit = F.exists(F.split("label_ids", ","), lambda x: F.array_contains("_hits", x) | (~F.array_contains("_named", x) & holds(x, t.value)))  # noqa: B023
            rows = rows.crossJoin(F.broadcast(found)).filter((F.col("label_ids") != "") & hit).drop("_named", "_hits")
    return rows
