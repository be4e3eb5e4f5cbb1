"""Normal forms in which texts and paths are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Files in a mail profile that are never mail stores, by extension.
IGNORED = ("msf", "dat", "html", "htm", "rdf", "sqlite", "sqlite-journal", "mab", "json", "js", "txt", "db", "xml", "csv", "jar", "xul", "xpt", "ico", "png", "xpm", "dtd", "ini")


def body(text: Column) -> Column:
    """Line ends as LF, none at the end."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n+$", "")


def html(text: Column) -> Column:
    """Runs of white space as one space, none at either end."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", " "))
