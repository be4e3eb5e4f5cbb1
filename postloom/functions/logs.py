"""Log lines: plain on the console, with time and severity in a file."""

from __future__ import annotations

import logging
import sys
import time
from pathlib import Path

LOG = logging.getLogger("postloom")


def tag(level: int) -> str:
    """A severity in five characters."""
    return {logging.WARNING: "WARN"}.get(level, logging.getLevelName(level))[:5].ljust(5)


class Lines(logging.Formatter):
    """The lines of a message after the first are put under the first."""

    converter = time.gmtime

    def __init__(self, dated: bool) -> None:
        super().__init__(datefmt="%Y-%m-%d %H:%M:%S")
        self.dated = dated

    def format(self, record: logging.LogRecord) -> str:
        head = f"[{tag(record.levelno)}] " if self.dated or record.levelno >= logging.WARNING else ""
        if self.dated:
            head = f"{self.formatTime(record, self.datefmt)} {head}"
        first, *rest = record.getMessage().splitlines() or [""]
        return "\n".join([(head + first).rstrip(), *[" " * len(head) + x if x else x for x in rest]])


def set_up(file: str | None = None, debug: bool = False) -> None:
    """Sends the log to standard output, and to a file if one is given."""
    LOG.handlers.clear()
    LOG.propagate = False
    LOG.setLevel(logging.DEBUG if debug else logging.INFO)
    console = logging.StreamHandler(sys.stdout)
    console.setFormatter(Lines(False))
    LOG.addHandler(console)
    if file:
        Path(file).absolute().parent.mkdir(parents=True, exist_ok=True)
        held = logging.FileHandler(file, encoding="utf-8")
        held.setFormatter(Lines(True))
        LOG.addHandler(held)
