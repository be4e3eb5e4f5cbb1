"""From a parsed message to one row of the mail model.

Header names and addresses come as mail programs write them, so display names are quoted before
they are parsed wherever they hold characters that would break the address apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from email import message_from_bytes, policy
from email.header import decode_header
from email.message import Message
from email.utils import format_datetime, getaddresses, parsedate_to_datetime

ROLES = ("from", "to", "cc", "bcc")
#: Addresses that need no grammar: atoms before ``<address>``, or an address alone, with ", " between them.
ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
DOTTED = rf"{ATOM}(?:\.{ATOM})*"
MAILBOX = re.compile(rf"(?:({ATOM}(?: {ATOM})*) <({DOTTED}@{DOTTED})>|({DOTTED}@{DOTTED}))(?:, (?!$)|$)")
SIMPLE = re.compile(rf"(?!.*=\?)(?:{MAILBOX.pattern})+", re.DOTALL)
#: Header lines as the standard says, continued ones included.
HEAD = re.compile(rb"(?:[!-9;-~]+:[\x09\x20-\x7e]*(?:\n[ \t][\x09\x20-\x7e]*)*(?:\n|$))+")
NEW_LINE = re.compile(rb"\n(?![ \t])")
UTF_8 = ('text/plain; charset="utf-8"', "text/plain; charset=utf-8")
FROM_LINE = re.compile(r"(\w{3}\s+\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4})")


def parsed(raw: bytes) -> Message:
    """The message of bytes. One with well-formed headers and a single part is cut at its first blank
    line, as the library's parser goes through a body line by line; it reads all others."""
    head, blank, body = raw.partition(b"\n\n")
    if blank and not head.startswith(b"\n") and HEAD.fullmatch(head):
        out = Message(policy.compat32)
        for line in NEW_LINE.split(head):
            out.set_raw(*policy.compat32.header_source_parse([line.decode("ascii")]))
        if out.get_content_maintype() not in ("multipart", "message"):
            out.set_payload(body.decode("ascii", "surrogateescape"))
            return out
    return message_from_bytes(raw, policy=policy.compat32)


def people(headers: list[str], repair: bool = True) -> list[tuple[str, str]]:
    """(name, address) of each person in address headers."""
    if all(map(SIMPLE.fullmatch, headers)):
        return [(name, address or alone) for h in headers for name, address, alone in MAILBOX.findall(h)]
    return getaddresses([quoted_names(h) if repair else h for h in headers])


def decoded(value: object) -> str:
    """A header value unfolded, its encoded words read; a charset that fails falls back to UTF-8."""
    if value is None:
        return ""
    flat = str(value)
    if "\n" in flat or "\r" in flat:
        flat = re.sub(r"\r?\n[ \t]*|\r", " ", flat)
    if "=?" not in flat and isinstance(value, str):
        return flat
    out = []
    try:
        parts = decode_header(flat)
    except ValueError:
        return flat
    for part, charset in parts:
        if isinstance(part, str):
            out.append(part)
            continue
        for name in (charset or "ascii", "utf-8"):
            try:
                out.append(part.decode(name))
                break
            except (LookupError, UnicodeDecodeError):
                continue
        else:
            out.append(part.decode("utf-8", "replace"))
    return "".join(out)


def quoted_names(header: str) -> str:
    """Display names with any of ``@ , ( ) [ ]`` put in quotes, the rest unchanged. A name runs up
    to its ``<``; a comma belongs to it unless what stands before is an address of its own."""
    out, at = [], 0
    while (angle := header.find("<", at)) >= 0:
        close = header.find(">", angle)
        if close < 0:
            break
        before = header[at:angle]
        start, inside = 0, False
        for i, c in enumerate(before):
            if c == '"':
                inside = not inside
            elif c == "," and not inside:
                word = before[start:i].strip()
                if not word or re.fullmatch(r"[^\s@]+@[^\s@]+", word):
                    start = i + 1
        lead, name = before[:start], before[start:]
        bare = name.strip()
        if bare and not bare.startswith('"') and re.search(r"[@,()\[\]]", bare):
            gap = name[: len(name) - len(name.lstrip())]
            name = gap + '"' + bare.replace("\\", "\\\\").replace('"', '\\"') + '" '
        out.append(lead + name + header[angle : close + 1])
        at = close + 1
    return "".join(out) + header[at:]


def addresses(message: Message, repair: bool = True) -> list[dict]:
    """One for each role and address, the first name kept."""
    out: dict[tuple[str, str], dict] = {}
    for role in ROLES:
        values = [decoded(v) for v in message.get_all(role, [])]
        for name, address in people(values, repair):
            if address:
                out.setdefault((role, address.lower()), {"role": role, "address": address.lower(), "name": name or None})
    return list(out.values())


def text_of(part: Message) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8")
    except (LookupError, UnicodeDecodeError):
        return raw.decode("utf-8", "replace")


def bodies(message: Message) -> tuple[str, str | None, str | None]:
    """(body, its type, html): plain text if there is any, else the raw HTML."""
    found: dict[str, str] = {}
    if message.get("Content-Type") in UTF_8 and message.get("Content-Disposition") is None and not message.is_multipart():
        return (message.get_payload(decode=True) or b"").decode("utf-8", "replace"), "text/plain", None
    for part in message.walk():
        if not part.is_multipart() and part.get_filename() is None and part.get_content_type() in ("text/plain", "text/html"):
            found.setdefault(part.get_content_type(), text_of(part))
    html = found.get("text/html")
    if "text/plain" in found:
        return found["text/plain"], "text/plain", html
    return (html, "text/html", html) if html is not None else ("", None, None)


def attachments(message: Message) -> list[dict]:
    """Parts with a file name, a Content-ID or the disposition of an attachment."""
    out = []
    for part in message.walk() if message.is_multipart() else ():
        cid = part.get("Content-ID")
        if part.is_multipart() or not (part.get_filename() or cid or part.get_content_disposition() == "attachment"):
            continue
        raw = part.get_payload(decode=True) or b""
        name = part.get_filename()
        out.append({"ord": len(out), "attachment_id": None, "filename": decoded(name) if name else None, "mime_type": part.get_content_type(), "size": len(raw), "content_sha256": hashlib.sha256(raw).hexdigest(), "content_id": str(cid) if cid else None, "content": raw})
    return out


def sent(message: Message, from_line: str) -> tuple[str | None, int | None]:
    """(date, epoch milliseconds): of the Date header, else of the From line (taken as UTC)."""
    raw = decoded(message.get("Date")).strip() or None
    try:
        when = parsedate_to_datetime(raw) if raw else None
    except ValueError:
        when = None
    if when is None and (m := FROM_LINE.search(from_line)):
        try:
            when = datetime.strptime(" ".join(m[1].split()), "%a %b %d %H:%M:%S %Y").replace(tzinfo=UTC)
            raw = format_datetime(when)
        except ValueError:
            when = None
    if when is None:
        return raw, None
    return raw, int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() * 1000)


def message_id(message: Message, from_line: str, prefix: str) -> str:
    """The id given, else a hash of the headers as they stand, the From line and the payload's beginning."""
    for name in ("Message-ID", "Resent-Message-ID"):
        if given := decoded(message.get(name)).strip():
            return prefix + given
    start = "" if message.is_multipart() else str(message.get_payload())[:500]
    told = "".join([*[str(message.get(h) or "") for h in ("Subject", "From", "Date")], from_line, start])
    return f"{prefix}sha1:{hashlib.sha1(told.encode('utf-8', 'replace')).hexdigest()}"


def with_inner(message: Message) -> Iterator[Message]:
    """A message and, after it, those attached to it at any depth, as messages or as EML files."""
    yield message
    todo = list(message.get_payload()) if message.is_multipart() else []
    while todo:
        part = todo.pop(0)
        if part.get_content_type() == "message/rfc822":
            for inner in part.get_payload() if part.is_multipart() else ():
                yield from with_inner(inner)
        elif decoded(part.get_filename()).lower().endswith(".eml"):
            yield from with_inner(parsed(part.get_payload(decode=True) or b""))
        elif part.is_multipart():
            todo = list(part.get_payload()) + todo


def row(message: Message, label_ids: str, seq: int, prefix: str = "thunderbird:", from_line: str = "", content: bool = False) -> dict:
    """The nested row of a message: its fields, addresses and attachments."""
    body, kind, html = bodies(message)
    date, ms = sent(message, from_line)
    held = attachments(message)
    if not content:
        held = [a | {"content": None} for a in held]
    heads = {out: quoted_names(decoded(message.get(name))) or None for out, name in (("sender", "From"), ("recipient", "To"), ("cc", "Cc"), ("bcc", "Bcc"))}
    return {"id": message_id(message, from_line, prefix), "thread_id": None, **heads, "subject": decoded(message.get("Subject")) or None, "date": date, "internal_date_ms": ms, "snippet": None, "label_ids": label_ids, "body_text": body, "body_mime_type": kind, "body_html": html, "addresses": addresses(message), "attachments": held, "seq": seq}
