"""The part of a text that shows a query's hits best, with the hits marked.

A window of so many tokens is tried around every hit, and from the start of the sentence before
it; each phrase counts 1000 once and 1 again, a sentence's start 100 (a text's, 120).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

from .query import Both, Near, Phrase
from .terms import WORD, folded

OPEN, CLOSE, MORE = "«", "»", "..."
SENTENCE = re.compile(r"[.:][ \t\n\r]+$")


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(term, start, end) of each term, by places in the text as it stands."""
    parts, places = [], []
    for i, c in enumerate(text):
        plain = folded(c)
        parts.append(plain)
        places += [i] * len(plain)
    out = []
    for m in WORD.finditer("".join(parts)):
        end = places[m.end() - 1] + 1
        while end < len(text) and not folded(text[end]):  # marks of the last letter
            end += 1
        out.append((m[0], places[m.start()], end))
    return out


def phrases(node: object) -> Iterator[Phrase | Near]:
    """What a query looks for; what it excludes is left out."""
    if isinstance(node, Both):
        yield from phrases(node.left)
        if node.kind != "NOT":
            yield from phrases(node.right)
    else:
        yield node


def places(p: Phrase, terms: list[str], column: str) -> list[int]:
    if not p.terms or column not in p.columns:
        return []
    size = len(p.terms)

    def at(i: int) -> bool:
        held = terms[i : i + size]
        return held[:-1] == list(p.terms[:-1]) and (held[-1].startswith(p.terms[-1]) if p.prefix else held[-1] == p.terms[-1])

    return [i for i in range(len(terms) - size + 1) if at(i) and (not p.first or i == 0)]


def hits(node: object, terms: list[str], column: str) -> list[tuple[int, int, int]]:
    """(place, phrase, size) in order."""
    out, number = [], 0
    for p in phrases(node):
        if isinstance(p, Phrase):
            out += [(i, number, len(p.terms)) for i in places(p, terms, column)]
            number += 1
            continue
        found = [places(q, terms, column) for q in p.phrases]
        close = [c for c in product(*found) if max(c) - min(i + len(q.terms) for i, q in zip(c, p.phrases, strict=True)) <= p.distance]
        for k, q in enumerate(p.phrases):
            out += [(i, number + k, len(q.terms)) for i in sorted({c[k] for c in close})]
        number += len(p.phrases)
    return sorted(out)


def window(found: list[tuple[int, int, int]], count: int, width: int, sentences: list[int]) -> int:
    """Where the best window begins."""

    def scored(start: int) -> tuple[int, int]:
        inside = [h for h in found if start <= h[0] < start + width]
        seen = len({p for _, p, _ in inside})
        if not inside:
            return 0, 0
        first, last = inside[0][0], inside[-1][0] + inside[-1][2]
        centred = first - int((width - (last - first)) / 2)
        return 1000 * seen + len(inside) - seen, max(0, min(centred, count - width))

    best, start = 0, 0
    for place, _, _ in found:
        score, centred = scored(place)
        if score > best:
            best, start = score, centred
        before = [s for s in sentences if s <= place]
        if count > width and before and before[-1] < place:
            score = scored(before[-1])[0] + (100 if before[-1] else 120)
            if score > best:
                best, start = score, before[-1]
    return start


def snippet(text: str | None, node: object, column: str, width: int) -> str:
    """The best window of a column's text. Without a hit it is the text's head, unmarked; a null or
    empty text gives an empty one."""
    text = text or ""
    told = tokens(text)
    if not told:
        return text
    found = hits(node, [t for t, _, _ in told], column)
    sentences = [0] + [i for i in range(1, len(told)) if SENTENCE.search(text[told[i - 1][2] : told[i][1]])]
    start = window(found, len(told), width, sentences)
    last = min(start + width, len(told)) - 1
    spans: list[list[int]] = []
    for place, _, size in found:
        if place < start or place > last:
            continue
        end = place + size - 1
        if spans and place <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([place, end])
    out, at = [MORE] if start else [], told[start][1] if start else 0
    for a, b in spans:
        begin, end = told[a][1], told[min(b, last)][2]
        out += [text[at:begin], OPEN, text[begin:end], CLOSE]
        at = end
    whole = last == len(told) - 1
    return "".join(out) + (text[at:] if whole else text[at : told[last][2]] + MORE)
