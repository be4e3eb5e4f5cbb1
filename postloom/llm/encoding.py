"""Token ids of whole texts, with the ``tokenizers`` library.

Texts are cut where no token can cross, so encoding the pieces one by one gives the ids of the
whole text, and a piece that was met before needn't be encoded again:

- byte_bpe (``spaced``): before a single space or line end that stands between visible characters.
  The space or line end belongs to the piece that follows it.
- word_bpe: at spaces and line ends, which the tokenizer drops; ASCII text is put in lower case
  first, as the tokenizer does.
- both: between a letter and one closing mark at a piece's end, which are of different classes for
  either pre-tokenizer. Only letters of the Latin blocks count, without the one whose lower case
  ends with a mark of its own.

A text that may hold an added token (``<|``) is encoded whole, since such a token may stand
anywhere, and so may its id. Tests compare with whole-text encoding.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import pairwise

import numpy as np

#: Pieces whose ids a worker keeps, and the longest piece kept: some 250 MB at most.
KEPT, LONGEST = 1_200_000, 48
MARKS = ".,;:!?"
#: After these a closing mark is a token of its own in either vocabulary.
LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower().isalpha() and len(c.lower()) == 1)
ADDED = "<|"
#: White space beside a space or line end (in Python's sense, which is the wider one).
UNEVEN = re.compile(r"[ \n](?=\s)|(?<=\s)[ \n]")
EVEN = re.compile(r"(?<=\S) (?=\S)")
#: Without any of these a text is even.
BROKEN = ("\n\n", " \n", "\n ")
OTHERS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """``ids(texts)``: for each text its ids as little-endian unsigned integers of ``width`` bytes.

    ``spaced``: whether a piece keeps the space or line end before it.
    """

    def __init__(self, path: str, spaced: bool, kept: int = KEPT) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not all(ADDED in t for t in added):
            raise ValueError(f"added tokens without {ADDED}: {added}")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaced, self.kept = spaced, kept
        self.known: dict[str, bytes] = {}
        self.line_end = self.encoded(["\n"])[0]
        self.marks = dict(zip(MARKS, self.encoded(list(MARKS)), strict=True))

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text that doesn't begin with white space. If spaced, those without a line end before them follow a space, and the
        first follows a line end that isn't in the text."""
        if not self.spaced:
            return (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")
        if "  " in text or any(x in text for x in BROKEN) or any(x in text for x in (OTHERS[:8] if text.isascii() else OTHERS)):
            text = "\n" + text
            return EVEN.split(text) if UNEVEN.search(text) else text.replace("\n", " \n")[1:].split(" ")
        return ("\n" + text.replace("\n", " \n")).split(" ")

    def encoded(self, pieces: list[str]) -> list[bytes]:
        dtype = self.dtype
        return [np.array(e.ids, dtype).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def listed(self, words: list[str], glue: str) -> list[bytes]:
        """The ids of each word, from a few calls: words are joined with a text that is a token of
        its own between them and in none of them."""
        out: list[bytes] = []
        width = self.dtype.itemsize
        mark = self.tokenizer.encode(glue.strip(" "), add_special_tokens=False).ids[0]
        lots = [words[i : i + 512] for i in range(0, len(words), 512)]
        lead = glue[len(glue.rstrip(" ")) :] if self.spaced else ""
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([lead + glue.join(x) for x in lots], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(ids == mark)
            if len(cuts) != len(lot) - 1:
                out += self.encoded([lead + w for w in lot])
                continue
            raw = ids.tobytes()
            starts = [0, *((cuts + 1) * width).tolist()]
            ends = [*(cuts * width).tolist(), len(raw)]
            out += [raw[s:e] for s, e in zip(starts, ends, strict=True)]
        return out

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        known, marks = self.known, self.marks
        closed = [p for p in missing if p[-1:] in marks and p[-2:-1] in LETTERS]
        if closed:
            missing = missing.difference(closed).union({c for p in closed if (c := p[:-1]) not in known})
        new: dict[str, bytes] = {}
        if self.spaced:
            heads = [p for p in missing if p[:1] == "\n"]
            plain = [p for p in heads if len(p) > 1 and not (p[1].isspace() or p[-1].isspace() or "\n" in p[1:])]
            end = self.line_end
            new.update((p, end + x) for p, x in zip(plain, self.listed([p[1:] for p in plain], "\n"), strict=True))
            rest = missing.difference(heads)
            words = [p for p in rest if p and not (p[0].isspace() or p[-1].isspace() or "\n" in p)]
            new.update(zip(words, self.listed(words, "\n "), strict=True))
        else:
            words = [p for p in missing if p and "0" not in p]
            new.update(zip(words, self.listed(words, " 0 "), strict=True))
        if len(new) < len(missing):
            odd = [p for p in missing if p not in new]
            new.update(zip(odd, self.encoded([p if p[:1] == "\n" else " " + p for p in odd] if self.spaced else odd), strict=True))
        if len(known) < self.kept:
            known.update(new if max(map(len, new), default=0) <= LONGEST else {p: x for p, x in new.items() if len(p) <= LONGEST})
        for p in closed:
            core = p[:-1]
            new[p] = (new[core] if core in new else known[core]) + marks[p[-1]]
        return new

    def ids(self, texts: list[str | None]) -> list[bytes]:
        every: list[str] = []
        ends = [0]
        whole = {}
        for i, t in enumerate(texts):
            if t and (ADDED in t or self.spaced and t[0].isspace()):
                whole[i], t = t, ""
            every += self.pieces(t or "")
            ends.append(len(every))
        got = list(map(self.known.get, every))
        holes = [i for i, x in enumerate(got) if x is None]
        if holes:
            new = self.learn({every[i] for i in holes})
            for i in holes:
                got[i] = new[every[i]]
        first = self.dtype.itemsize if self.spaced else 0
        out = [b"".join(got[s:e])[first:] for s, e in pairwise(ends)]
        for i, ids in zip(whole, self.encoded(list(whole.values())), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool, kept: int = KEPT) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path, spaced, kept)
