"""Token counts under a unigram model by dynamic programming on a shared trie.

A text is cut into pre-tokens at white space; each is the meta symbol followed by its characters.
The model gives a piece at rank r of the vocabulary the log-probability -ln(r + ZIPF): a fixed
rule, nothing is trained. A character outside the vocabulary is written as its UTF-8 bytes, one
token each. The best segmentation has the greatest sum; of equal ones the one with fewer tokens,
then the one with the shorter last piece.

Distinct pre-tokens are put in a trie. The forward score of a trie node (best sum and its number
of tokens over all segmentations of the path from the root) depends on its path alone, so it is
computed once however many pre-tokens share that prefix, from the nodes above that a piece of the
vocabulary ends on. A node that ends a pre-token thereby holds its count; a document's count is
the sum over its pre-tokens. A worker keeps its trie between batches and starts a new one beyond
``NODES`` nodes.

Nulls and empty texts: zero pre-tokens and tokens. A null doc_id keeps its row, and so do
repeated rows. An empty table gives an empty result. Other columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, rows_of
from .encoding import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
META = "▁"
ZIPF = 2.7
NODES = 400_000
#: Of one byte token, below that of any piece.
BYTE = -20.0


def pieces(path: str) -> dict[str, float]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(r + ZIPF) for r, p in enumerate(plain)}


class Trie:
    """For each node the nodes below by character, the best sum of its path and that sum's tokens.
    ``ends`` has the counts of the words that were put in."""

    def __init__(self, scores: dict[str, float]) -> None:
        #: The pieces backwards: for each character the pieces that end so, and under "" a score.
        self.ending: dict = {}
        for piece, score in scores.items():
            held = self.ending
            for c in reversed(piece):
                held = held.setdefault(c, {})
            held[""] = score
        self.clear()

    def clear(self) -> None:
        self.below: list[dict[str, int]] = [{}]
        self.best = [0.0]
        self.tokens = [0]
        self.ends: dict[str, int] = {}

    def count(self, pre: str) -> int:
        path = [0]
        for i, c in enumerate(pre):
            node = self.below[path[-1]].get(c)
            if node is None:
                node = self.below[path[-1]][c] = self.grow(pre, i, path)
            path.append(node)
        return self.tokens[path[-1]]

    def grow(self, pre: str, i: int, path: list[int]) -> int:
        """The node of pre[:i + 1], whose shorter prefixes are on the path."""
        best, least = -math.inf, 0
        bests, tokens, held = self.best, self.tokens, self.ending
        for start in range(i, -1, -1):
            held = held.get(pre[start])
            if held is None:
                break
            score = held.get("")
            if score is not None:
                at = path[start]
                total, n = bests[at] + score, tokens[at] + 1
                if total > best or total == best and n < least:
                    best, least = total, n
        if "" not in self.ending.get(pre[i], {}):
            size = len(pre[i].encode("utf-8", "surrogatepass"))
            total, n = bests[path[i]] + BYTE * size, tokens[path[i]] + size
            if total > best or total == best and n < least:
                best, least = total, n
        self.below.append({})
        self.best.append(best)
        self.tokens.append(least)
        return len(self.best) - 1


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(pieces(path))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row of docs."""
    path = path or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = trie(path)
        for rows in rows_of(batches):
            if len(held.best) > NODES:
                held.clear()
            ends, words, tokens = held.ends, [], []
            for text in rows["text"]:
                found = (text or "").split()
                total = 0
                for w in found:
                    n = ends.get(w)
                    if n is None:
                        n = ends[w] = held.count(META + w)
                    total += n
                words.append(len(found))
                tokens.append(total)
            yield pa.record_batch([pa.array(rows["doc_id"], pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
