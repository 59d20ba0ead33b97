"""Token counts by a linear longest-match automaton.

A word is cut greedily into the longest vocabulary pieces from the left; pieces
after the first are other entries than first ones. The automaton is a trie of
all pieces. A node's failure link is where matching goes on once the pieces
already certain are taken off, and the number of those pieces is worked out
beforehand, so counting a word takes one step per character, never goes back
and builds no piece. A word that cannot be cut counts as one unknown token.

Words: lower-cased letters, digits and marks in a row, or one other character
that is not white space. Counts of frequent short words are remembered
(boundedly many). A null or empty text has no tokens. Repeated rows each get
their row. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

SLICE_BYTES = 4 << 20
WORD = re.compile(r"\w+|[^\w\s]")
FIRST = "▁"  # the vocabulary's mark of pieces that begin a word
NONE = -1


class Automaton:
    """Longest-match counter over pieces that begin words and pieces that go on."""

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        # node 0 begins words, node 1 goes on after a piece
        self.step: dict[tuple[int, str], int] = {}
        self.link, self.popped = [NONE, NONE], [0, 0]
        ends: set[int] = set()
        parent: list[tuple[int, str]] = [(NONE, ""), (NONE, "")]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    following = self.step.get((node, c))
                    if following is None:
                        following = self.step[node, c] = len(parent)
                        parent.append((node, c))
                    node = following
                if node > 1:
                    ends.add(node)
        self.link += [NONE] * (len(parent) - 2)
        self.popped += [0] * (len(parent) - 2)
        for node in self._by_depth(parent):
            before, c = parent[node]
            if node in ends:  # the whole path is one piece
                self.link[node], self.popped[node] = 1, 1
                continue
            n, at = self.popped[before], self.link[before]
            while at != NONE and (at, c) not in self.step:
                n, at = n + self.popped[at], self.link[at]
            if at != NONE:
                self.link[node], self.popped[node] = self.step[at, c], n

    @staticmethod
    def _by_depth(parent: list[tuple[int, str]]) -> list[int]:
        depth = [0] * len(parent)
        for node in range(2, len(parent)):  # parents have smaller numbers
            depth[node] = depth[parent[node][0]] + 1
        return sorted(range(2, len(parent)), key=depth.__getitem__)

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it can't be cut."""
        step, link, popped = self.step, self.link, self.popped
        node, n = 0, 0
        for c in word:
            following = step.get((node, c))
            while following is None:
                n += popped[node]
                node = link[node]
                if node == NONE:
                    return 0
                following = step.get((node, c))
            node = following
        while node > 1:
            n += popped[node]
            node = link[node]
        return n if node == 1 else 0


class Counter:
    """Tokens and unknown words of texts."""

    def __init__(self, pieces: Iterable[str]):
        pieces = [p for p in pieces if p]
        self.automaton = Automaton((p[1:] for p in pieces if p[0] == FIRST and p != FIRST),
                                   (p for p in pieces if p[0] != FIRST))
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.automaton.count(word)
            if len(word) <= common.CACHE_WORD:
                if len(self.known) >= common.CACHE_ENTRIES:
                    self.known.clear()
                self.known[word] = n
        return n

    def text(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens and unknown words of a text."""
        counts = [self.word(w) for w in WORD.findall((text or "").lower())]
        unknown = counts.count(0)
        return len(counts), sum(counts) + unknown, unknown


def default_pieces() -> list[str]:
    """Pieces of the 32k vocabulary but for control and byte entries."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@lru_cache(maxsize=1)
def _counter(pieces: tuple[str, ...]) -> Counter:
    return Counter(pieces)


def count(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          pieces: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(pieces or default_pieces()))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = rows.drop("text").schema
    for name in ("n_words", "n_tokens", "n_unknown"):
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent.value)
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                got = [counter.text(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"),
                     *(pa.array([g[k] for g in got], pa.int64()) for k in range(3))],
                    schema.names)
        counter.known.clear()  # workers outlive their tasks

    return rows.mapInArrow(run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(common.table(spark, sf_dir, "documents"))
