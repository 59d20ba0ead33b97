"""Byte-pair encoding by backtracking over longest matches, and decoding.

A word's bytes are symbols, its last one marked as the word's end. An
Aho-Corasick automaton of all tokens finds the longest token at every place. The
encoder takes the longest token, then the longest prefix of it that is a token,
and so on, as long as it is compatible with the token before; at a dead end it
steps back and never returns to a place known to be dead, so a word takes linear
time. Two tokens are compatible if the merges of their joint bytes end in just
the two. That is looked up in a table filled by walking both tokens' merges
backwards from the seam: a merge across the seam that comes before the merges
that use up the pieces on both sides breaks the pair. A sequence whose
neighbours are all compatible is the one that merging by rank gives.

Decoding slices the tokens' text by a table of offsets and joins the slices
with one blank, as the vocabulary's library does where it has no decoder.

A text is read as that library reads it: special tokens stand for themselves,
the rest is composed (NFC) and lower-cased, words match ``WORD`` and white space
is dropped. No word reaches across white space, so results of frequent chunks
between white space are kept (boundedly many). A null or empty text has no
tokens. Repeated rows each get their row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from quarry.llm import common

SLICE_BYTES = 4 << 20
PAIRS = 200_000
CHUNKS = 150_000     # results remembered per generation
NEVER = 1 << 30

# Fixed value: the vocabulary's word pattern.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPACE = regex.compile(r"\p{White_Space}+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")  # blank to str.split, not to the pattern
END = "</w>"
MARK = 256  # added to the last symbol of a word


@lru_cache(maxsize=1)
def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of bytes in the vocabulary file -> the byte: printable
    Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encoder and decoder of one vocabulary file (its JSON text)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        vocab, special = spec["model"]["vocab"], spec["added_tokens"]
        names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in special}
        self.special = {t["content"]: t["id"] for t in special}
        self.split = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        symbols = byte_symbols()
        self.tokens, self.trie = {}, ahocorasick.Automaton()
        for name, i in vocab.items():
            body = name.removesuffix(END) if name != END else name
            s = [symbols[c] for c in body]
            if body != name:
                s[-1] += MARK
            word = "".join(map(chr, s))
            self.tokens[i] = word
            self.trie.add_word(word, (len(word), i))
        self.trie.make_automaton()
        top = max(names) + 1
        ids = {w: i for w, i in zip(self.tokens.values(), self.tokens)}
        self.lengths, self.prefix = [0] * top, [-1] * top
        for i, w in self.tokens.items():
            self.lengths[i] = len(w)
            self.prefix[i] = next((ids[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in ids),
                                  -1)
        self.rank: dict[int, int] = {}     # of a merged token
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merges[pair] = rank
            self.rank.setdefault(whole, rank)
            self.parts.setdefault(whole, pair)
        self.pairs: dict[int, bool] = {}  # by first id * 65536 + second id
        # offset table: token i is text[offsets[i]:offsets[i + 1]]
        self.text = "".join(names.get(i, "") for i in range(top))
        self.offsets = [0, *np.cumsum([len(names.get(i, "")) for i in range(top)]).tolist()]
        # results of short chunks in two generations: when the new one is full it
        # becomes the old one, from which what is used again moves back
        self.new: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}
        self.new_ids: dict[str, bytes] = {}
        self.old_ids: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 16 | b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 16 | b] = self._compatible(a, b)
        return known

    def _compatible(self, x: int, y: int) -> bool:
        rank, used_x, used_y = self.rank, NEVER, NEVER
        while True:
            across = self.merges.get((x, y), NEVER)
            # at equal ranks the left pair merges first
            if across < used_x and across <= used_y and across < NEVER:
                return False
            born_x, born_y = rank.get(x, -1), rank.get(y, -1)
            if born_x > born_y:
                used_x, x = born_x, self.parts[x][1]
            elif born_y >= 0:
                used_y, y = born_y, self.parts[y][0]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        s = word if word.isascii() else word.encode("utf-8", "replace").decode("latin-1")
        s = s[:-1] + chr(ord(s[-1]) + MARK)
        longest = [0] * len(s)
        for end, (n, token) in self.trie.iter(s):
            longest[end - n + 1] = token  # ends come in order: the longest is last
        out: list[int] = []
        place, token, dead, n = 0, longest[0], set(), len(s)
        lengths, pairs, last = self.lengths, self.pairs, -1
        while place < n:
            end = place + lengths[token]
            if (not dead or end not in dead) and (
                    last < 0 or (pairs.get(last << 16 | token) if last << 16 | token in pairs
                                 else self.compatible(last, token))):
                out.append(token)
                place, last = end, token
                token = longest[place] if place < n else -1
            elif self.prefix[token] >= 0:
                token = self.prefix[token]
            else:
                dead.add(place)
                token = out.pop()
                place -= lengths[token]
                last = out[-1] if out else -1
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space."""
        if chunk.isascii() and chunk.isalpha():
            return self.encode_word(chunk.lower())
        out, at = [], 0
        for m in self.split.finditer(chunk):
            out += [i for w in self._words(chunk[at:m.start()]) for i in self.encode_word(w)]
            out.append(self.special[m[0]])
            at = m.end()
        return out + [i for w in self._words(chunk[at:]) for i in self.encode_word(w)]

    @staticmethod
    def _words(part: str) -> list[str]:
        if not part.isascii():
            # character by character, a final sigma is not told apart
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        return WORD.findall(part.lower())

    @staticmethod
    def chunks_of(text: str | None) -> list[str]:
        text = text or ""
        return _SPACE.split(text) if _SEPARATORS.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.chunks_of(text) for i in self.encode_chunk(c)]

    def decode(self, ids) -> str:
        at, text = self.offsets, self.text
        return " ".join([text[at[i]:at[i + 1]] for i in ids])

    def forget(self) -> None:
        """Drop what is remembered of chunks."""
        self.new, self.old = {}, {}
        self.new_ids, self.old_ids = {}, {}

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of a chunk as 32-bit integers, remembered for short ones."""
        got = self.new_ids.get(chunk)
        if got is None:
            got = self.old_ids.get(chunk)
            if got is None:
                got = array("i", self.encode_chunk(chunk)).tobytes()
            if len(chunk) <= common.CACHE_WORD:
                if len(self.new_ids) >= CHUNKS:
                    self.old_ids, self.new_ids = self.new_ids, {}
                self.new_ids[chunk] = got
        return got

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Count, ids and decoded text of a chunk, remembered for short ones."""
        got = self.new.get(chunk)
        if got is None:
            got = self.old.get(chunk)
            if got is None:
                ids = self.encode_chunk(chunk)
                got = len(ids), " ".join(map(str, ids)), self.decode(ids)
            if len(chunk) <= common.CACHE_WORD:
                if len(self.new) >= CHUNKS:
                    self.old, self.new = self.new, {}
                self.new[chunk] = got
        return got


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _vocabulary(spark: SparkSession, path: str | None):
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    sent = _vocabulary(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = rows.drop("text").schema.add("n_tokens", "long").add("ids_sha256", "string") \
        .add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        sha = lambda parts: hashlib.sha256(
            " ".join(parts).encode("utf-8", "replace")).hexdigest()
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                n, ids, back = [], [], []
                for t in part.column("text"):
                    got = [encoder.chunk(c) for c in encoder.chunks_of(t.as_py())]
                    got = [g for g in got if g[0]]
                    n.append(sum([g[0] for g in got]))
                    ids.append(sha([g[1] for g in got]))
                    back.append(sha([g[2] for g in got]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                     pa.array(back, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` (array of int) of every row."""
    sent = _vocabulary(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = rows.drop("text").schema.add("n_tokens", "long") \
        .add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                ids = [np.frombuffer(b"".join([encoder.chunk_ids(c)
                                               for c in encoder.chunks_of(t.as_py())]),
                                     np.int32) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(list(map(len, ids)), pa.int64()),
                     pa.array(ids, pa.list_(pa.int32()))], schema.names)
        encoder.forget()  # a pipeline's next stage needs the memory
        common.release_memory()

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The rows of ``encode`` with ``decoded`` (null ids: null)."""
    sent = _vocabulary(encoded.sparkSession, vocabulary)
    schema = StructType([*encoded.schema.fields]).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            back = [None if v.as_py() is None else encoder.decode(v.as_py())
                    for v in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())],
                                             schema.names)

    return encoded.mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return encode(docs)
