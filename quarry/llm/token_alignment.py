"""Alignment of two tokenizers by inverted pair bitmaps.

Each text is cut into tokens twice, by a byte-level vocabulary (A, on a space and
the text) and by a piece vocabulary (B, which adds the space itself). Tokens of
the two whose byte ranges overlap are linked; byte offsets where both end cut a
text into groups. A pair of ids counts as many links as the corpus has of it.

1. *Index.* No token of the two reaches over the start of a space that follows
   text (checked of the vocabularies; else texts are taken whole), so texts are
   aligned word by word, and frequent words are remembered (boundedly many). A
   task gathers documents into blocks of about ``BLOCK_BYTES``. In a block, a pair's postings are a compressed bitmap of the block's documents: only
   64-bit words with a bit set are kept. How often a document has the pair stands
   in multiplicity planes: plane k has the documents whose number has bit k.
   Slices of a block are indexed one by one and OR-merged.
2. *Counts.* The OR of a pair's planes is popcounted for its documents, the
   planes, each weighted by its power of two, for its links. Every block sends
   (pair, documents, links); a pair's sum over the blocks is its count, and the
   largest count by B id tells the best pairs. A pair that all documents have
   sends one row per block, not one per document.
3. *Scores.* The counts return to the blocks that have the pair, where the
   postings hand them to the documents: each plane adds its share to the sums of
   the documents in it.

``align`` gives a row per input row (see there), ``pair_counts`` the table of
pairs. Texts that are null or empty, or whose tokens' bytes are not the space and
the text (white space that a vocabulary changes), have no tokens and count for
nothing. Rows that repeat an id, or have none, are documents of their own. Texts
are used whole; a text longer than a block is a block of its own. No other column
is read. Ids of both vocabularies must be below 65536.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.bpe import byte_symbols

BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 1 << 16
SLICE_BYTES = 512 << 10
SLICE_ROWS = 4096
ID_BITS = 16
PIECE = 1 << 16      # words of a plane that are spread out at a time
WORDS = 200_000      # words remembered
LINKS = 4_000_000    # of them
_SPACE = "▁"    # fixed value: the piece vocabulary's space
_GAPS = re.compile(r"\s ")
# Fixed value: how a byte-level vocabulary's texts are split.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Both vocabularies: ids of texts, and the bytes of each id."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_proto=b)
        symbols, spec = byte_symbols(), json.loads(a)
        names = {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items()
                 if all(c in symbols for c in t)}
        self.bytes_a = [names.get(i, b"") for i in range(max(names) + 2)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else
                        p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        n = max(len(self.len_a), len(self.len_b))
        if n > 1 << ID_BITS:
            raise ValueError(f"vocabularies of over {1 << ID_BITS} ids can't be paired")
        self.printed = np.array([[f"{i}{mark}" for i in range(n)] for mark in ",|;"], object)
        # does no token of either reach over the start of a space that follows text?
        split = spec.get("pre_tokenizer") or {}
        self.by_words = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and
                         not spec.get("normalizer") and
                         not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces))
        self.ranked = self._ranked(spec, names) if self.by_words else None

    @staticmethod
    def _ranked(spec: dict, names: dict[int, bytes]):
        """A faster library for the same merges, where ids are their ranks."""
        merges, vocab = spec["model"]["merges"], spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        if [vocab[x + y] for x, y in pairs] != list(range(256, 256 + len(pairs))):
            return None
        import tiktoken
        ranks = {names[i]: i for i in range(256 + len(pairs))}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of the words, a space before each, by both."""
        text = " " + " ".join(words)
        if self.ranked:
            a = self.ranked.encode_ordinary(text)
        else:
            a = self.a.encode(text, add_special_tokens=False).ids
        return a, list(chain.from_iterable(self.b.encode(words, num_threads=1)))

    def joined(self, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
        return (b"".join([self.bytes_a[i] for i in a]), b"".join([self.bytes_b[i] for i in b]))

    def words(self, text: str) -> list[str]:
        """The text in parts, each after a space, that both cut by themselves."""
        if not self.by_words:
            return [text]
        parts = text.split(" ")
        if text[0] != " " and text[-1] != " " and not _GAPS.search(text):
            return parts
        out, held = [], ""
        for p in parts:  # white space belongs to the word after it
            held += p
            if p and not p[-1].isspace():
                out.append(held)
                held = ""
            else:
                held += " "
        if parts[-1] == "" or parts[-1][-1].isspace():  # or to the last word
            held = held[:-1]
            out[-1:] = [f"{out[-1]} {held}"] if out else [held]
        return out


@lru_cache(maxsize=1)
def _tokenizers(a: str, b: bytes) -> Tokenizers:
    return Tokenizers(a, b)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers
    return (public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("piece_bpe_32k.model"))


class Aligned:
    """Links and groups of token ids of the same bytes, cut at ``stops`` (ends of
    parts, where tokens of both end)."""

    def __init__(self, both: Tokenizers, a: list[int], b: list[int], stops: np.ndarray):
        self.both, self.a, self.b = both, np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(both.len_a[self.a]), np.cumsum(both.len_b[self.b])
        # the bytes between two neighbouring ends belong to one token of each
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        ends = ends[np.append(True, ends[1:] != ends[:-1])[:len(ends)]]
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        cuts = ends[(end_a[at_a] == ends) & (end_b[at_b] == ends)]
        self.pair = (self.a[at_a] << ID_BITS | self.b[at_b]).astype(np.uint32)
        count_to = lambda x: np.diff(np.searchsorted(x, stops, "right"), prepend=0)
        self.n_a, self.n_b, self.n_groups, self.n_links = map(count_to, (end_a, end_b, cuts, ends))
        self.group_a, self.group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each part."""
        side = np.concatenate([2 * self.group_a, 2 * self.group_b + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([self.a, self.b])[order]
        mark = np.full(len(ids), 2)
        mark[:-1] = np.where(side[1:] == side[:-1], 0, np.where(side[1:] >> 1 == side[:-1] >> 1, 1, 2))
        printed = self.both.printed[mark, ids].tolist()
        stops = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(printed[i:j])[:-1] for i, j in zip([0, *stops], stops)]


class Words:
    """Alignments of words, by place: counts, links' pairs and groups. Forgotten
    as a whole beyond ``WORDS`` words or ``LINKS`` links."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.forget()

    def forget(self) -> None:
        self.place = defaultdict(count().__next__)
        self.groups: list[str] = []
        self.parts: list[list[np.ndarray]] = [[np.empty((4, 0), np.int64), np.empty(0, bool),
                                               np.empty(0, np.uint32)]]

    def learn(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Align the words that got a place since the last time. Counts of A's and
        B's tokens, groups and links; is a word kept by both; all links' pairs."""
        new = list(islice(reversed(self.place), len(self.place) - len(self.groups)))[::-1]
        # one call for all; a word that ends in white space would change the next
        plain = [w for w in new if w and not w[-1].isspace()]
        known = self._align(plain)
        if known is None or len(plain) < len(new):
            known = [self._align([w]) for w in new]
            nothing = (np.zeros((4, 1), np.int64), [""], np.empty(0, np.uint32))
            ok = np.array([k is not None for k in known], bool)
            known = [k or nothing for k in known]
            known = (np.concatenate([k[0] for k in known], axis=1),
                     [g for k in known for g in k[1]], np.concatenate([k[2] for k in known]))
        else:
            ok = np.ones(len(new), bool)
        self.groups += known[1]
        self.parts.append([known[0], ok, known[2]])
        self.parts = [[np.concatenate(x, axis=-1) for x in zip(*self.parts)]]
        return tuple(self.parts[0])

    def _align(self, words: list[str]):
        """Counts, groups and pairs of each word; None if bytes are not kept."""
        if not words:
            return np.zeros((4, 0), np.int64), [], np.empty(0, np.uint32)
        a, b = self.both.encode(words)
        whole = f" {' '.join(words)}".encode("utf-8", "replace")
        if self.both.joined(a, b) != (whole, whole):
            return None
        stops = np.cumsum([len(w.encode("utf-8", "replace")) + 1 for w in words])
        al = Aligned(self.both, a, b, stops)
        return np.array([al.n_a, al.n_b, al.n_groups, al.n_links]), al.groups(), al.pair

    def full(self) -> bool:
        return len(self.groups) > WORDS or len(self.parts[0][2]) > LINKS


class Slice:
    """Links and groups of a list of texts (null for none), word by word."""

    def __init__(self, words: Words, texts: list[str | None]):
        place = words.place
        at = [[place[w] for w in words.both.words(t)] if t else [] for t in texts]
        counts, ok, pairs = words.learn()
        word, n = self._flat(at)
        groups = words.groups
        odd = np.bincount(np.repeat(np.arange(len(at)), n), ~ok[word], len(at)) > 0
        if odd.any():  # odd texts are taken whole
            own = Words(words.both)
            for i in np.flatnonzero(odd).tolist():
                at[i] = [own.place[texts[i]] + len(groups)]
            more = own.learn()
            for i in np.flatnonzero(odd).tolist():
                at[i] = at[i] if more[1][at[i][0] - len(groups)] else []
            groups = groups + own.groups
            counts, pairs = (np.concatenate([x, y], axis=-1)
                             for x, y in ((counts, more[0]), (pairs, more[2])))
            word, n = self._flat(at)
        of = np.repeat(np.arange(len(at)), n)
        self.n_a, self.n_b, self.n_groups, self.n_links = (
            np.bincount(of, c[word], len(at)).astype(np.int64) for c in counts)
        links = counts[3][word]
        step = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        self.pair = pairs[np.repeat((np.cumsum(counts[3]) - counts[3])[word], links) + step]
        self.doc = np.repeat(of, links)
        self.groups = [";".join([groups[k] for k in v]) for v in at]
        if words.full():
            words.forget()

    @staticmethod
    def _flat(at: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(chain.from_iterable(at), np.int64), np.array(list(map(len, at)), np.int64)


def planes_of(pair: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bitmaps of the links (pair, document): for each plane the keys (pair, word
    of the documents) in order, and the words."""
    key, many = np.unique(pair.astype(np.uint64) << np.uint64(ID_BITS) | doc.astype(np.uint64),
                          return_counts=True)
    word, bit = key >> np.uint64(6), np.uint64(1) << (key & np.uint64(63))
    out = []
    for k in range(int(many.max(initial=0)).bit_length()):
        has = np.flatnonzero(many >> k & 1)
        out.append(_ored(word[has], bit[has]))
    return out


def _ored(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of equal keys (in order) OR-ed."""
    if not len(key):
        return key, words
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.bitwise_or.reduceat(words, first)


def merged(indexes: list[list[tuple[np.ndarray, np.ndarray]]]):
    """The OR of the planes of several indexes."""
    out = []
    for k in range(max(map(len, indexes), default=0)):
        key, words = (np.concatenate(x) for x in zip(*(p[k] for p in indexes if len(p) > k)))
        order = np.argsort(key, kind="stable")
        out.append(_ored(key[order], words[order]))
    return out


_DOC_BITS = np.uint64(ID_BITS - 6)  # of a key's word


def popcounts(planes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of an index, how many documents have each, and how many links."""
    if not planes:
        none = np.empty(0, np.int64)
        return none, none, none
    every = merged([[p] for p in planes])[0]
    pairs, first = np.unique(every[0] >> _DOC_BITS, return_index=True)
    docs = np.add.reduceat(np.bitwise_count(every[1]).astype(np.int64), first)
    links = np.zeros(len(pairs), np.int64)
    for k, (key, words) in enumerate(planes):
        np.add.at(links, np.searchsorted(pairs, key >> _DOC_BITS),
                  np.bitwise_count(words).astype(np.int64) << k)
    return pairs.astype(np.int64), docs, links


def _packed(pairs: np.ndarray, planes) -> list[bytes]:
    """Planes by place of the pair, compressed: steps of the keys, words."""
    pack, out = zstandard.ZstdCompressor(level=1).compress, []
    for key, words in planes:
        place = np.searchsorted(pairs, (key >> _DOC_BITS).astype(np.int64)).astype(np.uint64)
        key = place << _DOC_BITS | key & ((np.uint64(1) << _DOC_BITS) - np.uint64(1))
        out.append(pack(np.diff(key, prepend=np.uint64(0)).astype(np.uint32).tobytes()
                        + words.tobytes()))
    return out


def _unpacked(plane: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs, first documents of the words, words."""
    data = zstandard.ZstdDecompressor().decompress(plane)
    n = len(data) // 12
    key = np.cumsum(np.frombuffer(data, np.uint32, n).astype(np.uint64))
    return ((key >> _DOC_BITS).astype(np.int64),
            (key & ((np.uint64(1) << _DOC_BITS) - np.uint64(1))).astype(np.int64) * 64,
            np.frombuffer(data, np.uint64, n, 4 * n))


_BODY = pa.struct([("ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())),
                   ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())),
                   ("n_links", pa.list_(pa.int64())), ("groups", pa.list_(pa.string())),
                   ("planes", pa.list_(pa.binary()))])
_BLOCK = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("n_docs", pa.int64()),
                    ("n_links", pa.int64()), ("body", _BODY)])
_BLOCK_DDL = ("block long, pair long, n_docs long, n_links long, body struct<ids: array<long>, "
              "n_a: array<long>, n_b: array<long>, n_groups: array<long>, n_links: array<long>, "
              "groups: array<string>, planes: array<binary>>")


def _digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of few bytes and few rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield from common.slices(batch.slice(i, SLICE_ROWS), "text", SLICE_BYTES)


def _index(vocabulary_a, vocabulary_b, texts: bool):
    """Blocks: a row with the documents and planes, a row per pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(_tokenizers(vocabulary_a.value, vocabulary_b.value))
        name = TaskContext.get().partitionId() << 32
        body: dict[str, list] = {f.name: [] for f in _BODY}
        indexes, size = [], 0

        def settle():
            nonlocal name, size
            planes = merged(indexes)
            pairs, docs, links = popcounts(planes)
            body["planes"] = _packed(pairs, planes)
            n = len(pairs) + 1
            rows = [pa.array([name] * n, pa.int64()), pa.array([None, *pairs.tolist()], pa.int64()),
                    pa.array([None, *docs.tolist()], pa.int64()),
                    pa.array([None, *links.tolist()], pa.int64()),
                    pa.array([body] + [None] * (n - 1), _BODY)]
            for v in body.values():
                v.clear()
            indexes.clear()
            name, size = name + 1, 0
            return pa.RecordBatch.from_arrays(rows, schema=_BLOCK)

        for part in _parts(batches):
            lines = part.column("text").to_pylist()
            if body["ids"] and (size > BLOCK_BYTES or
                                len(body["ids"]) + len(lines) > BLOCK_DOCS):
                yield settle()
            size += sum(map(len, filter(None, lines)))
            found = Slice(words, lines)
            if len(found.pair):
                indexes.append(planes_of(found.pair, found.doc + len(body["ids"])))
            body["ids"] += part.column("id").to_pylist()
            body["groups"] += found.groups if texts else map(_digest, found.groups)
            for c in ("n_a", "n_b", "n_groups", "n_links"):
                body[c] += getattr(found, c).tolist()
        if body["ids"]:
            yield settle()
        common.release_memory()
    return run


_ALIGNED = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links",
                                                "n_best", "count_sum")] + [("groups", pa.string())])


def _scored(body: dict, count: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """Hand the counts of a block's pairs (in order) to its documents."""
    n = len(body["ids"])
    total, n_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, plane in enumerate(body["planes"]):
        place, doc, words = _unpacked(plane)
        for i in range(0, len(words), PIECE):
            bits = np.unpackbits(words[i:i + PIECE].view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little")
            at, lane = np.nonzero(bits)
            where, of = doc[i + at] + lane, place[i + at]
            np.add.at(total, where, count[of] << k)
            np.add.at(n_best, where, best[of].astype(np.int64) << k)
    values = [body[c] for c in ("ids", "n_a", "n_b", "n_groups", "n_links")]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip([*values, n_best, total, body["groups"]],
                                        _ALIGNED.types)], schema=_ALIGNED)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's row comes first, then its pairs in order; one block is held."""
    body, counts, best = None, [], []

    def settle():
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (counts, best)]
        counts.clear()
        best.clear()
        return _scored(body, *flat)

    for batch in batches:
        first = batch.column("pair").is_null().to_numpy(zero_copy_only=False)
        cuts = sorted({0, *np.flatnonzero(first).tolist()}) if batch.num_rows else []
        for i, j in zip(cuts, [*cuts[1:], batch.num_rows]):
            if first[i]:
                if body is not None:
                    yield settle()
                body = batch.column("body")[i].as_py()
                i += 1
            if i < j:
                counts.append(batch.column("count").slice(i, j - i).to_numpy())
                best.append(batch.column("best").slice(i, j - i).to_numpy(zero_copy_only=False))
    if body is not None:
        yield settle()
    common.release_memory()


def _indexed(docs: DataFrame, doc_id: str, text: str, vocabularies, texts: bool) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    path_a, path_b = vocabularies or default_vocabularies()
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        sent = sc.broadcast(a.read()), sc.broadcast(b.read())
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"),
                       F.col(f"`{text}`").alias("text"))
    return common.staged(rows.mapInArrow(_index(*sent, texts), _BLOCK_DDL))


def _totals(blocks: DataFrame) -> DataFrame:
    """``pair, n_docs, n_links, best`` of every pair."""
    sums = common.staged(blocks.where("pair is not null").groupBy("pair").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links")))
    b_id = F.col("pair").bitwiseAND((1 << ID_BITS) - 1)
    # one row per B id: at most 65536
    top = sums.groupBy(b_id.alias("b_id")).agg(F.max("n_links").alias("most"))
    return sums.withColumn("b_id", b_id).join(F.broadcast(top), "b_id").select(
        "pair", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """``a_id, b_id, n_docs, n_links, best`` of every pair that is linked."""
    found = _totals(_indexed(docs, doc_id, text, vocabularies, False))
    return found.select(F.shiftright("pair", ID_BITS).alias("a_id"),
                        F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b_id"),
                        "n_docs", "n_links", "best")


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          vocabularies: tuple[str, str] | None = None, texts: bool = True) -> DataFrame:
    """A row per input row: ``doc_id``; ``n_a``, ``n_b``, ``n_groups``, ``n_links``
    (long); ``n_best`` (links whose pair has its B id's highest count) and
    ``count_sum`` (counts of all links' pairs); ``groups`` (`a1,a2|b1;a3|b2,b3`,
    empty without tokens), or its SHA-256 unless ``texts``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _indexed(docs, doc_id, text, vocabularies, texts)
    pairs = blocks.where("pair is not null").select("block", "pair").join(
        _totals(blocks).select("pair", F.col("n_links").alias("count"), "best"), "pair")
    body = blocks.schema["body"].dataType
    rows = blocks.where("pair is null").select(
        "block", "pair", F.lit(None).cast("long").alias("count"),
        F.lit(None).cast("boolean").alias("best"), "body") \
        .unionByName(pairs.withColumn("body", F.lit(None).cast(body)))
    return rows.repartition(parts, "block").sortWithinPartitions("block", "pair").mapInArrow(
        _score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                "count_sum long, groups string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"), texts=False) \
        .withColumnRenamed("groups", "groups_sha256")
