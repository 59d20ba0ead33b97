"""Helpers shared by the training-data operators.

Bytes and words: ``WORD_TABLE`` lower-cases A-Z, keeps a-z, 0-9 and every byte
of a non-ASCII character, and turns the other ASCII bytes into blanks, so
``text.encode().translate(WORD_TABLE).split()`` are the words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import session

WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))

# A worker's word caches are emptied beyond this many entries, so that their
# memory stays bounded whatever the number of distinct words.
CACHE_ENTRIES = 100_000
# Words longer than this are worked out each time and never cached.
CACHE_WORD = 64


def encode(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty, lone surrogates become '?'."""
    return (text or "").encode("utf-8", "replace")


def words_of(text: str | None) -> list[bytes]:
    return encode(text).translate(WORD_TABLE).split()


class WordHashes(dict):
    """64-bit hashes of words, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_WORD:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (one multiply-xorshift finaliser)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


ROLL = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values (empty if there are fewer)."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * ROLL + hashes[k:k + m]
    return mix(out)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w consecutive values (w <= len(values))."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def release_memory() -> None:
    """Give freed memory back to the system. Workers outlive their tasks, and
    what one stage's tasks keep is missing for the next stage's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def bound_batches(spark: SparkSession, max_bytes: int) -> None:
    """Arrow batches for Python of at most so many bytes from here on, unless the
    application was started with a bound of its own. Results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(max_bytes))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int,
           within: str | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``max_bytes`` of a text column each (one row
    at least), so that what a task expands a part into stays small. The column
    may be a field ``within`` a struct column."""
    start, size = 0, 0
    texts = batch.column(within).field(column) if within else batch.column(column)
    lengths = pc.binary_length(texts).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)
    release_memory()


def spans_union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans [start, end); touching runs are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(first)[1:] - 1, len(starts) - 1)
    return starts[first], ends[last]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write an intermediate result once into the shared checkpoint folder and
    read it back: later stages reuse it and a lost executor rereads it."""
    return session.cut_lineage(df)


def drop_staged(df: DataFrame) -> None:
    session.drop_written(df.sparkSession, df)


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column (one pass over that column in the JVM)."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def long_id(name: str) -> Column:
    """A document id that orders rows; a null id stands after all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(2 ** 63 - 1))
