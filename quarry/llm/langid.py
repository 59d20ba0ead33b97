"""Language identification by rank-order n-gram profiles.

A language's profile is its ``PROFILE`` most frequent letter n-grams (lengths 1
to 3, words padded by blanks), ranked by frequency over all training rows. A
document's own most frequent n-grams are ranked the same way; for each of them
a profile is out of place by the difference of the two ranks, or by
``PROFILE`` if it lacks the n-gram. The language with the smallest sum wins
(ties: the smaller name).

Rows: text null, empty or without a letter gives ``und`` and score 0; so does
every row when nothing was learned. Repeated rows each get their row. Texts of
any length are used whole. Other columns of the input are not read. Ties among
n-gram counts go to the smaller code, so results do not depend on the order of
rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

PROFILE = 400
UNKNOWN = "und"
SLICE_BYTES = 1 << 20
# The pipeline rejects texts less alike than this to every profile, whatever
# the labelled rows score.
MIN_SCORE = 0.1
# Scores of labelled texts set the rest of the threshold: so many times the
# distance from the median to the lowest decile below the median, for each size
# (n-grams, in powers of two). MIN_SCORE weighs as much as so many scores, so few
# scores raise it little, and many settle it.
SPREAD = 5.0
PRIOR = 20
SIZES = 9
# Labelled texts count whole and by one of their beginnings, of 1 to 64 words.
BEGINNINGS = 7

_WORDS = re.compile(r"[^\W\d_]+")
_BLANK, _SHIFT = np.uint64(32), np.uint64(21)


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if no character is a letter."""
    words = _WORDS.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams (21 bits a character) of blank-padded words, and
    the place of each one's first character in `` w1 w2 ... ``."""
    a = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "replace"),
                      np.uint32).astype(np.uint64)
    letter = a != _BLANK
    two = (a[:-1] << _SHIFT) | a[1:]
    at1, at3 = np.flatnonzero(letter), np.flatnonzero(letter[1:-1])
    three = (two[:-1] << _SHIFT) | a[2:]
    return (np.concatenate([a[at1], two, three[at3]]),
            np.concatenate([at1, np.arange(len(two)), at3]))


def top_grams(words: list[str]) -> np.ndarray:
    """A document's most frequent n-grams, most frequent first."""
    codes = np.sort(gram_codes(words)[0])
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    counts = np.diff(np.append(first, len(codes)))
    return codes[first[np.argsort(-counts, kind="stable")[:PROFILE]]]


def weighed_grams(counter: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of counted words, and how often each occurs."""
    words = list(counter)
    codes, at = gram_codes(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    # the blank before a word counts with it; the last blank with the last word
    owner = np.minimum(np.searchsorted(np.cumsum(lengths), at, "right"), len(words) - 1)
    weight = np.fromiter(counter.values(), np.int64, len(words))[owner]
    return _summed(codes, weight)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.add.reduceat(counts, first)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by language, worked out slice by slice (a batch's distinct
    words would take far more memory than its text) and summed per batch."""
    for batch in batches:
        found: dict[str, list] = {}
        for part in common.slices(batch, "text", SLICE_BYTES):
            by_lang: dict[str, Counter] = {}
            for text, lang in zip(part.column("text"), part.column("lang").to_pylist()):
                by_lang.setdefault(lang, Counter()).update(letter_words(text.as_py()))
            for lang, counter in by_lang.items():
                if counter:
                    found.setdefault(lang, []).append(weighed_grams(counter))
        for lang, pieces in found.items():
            codes, counts = _summed(*(np.concatenate(x) for x in zip(*pieces)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)),
                 pa.array(counts)], ["lang", "gram", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang",
        profile: int = PROFILE) -> dict[str, list[int]]:
    """Learn profiles from every row with a language: n-grams are counted per
    batch, summed by Spark, and the first ``profile`` of each language (at most
    that many rows per language) come back."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")) \
        .where("text is not null and lang is not null")
    counted = rows.mapInArrow(_count_grams, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile)
    found: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r.lang, r.rank)):
        found.setdefault(r.lang, []).append(r.gram)
    return found


class Profiles:
    """Rank table of the learned profiles: one row per language."""

    def __init__(self, learned: dict[str, list[int]]):
        self.langs = sorted(learned)
        self.grams = np.unique(np.array([g for v in learned.values() for g in v], np.uint64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            at = np.searchsorted(self.grams, np.array(learned[lang], np.uint64))
            self.ranks[i, at] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_words(letter_words(text))[:2]

    def predict_words(self, words: list[str]) -> tuple[str, float, int]:
        """Language, score and number of the n-grams compared."""
        if not words or not self.langs:
            return UNKNOWN, 0.0, 0
        top = top_grams(words)
        at = np.searchsorted(self.grams, top)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != top] = len(self.grams)
        ranks = self.ranks[:, at]
        out = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(top))))
        distance = out.sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (PROFILE * len(top))), len(top)


def identify(docs: DataFrame, learned: dict[str, list[int]], keep: list[Column],
             text: str = "text") -> DataFrame:
    """``keep`` columns of every row plus ``lang_pred`` and ``score``."""
    return _identify(docs, learned, keep, text).drop("n_grams")


def _identify(docs: DataFrame, learned: dict[str, list[int]], keep: list[Column],
              text: str = "text") -> DataFrame:
    """``identify`` with the number of n-grams that were compared."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("n", pa.int32())])

    # only the text goes to Python, the other columns stay where they are
    @F.arrow_udf("struct<lang: string, score: double, n: int>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Profiles(learned)
        for batch in texts:
            got = [model.predict_words(letter_words(t.as_py())) for t in batch]
            yield pa.array([{"lang": g[0], "score": g[1], "n": g[2]} for g in got], kind)
            common.release_memory()

    return docs.select(*keep, predict(F.col(text)).alias("predicted")).select(
        *(F.col(f"`{c}`") for c in docs.select(*keep).columns),
        F.col("predicted.lang").alias("lang_pred"), F.col("predicted.score").alias("score"),
        F.col("predicted.n").alias("n_grams"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows are those whose crc32 of the id as text is divisible by 5
    (a null id counts as held out); the others with a language are learned from."""
    docs = common.table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    learned = fit(docs.where(~held))
    return identify(docs, learned, [F.col("doc_id"), held.alias("held_out")])


def _size(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def thresholds(docs: DataFrame, learned: dict[str, list[int]], text: str = "text",
               lang: str = "lang") -> list[float]:
    """The least score of a text of each size (see ``SPREAD``), from every row
    with a language. A beginning is as long as its text's crc32 says, so sizes
    that few whole texts have are there too."""
    kind = pa.list_(pa.struct([("score", pa.float64()), ("n", pa.int32())]))

    @F.arrow_udf("array<struct<score: double, n: int>>")
    def measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Profiles(learned)
        for batch in texts:
            out = []
            for t in batch:
                words = letter_words(t.as_py())
                first = 1 << zlib.crc32(" ".join(words[:64]).encode("utf-8", "replace")) % BEGINNINGS
                parts = [words, words[:first]] if len(words) > first else [words]
                out.append([{"score": s, "n": n} for _, s, n in map(model.predict_words, parts)
                            if n])
            yield pa.array(out, kind)
            common.release_memory()

    scores = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()) \
        .select(F.explode(measure(F.col(text))).alias("s")) \
        .select(_size(F.col("s.n")).alias("size"), "s.score")
    found = scores.groupBy("size").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("score", [0.1, 0.5], 10_000).alias("q")).collect()
    least = [MIN_SCORE] * SIZES
    for r in found:
        low, mid = r.q
        learned_from = max(MIN_SCORE, mid - SPREAD * (mid - low))
        least[r.size] = MIN_SCORE + (learned_from - MIN_SCORE) * r.n / (PRIOR + r.n)
    return least


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language: texts without letters, or less like
    every learned profile than texts of their size with a language are, go. A
    missing ``lang`` is filled in. Without any labelled row nothing is known,
    and all rows stay."""
    learned = fit(docs)
    if not learned:
        return docs
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    least = F.array(*map(F.lit, thresholds(docs, learned)))
    seen = _identify(docs, learned, [whole]) \
        .where((F.col("lang_pred") != UNKNOWN) &
               (F.col("score") >= F.get(least, _size(F.col("n_grams")))))
    return seen.select(*((F.coalesce("doc.lang", "lang_pred") if c == "lang" else
                          F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
