"""Quality rules from repeated substrings, found by suffix sorting.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return. The suffixes of a text's words that begin with a
3-word window found twice are sorted by prefix doubling; the common prefixes of
neighbours give, for every place, the longest run of words that is also found
at another place of the text: the maximal repeats are the runs that no place to
their left prolongs. A text fails if

* it has fewer than ``MIN_WORDS`` words, or over half of its words lie in
  3-word windows found twice or more (``base_failed``), or
* repeats of ``MIN_REPEAT`` words or more cover over ``MAX_COVERED`` of its
  words (their spans united), or
* its longest repeat is over ``MAX_LONGEST`` of its words.

A batch's texts are sorted together, each with word numbers of its own, so no
repeat crosses texts. A null or empty text has no words and fails. Repeated
rows each get their row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

MIN_WORDS = 50
MIN_REPEAT = 5
MAX_COVERED = 0.3
MAX_LONGEST = 0.2
SLICE_BYTES = 2 << 20

BLANKS = b" \t\n\x0b\x0c\r"
# Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers that no two texts share; words per text."""
    out: list[np.ndarray] = []
    counts, base = [], 0
    for text in texts:
        words, known = text.split(), {}
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words),
                               np.int64, len(words)) + base)
        counts.append(len(words))
        base += len(known)
    return np.concatenate(out) if out else np.empty(0, np.int64), np.array(counts, np.int64)


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key (place of its first equal in sorted order), and whether
    another key is equal."""
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(keys)))
    rank, many = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    rank[order] = np.repeat(first, size)
    many[order] = np.repeat(size > 1, size)
    return rank, many


def repeated_windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all places by their 3-word windows (equal ones have one rank),
    and the places whose window is found at another place. As texts share no
    word numbers, a window that reaches into the next text is like no other."""
    if not len(words):
        return words, words
    w = np.append(words + 1, [0, 0])
    two, _ = _dense(w[:-1] << 32 | w[1:])
    rank, many = _dense(two[:-1] << 32 | w[2:])
    return rank, np.flatnonzero(many)


def longest_repeats(words: np.ndarray, rank: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each place (its 3-word window is found elsewhere in its text): the
    longest run of words from it that is also found at another place."""
    n = len(words)
    level = np.append(rank, -1)
    levels, h, open_ = [], 3, places
    while len(open_):
        levels.append(level.copy())
        after = level[np.minimum(open_ + h, n)]
        order = np.lexsort((after, level[open_]))
        at = open_[order]
        group, after = level[at], after[order]
        new_group = np.append(True, group[1:] != group[:-1])
        new = new_group | np.append(True, after[1:] != after[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        begin = np.repeat(np.flatnonzero(new_group),
                          np.diff(np.append(np.flatnonzero(new_group), len(at))))
        level[at] = group + np.repeat(first, size) - begin
        open_ = np.sort(at[np.repeat(size > 1, size)])
        h *= 2
    order = places[np.argsort(level[places], kind="stable")]
    x, y = order[:-1].copy(), order[1:].copy()
    prefix = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(x, n)] == levels[k][np.minimum(y, n)]
        step = np.where(same, 3 << k, 0)
        prefix += step
        x += step
        y += step
    padded = np.append(words, [-1, -2, -3])
    alike = np.ones(len(x), bool)
    for k in range(2):  # fewer than three words are left
        alike &= (np.maximum(x, y) + k < n)
        alike &= padded[np.minimum(x + k, n)] == padded[np.minimum(y + k, n)]
        prefix += alike
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, order[:-1], prefix)
    np.maximum.at(longest, order[1:], prefix)
    return longest[places]


def _per_text(starts, lengths, ends) -> np.ndarray:
    """Words of each text covered by runs of words (runs never cross texts)."""
    a, b = common.spans_union(starts, starts + lengths)
    # united runs may touch across texts: cut them at the ends of texts
    cover = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    np.add.at(cover, a, 1)
    np.add.at(cover, b, -1)
    total = np.append(0, np.cumsum(np.cumsum(cover[:-1])))
    return np.diff(total[np.append(0, ends)])


def measures(texts: list[str | None]) -> dict[str, np.ndarray]:
    raw = [common.encode(t) for t in texts]
    words, n_words = word_numbers(raw)
    ends = np.cumsum(n_words)
    rank, places = repeated_windows(words)
    out = {"n_words": n_words}
    out["word_chars"] = np.array([
        len(t or "") - len(b) + len(b.translate(None, BLANKS)) for t, b in zip(texts, raw)])
    out["n_symbols"] = np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in raw])
    lines = [[x for x in b.split(b"\n") if x.strip(BLANKS)] for b in raw]
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines])
    out["n_repeat_words"] = _per_text(places, np.full(len(places), 3), ends)
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * n_words)
    longest = longest_repeats(words, rank, places)
    long = longest >= MIN_REPEAT
    out["n_covered"] = _per_text(places[long], longest[long], ends)
    out["longest_repeat"] = np.zeros(len(texts), np.int64)
    np.maximum.at(out["longest_repeat"], np.searchsorted(ends, places, "right"), longest)
    out["kept"] = (~out["base_failed"] & (out["n_covered"] <= MAX_COVERED * n_words) &
                   ((out["longest_repeat"] < MIN_REPEAT) |
                    (out["longest_repeat"] <= MAX_LONGEST * n_words)))
    return out


COLUMNS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"),
           ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"),
           ("n_covered", "long"), ("longest_repeat", "long"), ("kept", "boolean")]


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the measures of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = rows.drop("text").schema
    for name, kind in COLUMNS:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                got = measures(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"),
                     *(pa.array(got[n], pa.bool_() if k == "boolean" else pa.int64())
                       for n, k in COLUMNS)], schema.names)

    return rows.mapInArrow(run, schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
