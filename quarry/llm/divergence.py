"""Divergence audit of sources by in-mapper stripes.

For every language, how far each source's distribution of terms is from every
other source's, and which terms a source has more often than its language.

1. *Fold.* A task folds whole documents into a hash table of stripes: a term's
   documents and occurrences by (language, source). Beyond ``HELD`` terms the table
   is spilled and started anew, so memory doesn't grow with a partition. A spill is
   dealt by the terms' hashes: one packed row for each bucket of terms.
2. *Merge.* A bucket's rows meet in one task and are added by term; a term that all
   documents have comes once per spill. The number of buckets follows the bytes of
   the texts. Terms of fewer than ``MIN_DOCS`` documents of a language go; the
   others are packed, up to ``CHUNK`` merged stripes of one language to a row, with
   the sums by source.
3. *Totals.* The sums, and the groups that occur, give each language's sources,
   their totals and the number of kept terms: one row per language.
4. *Divergence.* Each packed row, given its language's totals, gives for all pairs
   of sources the sum over its terms and for each source its ``TOP`` terms; sums
   are added by pair, and the candidates ranked.

Contract (exact, in whole numbers): with N the occurrences of kept terms in a
group and V the kept terms of its language, a term with ``count`` occurrences
has p = 1 + floor(10^9 (count + 1) / (N + V)). f = floor((p - q)^2 / q). Part
``pair``: f against each other source, summed over the kept terms. Part ``term``:
terms the source has, with p above q of the language, by f, the first ``TOP``.
Ties are ordered by item (UTF-8 bytes).

Rows: null text, language and source count as empty. Repeated rows are documents
of their own, whatever their id; no id is read. Texts are used whole (the words
of a text are held at once). A language of one source has no pairs, one without kept terms
has pairs of value 0 and no terms; an empty table gives no rows. Totals must be
under 9 * 10^15 occurrences for a group.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

MIN_DOCS = 3
TOP = 200
SCALE_STEPS = 3      # of three decimal digits each: shares of 10^9
HELD = 300_000       # terms of a task
BUCKET_BYTES = 8 << 20    # of text whose terms a bucket holds, on average
CHUNK = 4_000        # merged stripes of a row
CELLS = 1 << 20      # of a table of terms by sources
SLICE_BYTES = 2 << 20
GROUP_BITS = 24

# A-Z are lowered, other ASCII characters but letters part terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))

_STRIPES = pa.schema([("bucket", pa.int32()), ("langs", pa.list_(pa.string())),
                      ("sources", pa.list_(pa.string())), ("terms", pa.binary()),
                      ("entries", pa.binary())])
_STRIPES_DDL = ("bucket int, langs array<string>, sources array<string>, terms binary, "
                "entries binary")


def terms_of(text: str | None) -> list[bytes]:
    return common.encode(text).translate(_TERMS).split()


def _added(key: np.ndarray, docs: np.ndarray, n: np.ndarray):
    """Documents and occurrences of equal keys added up; keys in order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    if not len(first):
        return key, docs, n
    return key[first], np.add.reduceat(docs[order], first), np.add.reduceat(n[order], first)


def _cuts(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal values."""
    cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1])[:len(values)]).tolist()
    return zip(cuts, [*cuts[1:], len(values)])


class _Table:
    """A task's stripes: (term, group) -> documents, occurrences."""

    def __init__(self):
        self.terms, self.groups = (defaultdict(count().__next__) for _ in range(2))
        self.found: list[tuple] = []

    def fold(self, texts: list[str | None], groups: list[tuple[str, str]]) -> None:
        words = [terms_of(t) for t in texts]
        n = np.array(list(map(len, words)), np.int64)
        term = np.fromiter(map(self.terms.__getitem__, chain.from_iterable(words)), np.int64)
        group = np.array([self.groups[g] for g in groups], np.int64)
        # by document first: each counts once for a term
        one = np.ones(len(term), np.int64)
        key, _, many = _added(term * len(texts) + np.repeat(np.arange(len(texts)), n), one, one)
        self.found.append(_added(key // len(texts) << GROUP_BITS | group[key % len(texts)],
                                 np.ones(len(key), np.int64), many))

    def full(self) -> bool:
        return len(self.terms) >= HELD or len(self.groups) >= 1 << GROUP_BITS - 1

    def rows(self, n_buckets: int) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        key, docs, n = _added(*(np.concatenate(x) for x in zip(*self.found)))
        terms, groups = list(self.terms), list(self.groups)
        bucket = np.fromiter((zlib.crc32(t) % n_buckets for t in terms), np.int64, len(terms))
        term, group = key >> GROUP_BITS, key & ((1 << GROUP_BITS) - 1)
        order = np.argsort(bucket[term], kind="stable")
        term, group, docs, n = (x[order] for x in (term, group, docs, n))
        for i, j in _cuts(bucket[term]):
            new = np.append(True, np.diff(term[i:j]) != 0)
            here, local = term[i:j][new].tolist(), np.cumsum(new) - 1
            used, place = np.unique(group[i:j], return_inverse=True)
            entries = np.stack([local, place, docs[i:j], n[i:j]])
            values = (int(bucket[term[i]]), [groups[g][0] for g in used.tolist()],
                      [groups[g][1] for g in used.tolist()],
                      pack(b" ".join([terms[t] for t in here])), pack(entries.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, _STRIPES.types)], schema=_STRIPES)


def _fold(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table()
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                text, lang, source = (part.column(c).to_pylist() for c in ("text", "lang", "source"))
                table.fold(text, list(zip(lang, source)))
                if table.full():
                    yield from table.rows(n_buckets)
                    table = _Table()
        if table.found:
            yield from table.rows(n_buckets)
        common.release_memory()
    return run


_CHUNKS = pa.schema([("lang", pa.string()), ("kept", pa.int64()), ("names", pa.list_(pa.string())),
                     ("sums", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())),
                     ("n_at", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())),
                     ("counts", pa.list_(pa.int64()))])
_CHUNKS_DDL = ("lang string, kept long, names array<string>, sums array<long>, "
               "terms array<binary>, n_at array<int>, at array<int>, counts array<long>")


def _bucket_chunks(rows: list[dict], least: int) -> Iterator[pa.RecordBatch]:
    """Merged stripes of a bucket, packed by language."""
    unpack = zstandard.ZstdDecompressor().decompress
    groups, names, parts, start = defaultdict(count().__next__), [], [], 0
    for r in rows:
        terms = unpack(r["terms"]).split(b" ")
        local, place, docs, n = np.frombuffer(unpack(r["entries"]), np.int64).reshape(4, -1)
        group = np.array([groups[g] for g in zip(r["langs"], r["sources"])], np.int64)
        parts.append((local + start, group[place], docs, n))
        names.append(pa.array(terms, pa.binary()))
        start += len(terms)
    names = pa.concat_arrays(names).dictionary_encode()
    term, group, docs, n = (np.concatenate(x) for x in zip(*parts))
    term = names.indices.to_numpy()[term].astype(np.int64)
    langs = sorted({g for g, _ in groups})
    lang_of = np.array([langs.index(g) for g, _ in groups], np.int64)
    source_of = [s for _, s in groups]
    key, docs, n = _added(((lang_of[group] << 32 | term) << GROUP_BITS) | group, docs, n)
    group, stripe = key & ((1 << GROUP_BITS) - 1), key >> GROUP_BITS
    first = np.flatnonzero(np.append(True, np.diff(stripe) != 0))
    size = np.diff(np.append(first, len(key)))
    kept = np.add.reduceat(docs, first) >= least
    entry = np.repeat(kept, size)
    stripe, size, group, n = stripe[first][kept], size[kept], group[entry], n[entry]
    ends = np.cumsum(size)
    lists = lambda x, t: pa.ListArray.from_arrays(
        pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
    for a, b in _cuts(stripe >> 32):
        for i in range(a, b, CHUNK):
            j = min(b, i + CHUNK)
            p, q = (int(ends[i - 1]) if i else 0), int(ends[j - 1])
            used, at = np.unique(group[p:q], return_inverse=True)
            sums = np.zeros(len(used), np.int64)
            np.add.at(sums, at, n[p:q])
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[int(stripe[i] >> 32)]]), pa.array([j - i], pa.int64()),
                 lists([source_of[g] for g in used.tolist()], pa.string()), lists(sums, pa.int64()),
                 lists(names.dictionary.take(pa.array(stripe[i:j] & 0xFFFFFFFF)), None),
                 lists(size[i:j].astype(np.int32), pa.int32()), lists(at.astype(np.int32), pa.int32()),
                 lists(n[p:q], pa.int64())], schema=_CHUNKS)


def _merge(least: int):
    """Buckets arrive in order; one is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    yield from _bucket_chunks(held, least)
                    held = []
                    common.release_memory()
                held.append(r)
        if held:
            yield from _bucket_chunks(held, least)
        common.release_memory()
    return run


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (counts + 1) / total) by long division, without overflow."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // q


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()),
                    ("item", pa.string()), ("value", pa.int64())])


def _diverge(top: int):
    """For each packed row: sums by pair of sources, first terms by source."""
    def of(batch: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        r = {c: batch.column(c)[i].as_py() for c in ("lang", "v", "all_names", "names", "terms")}
        totals, n_at, at, counts = (batch.column(c)[i].values.to_numpy()
                                    for c in ("totals", "n_at", "at", "counts"))
        names, terms, kept = r["all_names"], r["terms"], r["v"]
        n, column = len(names), {s: i for i, s in enumerate(names)}
        place = np.array([column[s] for s in r["names"]], np.int64)
        term_at, source_at = np.repeat(np.arange(len(terms)), n_at), place[at]
        sums = np.zeros((n, n), np.int64)
        best: list[tuple[np.ndarray, list]] = [(np.empty(0, np.int64), [])] * n
        step = max(1, CELLS // n)
        for start in range(0, len(terms), step):
            stop = min(len(terms), start + step)
            i, j = np.searchsorted(term_at, [start, stop])
            table = np.zeros((stop - start, n), np.int64)
            table[term_at[i:j] - start, source_at[i:j]] = counts[i:j]
            p = shares(table, totals + kept)
            for s in range(n):
                sums[s] += _excess(p[:, s:s + 1], p).sum(axis=0)
            q = shares(table.sum(axis=1), int(totals.sum()) + kept)
            for s in range(n):
                rows = np.flatnonzero((table[:, s] > 0) & (p[:, s] > q))
                best[s] = _first(top, *best[s], _excess(p[rows, s], q[rows]),
                                 [terms[start + k] for k in rows.tolist()])
        names = pa.array(names, pa.string())
        s, t = np.nonzero(~np.eye(n, dtype=bool))
        rank = np.repeat(np.arange(n), [len(v) for v, _ in best])
        items = pa.array([t for _, v in best for t in v], pa.binary()).cast(pa.string())
        for part, source, item, value in (
                ("pair", s, names.take(pa.array(t)), sums[s, t]),
                ("term", rank, items, np.concatenate([v for v, _ in best]))):
            m = len(source)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["lang"]] * m, pa.string()), names.take(pa.array(source)),
                 pa.array([part] * m, pa.string()), item, pa.array(value)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from of(batch, i)
        common.release_memory()
    return run


def _first(top: int, values: np.ndarray, terms: list, more: np.ndarray, names: list):
    """The ``top`` by value (ties: the smaller term) of two lists."""
    values, terms = np.concatenate([values, more]), terms + names
    if len(values) > top:  # all that reach the value of the last place, ties included
        least = np.partition(values, len(values) - top)[len(values) - top]
        at = np.flatnonzero(values >= least)
    else:
        at = np.arange(len(values))
    at = sorted(at.tolist(), key=lambda k: (-values[k], terms[k]))[:top]
    return values[at], [terms[k] for k in at]


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``; see the module's text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                         for c, name in ((text, "text"), (lang, "lang"), (source, "source"))))
    n = max(parts, -(-common.total_bytes(rows, "text") // BUCKET_BYTES))
    chunks = common.staged(rows.mapInArrow(_fold(n), _STRIPES_DDL).repartition(parts, "bucket")
                           .sortWithinPartitions("bucket").mapInArrow(_merge(min_docs), _CHUNKS_DDL))
    # groups without kept terms are there too
    sums = chunks.select("lang", F.explode(F.arrays_zip("names", "sums")).alias("s")) \
        .select("lang", F.col("s.names").alias("name"), F.col("s.sums").alias("total")) \
        .union(rows.select("lang", F.col("source").alias("name"), F.lit(0).cast("long")).distinct())
    # one row per language: small beside the stripes, whatever the input
    totals = common.staged(sums.groupBy("lang", "name").agg(F.sum("total").alias("total"))
                           .groupBy("lang").agg(F.sort_array(F.collect_list(
                               F.struct("name", "total"))).alias("all"))
                           .join(chunks.groupBy("lang").agg(F.sum("kept").alias("v")), "lang", "left")
                           .select("lang", F.coalesce("v", F.lit(0)).alias("v"),
                                   F.col("all.name").alias("all_names"),
                                   F.col("all.total").alias("totals")))
    # an empty chunk per language: its pairs are there without any kept term
    none = totals.select("lang", *(F.from_json(F.lit("[]"), chunks.schema[c].dataType.simpleString())
                                   .alias(c) for c in ("names", "terms", "n_at", "at", "counts")))
    chunks = chunks.select(none.columns).union(none)
    found = chunks.join(totals, "lang").mapInArrow(
        _diverge(top), "lang string, source string, part string, item string, value long")
    found = common.staged(found)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item") \
        .agg(F.sum("value").alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)) \
        .where(F.col("rank") <= top)
    return ranked.union(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(common.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (
  SELECT lang, source, id, term, count(*) AS n
  FROM (SELECT lang, source, id, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(n) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
gn AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM g LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source)),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)::HUGEINT) // (gn.n + gn.v)::HUGEINT AS p
  FROM gn JOIN k ON k.lang = gn.lang
  LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (
  SELECT lang, term,
         1 + (1000000000::HUGEINT * (t.n + 1)::HUGEINT) // (l.n + l.v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) t
  JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM gn GROUP BY lang) l USING (lang)),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT)
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM r)
WHERE part = 'pair' OR rank <= 200
"""
