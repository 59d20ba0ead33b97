"""Benchmark decontamination by winnowing.

A benchmark item's windows are its runs of ``SPAN`` consecutive words (an item
of fewer words is one window). From every run of ``SPAN`` words of a text
winnowing keeps the smallest hash of its ``GRAM``-word grams (the leftmost, if
it occurs again), so two texts that share such a run share its fingerprint. The
fingerprints of documents and items are joined, and each hit is extended: the
hashes of the document's windows that the fingerprint was kept for are joined
with the items' windows. Items of fewer than ``SPAN`` words are looked up by
the hash of all their words.

Before the join a document fingerprint has to be set in a bitmap of the items'
fingerprints. The bitmap has ``FILTER_BITS`` bits (1 MB) whatever the size of
the benchmark; a large benchmark only lets more rows through to the join.

Rows: a null or empty text has no words and no hits. Items without words or
with a null id are ignored, a repeated id counts once. Every row of the
documents gets a row, also repeated ones and null ids. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

SPAN = 10
GRAM = 5
FILTER_BITS = 1 << 23
SLICE_BYTES = 4 << 20


def winnow(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of a list of word hashes: their values and the first and
    last start of the windows each was kept for."""
    if len(hashes) < SPAN:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    grams = common.gram_hashes(hashes, GRAM)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    kept = (common.window_min(key, SPAN - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, kept[1:] != kept[:-1]))
    return grams[kept[first]], first, np.append(first[1:], len(kept)) - 1


def short_windows(hashes: np.ndarray, m: int) -> np.ndarray:
    """Hashes of runs of m < SPAN words, told apart from those of other lengths."""
    return common.mix(common.gram_hashes(hashes, m) + np.uint64(m))


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``item_id, m, f, w``: window hashes and the fingerprint kept for each."""
    cache = common.WordHashes()
    for batch in batches:
        for part in common.slices(batch, "text", SLICE_BYTES):
            for item, text in zip(part.column("item_id").to_pylist(), part.column("text")):
                hashes = cache.of(common.words_of(text.as_py()))
                m = min(SPAN, len(hashes))
                if not m:
                    continue
                if m < SPAN:
                    f = w = short_windows(hashes, m)
                else:
                    kept, a, b = winnow(hashes)
                    f, w = np.repeat(kept, b - a + 1), common.gram_hashes(hashes, SPAN)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(w)), pa.array(np.full(len(w), m, np.int32)),
                     pa.array(f.view(np.int64)), pa.array(w.view(np.int64))],
                    ["item_id", "m", "f", "w"])


_KEPT = pa.list_(pa.struct([("f", pa.int64()), ("m", pa.int32()), ("at", pa.int32()),
                            ("w", pa.list_(pa.int64()))]))
_KEPT_DDL = "array<struct<f: long, m: int, at: int, w: array<long>>>"


def _scan(bits: bytes, short: list[int]):
    """Word count of every row and its fingerprints that pass the bitmap, each
    with the hashes of the windows it was kept for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        cache = common.WordHashes()

        def passing(f: np.ndarray) -> np.ndarray:
            return np.flatnonzero(known[(f & np.uint64(FILTER_BITS - 1)).astype(np.int64)])

        def hits(hashes: np.ndarray) -> list[dict]:
            out = []
            f, a, b = winnow(hashes)
            at = passing(f)
            if len(at):
                w = common.gram_hashes(hashes, SPAN).view(np.int64)
                out += [{"f": int(f[i].view(np.int64)), "m": SPAN, "at": int(a[i]),
                         "w": w[a[i]:b[i] + 1].tolist()} for i in at]
            for m in short:
                f = short_windows(hashes, m)
                out += [{"f": int(f[i].view(np.int64)), "m": m, "at": int(i),
                         "w": [int(f[i].view(np.int64))]} for i in passing(f)]
            return out

        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                counts, found = [], []
                for t in part.column("text"):
                    hashes = cache.of(common.words_of(t.as_py()))
                    counts.append(len(hashes))
                    found.append(hits(hashes))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(counts, pa.int64()),
                     pa.array(found, _KEPT)], ["doc_id", "row", "n_words", "kept"])
    return run


def _bitmap(fingerprints: DataFrame) -> bytes:
    """FILTER_BITS bits, set at the fingerprints; put together by Spark."""
    place = F.pmod(F.col("f"), F.lit(FILTER_BITS)) + 1  # bitmaps count from 1
    parts = fingerprints.select(place.alias("p")) \
        .groupBy(F.bitmap_bucket_number("p").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in parts:
        at = (r.bucket - 1) * len(r.bits)
        out[at:at + len(r.bits)] = r.bits
    return bytes(out)


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words inside any of a row's windows."""
    for batch in batches:
        out = []
        for spans in batch.column("spans"):
            s = np.array([(x["at"], x["m"]) for x in spans.as_py()], np.int64)
            a, b = common.spans_union(s[:, 0], s[:, 0] + s[:, 1])
            out.append(int((b - a).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.int64())],
                                         ["row", "n_hit"])


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document: ``doc_id, n_words, n_hit, item_ids`` (sorted strings)."""
    items = common.staged(
        benchmark.select(F.col(item_id).cast("string").alias("item_id"),
                         F.col(item_text).alias("text"))
        .where("item_id is not null")
        .mapInArrow(_item_rows, "item_id string, m int, f long, w long").distinct())
    fingerprints = items.select("f").distinct()
    short = [r.m for r in items.where(F.col("m") < SPAN).select("m").distinct().collect()]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    schema = rows.drop("text").schema.add("n_words", "long").add(
        "kept", rows.sparkSession.createDataFrame([], f"kept {_KEPT_DDL}").schema[0].dataType)
    # written once: the row numbers hold from here on
    seen = common.staged(rows.mapInArrow(_scan(_bitmap(fingerprints), sorted(short)), schema))

    kept = seen.where(F.size("kept") > 0).select("row", F.explode("kept").alias("k")) \
        .select("row", "k.*").join(fingerprints, "f", "left_semi")
    windows = kept.select("row", "m", F.posexplode("w").alias("i", "w"), "at") \
        .select("row", "m", (F.col("at") + F.col("i")).alias("at"), "w")
    hits = common.staged(windows.join(items.select("m", "w").distinct(), ["m", "w"], "left_semi"))
    covered = hits.groupBy("row").agg(F.collect_set(F.struct("at", "m")).alias("spans")) \
        .mapInArrow(_covered, "row long, n_hit long")
    named = hits.select("row", "m", "w").distinct() \
        .join(items.select("m", "w", "item_id").distinct(), ["m", "w"]) \
        .select("row", "item_id").distinct() \
        .groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    none = F.array().cast("array<string>")
    return seen.select("doc_id", "row", "n_words").join(covered, "row", "left") \
        .join(named, "row", "left") \
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                F.coalesce("item_ids", none).alias("item_ids"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


# Words and windows are compared as strings, every document window of each
# length that occurs with every item window.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS m,
               unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT DISTINCT doc_id, i, m, item_id FROM dw JOIN bw USING (m, k)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit))
  GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go. Rows are judged by
    their texts: an id that is null, or that other texts have too, takes no clean
    row along."""
    def known_by(text: Column) -> Column:
        return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))

    hit = find(docs.select(known_by(F.col("text")).alias("known_by"), "text"),
               common.table(spark, sf_dir, "benchmark"), doc_id="known_by") \
        .where("n_hit > 0").select("doc_id").distinct()
    return docs.join(hit, known_by(docs["text"]) == hit["doc_id"], "left_anti")
