"""SimHash near duplicates by bit-sliced comparison.

A text's fingerprint has bit b set if over half of the hashes of its 3-word
shingles (repeats included) have it; fingerprints link at ``RADIUS`` or fewer
differing bits, and linked documents form components.

1. *Fingerprints.* A task emits a row per distinct fingerprint of a batch with
   the ids that have it, so a fingerprint of a third of all rows arrives as a
   few rows. From there on only distinct fingerprints are compared.
2. *Buckets.* Two fingerprints within the radius agree in all bits of at least
   one of ``RADIUS + 1`` parts of the bits, so each goes to one bucket per part,
   named by its bits there. A bucket of more than ``BUCKET`` fingerprints is
   split by the same argument over the bits its name doesn't fix, and so on:
   every level fixes a third of what is left, and after ``LEVELS`` of them a
   bucket can't hold more than ``BUCKET`` distinct values. No pair is lost, and
   no bucket has to be dealt out pair by pair.
3. *Bit-sliced comparison.* The fingerprints of many buckets are stored as 64
   vertical bit planes, 64 fingerprints to a word, a bucket never sharing a word
   with another unless it fits in whole. A fingerprint is compared with a word of
   64 others at once: each plane is xored with the fingerprint's own bit and
   added into two carry-save counters per lane; lanes past the radius are marked
   over, and after every ``STEP`` planes words whose lanes are all over are
   abandoned.
4. *Components.* A bucket sends one link per fingerprint (to the smallest of its
   component there); the links' connected components are found by star
   contraction and joined back to the ids.

Results: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the
smallest id reachable, itself included) for every row. A text that is null,
empty or white space has fingerprint zero and links like any other. Rows that
repeat an id keep their rows. A null id has its fingerprint and the smallest id
of its component (null if there is none). Texts are used whole, in pieces of
bounded memory, and no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import session
from quarry.llm import common
from quarry.llm.components import connected_components

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 2
BUCKET = 1024
STEP = 8
SLICE_BYTES = 2 << 20
PIECE = 1 << 15      # shingles whose bits are counted at a time
POOL = 4096          # fingerprints whose planes are held at a time
WORK = 1 << 16       # comparisons of one fingerprint with one word at a time

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONES = np.uint64(2 ** 64 - 1)


def fingerprint(text: str | None) -> int:
    words = common.encode(text).translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = min(SHINGLE, len(words))
    starts = np.append(0, ends[:-1] + 1)[:len(words) - n + 1].tolist()
    ends = ends[n - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(starts), PIECE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[i:i + PIECE],
                                                              ends[i:i + PIECE])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = []
        for part in common.slices(batch, "text", SLICE_BYTES):
            prints += [fingerprint(t.as_py()) for t in part.column("text")]
        prints = np.array(prints, np.uint64).view(np.int64)
        order = np.argsort(prints, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(prints[order]) != 0))[:len(order)]
        ids = pa.ListArray.from_arrays(
            pa.array(np.append(first, len(order)), pa.int32()), batch.column("id").take(order))
        yield pa.RecordBatch.from_arrays([pa.array(prints[order][first]), ids], ["fp", "ids"])


def _deal(bits: list[int]) -> list[list[int]]:
    """The bits in RADIUS + 1 parts, as even as can be."""
    n = RADIUS + 1
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _levels() -> list[list[int]]:
    """Masks by level: entry ``kind * (RADIUS + 1) + part`` are the bits that a
    bucket's child fixes further. The last level's buckets can't be too large."""
    free, out = [list(range(BITS))], []
    while 2 ** max(map(len, free)) > BUCKET:
        parts = [p for bits in free for p in _deal(bits)]
        out.append([sum(1 << b for b in p) - (1 << 64 if 63 in p else 0) for p in parts])
        free = [[b for b in bits if b not in p] for bits in free for p in _deal(bits)]
    return out


LEVELS = _levels()


def _buckets(prints: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``fp, path`` rows of every bucket that is compared, and the tables that
    they are read from."""
    def children(level: int, kind: Column, path: Column) -> Column:
        masks = F.array(*map(F.lit, LEVELS[level]))
        parts = [kind * (RADIUS + 1) + p for p in range(RADIUS + 1)]
        return F.explode(F.array(*(F.struct(
            k.alias("kind"), F.xxhash64(path, k, F.col("fp").bitwiseAND(F.get(masks, k)))
            .alias("path")) for k in parts)))

    rows = prints.select("fp", children(0, F.lit(0), F.lit(0)).alias("c")).select("fp", "c.*")
    found, tables = [], []
    for level in range(len(LEVELS)):
        rows = common.staged(rows)
        found.append(rows.select("fp", "path"))
        tables.append(rows)
        if level + 1 == len(LEVELS):
            break
        # only the names of large buckets are joined: at most 3 / BUCKET of the rows
        large, n = session.cut_lineage_counting(
            rows.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET)
            .select("path"), F.lit(True))
        tables.append(large)
        if not n:
            break
        found[-1] = rows.join(large, "path", "left_anti").select("fp", "path")
        rows = rows.join(large, "path", "left_semi") \
            .select("fp", children(level + 1, F.col("kind"), F.col("path")).alias("c")) \
            .select("fp", "c.*")
    out = found[0]
    for level in found[1:]:
        out = out.union(level)
    return out, tables


def _lanes(sizes: np.ndarray) -> np.ndarray:
    """First lane of each bucket: one that fits into what is left of a word goes
    there, any other starts a word."""
    out, at = [], 0
    for n in sizes.tolist():
        if at % 64 + n > 64 and at % 64:
            at += 64 - at % 64
        out.append(at)
        at += n
    return np.array(out, np.int64)


def _linked(prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (i > j) of linked fingerprints; ``sizes`` are those of the
    buckets, in which the fingerprints come one after another."""
    first = np.cumsum(sizes) - sizes
    begin = _lanes(sizes)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    lane = begin[bucket] + np.arange(len(prints)) - first[bucket]
    n_words = int(lane[-1]) // 64 + 1
    value, filled = np.zeros(n_words * 64, np.uint64), np.zeros(n_words * 64, np.uint8)
    value[lane], filled[lane] = prints, 1
    place = np.zeros(n_words * 64, np.int64)
    place[lane] = np.arange(len(prints))
    planes = np.empty((BITS, n_words), np.uint64)
    for b in range(BITS):
        bit = ((value >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        planes[b] = np.packbits(bit, bitorder="little").view(np.uint64)
    empty = ~np.packbits(filled, bitorder="little").view(np.uint64)

    # a fingerprint meets the words of its bucket up to its own
    here, start = lane // 64, begin[bucket] // 64
    reps = here - start + 1
    last = np.cumsum(reps)
    found_i, found_j = [], []
    row = 0
    while row < len(prints):
        stop = max(row + 1, int(np.searchsorted(last, (last[row - 1] if row else 0) + WORK)))
        r = np.repeat(np.arange(row, stop), reps[row:stop])
        base = last[row:stop] - reps[row:stop]
        word = start[r] + np.arange(len(r)) + base[0] - np.repeat(base, reps[row:stop])
        row = stop
        # lanes before the bucket, from the fingerprint's own on, and unused ones are over
        low = np.clip(begin[bucket[r]] - word * 64, 0, 63).astype(np.uint64)
        high = np.clip(lane[r] - word * 64, 0, 64)
        over = empty[word] | ((np.uint64(1) << low) - np.uint64(1))
        over |= np.where(high < 64, _ONES << np.minimum(high, 63).astype(np.uint64), np.uint64(0))
        one, two = np.zeros(len(r), np.uint64), np.zeros(len(r), np.uint64)
        for b in range(BITS):
            if b % STEP == 0:
                left = np.flatnonzero(over != _ONES)
                if not len(left):
                    break
                if len(left) < len(over):
                    r, word, over, one, two = (x[left] for x in (r, word, over, one, two))
            own = np.uint64(0) - ((prints[r] >> np.uint64(b)) & np.uint64(1))
            differ = planes[b][word] ^ own
            carry = one & differ
            one ^= differ
            over |= two & carry
            two ^= carry
            over |= one & two  # three
        left = np.flatnonzero(over != _ONES)
        if len(left):
            near = np.unpackbits((~over[left]).view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little")
            e, k = np.nonzero(near)
            found_i.append(r[left[e]])
            found_j.append(place[word[left[e]] * 64 + k])
    if not found_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place of each place's component."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (fingerprint, smallest of its component in the bucket); rows arrive
    ordered by bucket, and whole buckets are held until there are ``POOL`` rows."""
    def settle(path: np.ndarray, prints: np.ndarray):
        cuts = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        sizes = np.diff(np.append(cuts, len(path)))
        many = sizes > 1
        prints, sizes = prints[np.repeat(many, sizes)], sizes[many]
        if not len(prints):
            return None
        root = _roots(len(prints), *_linked(prints.view(np.uint64), sizes))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays(
            [pa.array(prints[linked]), pa.array(prints[root[linked]])], ["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for at in range(0, batch.num_rows, POOL):
            part = batch.slice(at, POOL)
            held.append((part.column("path").to_numpy(), part.column("fp").to_numpy()))
            if sum(len(p) for p, _ in held) < POOL:
                continue
            path, prints = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(path, path[-1]))  # the last bucket may go on
            held = [(path[cut:], prints[cut:])]
            if cut and (links := settle(path[:cut], prints[:cut])) is not None:
                yield links
    if held:
        path, prints = (np.concatenate(x) for x in zip(*held))
        if (links := settle(path, prints)) is not None:
            yield links
    common.release_memory()


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """See the module's text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"),
                       F.col(f"`{text}`").alias("text"))
    seen = common.staged(rows.mapInArrow(_fingerprints, "fp long, ids array<long>"))
    prints = common.staged(seen.groupBy("fp").agg(F.min(F.array_min("ids")).alias("least")))
    rows, tables = _buckets(prints)
    groups = connected_components(rows.repartition(parts, "path").sortWithinPartitions("path")
                                  .mapInArrow(_compare, "u long, v long"))
    for table in tables:  # the groups are a table of their own
        common.drop_staged(table)
    lead = groups.join(prints, F.col("node") == F.col("fp")) \
        .groupBy("component").agg(F.min("least").alias("first"))
    named = groups.join(lead, "component").select(F.col("node").alias("fp"), "first")
    known = prints.join(named, "fp", "left").select(
        "fp", F.coalesce("first", "least").alias("component_id"))
    return seen.join(known, "fp").select(
        F.explode("ids").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"))
