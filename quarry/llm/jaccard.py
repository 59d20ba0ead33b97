"""Near duplicates by a chosen-path Jaccard join of word shingles.

A document is the set of its 5-word shingles (words: see ``common``; a text of
fewer words is one shingle). Documents with equal sets are one class. Classes
are joined at Jaccard >= 0.8:

* Each class has a signature of ``SIGNATURE`` sampled tokens (minimum hashes of
  its shingles). A run starts with all classes in one node. A node picks two of
  the signature's places by hashing its own path and sends each class to the
  two children named by the tokens it has there, so similar sets keep meeting.
* A node of at most ``BUCKET`` classes is compared by brute force; so is one
  that keeps ``DENSE`` of its parent's classes, since splitting cannot part
  classes that are alike, and one of at most ``BLOCKS`` blocks that keeps half
  of them: with two children of over half their size each, splitting it makes
  more rows than its pairs of blocks. Every other node is split again, however
  deep.
* A pair of similarity s survives a run of any depth with probability over
  0.94 at s = 0.8 (q = 1 - (1 - s q)^2); ``RUNS`` = 4 independent runs leave
  about 1e-5 of such pairs, fewer above.

Brute force first compares signatures, then the exact sets of what is left. A
pair that meets in several nodes belongs to the one with the smallest path. A
node of more than ``BLOCK`` classes is dealt out as pairs of blocks, so that a
group of near copies of any size is spread over tasks, and rows are written per
class and block, never per pair. Linked classes form groups (connected
components over local spanning stars).

``join`` returns a row per input row: ``doc_id``, ``class_id`` (smallest doc_id
of its group), ``copy_id`` (smallest doc_id with an equal set) and ``n_links``
(other rows at Jaccard >= 0.8, equal sets included). Texts without words (null,
empty) link to nothing and are their own class. A null id gives a null class
and takes no part. Rows repeated under one id count as copies; different texts
under one id share a group. No other column is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import session
from quarry.llm import common
from quarry.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
SIGNATURE = 64
RUNS = 4
BUCKET = 512
DENSE = 0.8
BLOCK = 512
BLOCKS = 8
# Signatures of a pair at the threshold agree in 51 of 64 places on average,
# with a deviation of 3.2; 5 deviations below lose about one pair in 3 million.
AGREE = 35
SLICE_BYTES = 4 << 20

_draw = np.random.RandomState(20240229)
_A = _draw.randint(1, 2 ** 63 - 1, SIGNATURE, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_B = _draw.randint(1, 2 ** 63 - 1, SIGNATURE, dtype=np.int64).astype(np.uint64)


def shingle_set(text: str | None, cache: common.WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; none for a text without words."""
    hashes = cache.of(common.words_of(text))
    if not len(hashes):
        return hashes
    return np.unique(common.gram_hashes(hashes, min(SHINGLE, len(hashes))))


def set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2 ** 63


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum hashes, 32 bits each; worked out piece by piece for long sets."""
    low = np.full(SIGNATURE, 2 ** 64 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[i:i + 4096, None] * _A + _B).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = common.WordHashes()
    for batch in batches:
        for part in common.slices(batch, "text", SLICE_BYTES):
            keys, marks = [], []
            for t in part.column("text"):
                s = shingle_set(t.as_py(), cache)
                keys.append(set_key(s) if len(s) else None)
                marks.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("h"), pa.array(keys, pa.int64()),
                 pa.array(marks, pa.list_(pa.int32()))], ["id", "h", "cls", "sig"])


def _leaves(classes: DataFrame, n_classes: int) -> DataFrame:
    """``cls, path, size`` of every node that is compared by brute force."""
    def children(path: F.Column) -> list[F.Column]:
        first = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(SIGNATURE))
        step = F.pmod(F.xxhash64(path, F.lit(2)), F.lit(SIGNATURE - 1)) + 1
        second = F.pmod(first + step, F.lit(SIGNATURE))
        return [F.xxhash64(path, at, F.get("sig", at.cast("int"))) for at in (first, second)]

    roots = [F.xxhash64(F.lit("run"), F.lit(r)) for r in range(RUNS)]
    rows = classes.select("cls", F.explode(F.array(*(c for r in roots for c in children(r))))
                          .alias("path"), F.lit(n_classes).cast("long").alias("parent"))
    kept = F.col("size") / F.col("parent")
    half = (kept >= 0.5) & (F.col("size") <= BLOCKS * BLOCK)
    found, split = [], (F.col("size") > BUCKET) & (kept < DENSE) & ~half
    while True:
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        level, more = session.cut_lineage_counting(
            rows.join(sizes, "path").select("cls", "path", "size", split.alias("split")), "split")
        found.append(level)
        if not more:
            break
        rows = level.where("split").join(classes.select("cls", "sig"), "cls") \
            .select("cls", F.explode(F.array(*children(F.col("path")))).alias("path"),
                    F.col("size").alias("parent"))
    leaves = found[0]
    for level in found[1:]:
        leaves = leaves.union(level)
    return leaves.where("not split").select("cls", "path", "size")


def _units(rows: DataFrame) -> DataFrame:
    """Deal a node's classes out as one unit, or as pairs of blocks."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks) \
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("unit", F.xxhash64("path", F.least("block", "other"),
                                              F.greatest("block", "other"))) \
        .withColumn("same", F.col("block") == F.col("other")) \
        .drop("blocks", "other", "size")


def _by_unit(work: Callable, schema: pa.Schema) -> Callable:
    """Run ``work(table)`` for runs of rows of one unit (or several small ones
    together) as they stream in, sorted by unit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool):
            nonlocal held, rows
            whole = pa.Table.from_batches(held).combine_chunks()
            units = whole.column("unit").to_numpy()
            cut = len(units) if last else int(np.searchsorted(units, units[-1]))
            held = [] if cut == len(units) else whole.slice(cut).to_batches()
            rows = len(units) - cut
            if cut:
                yield from work(whole.slice(0, cut)).to_batches()

        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                held.append(batch.slice(i, 2048))
                rows += held[-1].num_rows
                if rows >= 2048:
                    yield from flush(False)
        if held:
            yield from flush(True)
        common.release_memory()
    return run


def _groups(units: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.append(True, units[1:] != units[:-1])).tolist()
    yield from zip(cuts, [*cuts[1:], len(units)])


def _met_before(less: list[list[int]]) -> np.ndarray:
    """Pairs that already share a smaller path than the node's own."""
    n = len(less)
    known = sorted({p for v in less for p in v})
    if not known:
        return np.zeros((n, n), bool)
    place = {p: i for i, p in enumerate(known)}
    has = np.zeros((n, len(known)), np.float32)
    for i, v in enumerate(less):
        has[i, [place[p] for p in v]] = 1
    return has @ has.T > 0


def _mine(less: list[list[int]], block: np.ndarray, same: bool) -> np.ndarray:
    """Pairs (i, j) that this unit has to compare, each in both orders."""
    mine = ~_met_before(less)
    if not same:
        mine &= block[:, None] != block[None, :]
    np.fill_diagonal(mine, False)
    return mine


_CANDIDATES = pa.schema([("unit", pa.int64()), ("cls", pa.int64()), ("block", pa.int32()),
                         ("same", pa.bool_()), ("less", pa.list_(pa.int64()))])


def _alike(rows: pa.Table) -> pa.Table:
    """Rows whose signature is like another's in the unit."""
    units = rows.column("unit").to_numpy()
    sig = np.asarray(rows.column("sig").combine_chunks().flatten()).reshape(-1, SIGNATURE)
    less = rows.column("less").to_pylist()
    block = rows.column("block").to_numpy()
    same = rows.column("same").to_numpy()
    keep: list[int] = []
    for a, b in _groups(units):
        s = sig[a:b]
        agree = np.empty((b - a, b - a), bool)
        for i in range(b - a):
            agree[i] = (s[i] == s).sum(axis=1) >= AGREE
        np.fill_diagonal(agree, False)
        if agree.any():
            agree &= _mine(less[a:b], block[a:b], bool(same[a]))
            keep.extend((a + np.flatnonzero(agree.any(axis=1))).tolist())
    return rows.select(_CANDIDATES.names).take(pa.array(keep, pa.int64())).cast(_CANDIDATES)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by counting columns in pieces."""
    n = len(sets)
    which = np.repeat(np.arange(n), [len(s) for s in sets])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    shared = np.bincount(column)[column] > 1
    which, column = which[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    which, column = which[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = max(64, (1 << 20) // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, width), np.float32)
        m[which[i:j], column[i:j] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id (of a class) of each row's component of links inside a unit."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == low).all():
            return low
        low = new


_LINKS = pa.schema([("cls", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])


def _verify(rows: pa.Table) -> pa.Table:
    """Exact Jaccard of a unit's pairs: links per class and a spanning star."""
    units = rows.column("unit").to_numpy()
    cls = rows.column("cls").to_numpy()
    weight = rows.column("n").to_numpy()
    less, texts = rows.column("less").to_pylist(), rows.column("text")
    block, same = rows.column("block").to_numpy(), rows.column("same").to_numpy()
    cache, out = common.WordHashes(), []
    for a, b in _groups(units):
        # a representative's id may name several rows: take the one with the set
        sets = {}
        for i in range(a, b):
            s = shingle_set(texts[i].as_py(), cache)
            if len(s) and set_key(s) == cls[i]:
                sets.setdefault(cls[i], (i, s))
        if len(sets) < 2:
            continue
        at = np.array([i for i, _ in sets.values()])
        own = [s for _, s in sets.values()]
        size = np.array([len(s) for s in own])
        both = _overlaps(own)
        union = size[:, None] + size[None, :] - both
        linked = both * 5 >= union * 4 if THRESHOLD == 0.8 else both >= union * THRESHOLD
        linked &= _mine([less[i] for i in at], block[at], bool(same[a]))
        some = np.flatnonzero(linked.any(axis=1))
        if len(some):
            n = (linked * weight[at][None, :]).sum(axis=1)
            root = _roots(linked, cls[at])
            out.append((cls[at][some], root[some], n[some]))
    columns = zip(*out) if out else [[np.empty(0, np.int64)]] * 3
    return pa.Table.from_arrays([pa.array(np.concatenate(list(c))) for c in columns],
                                schema=_LINKS)


def _in_units(rows: DataFrame) -> DataFrame:
    """Bring each unit's rows together, in order; the number of partitions is
    kept, as a unit's work is far larger than its bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "unit").sortWithinPartitions("unit")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, h, cls`` of the rows of ``id, text`` (h is the text's hash, cls is
    null without words), and each class with its group. A class is known by its
    set, as an id may name several rows: ``rep`` is its smallest id, ``lead`` the
    smallest id of its group and the class that has it."""
    rows = common.staged(docs.where("id is not null")
                         .select("id", F.xxhash64("text").alias("h"), "text")
                         .mapInArrow(_sets, "id long, h long, cls long, sig array<int>"))
    classes, n_classes = session.cut_lineage_counting(
        rows.where("cls is not null").groupBy("cls").agg(
            F.min("id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig")),
        F.lit(True))

    leaves = _leaves(classes, n_classes)
    paths = leaves.groupBy("cls").agg(F.collect_list(F.struct("path", "size")).alias("at"))
    less = F.transform(F.filter("at", lambda x: x.path < F.col("leaf.path")), lambda x: x.path)
    nodes = classes.join(paths, "cls").withColumn("leaf", F.explode("at")) \
        .select("cls", "sig", less.alias("less"), "leaf.path", "leaf.size")
    alike = common.staged(_in_units(_units(nodes)).mapInArrow(
        _by_unit(_alike, _CANDIDATES),
        "unit long, cls long, block int, same boolean, less array<long>"))

    reps = alike.join(classes.drop("sig"), "cls")
    found = reps.join(docs, reps.rep == docs.id).drop("id")
    links = common.staged(_in_units(found).mapInArrow(
        _by_unit(_verify, _LINKS), "cls long, root long, n long"))

    groups = connected_components(links.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    lead = groups.join(classes, F.col("node") == F.col("cls")).groupBy("component") \
        .agg(F.min(F.struct("rep", "cls")).alias("first"))
    per_class = classes.select("cls", "rep", F.col("n").alias("copies")) \
        .join(links.groupBy("cls").agg(F.sum("n").alias("links")), "cls", "left") \
        .join(groups.join(lead, "component"), F.col("cls") == F.col("node"), "left") \
        .select("cls", "rep", F.coalesce("first", F.struct("rep", "cls")).alias("lead"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.drop("sig"), per_class


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """See the module's text."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows, classes = _classes(docs)
    per_class = classes.select("cls", F.col("lead.rep").alias("class_id"),
                               F.col("rep").alias("copy_id"), "n_links")
    own = F.when(F.col("cls").isNull(), F.col("id"))
    known = rows.select("id", "cls").join(per_class, "cls", "left").select(
        F.col("id").alias("doc_id"), F.coalesce("class_id", own).alias("class_id"),
        F.coalesce("copy_id", own).alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    nameless = docs.where("id is null").select(
        F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("class_id"),
        F.lit(None).cast("long").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return known.union(nameless)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays (one of its
    rows, if the id is repeated with texts of the group); null ids all stay, and
    so do unlike texts under one id."""
    rows, classes = _classes(docs.select(F.col("doc_id").cast("long").alias("id"), "text"))
    first = classes.where("cls = lead.cls").select("cls", F.col("rep").alias("id"))
    leaders = rows.join(first, ["cls", "id"]).groupBy("cls", "id").agg(F.min("h").alias("h")) \
        .select("id", "h").union(rows.where("cls is null").select("id", "h").distinct())
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_h": F.xxhash64("text")})
    kept = keyed.join(leaders, (keyed["_id"] == leaders["id"]) & (keyed["_h"] == leaders["h"]),
                      "left_semi").dropDuplicates(["_id", "_h"]).drop("_id", "_h")
    return kept.unionByName(docs.where("doc_id is null"))
