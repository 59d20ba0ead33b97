"""Exact removal of byte strings that repeat across documents, by column-wise
construction of sorted suffixes and common prefixes.

Every byte of a document that lies in a ``LENGTH``-byte string which also starts
in a document with a smaller id is removed; strings are judged on the input and
never cross documents.

1. Each ``LENGTH``-byte string is named by its smallest hashed ``GRAM``-byte
   gram (the leftmost, if it occurs again). Neighbouring strings with the same
   gram form one segment, so equal strings always get to the same bucket, at
   the same distance from the same gram. Copies of a segment inside a batch are
   settled there, so a passage of any number of copies is sent once per batch.
2. In a bucket the segments are the collection, aligned at their grams. From
   the last column to the first, each round puts the next symbol of every
   segment in front of its suffix: the order of the suffixes that start in a
   column is the stable sort of that column's symbols in the order of the
   column after it, and the common prefix of two neighbours is one more than
   the least of the common prefixes between their former places. As equal
   strings stand in the same column, the part of the collection's transform
   that belongs to one column is all that a round needs; the columns follow one
   another like sequential files and only the last one is kept. Neighbours with
   a common prefix of ``LENGTH`` are repeats; the smallest id of such an
   interval keeps its bytes.
3. Spans are gathered per document and cut out of the text. They travel in
   bulk: a task sends the spans of all its documents in one row per target.

A bucket is processed in one task; the number of buckets follows the bytes of
the input. Rows: a null or empty text has no bytes. A null id stands after all
others and removes nothing. Rows that repeat an id never remove each other's
bytes. Texts are used whole, and no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

LENGTH = 50
GRAM = 12
LEFT = LENGTH - GRAM          # most bytes of a segment before its gram
WIDTH = LEFT + LENGTH         # columns of an aligned segment
WORDS = -(-WIDTH // 8)
SLICE_BYTES = 3 << 20
PIECE = 1 << 17               # strings of a text that are named at a time
LEVEL = 6                    # of compression, for what is shuffled
BUCKET_BYTES = 24 << 20
# Segments overlap: they hold nearly four times the bytes of the text.
OVERLAP = 4

_TABLE = np.random.RandomState(50).randint(1, 2 ** 63 - 1, 256, dtype=np.int64).astype(np.uint64)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte grams, put together from powers of two."""
    power, length, n = _TABLE[data], 1, len(data) - GRAM + 1
    out, have = np.zeros(n, np.uint64), 0
    while True:
        if GRAM & length:
            out = out * np.uint64(pow(int(common.ROLL), length, 2 ** 64)) + power[have:have + n]
            have += length
        if have == GRAM:
            return common.mix(out)
        power = power[:-length] * np.uint64(pow(int(common.ROLL), length, 2 ** 64)) + \
            power[length:]
        length *= 2


def _align(data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One row per segment, its gram at column LEFT, zeros outside; 8 * WORDS wide."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    out = np.zeros((len(at), 8 * WORDS), np.uint8)
    out[:, :WIDTH] = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    column = np.arange(8 * WORDS) - LEFT
    out *= column >= -left[:, None].astype(np.int64)
    out *= column < right[:, None]
    return out


def _row_hashes(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    words, h = rows.view(np.uint64), left.astype(np.uint64) * np.uint64(256) + right.astype(np.uint64)
    for k in range(WORDS):
        h = common.mix(h * common.ROLL + words[:, k])
    return h


def _equal_to_previous(rows, left, right, order) -> np.ndarray:
    """For each place of an order but the first: is it the segment before it?"""
    words = rows.view(np.uint64)
    same = (left[order[1:]] == left[order[:-1]]) & (right[order[1:]] == right[order[:-1]])
    at = np.flatnonzero(same)
    at = at[words[order[at + 1], LEFT // 8 + 1] == words[order[at], LEFT // 8 + 1]]
    equal = np.zeros(len(order) - 1, bool)
    equal[at] = (words[order[at + 1]] == words[order[at]]).all(axis=1)
    return equal


def segments(texts: list[bytes]):
    """Segments of a list of texts: the bytes laid end to end, where each gram
    stands, bytes before and from it, the text each belongs to, bucket hashes."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - np.array([len(t) for t in texts], np.int64)
    low, found = np.uint64(0xFFFFFFFF), [[np.empty(0, np.int64)] * 4]
    n = len(data) - LENGTH + 1
    for i in range(0, n, PIECE):  # strings in pieces, to bound the memory
        begin = np.arange(i, min(i + PIECE, n))
        whole = begin + LENGTH <= ends[np.searchsorted(ends, begin, "right")]
        if not whole.any():
            continue
        hashes = _gram_hashes(data[i:begin[-1] + LENGTH])
        key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        gram = (common.window_min(key, LEFT + 1)[whole] & low).astype(np.int64)
        begin = begin[whole]
        new = np.append(True, (gram[1:] != gram[:-1]) | (begin[1:] != begin[:-1] + 1))
        first = np.flatnonzero(new)
        at = gram[first]
        found.append([begin[first], begin[np.append(first[1:], len(begin)) - 1], i + at,
                      (hashes[at] & low).astype(np.int64)])
    begin, last, at, code = (np.concatenate(x) for x in zip(*found))
    # a segment that goes on in the next piece is one
    new = np.append(True, (at[1:] != at[:-1]) | (begin[1:] != last[:-1] + 1))[:len(at)]
    last = last[np.append(new[1:], True)[:len(at)]]
    begin, at, code = begin[new], at[new], code[new]
    owner = np.searchsorted(ends, begin, "right")
    return data, starts, at, at - begin, last + LENGTH - at, owner, code.astype(np.uint64)


_SENT = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("hashes", pa.binary()),
                   ("bytes", pa.binary()), ("shape", pa.binary()), ("n_at", pa.binary()),
                   ("at", pa.binary()), ("marks", pa.binary())])
_SENT_DDL = ("bucket int, ids binary, hashes binary, bytes binary, shape binary, "
             "n_at binary, at binary, marks binary")


def _cut(n_buckets: int):
    """Rows of segments for the buckets; a row with ``marks`` has the spans of a
    batch's own copies instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                part = part.take(pc.sort_indices(part.column("id")))
                ids = part.column("id").to_numpy()
                own = part.column("h").to_numpy()
                texts = [common.encode(t.as_py()) for t in part.column("text")]
                data, starts, at, left, right, owner, code = segments(texts)
                if not len(at):
                    continue
                rows = _align(data, at, left, right)
                bucket = (code % np.uint64(n_buckets)).astype(np.int64)
                place = at - left - starts[owner]
                # equal segments next to each other, smaller ids first
                h = _row_hashes(rows, left, right)
                order = np.argsort(h, kind="stable")
                new = np.append(True, ~_equal_to_previous(rows, left, right, order))
                group = np.cumsum(new) - 1
                lead = order[new]
                copy = ids[owner[order]] > ids[owner[lead]][group]
                if copy.any():
                    c = order[copy]
                    yield _marks_batch(ids[owner[c]], own[owner[c]], place[c],
                                       place[c] + left[c] + right[c], n_buckets)
                # occurrences in the leading document, in the order of the text
                held, group = order[~copy], group[~copy]
                rank = np.empty(len(lead), np.int64)
                rank[np.lexsort((lead, bucket[lead]))] = np.arange(len(lead))
                sort = np.lexsort((held, rank[group]))
                held, seg = held[sort], rank[group][sort]
                lead = lead[np.argsort(rank)]
                count = np.bincount(seg, minlength=len(lead))
                cuts = np.flatnonzero(np.append(True, bucket[lead][1:] != bucket[lead][:-1]))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lead)]):
                    s = lead[a:b]
                    i, j = np.searchsorted(seg, [a, b])
                    known, who = np.unique(owner[held[i:j]], return_inverse=True)
                    shape = np.stack([left[s], right[s]]).astype(np.uint8)
                    column = np.arange(8 * WORDS) - LEFT
                    inside = (column >= -left[s][:, None]) & (column < right[s][:, None])
                    where = np.stack([np.diff(who, prepend=0),
                                      np.diff(place[held[i:j]], prepend=0)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in (
                        (int(bucket[s[0]]), pa.int32()),
                        (pack(np.diff(ids[known], prepend=0).tobytes()), pa.binary()),
                        (own[known].tobytes(), pa.binary()),
                        (pack(rows[s][inside].tobytes()), pa.binary()),
                        (pack(shape.tobytes()), pa.binary()),
                        (pack(count[a:b].astype(np.uint32).tobytes()), pa.binary()),
                        (pack(where.tobytes()), pa.binary()), (None, pa.binary()))],
                        schema=_SENT)
    return run


def _by_row(ids, own, start, end):
    """Spans joined row by row: id, hash and packed spans of each row."""
    order = np.lexsort((start, own, ids))
    ids, own, start, end = ids[order], own[order], start[order], end[order]
    new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])))
    spans = []
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(ids)]):
        s, e = common.spans_union(start[a:b], end[a:b])
        spans.append(np.stack([s, e], axis=1).astype(np.uint32).tobytes())
    return ids[new], own[new], spans


def _marks_batch(ids, own, start, end, n_buckets: int) -> pa.RecordBatch:
    """All spans of a batch's own copies as one row."""
    ids, own, spans = _by_row(ids, own, start, end)
    count = np.array([len(s) // 8 for s in spans], np.uint32)
    return pa.RecordBatch.from_arrays(
        [pa.array([int(ids[0] % n_buckets)], pa.int32()), pa.array([ids.tobytes()]),
         pa.array([own.tobytes()]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
         pa.array([count.tobytes()]), pa.nulls(1, pa.binary()), pa.array([b"".join(spans)])],
        schema=_SENT)


def _unpack_marks(r: dict):
    count = np.frombuffer(r["n_at"], np.uint32)
    s = np.frombuffer(r["marks"], np.uint32).reshape(-1, 2).astype(np.int64)
    return (np.repeat(np.frombuffer(r["ids"], np.int64), count),
            np.repeat(np.frombuffer(r["hashes"], np.int32), count), s[:, 0], s[:, 1])


def repeats(rows: np.ndarray, left: np.ndarray, right: np.ndarray,
            owner: np.ndarray) -> np.ndarray:
    """For aligned segments: does the string that starts in a column before or
    at the gram (LEFT + 1 of them) also belong to a smaller owner?"""
    n = len(left)
    hit = np.zeros((n, LEFT + 1), bool)
    order, prefix = np.arange(n), np.zeros(n + 1, np.int16)
    for column in range(WIDTH - 1, -1, -1):
        offset = column - LEFT
        present = (offset >= -left.astype(np.int64)) & (offset < right)
        symbol = np.where(present, rows[:, column].astype(np.uint16) + 1, 0).astype(np.uint16)
        perm = np.argsort(symbol[order], kind="stable")
        moved = symbol[order[perm]]
        joined = np.flatnonzero((moved[1:] == moved[:-1]) & (moved[1:] > 0)) + 1
        between = np.stack([perm[joined - 1] + 1, perm[joined] + 1], axis=1).ravel()
        least = np.minimum.reduceat(prefix, between)[::2] if len(between) else prefix[:0]
        prefix = np.zeros(n + 1, np.int16)
        prefix[joined] = least + 1
        order = order[perm]
        if column <= LEFT:
            start = np.flatnonzero(prefix[:n] < LENGTH)
            low = np.minimum.reduceat(owner[order], start)
            low = np.repeat(low, np.diff(np.append(start, n)))
            hit[order, column] = low < owner[order]
    return hit


def _unpack(sent: list[dict]):
    """Segments and their occurrences from a bucket's rows."""
    unpack = zstandard.ZstdDecompressor().decompress
    parts = []
    for r in sent:
        shape = np.frombuffer(unpack(r["shape"]), np.uint8).reshape(2, -1).astype(np.int64)
        text = np.frombuffer(unpack(r["bytes"]), np.uint8)
        ends = np.cumsum(shape.sum(axis=0))
        rows = _align(text, ends - shape[1], shape[0], shape[1])
        count = np.frombuffer(unpack(r["n_at"]), np.uint32).astype(np.int64)
        who, place = np.cumsum(np.frombuffer(unpack(r["at"]), np.int32).reshape(2, -1), axis=1)
        ids = np.cumsum(np.frombuffer(unpack(r["ids"]), np.int64))[who]
        parts.append((rows, shape[0], shape[1], count, ids,
                      np.frombuffer(r["hashes"], np.int32)[who], place))
    return [np.concatenate(x) for x in zip(*parts)]


def _bucket_marks(sent: list[dict]):
    """Spans (id, hash, start, end) to remove from the rows of one bucket."""
    rows, left, right, count, ids, own, place = _unpack(sent)
    seg = np.repeat(np.arange(len(left)), count)
    first = np.cumsum(count) - count
    owner = ids[first]  # all occurrences of a sent segment have one id
    # only grams that more than one document has
    gram = _row_hashes(np.pad(rows[:, LEFT:LEFT + GRAM], ((0, 0), (0, 8 * WORDS - GRAM))),
                       np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64))
    order = np.argsort(gram)
    start = np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1]))
    low = np.minimum.reduceat(owner[order], start)
    shared = low < np.maximum.reduceat(owner[order], start)
    keep = np.sort(order[np.repeat(shared, np.diff(np.append(start, len(order))))])
    if not len(keep):
        return None
    rows, left, right, owner = rows[keep], left[keep], right[keep], owner[keep]
    # equal segments once, with the smallest owner
    order = np.argsort(_row_hashes(rows, left, right), kind="stable")
    new = np.append(True, ~_equal_to_previous(rows, left, right, order))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    lead = order[new]
    least = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(least, group, owner)
    hit = repeats(rows[lead], left[lead], right[lead], least)[group]
    column = np.arange(LEFT + 1) - LEFT
    hit |= ((owner > least[group])[:, None] & (column >= -left[:, None]) &
            (column + LENGTH <= right[:, None]))
    # runs of hit columns become spans of every occurrence
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    who, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1]
    number = np.full(len(count), -1)
    number[keep] = np.arange(len(keep))
    mine = number[seg]
    runs = np.bincount(who, minlength=len(keep))
    begin = np.cumsum(runs) - runs
    occ = np.flatnonzero((mine >= 0) & (runs[mine] > 0))
    reps = runs[mine[occ]]
    if not len(occ):
        return None
    each = np.repeat(occ, reps)
    run = np.repeat(begin[mine[occ]], reps) + np.arange(reps.sum()) - \
        np.repeat(np.cumsum(reps) - reps, reps)
    base = place[each] + left[mine[each]] - LEFT
    return ids[each], own[each], base + a[run], base + b[run] - 1 + LENGTH


_BULK = pa.schema([("target", pa.int32()), ("ids", pa.binary()), ("hashes", pa.binary()),
                   ("spans", pa.binary())])
_MARKS = pa.schema([("id", pa.int64()), ("h", pa.int32()), ("spans", pa.binary())])
HELD_SPANS = 1_000_000


def _reduce(n_targets: int):
    """Buckets arrive in order; one is held at a time. The spans found are sent
    to their documents' targets, many documents to a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        found: list[tuple] = []

        def send():
            ids, own, start, end = (np.concatenate(x) for x in zip(*found))
            found.clear()
            target = (common.mix(ids.view(np.uint64)) % np.uint64(n_targets)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(target[order]) > 0)).tolist()
            parts = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])]
            spans = np.stack([start, end], axis=1).astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([int(target[i[0]]) for i in parts], pa.int32()),
                 pa.array([ids[i].tobytes() for i in parts], pa.binary()),
                 pa.array([own[i].tobytes() for i in parts], pa.binary()),
                 pa.array([spans[i].tobytes() for i in parts], pa.binary())], schema=_BULK)

        def settle():
            if held and (marks := _bucket_marks(held)) is not None:
                found.append(marks)
            held.clear()
            common.release_memory()

        for batch in batches:
            for r in batch.to_pylist():
                if r["marks"] is not None:
                    found.append(_unpack_marks(r))
                    continue
                if held and held[0]["bucket"] != r["bucket"]:
                    settle()
                held.append(r)
                if sum(len(f[0]) for f in found) > HELD_SPANS:
                    yield send()
        settle()
        if found:
            yield send()
    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with its spans united; targets arrive in order."""
    held: list[tuple] = []

    def settle():
        got = _by_row(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(got, _MARKS.types)], schema=_MARKS)

    last = None
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["target"] != last:
                yield settle()
            last = r["target"]
            s = np.frombuffer(r["spans"], np.uint32).reshape(-1, 2).astype(np.int64)
            held.append((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["hashes"], np.int32),
                         s[:, 0], s[:, 1]))
    if held:
        yield settle()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list:
    return [common.long_id(f"`{doc_id}`").alias("id"), F.hash(F.col(f"`{text}`")).alias("h")]


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, h, spans`` of rows with bytes to remove: the row's id and text hash
    and its packed spans (pairs of 32-bit byte offsets)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(parts, -(-common.total_bytes(docs, f"`{text}`") * OVERLAP // BUCKET_BYTES))
    rows = docs.select(*_keyed(docs, doc_id, text), F.col(f"`{text}`").alias("text"))
    sent = rows.mapInArrow(_cut(n), _SENT_DDL)
    found = sent.repartition(parts, "bucket").sortWithinPartitions("bucket") \
        .mapInArrow(_reduce(4 * parts), "target int, ids binary, hashes binary, spans binary")
    return found.repartition(parts, "target").sortWithinPartitions("target") \
        .mapInArrow(_gather, "id long, h int, spans binary")


def cut_out(text: bytes, packed: bytes | None) -> tuple[bytes, int, int]:
    """Remaining bytes, bytes removed and maximal runs removed."""
    if not packed:
        return text, 0, 0
    starts, ends = np.frombuffer(packed, np.uint32).reshape(-1, 2).astype(np.int64).T
    kept = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)]))
    return kept, len(text) - len(kept), len(starts)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          decode: bool = False) -> DataFrame:
    """Every row as ``doc`` (a struct of its other columns), ``size`` (bytes of
    the text), ``kept`` (binary: what remains of the text; as a string if
    ``decode``, without characters that were cut in two; null for a null text),
    ``removed`` and ``spans`` (long). The text is shuffled compressed."""
    spans = repeated_spans(docs, doc_id, text)
    other = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*other).alias("doc"), *_keyed(docs, doc_id, text),
                       F.col(f"`{text}`").alias("text"))
    packed = rows.drop("text").schema.add("packed", "binary")
    rows = rows.mapInArrow(_pack, packed).withColumnsRenamed({"id": "_id", "h": "_h"})
    joined = rows.join(spans, (rows["_id"] == spans["id"]) & (rows["_h"] == spans["h"]), "left") \
        .select("doc", "packed", spans["spans"].alias("cuts"))
    schema = joined.drop("packed", "cuts").schema.add("size", "long") \
        .add("kept", "string" if decode else "binary").add("removed", "long").add("spans", "long")
    kind = pa.string() if decode else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in common.slices(batch, "packed", SLICE_BYTES):
                texts = [None if t is None else unpack(t)
                         for t in part.column("packed").to_pylist()]
                got = [cut_out(t or b"", c) for t, c in
                       zip(texts, part.column("cuts").to_pylist())]
                kept = [None if t is None else g[0].decode("utf-8", "ignore") if decode else g[0]
                        for t, g in zip(texts, got)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array([len(t or b"") for t in texts], pa.int64()),
                     pa.array(kept, kind), pa.array([g[1] for g in got], pa.int64()),
                     pa.array([g[2] for g in got], pa.int64())], schema.names)

    return joined.mapInArrow(run, schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        packed = [None if t.as_py() is None else pack(common.encode(t.as_py()))
                  for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc", "id", "h")), pa.array(packed, pa.binary())],
            ["doc", "id", "h", "packed"])


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.coalesce("kept", F.lit(b""))
    return dedup(docs).select(
        "doc.doc_id", F.col("size").alias("n_bytes"), F.col("removed").alias("n_removed"),
        F.col("spans").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated bytes are cut out of the texts (a character cut in two goes);
    rows of which nothing but white space is left go, if anything was cut. Batches
    are bounded by bytes, as executors hold what earlier stages left there."""
    common.bound_batches(spark, 3 * SLICE_BYTES)
    cut = dedup(docs, decode=True).where("removed = 0 or length(trim(kept)) > 0")
    fixed = {"text": F.col("kept"),
             "n_chars": F.when(F.col("removed") > 0, F.length("kept"))
             .otherwise(F.col("doc.n_chars")).cast("long")}
    return cut.select(*((fixed[c] if c in fixed else F.col(f"doc.`{c}`")).alias(c)
                        for c in docs.columns))
