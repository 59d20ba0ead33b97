"""Lock chains over event streams by composing slabs.

One automaton covers repeat suppression and lockouts. Per key, in (time, id)
order: an event before ``locked until`` is ignored; any other is *processed*. A
processed ``ok`` event resets the counter and lifts the lock; a processed
failure adds one and, at ``max_failures`` or more, locks the key for
``lock_us`` from then on (W4: one failure locks, a resolved event is ok).

The state between two events is one number: a counter below ``max_failures``
(``UNLOCKED`` + counter) or, once locked, the time until which it is (the counter
stays full, so a failure at its end locks again). What a run of events does is
therefore a function of that number, and runs compose:

1. The events are range-partitioned by (key, time, id), so a key of any share of
   the rows lies in many tasks, and cut into *slabs* of at most ``rows`` events of
   one key. A slab is one row: its events, packed, and its function - the exit for
   each counter, and for locks the exit by the first event that the lock lets
   through, kept as steps (only those that a lock from before the slab can reach).
2. Slabs of a key are composed by doubling: in round r, a slab that does not know
   the state before it takes the function (or, near the key's start, the state)
   of the slab 2^r before it. Rounds grow with the logarithm of a key's number of
   slabs; rows are slabs, never events, and a key of one slab takes no round.
3. Each slab is replayed from the state before it.

Rows whose key columns are null belong to one key. Events without a time or id
are never processed. Ids are unique. Equal times are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.session import cut_lineage, cut_lineage_counting, drop_written

SLAB_ROWS = 1 << 16
UNLOCKED = -(2 ** 63)
_I64 = np.int64


class Function:
    """State -> state of a run of events: ``const[c]`` for counter c, else the
    value of the first step whose ``bound`` is not below the state; a lock past
    the last bound outlives the run."""

    def __init__(self, const: np.ndarray, bound: np.ndarray, value: np.ndarray, limit: int):
        self.const, self.bound, self.value, self.limit = const, bound, value, limit

    def __call__(self, states: np.ndarray) -> np.ndarray:
        out = states.copy()
        free = states < UNLOCKED + len(self.const)
        out[free] = self.const[(states[free] - UNLOCKED)]
        at = np.searchsorted(self.bound, states, "left")
        stepped = ~free & (at < len(self.bound))
        out[stepped] = self.value[at[stepped]]
        return out

    def then(self, later: Function) -> Function:
        """This run and the one after it."""
        past = later.bound > (self.bound[-1] if len(self.bound) else UNLOCKED)
        return Function(later(self.const), np.concatenate([self.bound, later.bound[past]]),
                        np.concatenate([later(self.value), later.value[past]]),
                        self.limit).short()

    def short(self) -> Function:
        """Steps of equal value joined; those beyond the limit go."""
        keep = np.append(self.value[1:] != self.value[:-1], True)[:len(self.value)]
        bound, value = self.bound[keep], self.value[keep]
        n = int(np.searchsorted(bound, self.limit, "left")) + 1
        return Function(self.const, bound[:n], value[:n], self.limit)

    def packed(self) -> bytes:
        return np.concatenate([[self.limit], self.const, self.bound, self.value]) \
            .astype(_I64).tobytes()

    @staticmethod
    def unpacked(data: bytes, max_failures: int) -> Function:
        a = np.frombuffer(data, _I64)
        steps = (len(a) - 1 - max_failures) // 2
        const, rest = a[1:1 + max_failures], a[1 + max_failures:]
        return Function(const, rest[:steps], rest[steps:], int(a[0]))


class Slab:
    """Events of one key in order: what they do from any state."""

    def __init__(self, t: np.ndarray, ok: np.ndarray, max_failures: int, lock_us: int):
        self.t, self.ok, self.max, self.lock = t, ok, max_failures, lock_us
        n = len(t)
        self.after = np.searchsorted(t, t + lock_us, "left")  # first event past a lock
        place = np.arange(n)
        last_ok = np.maximum.accumulate(np.where(ok, place, -1))
        self.run = place - last_ok                            # failures in a row
        full = np.append(np.flatnonzero(self.run >= max_failures), n)
        # an event processed when a lock ends: it locks, or opens a segment that
        # ends at the next full run of failures (n: at none of this slab)
        self.locks_at = np.where(ok, full[np.searchsorted(full[:-1], place + 1)], place)
        self.next = np.append(self.after, n)[self.locks_at]

    def _exit(self, locks_at: int) -> int:
        """State after the slab if the last lock is at this event (n: none)."""
        if locks_at < len(self.t):
            return int(self.t[locks_at]) + self.lock
        return UNLOCKED + int(self.run[-1])

    def first_lock(self, counter: int) -> int:
        """The event that locks, from the counter at the slab's start (n: none)."""
        n = len(self.t)
        ok = np.flatnonzero(self.ok[:self.max])
        prefix = int(ok[0]) if len(ok) else min(n, self.max)
        if counter + prefix >= self.max:
            return self.max - counter - 1
        full = np.flatnonzero(self.run >= self.max)
        return int(full[0]) if len(full) else n

    def _free_exit(self, counter: int) -> int:
        """Exit from a counter without a lock in the slab."""
        all_failed = int(self.run[-1]) == len(self.t)
        return UNLOCKED + int(self.run[-1]) + (counter if all_failed else 0)

    def function(self, limit: int | None = None) -> Function:
        """``limit``: the latest lock that can come in; a lock from before the
        slab ends by its first event's time and the lock's length."""
        n = len(self.t)
        # the last event of each chain, by doubling
        end = np.where(self.next < n, self.next, np.arange(n))
        while (end[end] != end).any():
            end = end[end]
        locks_at = self.locks_at[end]
        exits = np.where(locks_at < n, self.t[np.minimum(locks_at, n - 1)] + self.lock,
                         UNLOCKED + int(self.run[-1]))
        const = []
        for c in range(self.max):
            j = self.first_lock(c)
            if j >= n:
                const.append(self._free_exit(c))
            else:
                k = int(self.after[j])
                const.append(int(exits[k]) if k < n else self._exit(j))
        return Function(np.array(const, _I64), self.t, exits.astype(_I64),
                        int(self.t[0]) + self.lock if limit is None else limit).short()

    def replay(self, state: int) -> tuple[np.ndarray, np.ndarray]:
        """Which events are processed, and which lock."""
        n = len(self.t)
        processed, locks = np.zeros(n, bool), np.zeros(n, bool)
        if state < UNLOCKED + self.max:
            j = self.first_lock(state - UNLOCKED)
            processed[:j + 1] = True
            if j < n:
                locks[j] = True
            k = int(self.after[j]) if j < n else n
        else:
            k = int(np.searchsorted(self.t, state, "left"))
        while k < n:
            j = int(self.locks_at[k])
            processed[k:j + 1] = True
            if j < n:
                locks[j] = True
            k = int(self.next[k])
        return processed, locks


def _cut(keys: list[str], rows: int, max_failures: int, lock_us: int, limit: int | None):
    """Slabs of ordered events: one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        n_held = 0

        def slab(events: pa.Table) -> pa.RecordBatch:
            nonlocal name
            t, ok = events.column("t").to_numpy(), events.column("ok").to_numpy()
            f = Slab(t, ok, max_failures, lock_us).function(limit)
            values = [pa.array([name], pa.int64()), pa.array([f.packed()], pa.binary()),
                      pa.array([t.tobytes()], pa.binary()),
                      pa.array([events.column("id").to_numpy().tobytes()], pa.binary()),
                      pa.array([ok.tobytes()], pa.binary())]
            name += 1
            first = events.slice(0, 1).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*(first.column(k) for k in keys), *values],
                                              [*keys, "slab", "f", "t", "ids", "ok"])

        def settle(last: bool):
            nonlocal held, n_held
            events = pa.Table.from_batches(held).combine_chunks()
            n = events.num_rows
            new = np.zeros(n, bool)
            for k in keys:
                codes = events.column(k).combine_chunks().dictionary_encode("encode").indices \
                    .to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), n]
            rest = n
            for a, b in zip(cuts, cuts[1:]):
                for i in range(a, b, rows):
                    if not last and b == n and n - i < rows:
                        rest = i  # the key may go on in the next batch
                        break
                    yield slab(events.slice(i, min(rows, b - i)))
            held = events.slice(rest).to_batches() if rest < n else []
            n_held = n - rest

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n_held += batch.num_rows
                if n_held >= rows:
                    yield from settle(False)
        if n_held:
            yield from settle(True)
    return run


def _compose(max_failures: int):
    """One round: a slab's function after what comes before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, states = [], []
            for own, before, state in zip(*(batch.column(c).to_pylist()
                                            for c in ("f", "before_f", "before_state"))):
                f = Function.unpacked(own, max_failures)
                if state is not None:
                    fs.append(None)
                    states.append(int(f(np.array([state], _I64))[0]))
                else:
                    fs.append(Function.unpacked(before, max_failures).then(f).packed())
                    states.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kid"), batch.column("n"), pa.array(fs, pa.binary()),
                 pa.array(states, pa.int64())], ["kid", "n", "f", "state"])
    return run


def _replay(max_failures: int, lock_us: int, all_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, ids, ok, state in zip(*(batch.column(c).to_pylist()
                                           for c in ("t", "ids", "ok", "state"))):
                t, ids = np.frombuffer(t, _I64), np.frombuffer(ids, _I64)
                slab = Slab(t, np.frombuffer(ok, bool), max_failures, lock_us)
                processed, locks = slab.replay(UNLOCKED if state is None else state)
                at = np.arange(len(ids)) if all_rows else np.flatnonzero(processed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(processed[at]), pa.array(locks[at])],
                    ["id", "processed", "locks"])
    return run


def _states(slabs: DataFrame, max_failures: int, entry: DataFrame | None,
            keys: list[str]) -> DataFrame:
    """``slab, kid, n`` (place in its key) and ``state`` after it, of every slab."""
    w = Window.partitionBy(*keys).orderBy("slab")  # one row per slab
    order = slabs.select(*keys, "slab", F.row_number().over(w).alias("n"),
                         F.first("slab").over(w).alias("kid"))
    known = order.withColumn("start", F.lit(UNLOCKED))
    if entry is not None:
        e = entry.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("state").alias("_state"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        on = same[0]
        for c in same[1:]:
            on = on & c
        known = order.join(e, on, "left").withColumn(
            "start", F.coalesce("_state", F.lit(UNLOCKED))).select(*order.columns, "start")
    # before a key's first slab the state is given
    first = known.join(slabs.select("slab", "f"), "slab").select(
        "kid", "n", "f", F.lit(None).cast("binary").alias("before_f"),
        F.when(F.col("n") == 1, F.col("start")).alias("before_state"))
    level, open_ = cut_lineage_counting(first.where("n = 1").mapInArrow(
        _compose(max_failures), "kid long, n int, f binary, state long")
        .unionByName(first.where("n > 1").select("kid", "n", "f",
                                                 F.lit(None).cast("long").alias("state"))),
        F.col("state").isNull())
    step, levels = 1, [level]
    while open_:
        # what is known stays, what isn't takes the slab 2^round before it
        todo, have = level.where("state is null"), level.where("state is not null")
        before = level.select("kid", (F.col("n") + step).alias("n"),
                              F.col("f").alias("before_f"), F.col("state").alias("before_state"))
        level, open_ = cut_lineage_counting(
            have.unionByName(todo.join(before, ["kid", "n"]).mapInArrow(
                _compose(max_failures), "kid long, n int, f binary, state long")),
            F.col("state").isNull())
        levels.append(level)
        step *= 2
    done = cut_lineage(known.join(level.select("kid", "n", "state"), ["kid", "n"]))
    for table in levels:
        drop_written(slabs.sparkSession, table)
    return done


def lock_chains(events: DataFrame, keys: list[str], max_failures: int, lock_us: int,
                rows: int = SLAB_ROWS, entry: DataFrame | None = None,
                all_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """The automaton (see the module's text) over ``events`` (``keys``, ``id``,
    ``t`` in microseconds, boolean ``ok``). Returns two tables of the checkpoint
    folder: ``id, processed, locks`` of the processed events (of all events if
    ``all_rows``), and ``keys, state`` after each key's last event. ``entry``
    (``keys, state``) are the states before the first."""
    spark = events.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ev = events.where("t is not null and id is not null").select(
        *keys, F.col("id").cast("long").alias("id"), F.col("t").cast("long").alias("t"),
        F.coalesce("ok", F.lit(False)).alias("ok"))
    schema = StructType([ev.schema[k] for k in keys]).add("slab", "long").add("f", "binary") \
        .add("t", "binary").add("ids", "binary").add("ok", "binary")
    # states that are handed in may come from events after the first ones here
    limit = None if entry is None else 2 ** 63 - 1
    slabs = cut_lineage(ev.repartitionByRange(parts, *keys, "t", "id")
                        .sortWithinPartitions(*keys, "t", "id")
                        .mapInArrow(_cut(keys, rows, max_failures, lock_us, limit), schema))
    done = _states(slabs, max_failures, entry, keys)
    # a slab starts from the state after the one before it
    before = done.select("kid", (F.col("n") + 1).alias("n"), F.col("state").alias("before"))
    starts = done.join(before, ["kid", "n"], "left").select(
        "slab", F.coalesce("before", "start").alias("state"))
    marked = cut_lineage(slabs.select("slab", "t", "ids", "ok").join(starts, "slab").mapInArrow(
        _replay(max_failures, lock_us, all_rows), "id long, processed boolean, locks boolean"))
    exits = cut_lineage(done.groupBy(*keys).agg(F.max_by("state", "n").alias("state")))
    drop_written(spark, slabs)
    drop_written(spark, done)
    return marked, exits
