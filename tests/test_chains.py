"""Lock chains by composed slabs against plain loops."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import chains
from quarry.operators.chains import UNLOCKED, Function, Slab


def brute(t, ok, max_failures, lock, state):
    count, until = (state - UNLOCKED, None) if state < UNLOCKED + max_failures else \
        (max_failures, state)
    processed, locks = [], []
    for x, good in zip(t, ok):
        if until is not None and x < until:
            processed.append(False)
            locks.append(False)
            continue
        processed.append(True)
        count, until = (0, None) if good else (min(max_failures, count + 1), until)
        locks.append(not good and count >= max_failures)
        if locks[-1]:
            until = x + lock
    return processed, locks, UNLOCKED + count if until is None else until


def test_slab_functions_against_a_loop():
    rng = random.Random(0)
    for _ in range(400):
        most, lock, n = rng.choice([1, 1, 2, 3, 5]), rng.choice([1, 3, 10, 50]), rng.randrange(1, 40)
        t = np.array(sorted(rng.randrange(100, 200) for _ in range(n)), np.int64)
        ok = np.array([rng.random() < 0.3 for _ in range(n)])
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(2))})
        parts = [Slab(t[a:b], ok[a:b], most, lock).function() for a, b in zip(cuts, cuts[1:])]
        composed = parts[0]
        for p in parts[1:]:
            composed = composed.then(p)
        whole = Slab(t, ok, most, lock)
        for state in [*(UNLOCKED + c for c in range(most)), *range(100, int(t[0]) + lock + 1)]:
            processed, locks, end = brute(t, ok, most, lock, state)
            got = whole.replay(state)
            assert got[0].tolist() == processed and got[1].tolist() == locks
            for f in (whole.function(), composed, Function.unpacked(composed.packed(), most)):
                assert f(np.array([state], np.int64)).tolist() == [end]


def plain(rows, most, lock, entry=None):
    found, states = {}, {}
    for key in {r[0] for r in rows}:
        mine = sorted((t, i, ok) for k, i, t, ok in rows if k == key)
        processed, locks, end = brute([m[0] for m in mine], [m[2] for m in mine], most, lock,
                                      (entry or {}).get(key, UNLOCKED))
        found |= {m[1]: x for m, *x in zip(mine, processed, locks)}
        states[key] = end
    return found, states


def test_chains_over_many_slabs(spark):
    """A key with most rows inside one hour, cut into slabs of 16: many rounds."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.randrange(3_600_000),
             rng.random() < 0.2) for i in range(3000)]
    ev = spark.createDataFrame(rows, "k string, id long, t long, ok boolean").repartition(5)
    for most, lock in ((1, 50_000), (3, 20_000), (1, 10)):
        marked, exits = chains.lock_chains(ev, ["k"], most, lock, rows=16, all_rows=True)
        want, states = plain(rows, most, lock)
        assert {r.id: [r.processed, r.locks] for r in marked.collect()} == want
        assert {r.k: r.state for r in exits.collect()} == states


def test_states_are_handed_on(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, rng.randrange(100_000), rng.random() < 0.3) for i in range(500)]
    first = [r for r in rows if r[2] < 50_000]
    rest = [r for r in rows if r[2] >= 50_000]
    frame = lambda x: spark.createDataFrame(x, "k string, id long, t long, ok boolean")
    a, exits = chains.lock_chains(frame(first), ["k"], 2, 3000, rows=32, all_rows=True)
    b, _ = chains.lock_chains(frame(rest), ["k"], 2, 3000, rows=32, entry=exits, all_rows=True)
    got = {r.id: [r.processed, r.locks] for r in a.unionByName(b).collect()}
    assert got == plain(rows, 2, 3000)[0]


def test_a_hot_key_within_one_hour_is_spread_over_tasks(spark):
    """Slabs of a key that has nearly all rows, all in one hour, are made by
    several tasks, none of which has more than a few times its share."""
    ev = spark.range(40_000).select(
        F.when(F.col("id") % 50 == 0, "other").otherwise("hot").alias("k"), "id",
        (F.col("id") * 89_989 % 3_600_000_000).alias("t"), F.lit(False).alias("ok"))
    sizes = ev.repartitionByRange(8, "k", "t", "id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in sizes.collect()) < 3 * 40_000 / 8
    marked, _ = chains.lock_chains(ev, ["k"], 1, 60_000_000, rows=1000)
    rows = [(r.k, r.id, r.t, r.ok) for r in ev.collect()]
    want = {i for i, (p, _) in plain(rows, 1, 60_000_000)[0].items() if p}
    assert {r.id for r in marked.collect()} == want


def test_empty_input(spark):
    none = spark.createDataFrame([], "k string, id long, t long, ok boolean")
    marked, exits = chains.lock_chains(none, ["k"], 1, 10)
    assert not marked.collect() and not exits.collect()
    odd = spark.createDataFrame([("a", 1, None, False), ("a", None, 5, False)],
                                "k string, id long, t long, ok boolean")
    assert not chains.lock_chains(odd, ["k"], 1, 10)[0].collect()


def test_timestamps(spark):
    from quarry.operators import sequence
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([("k", 1, at(0), False), ("k", 2, at(60), False),
                                ("k", 3, at(61), True), ("k", 4, at(62), False)],
                               "k string, id long, ts timestamp, done boolean")
    kept = lambda **o: {r.id for r in sequence.suppress_repeats(
        df, ["k"], "ts", "id", **o).where("emitted").collect()}
    assert kept() == {1, 3} and kept(resolved="done") == {1, 3, 4}
