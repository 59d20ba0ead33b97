"""Skew-safe sequential operators over event streams.

W4 and W7 are lock chains (``quarry.operators.chains``). General building blocks
for other "process, then jump ahead" logic, a chain through a functional graph in
which every event points at the one processed next:

* ``next_at_or_after`` - an as-of lookup (first event of the same key at or
  after ``t_i + gap``). Work is split by ``(key, slab)`` where a slab is a
  fixed time range, so a key holding a third of all rows is still spread
  over many tasks; a probe with no answer in its own slab takes the first
  event of the next non-empty slab from a per-slab summary.
* ``mark_paths`` - pointer doubling: level ``k+1`` jumps ``2^(k+1)`` steps
  by joining level ``k`` with itself on the unique node id, then the nodes
  on the paths from the roots are expanded level by level. Every join is
  on a unique id (no key skew); ``log2(path length)`` rounds; each level is
  checkpointed to the shared checkpoint folder so a lost executor never
  replays the whole loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.chains import lock_chains
from quarry.session import cut_lineage, cut_lineage_counting, drop_written

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def to_micros(df: DataFrame, ts: str):
    """Epoch microseconds of a timestamp column without any session-time-zone
    conversion: wall-clock (NTZ) columns are measured from the NTZ epoch."""
    from pyspark.sql.types import TimestampNTZType

    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, `{ts}`)")
    return F.unix_micros(F.col(ts).cast("timestamp"))


LONG_MIN = -(2 ** 63)
LONG_MAX = 2 ** 63 - 1


def next_events(ev: DataFrame, keys: list[str], specs: dict[str, tuple[int, str]],
                slab_us: int = HOUR_US, events_where=None) -> DataFrame:
    """As-of lookups for every event ``(keys, id, t)`` (``t`` in epoch
    microseconds), several kinds answered by ONE sort of the data.

    ``specs`` maps a name to ``(gap_us, mode)``; for each event and spec the
    answer is the first event of the same key, in ``(t, id)`` order, with
    ``t' >= t + gap`` (mode ``"ge"``), ``t' > t + gap`` (``"gt"``) or
    ``(t', id') > (t + gap, id)`` (``"succ"``, the successor when gap is 0)
    or ``(t', id') >= (t + gap, id)`` (``"self"``: the event itself counts).
    ``events_where`` (a boolean column of ``ev``) restricts which rows can
    be answers; every row is still a probe.
    Returns ``(id, name, nxt)``; ``nxt`` is NULL when there is none."""
    flag = events_where if events_where is not None else F.lit(True)
    ev = ev.select(*keys, "id", "t", flag.alias("__ev"))
    rows = ev.where(F.col("__ev")).select(
        *keys, F.col("t"), F.col("id").alias("k2"), F.lit(0).alias("tag"),
        F.col("id").alias("eid"), F.lit(None).cast("bigint").alias("src"),
        F.lit(None).cast("string").alias("name"))
    for name, (gap_us, mode) in specs.items():
        # Probe rows sit between events: ``k2`` places them before (ge),
        # after (gt) or exactly at (succ) the events of their instant.
        k2 = {"succ": F.col("id"), "self": F.col("id"), "ge": F.lit(LONG_MIN).cast("bigint"),
              "gt": F.lit(LONG_MAX).cast("bigint")}[mode]
        # at equal (t, k2) a probe with tag 1 sorts before the event (strict),
        # tag -1 after it (the event itself answers)
        tag = -1 if mode == "self" else 1
        rows = rows.unionByName(ev.select(*keys, (F.col("t") + F.lit(gap_us)).alias("t"),
                                          k2.alias("k2"), F.lit(tag).alias("tag"),
                                          F.lit(None).cast("bigint").alias("eid"),
                                          F.col("id").alias("src"), F.lit(name).alias("name")))
    rows = rows.withColumn("slab", F.floor(F.col("t") / F.lit(slab_us)))
    # descending order + frame "everything before me" = everything after me
    # in (t, id) order: an incrementally maintained frame (linear), not a
    # re-scan.
    w = (Window.partitionBy(*keys, "slab")
         .orderBy(F.col("t").desc(), F.col("k2").desc(), F.col("tag").desc())
         .rowsBetween(Window.unboundedPreceding, -1))
    nearest = F.last(F.when(F.col("eid").isNotNull(), F.struct("t", "eid")), ignorenulls=True)
    probes = (rows.withColumn("hit", nearest.over(w))
              .where(F.col("src").isNotNull())
              .select(*keys, "slab", "src", "name", F.col("hit.eid").alias("nxt")))
    # per-slab first event, then "first event in any later slab" per key:
    # one row per (key, slab), so this window is bounded by the time span.
    firsts = (rows.where(F.col("eid").isNotNull())
              .groupBy(*keys, "slab")
              .agg(F.min(F.struct("t", "eid")).alias("first")))
    slabs = (probes.select(*keys, "slab").distinct()
             .join(firsts, [*keys, "slab"], "full_outer"))
    ws = (Window.partitionBy(*keys).orderBy(F.col("slab").desc())
          .rowsBetween(Window.unboundedPreceding, -1))
    later = slabs.select(*keys, "slab",
                         F.last("first", ignorenulls=True).over(ws)["eid"].alias("later"))
    return (probes.join(later, [*keys, "slab"], "left")
            .select(F.col("src").alias("id"), "name", F.coalesce("nxt", "later").alias("nxt")))


def next_at_or_after(ev: DataFrame, keys: list[str], gap_us: int, inclusive: bool,
                     slab_us: int = HOUR_US, successor: bool = False) -> DataFrame:
    """One as-of lookup (see ``next_events``): first event at or after
    (``inclusive``) / after ``t + gap``, or the successor. ``(id, nxt)``."""
    mode = "succ" if successor else ("ge" if inclusive else "gt")
    return next_events(ev, keys, {"n": (gap_us, mode)}, slab_us).select("id", "nxt")


def mark_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reachable from ``roots`` (``id``) following ``edges`` (``id``,
    ``nxt``) - each node has at most one successor. Returns ``id``.

    Level ``k`` maps every node to its ``2^k``-th successor; the reached set
    after step ``k`` holds every node at distance ``< 2^(k+1)`` from a root.
    Each level is written once to the shared checkpoint folder; whether
    another level is needed is counted while it is written."""
    level, live = cut_lineage_counting(edges.select("id", F.col("nxt").alias("j")),
                                       F.col("j").isNotNull())
    levels = [level]
    while live:
        if len(levels) > 64:  # 2^64 steps: longer than any path without a cycle
            raise ValueError("the edges have a cycle")
        a, b = level.alias("a"), level.alias("b")
        level, live = cut_lineage_counting(
            a.join(b, F.col("a.j") == F.col("b.id"), "left").select(F.col("a.id"), F.col("b.j")),
            F.col("j").isNotNull())
        levels.append(level)
    reached = roots.select("id")
    written = []
    for lv in levels[:-1]:
        step = (reached.join(lv, "id").where(F.col("j").isNotNull())
                .select(F.col("j").alias("id")))
        reached = cut_lineage(reached.unionByName(step))
        written.append(reached)
    # the finished levels and the intermediate reached sets are read by no
    # later plan: free their storage in the checkpoint folder
    spark = edges.sparkSession
    for t in levels + written[:-1]:
        drop_written(spark, t)
    return reached


def first_per_key(ev: DataFrame, keys: list[str]) -> DataFrame:
    """Root of each key's chain: earliest ``(t, id)`` (partial aggregate)."""
    return ev.groupBy(*keys).agg(F.min(F.struct("t", "id"))["id"].alias("id"))


def suppress_repeats(events: DataFrame, keys: list[str], ts: str, id_col: str,
                     window_seconds: int = 3600, resolved: str | None = None) -> DataFrame:
    """Keep an event only when no *kept* event of the same key happened
    within ``window_seconds`` before it (a gap of exactly the window is still
    suppressed). Suppressed events do not extend the window. A kept event
    that is ``resolved`` (a boolean column) suppresses nothing: the next one
    after it is looked at again. Returns the input rows with a boolean
    ``emitted`` column."""
    names = [f"k{i}" for i in range(len(keys))]
    done = F.lit(False) if resolved is None else F.col(resolved)
    ev = events.select(*(F.col(k).alias(n) for k, n in zip(keys, names)),
                       F.col(id_col).alias("id"), to_micros(events, ts).alias("t"),
                       done.alias("ok"))
    # a kept event locks its key; the first instant after the window is free again
    marked, _ = lock_chains(ev, names, 1, window_seconds * 1_000_000 + 1)
    kept = marked.select(F.col("id").alias(id_col), F.lit(True).alias("emitted"))
    return (events.join(kept, id_col, "left")
            .withColumn("emitted", F.coalesce("emitted", F.lit(False))))


def lockouts(attempts: DataFrame, user: str, ts: str, id_col: str, success: str,
             max_failures: int = 5, lock_minutes: int = 30) -> DataFrame:
    """Login attempts -> which were processed and which locked the account.

    Per user: an attempt while locked is rejected and changes nothing; a
    processed failure adds one to the counter and, at ``max_failures`` or
    more, locks the account for ``lock_minutes``; a processed success resets
    the counter.

    The whole is one automaton per user, run by ``chains.lock_chains``: no
    user's attempts are gathered in one task.
    Returns the attempts with ``processed``, ``locks`` and ``locked_until``.
    """
    a = attempts.select(F.col(user).alias("u"), F.col(id_col).alias("id"),
                        to_micros(attempts, ts).alias("t"),
                        F.col(success).cast("boolean").alias("ok"))
    marked, _ = lock_chains(a, ["u"], max_failures, lock_minutes * 60_000_000)
    out = (attempts.join(marked.withColumnRenamed("id", id_col), id_col, "left")
           .withColumn("processed", F.coalesce("processed", F.lit(False)))
           .withColumn("locks", F.coalesce("locks", F.lit(False))))
    return out.withColumn("locked_until", F.when(
        F.col("locks"), F.col(ts).cast("timestamp") + F.expr(f"INTERVAL {lock_minutes} MINUTES")))


def sessionize(df: DataFrame, keys: list[str], ts: str, gap_seconds: int,
               slab_us: int = HOUR_US) -> DataFrame:
    """Session start of every row: a row opens a new session when the
    previous row of its key is ``gap_seconds`` or more earlier (or absent);
    every row belongs to the latest session start at or before it.

    Both steps are prefix computations done in two levels so no key is
    sorted whole in one task: windows run per ``(key, slab)`` and a small
    per-key window over one summary row per slab carries the previous slab's
    last event / last session start across slab borders. Adds
    ``session_start`` (timestamp)."""
    from pyspark.sql.types import TimestampNTZType

    ntz = isinstance(df.schema[ts].dataType, TimestampNTZType)
    x = (df.withColumn("__t", to_micros(df, ts))
         .withColumn("__slab", F.floor(F.col("__t") / F.lit(slab_us))))
    w = Window.partitionBy(*keys, "__slab").orderBy("__t")
    x = x.withColumn("__prev", F.lag("__t").over(w))
    # carry: last event time of the closest earlier non-empty slab
    last_in_slab = x.groupBy(*keys, "__slab").agg(F.max("__t").alias("__last"))
    ws = Window.partitionBy(*keys).orderBy("__slab")
    carry = last_in_slab.select(*keys, "__slab", F.lag("__last").over(ws).alias("__carry"))
    x = x.join(carry, [*keys, "__slab"], "left")
    prev = F.coalesce(F.col("__prev"), F.col("__carry"))
    x = x.withColumn("__start", F.when(prev.isNull() | (F.col("__t") - prev >= F.lit(
        gap_seconds * 1_000_000)), F.col("__t")))
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("__open", F.max("__start").over(wr))
    # carry: latest session start of all earlier slabs
    starts = x.groupBy(*keys, "__slab").agg(F.max("__start").alias("__s"))
    wsr = ws.rowsBetween(Window.unboundedPreceding, -1)
    carry2 = starts.select(*keys, "__slab", F.max("__s").over(wsr).alias("__carry2"))
    x = x.join(carry2, [*keys, "__slab"], "left")
    start = F.coalesce(F.col("__open"), F.col("__carry2"))
    x = x.withColumn("__s0", start)
    return (x.withColumn("session_start", F.expr(f"timestampadd(MICROSECOND, __s0, {EPOCH_NTZ})")
                         if ntz else F.timestamp_micros(start))
            .drop("__t", "__slab", "__prev", "__carry", "__start", "__open", "__carry2", "__s0"))
