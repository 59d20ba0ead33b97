"""Lineage and dependency queries."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import cut_lineage, cut_lineage_counting, drop_written


def closure(spark: SparkSession, edges: DataFrame, direction: str = "downstream",
            roots: DataFrame | None = None) -> DataFrame:
    """Transitive closure over ``edges(source, target)``. ``direction``
    is downstream (follow source -> target), upstream (target -> source) or
    both.

    Breadth first: the frontier of ``(root, node)`` pairs is joined with the
    edges, and pairs seen before are dropped by an anti-join, so a cycle ends
    by itself, a node reached on many paths is one row, and there is no limit
    on depth or rows. Each level is written once to the checkpoint folder;
    the levels are then gathered in one table and freed.

    Returns ``(root, node, depth)``, depth being the fewest steps, for every
    other node reachable from a root (all sources by default).
    """
    e = cut_lineage(_arrows(edges, direction).distinct())
    starts = roots.select("root") if roots is not None else e.select(F.col("a").alias("root"))
    levels = [cut_lineage(starts.distinct().select("root", F.col("root").alias("node"),
                                                   F.lit(0).alias("depth")))]
    while True:
        seen = functools.reduce(DataFrame.unionByName, levels)
        step = _kept(_onward(levels[-1], e).select(*PAIR), seen, PAIR, "left_anti") \
            .withColumn("depth", F.lit(len(levels)))
        level, n = cut_lineage_counting(step, F.lit(True))
        if not n:
            break
        levels.append(level)
    out = cut_lineage(functools.reduce(DataFrame.unionByName, levels).where("depth > 0"))
    for t in [e, level, *levels]:
        drop_written(spark, t)
    return out


PAIR = ["root", "node"]


def _arrows(edges: DataFrame, direction: str) -> DataFrame:
    """``a, b`` to be followed from a to b; edges may repeat."""
    down = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    up = edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    if direction not in ("downstream", "upstream", "both"):
        raise ValueError(f"unknown direction: {direction}")
    e = {"downstream": down, "upstream": up, "both": down.unionByName(up)}[direction]
    return e.where("a is not null and b is not null")


def _kept(rows: DataFrame, by: DataFrame, on: list[str], how: str) -> DataFrame:
    """Distinct rows that are (``left_semi``) or aren't (``left_anti``) in ``by``."""
    return rows.distinct().join(by, on, how)


def _onward(pairs: DataFrame, e: DataFrame) -> DataFrame:
    return pairs.join(e, F.col("node") == F.col("a")) \
        .select("root", F.col("b").alias("node"), (F.col("depth") + 1).alias("depth"))


def update_closure(spark: SparkSession, known: DataFrame, old: DataFrame, new: DataFrame,
                   direction: str = "downstream", roots: DataFrame | None = None) -> DataFrame:
    """J10, incremental: what ``closure`` gives for the edges ``new``, worked out from
    ``known``, its result for ``old`` (same direction and roots), by joins of pairs
    that change only.

    Delete: a pair of depth d stands on the pairs of depth d - 1 that an edge leads on
    to it. Depth by depth, pairs that stood on a removed edge or on a deleted pair are
    taken out if nothing is left that they stand on. As what a pair stands on is
    less deep than itself, a cycle can't hold itself up. Derive: deleted pairs get the
    least depth that the remaining pairs give, added edges offer theirs, and offers that
    are better than what is known are followed on until none is left.

    Rounds: the depths at which pairs go, and the steps on which depths get better. Each
    round's rows are those that change; the known pairs are looked up by them."""
    def starts(e: DataFrame) -> DataFrame:
        return roots.select("root") if roots is not None else e.select(F.col("a").alias("root"))

    made = []

    def cut(df: DataFrame) -> DataFrame:
        made.append(cut_lineage(df))
        return made[-1]

    def counted(df: DataFrame) -> tuple[DataFrame, int]:
        table, n = cut_lineage_counting(df, F.lit(True))
        made.append(table)
        return table, n

    # both states' edges in one table, by what they stand in
    sides = [_arrows(x, direction).select("a", "b", F.lit(was).alias("was"), F.lit(now).alias("now"))
             for x, was, now in ((old, True, False), (new, False, True))]
    both = cut(sides[0].unionByName(sides[1]).groupBy("a", "b")
               .agg(F.max("was").alias("was"), F.max("now").alias("now")))
    e, gone, fresh = (both.where(x).select("a", "b")
                      for x in ("now", "was and not now", "now and not was"))
    into = e.select("a", F.col("b").alias("node"))
    zero = starts(both).distinct() \
        .select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    state = cut(known.select(*PAIR, "depth").unionByName(zero))

    shaken = cut(_kept(_onward(state, gone), state, [*PAIR, "depth"], "left_semi"))
    span = shaken.agg(F.min("depth").alias("first"), F.max("depth").alias("last")).first()
    lost, ways, depth, n = [], [], span.first, 0  # ways: all edges to pairs in doubt
    while depth is not None and (depth <= span.last or n):
        at = shaken.where(F.col("depth") == depth)
        if n:
            at = cut(at.unionByName(_kept(_onward(lost[-1], e), state, [*PAIR, "depth"],
                                          "left_semi")).distinct())
        below = state.where(F.col("depth") == depth - 1)
        if n:
            below = below.join(lost[-1], PAIR, "left_anti")
        ways.append(cut(at.join(into, "node").select(*PAIR, "a")))
        stands = ways[-1].join(below.select("root", F.col("node").alias("a")), ["root", "a"])
        level, n = counted(at.join(stands, PAIR, "left_anti"))
        lost.append(level)
        depth += 1

    offers = _onward(state, fresh)
    left = state
    if lost:
        taken = cut(functools.reduce(DataFrame.unionByName, lost).select(*PAIR))
        left = cut(state.join(taken, PAIR, "left_anti"))
        again = functools.reduce(DataFrame.unionByName, ways).join(taken, PAIR, "left_semi").join(
            left.select("root", F.col("node").alias("a"), "depth"), ["root", "a"])
        offers = _onward(left, fresh).unionByName(
            again.select(*PAIR, (F.col("depth") + 1).alias("depth")))
    levels = [left]
    while True:
        best = cut(offers.groupBy(*PAIR).agg(F.min("depth").alias("depth")))
        have = functools.reduce(DataFrame.unionByName, levels).join(best.select(*PAIR), PAIR) \
            .groupBy(*PAIR).agg(F.min("depth").alias("had"))
        level, n = counted(best.join(have, PAIR, "left")
                           .where("had is null or depth < had").select(*PAIR, "depth"))
        if not n:
            break
        levels.append(level)
        offers = _onward(level, e)
    out = cut_lineage(functools.reduce(DataFrame.unionByName, levels).groupBy(*PAIR)
                      .agg(F.min("depth").alias("depth")).where("depth > 0"))
    for t in made:
        drop_written(spark, t)
    return out


def reference_edges(region: DataFrame, nation: DataFrame, customer: DataFrame,
                    orders: DataFrame) -> DataFrame:
    """Dataset-level lineage edges derived from the supplied tables:
    region -> nation -> customer -> order (names as node ids)."""
    rn = (nation.join(region, nation.n_regionkey == region.r_regionkey)
          .select(F.concat(F.lit("region:"), "r_name").alias("source"),
                  F.concat(F.lit("nation:"), "n_name").alias("target")))
    nc = (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
          .select(F.concat(F.lit("nation:"), "n_name").alias("source"),
                  F.concat(F.lit("customer:"), "c_name").alias("target")))
    co = (orders.join(customer, orders.o_custkey == customer.c_custkey)
          .select(F.concat(F.lit("customer:"), "c_name").alias("source"),
                  F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("target")))
    return rn.unionByName(nc).unionByName(co)


def runnable_jobs(jobs: DataFrame) -> DataFrame:
    """Pending jobs whose every dependency has succeeded (a query over
    the job table, not a scheduler). ``jobs(job_id, status, depends_on)``."""
    deps = jobs.select("job_id", F.explode_outer("depends_on").alias("dep"))
    status = jobs.select(F.col("job_id").alias("dep"), F.col("status").alias("dep_status"))
    blocked = (deps.where(F.col("dep").isNotNull())
               .join(status, "dep", "left")
               .where(F.coalesce(F.col("dep_status"), F.lit("missing")) != "success")
               .select("job_id").distinct())
    return (jobs.where(F.col("status") == "pending")
            .join(blocked, "job_id", "left_anti"))
