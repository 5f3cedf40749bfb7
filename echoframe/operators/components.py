"""Connected components of an undirected edge table.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014) turn any edge table into stars whose
centres are the smallest node of each component.  Every round is one or two
shuffles of the edge table, which is written between rounds; the number of
rounds grows with the logarithm of the longest path, and no component is ever
gathered in one task: stars are grown with a grouped minimum, not with a
collected list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import forget, materialize, settled


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that the join reads both sides from plain shuffles, whose large
    # partitions Spark can split: the centre of a star has many edges.
    low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-low")
    return (
        both.join(low, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """One row ``(node, component)`` for every node of ``edges``; ``component`` is
    the smallest node reachable.

    Rows with a null end and self-loops link nothing; a node that occurs in
    self-loops only is its own component.  Repeated edges count once.  An empty
    table gives an empty table.  The two columns must have the same type, which
    may be any orderable one; other columns are ignored."""
    nodes = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where(
        "a is not null and b is not null"
    )
    base = materialize(nodes.distinct(), "cc-input")
    cur = materialize(
        base.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")),
        "cc-edges",
    )
    seen = _fingerprint(cur)
    for _ in range(max_rounds):
        before = cur
        cur = settled(edges.sparkSession, lambda: _small_star(_large_star(before)), "cc-round")
        forget(before)
        now = _fingerprint(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select("b").distinct().select(F.col("b").alias("a"), "b")
    loops = base.where("a = b").join(cur, "a", "left_anti").select("a", "b")
    loops = loops.join(roots, "a", "left_anti")
    return cur.union(roots).union(loops).select(F.col("a").alias("node"), F.col("b").alias("component"))
