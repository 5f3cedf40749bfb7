"""Inverted index on fingerprints and the candidate join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import permille
from ..plans.scratch import materialize


def buckets(fps: DataFrame) -> DataFrame:
    """(fp, n): how many fragments have each fingerprint."""
    return fps.groupBy("fp").agg(F.count("*").alias("n"))


def common(fps: DataFrame) -> DataFrame:
    """(fp, n) of the fingerprints that more than one fragment has, written: they are
    counted once for all that asks for them."""
    return materialize(buckets(fps).where("n > 1"), "common-fingerprints")


def live(fps: DataFrame, max_bucket: int) -> DataFrame:
    """``fps`` without the fingerprints that more than ``max_bucket`` fragments
    have.  This bounds what one fingerprint can join.  The list of those is written,
    so that the join reads both sides plainly and a very common one can be split."""
    hot = materialize(buckets(fps).where(F.col("n") > max_bucket).select("fp"), "hot-fingerprints")
    return fps.join(hot, "fp", "left_anti")


def effective_sizes(kept: DataFrame) -> DataFrame:
    return kept.groupBy("rank").agg(F.count("*").alias("size"))


def shared_pairs(kept: DataFrame) -> DataFrame:
    """(l, r, shared): fragments with a common fingerprint, ``l`` before ``r``.
    Fingerprints of one fragment only are dropped before the join."""
    common = buckets(kept).where("n > 1").select("fp")
    rows = kept.join(common, "fp", "left_semi")
    left, right = rows.select("fp", F.col("rank").alias("l")), rows.select("fp", F.col("rank").alias("r"))
    return left.join(right, "fp").where("l < r").groupBy("l", "r").agg(F.count("*").alias("shared"))


def _scored(pairs: DataFrame, min_similarity: int) -> DataFrame:
    """(l, r, shared, jaccard, containment) of pairs with the sizes ``ls`` and ``rs``."""
    scored = pairs.select(
        "l", "r", "shared",
        permille(F.col("shared"), F.col("ls") + F.col("rs") - F.col("shared")).alias("jaccard"),
        permille(F.col("shared"), F.least("ls", "rs")).alias("containment"),
    )
    return scored.where(F.greatest("jaccard", "containment") >= min_similarity)


def most_pairs(often: DataFrame) -> int:
    """No fewer than the pairs of fragments that have one of these fingerprints (fp, n)."""
    n = F.col("n").cast("decimal(19,0)")
    return int(often.agg(F.sum(n * (n - 1))).first()[0] or 0) // 2


def _sets(fps: DataFrame, often: DataFrame, max_bucket: int | None, min_shared: int, min_similarity: int) -> DataFrame:
    """(rank, size, need, own, fps, a, b), one row per fragment that another may share
    enough with: ``own`` counts the fingerprints that no other has, ``fps`` are the rest,
    the rarest first; ``need`` is what must be shared with a fragment of no smaller
    size; ``a`` and ``b`` are a key of the whole set, null if some are its own."""
    rows = fps.join(often, "fp", "left")
    if max_bucket is not None:
        rows = rows.where(F.col("n").isNull() | (F.col("n") <= max_bucket))
    some = F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "fp"))))
    sets = rows.groupBy("rank").agg(F.count("*").alias("size"), F.count(F.when(F.col("n").isNull(), 1)).alias("own"), some.alias("s"))
    need = F.greatest(F.lit(max(min_shared, 1)).cast("long"), F.expr(f"(size * {min_similarity} + 999) div 1000"))
    whole = lambda seed: F.when(F.col("own") == 0, F.xxhash64(F.lit(seed), F.col("s.fp")))
    sets = sets.select("rank", "size", need.alias("need"), "own", F.col("s.fp").alias("fps"), whole(1).alias("a"), whole(2).alias("b"))
    # ``need`` rises with the size, so a larger fragment shares no less than its smaller partner needs.
    return materialize(sets.where((F.col("size") >= max(min_shared, 1)) & (F.size("fps") > 0)), "fingerprint-sets")


def candidates(fps: DataFrame, min_shared: int, min_similarity: int, often: DataFrame | None = None, max_bucket: int | None = None) -> DataFrame:
    """The pairs that share enough: (l, r, shared, jaccard, containment).  ``often`` is
    what ``common`` gives for ``fps``; those of more than ``max_bucket`` fragments are
    left out on the way, as ``live`` does it.

    The larger of the two similarities is the share of the smaller set.  If two sets have
    ``need`` elements in common, then the first common one, in any order of elements, has
    so many places from its own to the end in both.  The rarest are put first, so most
    fragments look up few fingerprints, or none, instead of all.  Fragments with equal
    sets are looked up once, and what they share is not counted again."""
    sets = _sets(fps, common(fps) if often is None else often, max_bucket, min_shared, min_similarity)
    twins = sets.where("a is not null").select("rank", "size", "a", "b")
    groups = twins.groupBy("size", "a", "b").agg(F.min("rank").alias("rep"), F.count("*").alias("k")).where("k > 1")
    members = materialize(twins.join(groups, ["size", "a", "b"]).select("rank", "rep", "size"), "equal-sets")
    reps = materialize(sets.join(members.where("rank <> rep").select("rank"), "rank", "left_anti").drop("a", "b"), "distinct-sets")
    at = reps.select("rank", "size", "need", "own", F.posexplode("fps").alias("i", "fp")).withColumn("left", F.col("size") - F.col("own") - F.col("i"))
    x = at.where(F.col("left") >= F.col("need")).select("fp", F.col("rank").alias("x"), F.col("size").alias("xs"), "need")
    y = at.select("fp", F.col("rank").alias("y"), F.col("size").alias("ys"), "left")
    later = (F.col("ys") > F.col("xs")) | ((F.col("ys") == F.col("xs")) & (F.col("y") > F.col("x")))
    met = x.join(y, "fp").where(later & (F.col("left") >= F.col("need"))).select("x", "y").distinct()
    side = lambda c: reps.select(F.col("rank").alias(c), F.col("size").alias(f"{c}s"), F.col("fps").alias(f"{c}f"), F.col("need").alias(f"{c}n"))
    both = materialize(met, "met").join(side("x"), "x").join(side("y"), "y")
    both = both.withColumn("shared", F.size(F.array_intersect("xf", "yf")).cast("long")).where(F.col("shared") >= F.col("xn"))
    both = materialize(both.select("x", "y", "xs", "ys", "shared"), "near-sets")
    for c in ("x", "y"):  # every fragment in the place of the one that stood for it
        of = members.select(F.col("rep").alias(c), F.col("rank").alias(f"{c}m"))
        both = both.join(of, c, "left").withColumn(f"{c}m", F.coalesce(f"{c}m", c))
    apart = both.select(F.least("xm", "ym").alias("l"), F.greatest("xm", "ym").alias("r"), "shared", F.col("xs").alias("ls"), F.col("ys").alias("rs"))
    l, r = members.select("rep", F.col("rank").alias("l"), "size"), members.select("rep", F.col("rank").alias("r"))
    equal = l.join(r, "rep").where("l < r").select("l", "r", F.col("size").alias("shared"), F.col("size").alias("ls"), F.col("size").alias("rs"))
    return _scored(apart.unionByName(equal), min_similarity)
