"""Suppression of pairs that a better pair of the same two paths contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import materialize

_SIDES = ("left", "right")


def covered_bytes(side: str):
    return F.greatest(F.lit(0), F.col(f"{side}.span.end_byte") - F.col(f"{side}.span.start_byte"))


def _level(length: Column) -> Column:
    """The smallest power of two that is no less than a length, by its exponent."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")


def best_of_equal_spans(rows: DataFrame) -> DataFrame:
    """Of pairs with the same spans, those that none before them reaches in similarity;
    before means more compared tokens, then higher similarity, then a smaller id."""
    same = [f"{s}.{c}" for s in _SIDES for c in ("path", "span.start_byte", "span.end_byte")]
    order = [F.desc("evidence.compared_tokens"), F.desc("similarity"), F.asc("id")]
    before = W.partitionBy(*same).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    over = rows.withColumn("_over", F.coalesce(F.max("similarity").over(before), F.lit(-1)))
    # Rows that are equal in all of the order are not before one another.
    peers = W.partitionBy(*same, "evidence.compared_tokens", "similarity", "id")
    return over.withColumn("_over", F.min("_over").over(peers)).where("_over < similarity").drop("_over")


def suppress_contained(pairs: DataFrame) -> DataFrame:
    """``pairs`` without those that an earlier one contains on both sides at no
    lower similarity; earlier means more covered bytes, then more compared tokens,
    higher similarity, smaller id.  Equal pairs count once; an empty table gives an empty one.

    Containment is transitive, so it does not matter whether the better pair is itself
    kept.  A pair that contains another with other spans covers more bytes, so only
    pairs of equal spans need the rest of the order.  The others are found in cells:
    along each side a span lies in at most two intervals of the power of two above its
    length, and one that it contains begins in one of them.  So every pair is filed in
    at most four cells, looks into one cell of each size that occurs and is no smaller
    than itself, and pairs of the same two paths that lie apart never meet."""
    columns = pairs.columns
    once = pairs.dropDuplicates(["id", "kind", "similarity", "left", "right"])
    rows = materialize(best_of_equal_spans(once).withColumn("_n", F.monotonically_increasing_id()), "best-pairs")
    flat = rows.select(
        "_n", "similarity", *[F.col(f"{s}.path").alias(f"{s}_path") for s in _SIDES],
        *[F.col(f"{s}.span.{e}_byte").alias(f"{s}_{e}") for s in _SIDES for e in ("start", "end")],
    )
    flat = flat.withColumns({f"{s}_level": _level(F.col(f"{s}_end") - F.col(f"{s}_start")) for s in _SIDES})
    # At most one row for each two sizes of spans: some hundreds.
    sizes = [(r.left_level, r.right_level) for r in flat.select("left_level", "right_level").distinct().collect()]
    if not sizes:
        return rows.select(*columns)
    cell = lambda s, e: F.expr(f"shiftright({s}_{e}, {s}_level)")
    held = flat.select("*", F.explode(F.array_distinct(F.array(cell("left", "start"), cell("left", "end")))).alias("left_cell"))
    held = held.select("*", F.explode(F.array_distinct(F.array(cell("right", "start"), cell("right", "end")))).alias("right_cell"))
    every = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(sizes)])
    seen = flat.select("*", F.explode(F.filter(every, lambda x: (x["a"] >= F.col("left_level")) & (x["b"] >= F.col("right_level")))).alias("size"))
    seen = seen.drop("left_level", "right_level").withColumns({"left_level": F.col("size.a"), "right_level": F.col("size.b")})
    seen = seen.withColumns({f"{s}_cell": cell(s, "start") for s in _SIDES})
    a, b = seen.alias("a"), held.alias("b")
    inside = F.col("b.similarity") >= F.col("a.similarity")
    for s in _SIDES:
        for c in ("path", "level", "cell"):
            inside = inside & (F.col(f"a.{s}_{c}") == F.col(f"b.{s}_{c}"))
        inside = inside & (F.col(f"b.{s}_start") <= F.col(f"a.{s}_start")) & (F.col(f"b.{s}_end") >= F.col(f"a.{s}_end"))
    wider = F.lit(False)
    for s in _SIDES:
        wider = wider | (F.col(f"b.{s}_start") < F.col(f"a.{s}_start")) | (F.col(f"b.{s}_end") > F.col(f"a.{s}_end"))
    gone = a.join(b, inside & wider, "left_semi").select("_n").distinct()
    return rows.join(gone, "_n", "left_anti").select(*columns)
