"""Running numbers over a whole table without a single task that holds it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import materialize


PLACE_BITS, ROW_BITS = 27, 35


def spot(row, place):
    """A row's number and a place in it as one long that orders like the two; minima
    of it are grouped by hash, where those of a struct would be sorted.  Places have
    27 bits, rows 35, and twice the long still fits one; more is an error."""
    over = (row >= (1 << ROW_BITS)) | (place >= (1 << PLACE_BITS))
    joined = F.shiftleft(row.cast("long"), PLACE_BITS).bitwiseOR(place.cast("long"))
    return F.when(over, F.raise_error(F.lit(f"more than 2**{ROW_BITS} rows or 2**{PLACE_BITS} tokens in one")).cast("long")).otherwise(joined)


def row_of(spots):
    return F.shiftright(spots, PLACE_BITS)


def place_of(spots):
    return spots.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))


def numbered(df: DataFrame, order: list[str], name: str, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with ``name``, 0 to n - 1 in ascending ``order``; ties are numbered
    in any order.  Rows are dealt by ranges of the order and numbered within their
    partition; the counts of the partitions, one row each, give the first number
    of every partition and are sent to all tasks.  ``made`` works on the dealt rows, one by
    one, before they are written, so that they are not written twice."""
    # Work on rows keeps all partitions; plain rows may be put into fewer.
    parts = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if made else []
    dealt = df.repartitionByRange(*parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(made(dealt) if made else dealt, "numbered")
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    if made:
        first = materialize(first, "first-numbers")
    return dealt.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + local).drop("_at", "_part", "_first")
