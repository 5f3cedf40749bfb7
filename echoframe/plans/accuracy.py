"""The accuracy gate: labelled pairs of line ranges against reported pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AccuracyGateFailed
from .scratch import materialize


def covers(path, span, oracle_path, start, end, coverage: int):
    """Whether a location covers enough lines of an expected one."""
    shared = F.greatest(F.lit(0), F.least(span["end_line"], end) - F.greatest(span["start_line"], start) + 1)
    return (F.replace(path, F.lit("\\"), F.lit("/")) == oracle_path) & (start <= end) & (shared.cast("long") * 1000 >= (end - start + 1).cast("long") * coverage)


def _level(length):
    """The smallest power of two that is no less than a length, by its exponent."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")


def detected(pairs: DataFrame, oracle: DataFrame, coverage: int = 700) -> DataFrame:
    """``oracle`` with ``detected``: whether some pair covers both sides, in either
    order.

    Labels and pairs meet in one join, not on their two paths alone: what covers so
    many lines of a range holds one of a few lines of it, that many apart.  A pair's
    span is filed under the intervals, of the power of two above its length, that it
    touches, two at most; a label looks up its lines' intervals of every size that
    occurs.  Labels with null lines, or that end before they begin, are not detected."""
    path = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    ways = [pairs.select(path(F.col(f"{a}.path")).alias("l_path"), path(F.col(f"{b}.path")).alias("r_path"), F.col(f"{a}.span").alias("l_span"), F.col(f"{b}.span").alias("r_span")) for a, b in (("left", "right"), ("right", "left"))]
    have = ways[0].unionByName(ways[1]).withColumn("level", _level(F.col("l_span.end_line") - F.col("l_span.start_line") + 1))
    have = materialize(have, "gate-spans")
    want = materialize(oracle.withColumn("_n", F.monotonically_increasing_id()), "gate-labels")
    # At most some thirty sizes.
    levels = sorted(r.level for r in have.select("level").distinct().collect() if r.level is not None)
    touched = F.array_distinct(F.array(*[F.expr(f"shiftright(l_span.{e}_line, level)") for e in ("start", "end")]))
    filed = have.select("*", F.explode(touched).alias("cell"))
    lines = F.col("left_end") - F.col("left_start") + 1
    apart = F.greatest(F.lit(1), F.ceil(lines * F.lit(max(coverage, 0)) / 1000).cast("int"))
    some = want.where("left_start <= left_end and right_start <= right_end")
    if coverage > 0:
        some = some.select("*", F.explode(F.sequence(F.col("left_start") + apart - 1, F.greatest(F.col("left_start") + apart - 1, F.col("left_end")), apart)).alias("_line"))
        some = some.select("*", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("_level"))
        some = some.withColumn("_cell", F.expr("shiftright(_line, _level)"))
        keys = (F.col("o._level") == F.col("p.level")) & (F.col("o._cell") == F.col("p.cell"))
    else:  # any span of the two files will do
        keys = F.lit(True)
    o, p = some.alias("o"), filed.alias("p")
    match = (F.col("o.left_path") == F.col("p.l_path")) & (F.col("o.right_path") == F.col("p.r_path")) & keys
    for side in ("left", "right"):
        match = match & covers(F.col(f"p.{side[0]}_path"), F.col(f"p.{side[0]}_span"), F.col(f"o.{side}_path"), F.col(f"o.{side}_start"), F.col(f"o.{side}_end"), coverage)
    hit = o.join(p, match, "left_semi").select("_n").distinct().withColumn("detected", F.lit(True))
    return want.join(hit, "_n", "left").withColumn("detected", F.coalesce("detected", F.lit(False))).drop("_n")


def confusion(found: DataFrame) -> DataFrame:
    """Counts overall and by labelled kind: scope, tp, fp, fn, tn."""
    scopes = found.withColumn("scope", F.explode(F.filter(F.array(F.lit("overall"), F.col("kind")), lambda k: k.isNotNull())))
    n = lambda e, d: F.count(F.when((F.col("expected") == e) & (F.col("detected") == d), 1))
    return scopes.groupBy("scope").agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))


def metrics(counts: DataFrame) -> DataFrame:
    """``counts`` with precision, recall and f1 in permille; 1000 where there is
    nothing to count."""
    rate = lambda a, b: f"cast(case when {a} + {b} = 0 then 1000 else {a} * 1000 div ({a} + {b}) end as int)"
    out = counts.withColumn("precision", F.expr(rate("tp", "fp"))).withColumn("recall", F.expr(rate("tp", "fn")))
    return out.withColumn("f1", F.expr("cast(case when precision + recall = 0 then 0 else 2 * precision * recall div (precision + recall) end as int)"))


@dataclass(frozen=True)
class AccuracyGate:
    coverage: int = 700
    min_precision: int = 1000
    min_recall: int = 1000

    def evaluate(self, pairs: DataFrame, oracle: DataFrame) -> DataFrame:
        return metrics(confusion(detected(pairs, oracle, self.coverage)))

    def check(self, pairs: DataFrame, oracle: DataFrame) -> DataFrame:
        """As ``evaluate``; too low a precision or recall is an error."""
        table = self.evaluate(pairs, oracle)
        overall = table.where("scope = 'overall'").first()
        for name, least in (("precision", self.min_precision), ("recall", self.min_recall)):
            actual = overall[name] if overall else 1000
            if actual < least:
                raise AccuracyGateFailed(name, actual, least)
        return table
