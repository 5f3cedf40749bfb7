"""Verification of candidates: equal, equal when renamed, or near in edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CloneConfig
from ..functions.languages import permille
from ..plans.scratch import materialize


@F.pandas_udf(T.StructType([T.StructField("l", T.StringType()), T.StructField("r", T.StringType())]))
def _alphabet(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Both id arrays as strings of one character an id, numbered for the pair, so
    that Spark's own ``levenshtein`` can count edits of any ids."""
    out = []
    for a, b in zip(left, right):
        if a is None or b is None:
            out.append((None, None))
            continue
        number: dict = {}
        text = ["".join(chr(48 + n if n < 55000 else n + 3000) for n in (number.setdefault(x, len(number)) for x in s)) for s in (a, b)]
        out.append(tuple(text))
    return pd.DataFrame(out, columns=["l", "r"])


def bounded_distance(df: DataFrame, left: str, right: str, bound: str, name: str) -> DataFrame:
    """``df`` with the edit distance of two id arrays, -1 where above ``bound``."""
    far = F.abs(F.size(left) - F.size(right)) > F.col(bound)
    near = df.where(~far).withColumn("_t", _alphabet(F.col(left), F.col(right)))
    near = near.withColumn(name, F.expr(f"levenshtein(_t.l, _t.r, cast({bound} as int))").cast("long")).drop("_t")
    return near.unionByName(df.where(far).withColumn(name, F.lit(-1).cast("long")))


def verified(found: DataFrame, streams: DataFrame, config: CloneConfig) -> DataFrame:
    """Candidates that are clones: (l, r, shared, jaccard, containment, kind,
    similarity, edit_distance, compared_tokens).  Cheaper tests come first, and
    only what they leave is measured in edits."""
    # Pairs of equal streams are told by their digests: no pair carries whole streams
    # but those that are measured.
    ranks = found.select(F.col("l").alias("rank")).unionByName(found.select(F.col("r").alias("rank"))).distinct()
    digest = lambda c: F.sha2(F.concat_ws(",", F.col(c).cast("array<string>")), 256)
    kinds = {"s": "strict"} if config.mode == "exact" else {"s": "strict", "n": "renamed"}
    short = streams.join(ranks, "rank", "left_semi").select("rank", F.size("renamed").alias("len"), *[digest(c).alias(k) for k, c in kinds.items()])
    short = materialize(short, "digests")
    side = lambda c: short.select(*[F.col(x).alias(c if x == "rank" else f"{c}_{x}") for x in short.columns])
    rows = found.join(side("l"), "l").join(side("r"), "r")
    rows = rows.withColumn("compared_tokens", F.greatest("l_len", "r_len").cast("long"))
    type1, type2 = F.col("l_s") == F.col("r_s"), F.col("l_n") == F.col("r_n") if "n" in kinds else F.lit(False)
    out = ["l", "r", "shared", "jaccard", "containment", "kind", "similarity", "edit_distance", "compared_tokens"]
    equal = (
        rows.withColumn("kind", F.when(type1, "type1").when(type2, "type2"))
        .where("kind is not null")
        .withColumn("similarity", F.lit(1000))
        .withColumn("edit_distance", F.lit(0).cast("long"))
        .select(*out)
    )
    if config.mode != "nearMiss":
        return equal
    slack = 1000 - config.min_similarity
    rest = rows.where(~type1 & ~type2).withColumn("_bound", F.expr(f"compared_tokens * {slack} div 1000"))
    # What differs more in length needs more edits than the bound.
    rest = rest.where(F.abs(F.col("l_len") - F.col("r_len")) <= F.col("_bound"))
    for c in ("l", "r"):
        rest = rest.join(streams.select(F.col("rank").alias(c), F.col("renamed").alias(f"{c}_renamed")), c)
    near = bounded_distance(rest, "l_renamed", "r_renamed", "_bound", "edit_distance").where("edit_distance >= 0")
    near = near.withColumn("kind", F.lit("type3")).withColumn("similarity", permille(F.col("compared_tokens") - F.col("edit_distance"), F.col("compared_tokens")))
    return equal.unionByName(near.select(*out))
