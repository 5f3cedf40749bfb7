"""Families: the connected components of clone pairs.

A family is one row of counts and sums, and its members and pairs are rows of their
own.  Its id is a digest of sums over members and pairs, so it is merged like any sum
and no row or task holds a whole family; arrays are made only where they are asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import forget, materialize, settled
from .components import connected_components
from .ordering import numbered


def _halves(c: Column) -> list[Column]:
    """Two numbers of 60 bits from a text's hash."""
    return [F.conv(F.substring(F.md5(c.cast("binary")), at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 17)]


def _summed(c: Column, name: str) -> list[Column]:
    return [F.count("*").alias(f"n_{name}"), *[F.sum(h).alias(f"{name}_{i}") for i, h in enumerate(_halves(c))]]


@dataclass
class Families:
    """``sizes``: one row per family (id, n_members, n_pairs, first: its smallest
    location); ``members``: (id, member); ``pairs``: (id, pair_id)."""

    sizes: DataFrame
    members: DataFrame
    pairs: DataFrame

    def arrays(self) -> DataFrame:
        """One row per family with sorted arrays: ``id``, ``members``, ``pair_ids``.  A
        row is as large as its family; the encoders do without."""
        members = self.members.groupBy("id").agg(F.sort_array(F.collect_list("member")).alias("members"))
        return members.join(self.pairs.groupBy("id").agg(F.sort_array(F.collect_list("pair_id")).alias("pair_ids")), "id")


def placed(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` (id, value) with ``place``, from 0 in the order of the value within its
    id: running numbers over all rows, less the first one of the id."""
    rows = materialize(numbered(rows, ["id", value], "_n"), "family-places")
    return rows.join(rows.groupBy("id").agg(F.min("_n").alias("_first")), "id").withColumn("place", F.col("_n") - F.col("_first")).drop("_n", "_first")


def family_tables(pairs: DataFrame) -> Families:
    """The families of a table of pairs, any filtered one.  A location is a node as a
    whole, so two spans of one fragment are two nodes.  A pair that occurs more than
    once counts once; an empty table gives empty ones."""
    pairs = materialize(pairs.select("id", "left", "right"), "family-pairs")
    node = settled(pairs.sparkSession, lambda: connected_components(pairs, "left", "right"), "family-nodes")
    held = pairs.join(node.select(F.col("node").alias("left"), "component"), "left").select("component", F.col("id").alias("pair_id")).distinct()
    held = materialize(held, "family-pair-ids")
    members = node.groupBy("component").agg(*_summed(F.col("node.fragment_id"), "members"))
    both = members.join(held.groupBy("component").agg(*_summed(F.col("pair_id"), "pairs")), "component")
    parts = [F.col(f"{a}_{b}").cast("string") for a in ("members", "pairs") for b in (0, 1)]
    digest = F.md5(F.concat_ws(":", F.col("n_members").cast("string"), *parts[:2], F.col("n_pairs").cast("string"), *parts[2:]).cast("binary"))
    sizes = both.select("component", F.concat(F.lit("clone:v1:family:"), digest).alias("id"), "n_members", "n_pairs")
    sizes = materialize(sizes, "family-sizes")
    forget(pairs)
    named = sizes.select("component", "id")
    return Families(
        sizes.select("id", "n_members", "n_pairs", F.col("component").alias("first")),
        node.join(named, "component").select("id", F.col("node").alias("member")),
        held.join(named, "component").select("id", "pair_id"),
    )


def families_for_pairs(pairs: DataFrame) -> DataFrame:
    """One row per family: ``id``, ``members`` (locations, sorted) and ``pair_ids`` (sorted)."""
    return family_tables(pairs).arrays()
