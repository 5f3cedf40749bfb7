"""Jump consistent hashing of rows into numbered shards.

The shard of a row follows from its key and the number of shards alone (Lamping
and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm", 2014): there is
no ring table to keep or send, and with one shard more a row either stays or
moves into the new shard, which takes 1/(n+1) of all rows.

The slot of a row inside its shard needs a running number over all rows of a
shard.  No task ever holds a whole shard: each input partition numbers its own
rows, the light result is written once, and the numbers of rows per (partition,
shard) give every partition its first slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def spread(keys: np.ndarray) -> np.ndarray:
    """64-bit integers mixed so that near keys become unrelated ones."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to ``shards`` - 1, of each mixed key."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(going):
            state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead = ((at[going] + 1) * (2147483648.0 / draw)).astype(np.int64)
            on = ahead < shards
            going = going[on]
            at[going] = ahead[on]
    return at.astype(np.int32)


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """One row per input row: the key, ``size`` (UTF-8 bytes of the text plus 1),
    ``text_crc32``, ``law`` ("key"), ``shard``, ``slot`` (gapless from 0 within the
    shard) and ``grown_shard`` (the shard if there were one more).

    A null text counts as empty.  A null key is a key of its own, so all its rows
    share a shard; repeated keys share theirs, each row with its own slot.  An
    empty table gives an empty table.  Other columns of the input are ignored,
    whatever their names."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    light = df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )

    def number(batches):
        part = TaskContext.get().partitionId()
        used = np.zeros(shards, np.int64)
        for b in batches:
            ids = b.column(0)
            mixed = spread(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            mixed[ids.is_null().to_numpy(zero_copy_only=False)] = np.uint64(0x6E756C6C)
            at, grown = jump_hash(mixed, shards), jump_hash(mixed, shards + 1)
            local = np.empty(len(at), np.int64)
            for s in range(shards):
                mine = np.flatnonzero(at == s)
                local[mine] = used[s] + np.arange(len(mine))
                used[s] += len(mine)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(at), pa.array(grown), pa.array(np.full(len(at), part, np.int32)), pa.array(local)],
                ["doc_id", "size", "text_crc32", "shard", "grown_shard", "part", "local"],
            )

    placed = materialize(
        light.mapInArrow(
            number,
            "doc_id long, size long, text_crc32 long, shard int, grown_shard int, part int, local long",
        ),
        "shards",
    )
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return placed.join(first, ["part", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("local")).alias("slot"),
        "grown_shard",
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = 8) -> None:
    """Write the rows of ``df`` in folders ``shard=0`` .. below ``path``.  Each task
    writes its own rows, so no shard passes through one task.

    Rows with a null key share a shard, as do those of a repeated key; nulls
    elsewhere are written as they are.  A column that is named like the folders'
    is left out.  An empty table writes no rows."""

    def place(batches):
        for b in batches:
            ids = b.column(b.num_columns - 1)
            mixed = spread(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            mixed[ids.is_null().to_numpy(zero_copy_only=False)] = np.uint64(0x6E756C6C)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(jump_hash(mixed, shards))], [*b.schema.names[:-1], "shard"]
            )

    rest = [f for f in df.schema if f.name.lower() != "shard"]
    keyed = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(rest)], F.col(f"`{key}`").cast("long").alias("_key"))
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rest)] + ["shard int"])
    out = keyed.mapInArrow(place, schema).toDF(*[f.name for f in rest], "shard")
    out.write.partitionBy("shard").parquet(path)
