"""Fingerprints: k-gram hashes and winnowing.

Hashes are unsigned 64-bit numbers kept in signed longs; winnowing compares them
as unsigned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import in_parts, list_starts

#: Fixed value: the base of the polynomial.
BASE = 1099511628211


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """For each k-gram the sum of (id + 1) * BASE**(distance to its end), mod 2**64."""
    n = len(ids) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    x = np.asarray(ids, np.int64).astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(BASE) + x[j : j + n]
    return out


def winnowed(ids: np.ndarray, k: int, window: int) -> np.ndarray:
    """The distinct minima of every ``window`` consecutive hashes."""
    h = rolling(ids, k)
    if len(h) < window:
        return np.empty(0, np.uint64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1))


def _each(ids: pa.Array, made) -> pa.Array:
    """What ``made`` gives for every row of an array of arrays of numbers."""
    starts, values = list_starts(ids), np.asarray(ids.flatten(), np.int64)
    rows = [made(values[a:b]) for a, b in zip(starts, starts[1:])]
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64)))


def _hashes(ids: Column, made) -> Column:
    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield from in_parts(lambda part: _each(part, made), (rows,))

    return run(ids)


def kgram_hashes(ids: Column, k: int) -> Column:
    return _hashes(ids, lambda x: rolling(x, k))


def fingerprints(ids: Column, k: int, window: int) -> Column:
    """The winnowed hashes of an id array, distinct."""
    return _hashes(ids, lambda x: winnowed(x, k, window))


def fingerprint_rows(streams: DataFrame, stream: str, k: int, window: int, rank: str = "rank") -> DataFrame:
    """(rank, fp), distinct."""
    return streams.select(rank, F.explode(fingerprints(F.col(stream), k, window)).alias("fp"))
