"""Packing documents into training sequences.

Two ways share one frame.  Both cut lossless pieces from documents and fill
sequences of a fixed length without a shuffle: every task packs the documents
of its own partition in blocks of a bounded number of tokens, so that neither
memory nor time depends on how many documents there are.  Sequence numbers are
made of the partition's number and a running one.

* ``pack_balanced``: attention costs a linear and a quadratic part, so equally
  full sequences can differ in cost.  Descending documents go to the sequence of
  lowest cost that has the room.
* ``pack_best_fit``: descending documents go to the sequence with the least room
  that is enough, found in a segment tree over capacities.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import default_words, text_slices, word_ids

#: Tokens that a task packs at once; a longer document makes a block of its own.
BLOCK_TOKENS = 1 << 21


def _blocks(batches, path: str, end_id: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Keys, bounds and ids of the documents, with the end id behind each, block by
    block.  Document ``i`` has the ids from ``bounds[i]`` to ``bounds[i + 1]``."""
    words = word_ids(path)
    keys: list[list] = []
    sizes: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    held = 0

    def block():
        return list(chain.from_iterable(keys)), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(ids)

    for b in batches:
        for at, n in text_slices(b.column(1)):
            key, (found, bounds) = b.column(0).slice(at, n).to_pylist(), words.encode(b.column(1).slice(at, n))
            found, bounds = np.insert(found, bounds[1:], end_id).astype("<u4"), bounds + np.arange(n + 1)
            lo = 0
            while lo < n:  # up to the document that fills the block
                hi = min(n, int(np.searchsorted(bounds, bounds[lo] + BLOCK_TOKENS - held)))
                hi = max(lo + 1, hi)
                keys.append(key[lo:hi])
                sizes.append(np.diff(bounds[lo : hi + 1]))
                ids.append(found[bounds[lo] : bounds[hi]])
                held += int(bounds[hi] - bounds[lo])
                lo = hi
                if held >= BLOCK_TOKENS:
                    yield block()
                    keys, sizes, ids, held = [], [], [], 0
    if keys:
        yield block()


def balanced_plan(lengths: list[int], size: int, linear: float = 1.0, quadratic: float | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` that fill as many
    sequences of ``size`` as the tokens allow, and the rest in sequences whose
    lengths are powers of two, so that none needs padding.

    Documents come in descending order of length, each whole where a sequence
    has the room; else it is cut where the cheapest open sequence ends, and what
    is left of it queues again by its length.  A document longer than a sequence
    is first cut into full ones."""
    quadratic = 1.0 / size if quadratic is None else quadratic
    total = sum(lengths)
    rooms = [size] * (total // size) + [1 << i for i in range((total % size).bit_length() - 1, -1, -1) if total % size >> i & 1]
    free, cost = np.array(rooms, np.int64), np.zeros(len(rooms))
    used = np.zeros(len(rooms), np.int64)
    queue = [(-min(n - s, size), d, s) for d, n in enumerate(lengths) for s in range(0, n, size)]
    heapq.heapify(queue)
    out = []
    while queue:
        n, d, s = heapq.heappop(queue)
        n = -n
        open_ = np.flatnonzero(free >= n)
        if not len(open_):
            open_ = np.flatnonzero(free)
        at = int(open_[np.argmin(cost[open_])])
        take = min(n, int(free[at]))
        out.append((d, s, take, at, int(used[at])))
        free[at] -= take
        used[at] += take
        cost[at] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(queue, (take - n, d, s + take))
    return out


class CapacityTree:
    """Which capacities have an open sequence; the least one that is enough is
    found in a number of steps logarithmic in the largest capacity."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.any = [False] * (2 * self.width)
        self.held: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, item: int) -> None:
        self.held[capacity].append(item)
        at = capacity + self.width
        while at and not self.any[at]:
            self.any[at] = True
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, item) of the least capacity >= ``least``."""
        at = least + self.width
        if at >= 2 * self.width:
            return None
        while not self.any[at]:
            while at & 1:
                at >>= 1
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:
                return None
        while at < self.width:
            at = 2 * at + (not self.any[2 * at])
        capacity = at - self.width
        item = self.held[capacity].pop()
        if not self.held[capacity]:
            self.any[at] = False
            at >>= 1
            while at and self.any[at] and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = False
                at >>= 1
        return capacity, item


def best_fit_plan(lengths: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)``: documents longer
    than a sequence are cut into full ones and a rest, then all pieces, longest
    first, each go whole to the open sequence with the least room that is enough,
    or open a new one."""
    pieces = sorted((-min(n - s, size), d, s) for d, n in enumerate(lengths) for s in range(0, n, size))
    tree, opened, out = CapacityTree(size), 0, []
    for n, d, s in pieces:
        n = -n
        room, at = tree.take(n) or (size, opened)
        opened += at == opened
        out.append((d, s, n, at, size - room))
        if room > n:
            tree.put(room - n, at)
    return out


def _prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def pack_balanced(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 2, path: str | None = None,
    linear: float = 1.0, quadratic: float | None = None, with_ids: bool = False,
) -> DataFrame:
    """Cost-balanced packing of all documents.

    One row per piece: ``doc_id``, ``start`` (ids of its document before it),
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``; with
    ``with_ids`` also ``ids``, the piece's ids as little-endian unsigned 32-bit
    integers.  No sequence is longer than ``size``; shorter ones have a power of
    two as length, so nothing is padded.

    A null or empty text is a document of the end id alone.  Null and repeated
    keys are allowed: every row is a document.  An empty table gives an empty
    table; other columns are ignored."""
    path = path or default_words()

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        for keys, bounds, ids in _blocks(batches, path, end_id):
            lengths = np.diff(bounds)
            plan = np.array(balanced_plan(lengths.tolist(), size, linear, quadratic), np.int64)
            doc, start, length, sequence, offset = plan.T
            begins = (bounds[doc] + start).tolist()
            cut = [ids[at : at + n] for at, n in zip(begins, length.tolist())]
            columns = [
                pa.array([keys[d] for d in doc.tolist()], pa.int64()),
                pa.array(start),
                pa.array(length),
                pa.array(map(zlib.crc32, cut), pa.int64()),
                pa.array(lengths[doc]),
                pa.array(first + sequence),
                pa.array(offset),
            ]
            first += int(sequence.max()) + 1
            if with_ids:
                columns.append(pa.array([x.tobytes() for x in cut], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{n} long" for n in names) + ", ids binary" * with_ids
    return _prepared(df, key, text).mapInArrow(run, schema)


def pack_best_fit(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 2, pad_id: int = 0, path: str | None = None
) -> DataFrame:
    """Best-fit-decreasing packing of all documents into a matrix of ids.

    One row per sequence: ``sequence_id``, ``n_tokens``, ``n_padding``,
    ``doc_ids`` and ``starts`` (of its pieces: the document, and the ids of it
    that stand before the piece), ``cu_seqlens`` (cumulative lengths of its
    segments from 0, the padding not among them), ``position_resets`` (where
    positions start again from 0: each segment's first place, and the padding's)
    and ``ids``, a row of ``size`` little-endian unsigned ids, of 16 bits each if all
    ids of the vocabulary, ``end_id`` and ``pad_id`` fit, else of 32.

    Documents longer than ``size`` are cut without loss.  A null or empty text
    is a document of the end id alone; null and repeated keys are allowed; an
    empty table gives an empty table; other columns are ignored."""
    path = path or default_words()

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        kind = id_type(path, end_id, pad_id)
        for keys, bounds, ids in _blocks(batches, path, end_id):
            plan = best_fit_plan(np.diff(bounds).tolist(), size)
            plan.sort(key=lambda p: (p[3], p[4]))
            n_seq = plan[-1][3] + 1
            matrix = np.full((n_seq, size), pad_id, kind)
            docs, starts, ends = [[] for _ in range(n_seq)], [[] for _ in range(n_seq)], [[0] for _ in range(n_seq)]
            begins = bounds.tolist()
            for d, s, n, q, o in plan:
                matrix[q, o : o + n] = ids[begins[d] + s : begins[d] + s + n]
                docs[q].append(keys[d])
                starts[q].append(s)
                ends[q].append(o + n)
            for lo in range(0, n_seq, 1024):
                part = slice(lo, min(lo + 1024, n_seq))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(first + part.start, first + part.stop), pa.int64()),
                        pa.array([e[-1] for e in ends[part]], pa.int32()),
                        pa.array([size - e[-1] for e in ends[part]], pa.int32()),
                        pa.array(docs[part], pa.list_(pa.int64())),
                        pa.array(starts[part], pa.list_(pa.int64())),
                        pa.array(ends[part], pa.list_(pa.int32())),
                        pa.array([e if e[-1] < size else e[:-1] for e in ends[part]], pa.list_(pa.int32())),
                        pa.array([row.tobytes() for row in matrix[part]], pa.binary()),
                    ],
                    ["sequence_id", "n_tokens", "n_padding", "doc_ids", "starts", "cu_seqlens", "position_resets", "ids"],
                )
            first += n_seq

    return _prepared(df, key, text).mapInArrow(
        run,
        "sequence_id long, n_tokens int, n_padding int, doc_ids array<long>, starts array<long>, "
        "cu_seqlens array<int>, position_resets array<int>, ids binary",
    )


def id_type(path: str, *others: int) -> str:
    """The kind of number that holds every id of the vocabulary and ``others``."""
    if min(others, default=0) < 0:
        raise ValueError("ids must not be negative")
    return "<u2" if max(word_ids(path).largest, *others) < 1 << 16 else "<u4"


def write_packed(df: DataFrame, path: str, **options) -> None:
    """Pack the documents of ``df`` and write the matrix as Parquet under ``path``.

    Nulls, repeated rows and other columns are as for ``pack_best_fit``; an empty
    table writes an empty one."""
    pack_best_fit(df, **options).write.parquet(path)


def read_matrix(rows, size: int) -> np.ndarray:
    """The id matrix of some collected rows of a packed table of one id width."""
    held = [bytes(r["ids"]) for r in rows]
    return np.frombuffer(b"".join(held), f"<u{len(held[0]) // size}" if held else "<u2").reshape(-1, size)
