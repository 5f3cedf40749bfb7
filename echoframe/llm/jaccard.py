"""Near-duplicate join on word n-grams: MinHash banding, then exact Jaccard.

1. Every text becomes the set of its n-gram hashes; texts with equal sets are one
   *set* from there on, with a count of its copies.
2. MinHash values are cut in bands; sets that share a band share a bucket.  Band
   and row counts follow from the threshold and the recall wanted.
3. Within buckets, sketches (a byte of each MinHash value) tell chance meetings from
   near sets: every member is held against the bucket's first, and the few that
   are unlike it against all others, in blocks.  So a bucket yields a forest, not
   its pairs, and unlike sets do not chain buckets together.
4. The connected components of that are verified on full n-gram sets, in pairs of
   blocks of bounded numbers and bytes, dealt over the tasks.  Sets whose sizes
   rule a link out do not meet.  Links are counted in the tasks; of a block's
   links only a spanning forest leaves it.
5. Connected components of those links are the classes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.scratch import materialize
from .words import hashed_words, text_slices

BLOCK, BLOCK_BYTES = 128, 1 << 25  # on either side of a pair of blocks of n-gram sets, about
BUCKET = 256  # sketches on either side of a pair of blocks, about


def choose_bands(threshold: float, recall: float, most_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): as many rows as the hashes allow, so that few dissimilar
    sets meet, with a pair at the threshold meeting with probability ``recall``."""
    best = None
    for rows in range(1, 17):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if miss > 0 else 1
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding within so many hashes reaches this recall")
    return best


def grams_of(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text of words with hashes
    ``h``.  A text of fewer than ``n`` words has one n-gram, all its words; a text
    without words has none."""
    if not len(h):
        return np.empty(0, np.uint64)
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            mixed = (mixed ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The n-gram sets of texts, whose words are what ASCII white space parts."""
    h, bounds = hashed_words(texts, None)
    return [grams_of(h[a:b], n) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def ngram_set(text: str, n: int) -> np.ndarray:
    return ngram_sets(pa.array([text], pa.string()), n)[0]


def minhash_bands(grams: np.ndarray, bands: int, rows: int, seed: int = 1) -> tuple[np.ndarray, bytes]:
    """One 64-bit hash for each band of the set's MinHash values, and the values' low
    bytes."""
    rng = np.random.default_rng(seed)
    k = bands * rows
    mul = (rng.integers(0, 1 << 31, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
    add = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
    low = np.full(k, 0xFFFFFFFF, np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 2048):
            v = x[at : at + 2048, None] * mul[None, :] + add[None, :]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x85EBCA6B)
            low = np.minimum(low, v.min(axis=0))
        h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in low.reshape(bands, rows).T.astype(np.uint64):
            h = (h ^ r) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
    return h.astype(np.int64), low.astype(np.uint8).tobytes()


def least_agreement(hashes: int, threshold: float, miss: float = 1e-6) -> int:
    """The number of equal MinHash values that a pair at the threshold falls short of
    with a probability of at most ``miss``."""
    below = 0.0
    for k in range(hashes + 1):
        below += math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if below > miss:
            return k
    return hashes


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (one of ``left``, one of ``right``; flags) have a Jaccard
    similarity of ``threshold`` or more, as a symmetric matrix."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.concatenate([[True], grams[1:] != grams[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    held = shared[column]
    column, owner = number[column[held]], owner[held]
    common = np.zeros((n, n), np.float32)
    width = max(1, min(16384, (1 << 24) // n, int(shared.sum())))
    for at in range(0, int(shared.sum()), width):  # columns are in order, so each slice is a range
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    near = (common >= threshold * union - 1e-6) & (common > 0)
    np.fill_diagonal(near, False)
    return near & ((left[:, None] & right[None, :]) | (right[:, None] & left[None, :]))


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row the first row that it is linked to, by whatever path."""
    root = np.arange(len(near))
    seen = np.zeros(len(near), bool)
    for i in range(len(near)):
        if seen[i]:
            continue
        front = np.zeros(len(near), bool)
        front[i] = True
        while front.any():
            seen |= front
            root[front] = i
            front = near[front].any(axis=0) & ~seen
    return root


def _signatures(df: DataFrame, key: str, text: str, n: int, bands: int, rows: int, number: list[str]) -> DataFrame:
    """``number``: the name of the column that numbers the rows, or nothing."""

    def run(batches):
        for whole in batches:
            for at, some in text_slices(whole.column(2)):
                b = whole.slice(at, some)
                keys, counts, found, sketches = [], [], [], []
                for grams in ngram_sets(b.column(2), n):
                    counts.append(len(grams))
                    if len(grams):
                        keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                        band, sketch = minhash_bands(grams, bands, rows)
                        found.append(band)
                        sketches.append(sketch)
                    else:
                        keys.append(None)
                        found.append(None)
                        sketches.append(None)
                made = [pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made, *b.columns[3:]], names)

    names = ["doc_id", "text_hash", "set_key", "n_grams", "bands", "sketch", *number]
    rows_in = df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *number
    )
    schema = "doc_id long, text_hash long, set_key binary, n_grams long, bands array<long>, sketch binary"
    return rows_in.mapInArrow(run, ", ".join([schema, *[f"{c} long" for c in number]]))


def _runs(batches, width: int):
    """Runs of rows that agree in their first ``width`` columns, of a sorted partition."""
    held, now = [], None
    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
            if row[:width] != now and held:
                yield now, held
                held = []
            now = row[:width]
            held.append(row[width:])
    if held:
        yield now, held


def _sketched(sets: DataFrame, least: int) -> DataFrame:
    """Edges (set_key, root) between sets of one bucket whose sketches agree in
    ``least`` places or more; not all such pairs, but paths between all."""
    # Sketches stay behind until few rows are left that need them.
    member, sketches = sets.select("set_key", F.explode("bands").alias("band")), sets.select("set_key", "sketch")
    bucket = member.groupBy("band").agg(F.min("set_key").alias("root"), F.count("*").alias("n")).where("n > 1")
    bucket = materialize(bucket, "ngram-buckets")
    star = materialize(member.join(bucket, "band").where("set_key <> root"), "ngram-stars")

    def against_first(batches):
        for b in batches:
            like = [int((x == y).sum()) >= least for x, y in zip(_bytes(b.column(2)), _bytes(b.column(3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(like, pa.bool_())], ["set_key", "root", "like"])

    pairs = star.select("set_key", "root").distinct().join(sketches, "set_key").join(sketches.select(F.col("set_key").alias("root"), F.col("sketch").alias("root_sketch")), "root")
    pairs = pairs.select("set_key", "root", "sketch", "root_sketch").mapInArrow(against_first, "set_key binary, root binary, like boolean")
    pairs = materialize(pairs, "ngram-star-pairs")

    # Members that are unlike the first meet all others of their bucket, in blocks.
    rest = star.join(pairs.where("not like").select("set_key", "root"), ["set_key", "root"]).select("band", "set_key", "n")
    rest = materialize(rest, "ngram-rest")
    blocks = lambda n: F.ceil(n / BUCKET).cast("int")
    sizes = materialize(rest.groupBy("band").agg(blocks(F.count("*")).alias("asking"), blocks(F.max("n")).alias("answering")), "ngram-rest-sizes")
    place = lambda n: F.pmod(F.xxhash64("set_key"), F.col(n)).cast("int")
    every = member.join(sizes, "band").join(rest.select("band", "set_key", F.lit(True).alias("asks")), ["band", "set_key"], "left").join(sketches, "set_key")
    # i is the block of those that ask, j that of those that answer; who asks is in both.
    ask = every.where("asks").select("band", "set_key", "sketch", F.lit(True).alias("asks"), place("asking").alias("i"), F.explode(F.sequence(F.lit(0), F.col("answering") - 1)).alias("j"))
    answer = every.select("band", "set_key", "sketch", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("i"), place("answering").alias("j"))
    dealt = ask.unionByName(answer).select("band", "i", "j", "set_key", "asks", "sketch").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def among(batches):
        for _, rows in _runs(batches, 3):
            asks = [r for r in rows if r[1]]
            keys, x = [r[0] for r in rows], np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
            root = np.arange(len(keys))
            number = {k: i for i, k in reversed(list(enumerate(keys)))}  # a set that asks and answers is one
            for k, _, sketch in asks:
                like = (x == np.frombuffer(sketch, np.uint8)).sum(axis=1) >= least
                mine = np.unique(root[[number[keys[i]] for i in np.flatnonzero(like)] + [number[k]]])
                root[np.isin(root, mine)] = mine[0]
            joined = [(keys[i], keys[root[i]]) for i in set(number.values()) if root[i] != i]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in joined], pa.binary()) for i in (0, 1)], ["set_key", "root"])

    more = dealt.mapInArrow(among, "set_key binary, root binary")
    return pairs.where("like").select("set_key", "root").unionByName(more).distinct()


def _bytes(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in column.to_pylist()]


def _with_grams(found: DataFrame, n: int) -> DataFrame:
    """``found`` with the texts' n-gram sets as bytes in place of the texts, made once,
    before a set is sent to its pairs of blocks.  Repeated rows are one set; a task
    hands each on once."""

    def run(batches):
        seen: set[bytes] = set()
        for whole in batches:
            for at, some in text_slices(whole.column(whole.num_columns - 1)):
                b = whole.slice(at, some)
                keys = b.column(0).to_pylist()
                fresh = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
                b = b.take(pa.array(fresh, pa.int32()))
                grams = [x.tobytes() for x in ngram_sets(b.column(b.num_columns - 1), n)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(grams, pa.binary())], names)

    names = ["set_key", "copies", "component", "size_class", "block", "blocks", "blocks_above", "blocks_below", "grams"]
    schema = "set_key binary, copies long, component binary, size_class int, block int, blocks int, blocks_above int, blocks_below int, grams binary"
    return found.select(*names[:-1], "text").mapInArrow(run, schema)


def _dealt(sets: DataFrame) -> DataFrame:
    """Sets sent to all pairs of blocks that they are in.  A block is of one component
    and one class of sizes; blocks meet within their class and the next."""
    here = F.col("size_class")
    own = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(here.alias("low"), F.least("block", o).alias("i"), here.alias("high"), F.greatest("block", o).alias("j"))
    )
    none = F.array().cast("array<struct<low:int,i:int,high:int,j:int>>")
    above = F.when(F.col("blocks_above") > 0, F.transform(F.sequence(F.lit(0), F.col("blocks_above") - 1), lambda o: F.struct(here.alias("low"), F.col("block").alias("i"), (here + 1).alias("high"), o.alias("j"))))
    below = F.when(F.col("blocks_below") > 0, F.transform(F.sequence(F.lit(0), F.col("blocks_below") - 1), lambda o: F.struct((here - 1).alias("low"), o.alias("i"), here.alias("high"), F.col("block").alias("j"))))
    pairs = F.explode(F.concat(own, F.coalesce(above, none), F.coalesce(below, none))).alias("p")
    out = sets.select("component", "size_class", "block", "set_key", "copies", "grams", pairs)
    key = ["component", "low", "i", "high", "j"]
    return out.select("component", "p.low", "p.i", "p.high", "p.j", "size_class", "block", "set_key", "copies", "grams").repartition(*key).sortWithinPartitions(*key)


def _verified(sets: DataFrame, threshold: float) -> DataFrame:
    """One row for each set and pair of blocks: its links across and its root."""

    def run(batches):
        for (_, low, i, high, j), rows in _runs(batches, 5):
            rows = list({r[2]: r for r in rows}.values())  # a repeated row of the table is one set
            block = [(r[0], r[1]) for r in rows]
            left, right = (np.array([b == side for b in block]) for side in ((low, i), (high, j)))
            near = links_within([np.frombuffer(r[4], np.uint64) for r in rows], left, right, threshold)
            root, copies = _forest(near), np.array([r[3] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[2] for r in rows], pa.binary()),
                    pa.array([rows[k][2] for k in root], pa.binary()),
                    pa.array(near.sum(axis=1), pa.int64()),
                    pa.array(near @ copies, pa.int64()),
                ],
                ["set_key", "root", "n_near", "n_near_docs"],
            )

    return sets.mapInArrow(run, "set_key binary, root binary, n_near long, n_near_docs long")


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999
) -> DataFrame:
    """One row per document: ``doc_id``; ``class_id``, the smallest id among all
    documents reachable by links; ``n_links``, how many other documents are
    linked to it; ``n_near_texts``, how many different n-gram sets those are
    besides its own; ``n_grams``, the size of its own set.

    Two documents are linked if the Jaccard similarity of their word n-gram sets
    is ``threshold`` or more.  A text of fewer than ``n`` words has one n-gram, all
    its words.  A null, empty or blank text has no n-grams, links to nothing and
    is its own class.  Repeated rows are copies of each other.  Rows with a null
    id take part like any others; a class of such rows only has a null id.  An
    empty table gives an empty one; other columns are ignored."""
    docs, classes = _classed(df, key, text, n, threshold, recall)
    classes = classes.withColumn("first_id", F.col("of.doc_id"))
    first = classes.groupBy("component").agg(F.min("first_id").alias("class_id"))
    by_set = classes.join(first, "component").select(
        "set_key",
        "class_id",
        (F.col("copies") - 1 + F.coalesce("n_near_docs", F.lit(0))).alias("n_links"),
        F.coalesce("n_near", F.lit(0)).alias("n_near_texts"),
    )
    return docs.select("doc_id", "set_key", "n_grams").join(by_set, "set_key", "left").select(
        "doc_id",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_near_texts", F.lit(0)).alias("n_near_texts"),
        "n_grams",
    )


def _classed(
    df: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, number: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and the sets with their classes: ``set_key``, ``of`` (its
    first row, by id and then by ``number``), ``copies``, ``component``, ``n_near``
    and ``n_near_docs``."""
    bands, rows = choose_bands(threshold, recall)
    numbers = [number] if number else []
    docs = materialize(_signatures(df, key, text, n, bands, rows, numbers), "ngram-signatures")
    chosen = F.struct(F.isnull("doc_id").alias("none"), "doc_id", *numbers, "text_hash")
    sets = materialize(
        docs.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.min(chosen).alias("of"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"), F.min("sketch").alias("sketch")),
        "ngram-sets",
    )
    edges = _sketched(sets, least_agreement(bands * rows, threshold))
    candidates = materialize(connected_components(edges, "set_key", "root"), "ngram-candidates")

    # Sets whose sizes differ by more than a class can not reach the threshold.
    step = max(-math.log(threshold) * (1 + 1e-9), 1e-6)
    placed = candidates.join(sets.select(F.col("set_key").alias("node"), "of", "copies", "n_grams"), "node").withColumn(
        "size_class", F.floor(F.log("n_grams") / step).cast("int")
    )
    placed = materialize(placed, "ngram-placed")
    sizes = placed.groupBy("component", "size_class").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_grams") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    sizes = materialize(sizes, "ngram-blocks")
    near = lambda by, name: sizes.select("component", (F.col("size_class") + by).alias("size_class"), F.col("blocks").alias(name))
    at = ["component", "size_class"]
    around = sizes.join(near(-1, "blocks_above"), at, "left").join(near(1, "blocks_below"), at, "left").fillna(0)
    placed = placed.join(around, at).select(
        *at, "blocks", "blocks_above", "blocks_below", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.col("node").alias("set_key"), "copies",
        F.col("of.doc_id").alias("doc_id"), F.col("of.text_hash").alias("text_hash"),
    )
    source, body = F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")
    texts = df.select(source.alias("d"), F.xxhash64(body).alias("h"), F.coalesce(body, F.lit("")).alias("text"))
    found = placed.join(texts, placed.doc_id.eqNullSafe(texts.d) & (placed.text_hash == texts.h))
    dealt = _dealt(_with_grams(found, n))
    checked = materialize(_verified(dealt, threshold), "ngram-links")
    links = checked.groupBy("set_key").agg(F.sum("n_near").alias("n_near"), F.sum("n_near_docs").alias("n_near_docs"))
    joined = connected_components(checked.where("set_key <> root"), "set_key", "root")
    classes = (
        sets.select("set_key", "of", "copies")
        .join(joined.select(F.col("node").alias("set_key"), "component"), "set_key", "left")
        .join(links, "set_key", "left")
        .withColumn("component", F.coalesce("component", "set_key"))
    )
    return docs, materialize(classes, "ngram-classes")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class of near-duplicates, columns as before: that of the
    smallest id, null ids last, and of rows with that id any one.  Rows are told
    apart by a number that is written with them, so an id may occur more than
    once, and repeated rows are copies of which one stays.  Texts without n-grams, null
    ones among them, are their own class and stay.  Columns are carried under names of
    their places, so theirs may be any; an empty table gives an empty one."""
    lower = [c.lower() for c in df.columns]
    own = lambda c: f"c{df.columns.index(c) if c in df.columns else lower.index(c.lower())}"
    carried = [f"c{i}" for i in range(len(df.columns))]
    rows = materialize(df.toDF(*carried).withColumn("number", F.monotonically_increasing_id()), "ngram-rows")
    docs, classes = _classed(rows, own(key), own(text), number="number", **options)
    first = classes.groupBy("component").agg(F.min("of").alias("first"))
    stays = classes.join(first, "component").select("set_key", F.col("first.number").alias("stays"))
    gone = docs.select("set_key", "number").join(stays, "set_key").where("number <> stays").select("number")
    return rows.join(materialize(gone, "ngram-gone"), "number", "left_anti").select(*carried).toDF(*df.columns)
