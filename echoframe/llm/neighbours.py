"""Approximate nearest neighbours by largest inner product.

A forest of random-projection trees is fitted on a bounded sample; every row is
then sent down each tree.  A query goes down all trees at once with one priority
queue: the leaf that is nearest, by the margins at which its path leaves the
query's own, is opened next, whichever tree it is in, until enough rows have
been reached.  All rows of the opened leaves are scored exactly.

How much is enough is measured, not guessed: a small sample of queries is
searched by brute force over all rows, and the budget is the share of rows
that the queue had to reach for the recall wanted.

Inner products are turned into angles by one more coordinate, sqrt(M^2 - |x|^2),
for rows and 0 for queries (Neyshabur and Srebro, 2015); only the trees see it.
Equal vectors are one entry, of which the smallest ids are kept, as many as a
result can hold, so that a vector with a third of all rows is one row of a leaf.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize

SAMPLE = 32_768  # rows that the forest is fitted on, at most about
GROUP_ROWS = 65_536  # rows that a task scores at once, about
GROUP_QUERIES = 65_536  # queries that a task answers at once, about
PROBES = 128  # queries that are searched by brute force to set the budget


@dataclass
class Forest:
    """Per tree one direction a level, and a threshold for every inner node; of
    bounded size, since no tree has more leaves than the sample has rows."""

    directions: np.ndarray  # dimensions x (trees * depth)
    thresholds: list[list[np.ndarray]]  # by tree and level
    largest: float  # norm

    @property
    def trees(self) -> int:
        return len(self.thresholds)

    @property
    def depth(self) -> int:
        return len(self.thresholds[0])

    def projections(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.largest**2 - (x * x).sum(1)))
        return np.hstack([x, extra[:, None]]) @ self.directions

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Rows x trees."""
        p = self.projections(x, False)
        out = np.zeros((len(x), self.trees), np.int32)
        for t, levels in enumerate(self.thresholds):
            for d, cut in enumerate(levels):
                out[:, t] = 2 * out[:, t] + (p[:, t * self.depth + d] > cut[out[:, t]])
        return out

    def order(self, projected: np.ndarray):
        """Leaves of all trees, nearest first: (priority, tree, leaf).  One queue
        holds the open branches of every tree."""
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        heapq.heapify(queue)
        while queue:
            far, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                margin = projected[t * self.depth + level] - self.thresholds[t][level][node]
                side = int(margin > 0)
                heapq.heappush(queue, (far + margin * margin, t, level + 1, 2 * node + 1 - side))
                node, level = 2 * node + side, level + 1
            yield far, t, node


def fit_forest(sample: np.ndarray, trees: int, depth: int, largest: float, seed: int = 3) -> Forest:
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((sample.shape[1] + 1, trees * depth))
    forest = Forest(directions, [[np.zeros(1)] for _ in range(trees)], largest)
    p = forest.projections(sample, False)
    forest.thresholds = []
    for t in range(trees):
        node, levels = np.zeros(len(sample), np.int64), []
        for d in range(depth):
            v = p[:, t * depth + d]
            order = np.lexsort((v, node))
            bounds = np.searchsorted(node[order], np.arange((1 << d) + 1))
            cut = np.array([np.median(v[order[a:b]]) if b > a else 0.0 for a, b in zip(bounds, bounds[1:])])
            levels.append(cut)
            node = 2 * node + (v > cut[node])
        forest.thresholds.append(levels)
    return forest


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    return (
        df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0))
        .where(~bad & ~zero)
    )


def _top(ids: list[np.ndarray], scores: list[np.ndarray], own: int, k: int) -> tuple[list[int], list[float]]:
    """The ``k`` best of several lists, ties to smaller ids, without ``own``."""
    i, s = np.concatenate(ids), np.concatenate(scores)
    order = np.lexsort((i, -s))
    i, s = i[order], s[order]
    i, first = np.unique(i, return_index=True)
    first = np.sort(first[i != own])[:k]
    order_ids = np.concatenate(ids)[order][first]
    return order_ids.tolist(), s[first].tolist()


def _best(rows: np.ndarray, scores: np.ndarray, members: list[np.ndarray], own: int, k: int) -> tuple[list[int], list[float]]:
    """The best ids among vectors ``rows`` with ``scores``, each having ids."""
    if len(rows) > k + 1:
        bar = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
        rows, scores = rows[scores >= bar], scores[scores >= bar]
    if not len(rows):
        return [], []
    return _top([members[r] for r in rows], [np.full(len(members[r]), s) for r, s in zip(rows, scores)], own, k)


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision that depend on nothing but the two
    vectors: sums run over the components in order, whatever the block."""
    out = np.zeros((len(queries), len(rows)))
    for d in range(queries.shape[1]):
        out += queries[:, d, None] * rows[None, :, d]
    return out


def nearest(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, query_every: int = 20,
    trees: int = 12, recall: float = 0.95, leaf_rows: int = 64,
) -> DataFrame:
    """The ``k`` nearest rows found for every row whose id is divisible by
    ``query_every``: ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the
    inner product of the original vectors in double precision.

    Ties go to the smaller id; a query is not its own neighbour; with fewer than
    ``k`` candidates all are returned.  Rows whose id or vector is null, or whose
    vector is empty, zero or holds a null or non-finite component, take no part.
    Of rows with one id and one vector there is one; rows with one id and several
    vectors are candidates with each, of which the best counts, and as queries
    each asks, and the best answers are given.  Vectors of different lengths are
    an error.  An empty table gives an empty table; other columns are ignored."""
    spark = df.sparkSession
    rows = _usable(df, key, vector)
    light = materialize(rows.distinct(), "ann-rows")
    # The k + 1 smallest ids of equal vectors: no result holds more of them.
    distinct = materialize(_smallest_ids(light, k + 1), "ann-vectors")
    about = distinct.agg(
        F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("e")
    ).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not about.n:
        return spark.createDataFrame([], schema)
    if about.d != about.e:
        raise ValueError("vectors must have one length")
    n = about.n
    queries = light.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), "v")

    share = min(1.0, SAMPLE / n)
    sample = distinct.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("v").limit(2 * SAMPLE)
    sample = _vectors(sample.toArrow().column(0))
    if not len(sample):
        sample = _vectors(distinct.select("v").limit(SAMPLE).toArrow().column(0))
    depth = int(np.clip(np.ceil(np.log2(max(1, n / leaf_rows))), 1, np.log2(SAMPLE / 16)))
    while depth > 1 and len(sample) >> depth < 8:
        depth -= 1
    forest = fit_forest(sample, trees, depth, float(np.sqrt(about.m)))
    held = spark.sparkContext.broadcast(forest)

    def descend(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(held.value.leaves(_vectors(b.column(0))).tolist(), pa.list_(pa.int32()))], ["v", "ids", "leaves"]
                )

    placed = materialize(distinct.select("v", "ids").mapInArrow(descend, "v array<double>, ids array<long>, leaves array<int>"), "ann-placed")
    sizes = np.zeros((trees, 1 << depth), np.int64)
    counted = placed.select(F.posexplode("leaves").alias("t", "leaf")).groupBy("t", "leaf").agg(F.count("*").alias("n"))
    counted = counted.toArrow()  # at most trees * 2**depth rows
    sizes[counted.column(0).to_numpy(), counted.column(1).to_numpy()] = counted.column(2).to_numpy()

    budget = _budget(placed, queries, forest, sizes, k, recall, n)
    # So many vectors of one tree, which are all different, have k + 1 ids; a small table is searched whole.
    most = light.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    enough = (k + 1) * most
    enough = n if n <= 4 * enough else enough
    # Leaves of one branch are a group, so that a query's hits in it are one list.
    bits = max(0, min(depth, int(np.floor(np.log2(max(1, n / GROUP_ROWS))))))
    salts = max(1, int(np.ceil(n / (1 << bits) / GROUP_ROWS)))
    # Rows of a group are sent to each block of queries, so neither side of a task grows with the table.
    blocks = max(1, int(np.ceil(n / query_every / GROUP_QUERIES)))
    plan = spark.sparkContext.broadcast((forest, sizes, budget, enough))

    def open_leaves(batches):
        forest, sizes, budget, enough = plan.value
        for b in batches:
            out = []
            ids, vectors = b.column(0).to_pylist(), b.column(1).to_pylist()
            if not ids:
                continue
            for q, p in zip(range(len(ids)), forest.projections(np.array(vectors, float), True)):
                reached, opened, in_tree = 0, {}, [0] * forest.trees
                for _, t, leaf in forest.order(p):
                    opened.setdefault((t, leaf >> (depth - bits)), []).append(leaf)
                    reached += int(sizes[t, leaf])
                    in_tree[t] += int(sizes[t, leaf])
                    if reached >= budget and max(in_tree) >= enough:
                        break
                for (t, g), leaves in opened.items():
                    for salt in range(salts):
                        out.append((ids[q], vectors[q], t, g, salt, ids[q] // query_every % blocks, leaves))
            for lo in range(0, len(out), 4096):
                c = list(zip(*out[lo : lo + 4096]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.list_(pa.float64())), *(pa.array(x, pa.int32()) for x in c[2:6]), pa.array(c[6], pa.list_(pa.int32()))],
                    ["query_id", "v", "t", "g", "salt", "block", "leaves"],
                )

    asked = queries.mapInArrow(open_leaves, "query_id long, v array<double>, t int, g int, salt int, block int, leaves array<int>")
    held_rows = placed.select("v", "ids", F.posexplode("leaves").alias("t", "leaf")).select(
        "v", "ids", "t", "leaf", F.shiftright("leaf", depth - bits).alias("g"), F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int").alias("salt"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def score(key_, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(have):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "ids": pd.Series([], dtype=object), "scores": pd.Series([], dtype=object)})
        x = np.stack(have.v.to_numpy())
        leaf, members = have.leaf.to_numpy(), [np.asarray(i) for i in have.ids]
        order = np.argsort(leaf, kind="stable")
        ordered = leaf[order]
        found = []
        for q, v, leaves in zip(ask.query_id, ask.v, ask.leaves):
            mine = np.concatenate([order[np.searchsorted(ordered, y) : np.searchsorted(ordered, y, "right")] for y in leaves])
            rough = x[mine] @ v
            if len(mine) > 2 * k + 2:  # rounding can not lift a row over so many others that lead by this much
                bar = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
                mine = mine[rough >= bar - 1e-9 * (1 + abs(bar))]
            s = exact_scores(v[None, :], x[mine])[0]
            found.append((q, *_best(mine, s, members, q, k)))
        return pd.DataFrame(found, columns=["query_id", "ids", "scores"])

    hits = asked.groupBy("t", "g", "salt", "block").cogroup(held_rows.groupBy("t", "g", "salt", "block")).applyInPandas(
        score, "query_id long, ids array<long>, scores array<double>"
    )
    each = hits.select("query_id", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    best = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # A query's list has at most k rows from each group of leaves that it opened.
    lists = best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("l"))
    return lists.select("query_id", F.posexplode("l").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )


def _smallest_ids(rows: DataFrame, most: int) -> DataFrame:
    """(vector, its ``most`` smallest ids), summed in two steps: the first bounds
    what each of many parts of a common vector hands on."""
    part = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, most).alias("ids"))
    return part.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"))


def brute_force(placed: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """Exact results of a small, given set of queries over all rows: every task
    hands on the best of its own rows."""
    held = placed.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches):
        queries, q = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x, members = _vectors(b.column(0)), [np.array(i) for i in b.column(1).to_pylist()]
            found = [(own, *_best(np.arange(len(x)), s, members, own, k)) for own, s in zip(queries.tolist(), exact_scores(q, x))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))],
                ["query_id", "ids", "scores"],
            )

    hits = placed.select("v", "ids").mapInArrow(run, "query_id long, ids array<long>, scores array<double>")
    each = hits.select("query_id", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    best = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("l"))


def _budget(placed: DataFrame, queries: DataFrame, forest: Forest, sizes: np.ndarray, k: int, recall: float, n: int) -> int:
    """Rows, counted with repeats over trees, that the queue must reach so that
    ``PROBES`` queries find ``recall`` of their true neighbours."""
    probes = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(PROBES).toArrow()
    if not probes.num_rows:
        return 0
    ids, vectors = probes.column(0).to_numpy(), _vectors(probes.column(1))
    truth = {r.query_id: [x.vec_id for x in r.l] for r in brute_force(placed, ids, vectors, k).collect()}
    wanted = {i for l in truth.values() for i in l}
    ask = placed.sparkSession.createDataFrame([(int(i),) for i in wanted] or [(0,)], "id long")
    at = placed.select(F.explode("ids").alias("id"), "leaves").join(F.broadcast(ask), "id")  # PROBES * k rows at most
    leaves = {r.id: r.leaves for r in at.collect()}
    needs = []
    for q, p in zip(ids.tolist(), forest.projections(vectors, True)):
        reached, when = 0, {}
        for _, t, leaf in forest.order(p):
            reached += int(sizes[t, leaf])
            when[t, leaf] = reached
        needs += [min(when[t, leaf] for t, leaf in enumerate(leaves[i])) for i in truth.get(q, []) if i in leaves]
    return int(np.quantile(needs, recall, method="higher")) if needs else n
