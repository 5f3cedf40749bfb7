"""Centroid clustering (Lloyd's rounds) by Exponion search.

Newling and Fleuret, "Fast k-means with accurate bounds" (2016): every vector keeps an
upper bound of the distance to its own centroid and a lower bound of the distance to
any other.  After the centroids moved, the bounds are widened by how far.  A vector
whose bounds still part, or that is nearer than half the way to the nearest other
centroid, stays without a look at any centroid.  Of the others, only centroids inside
a ball around the vector's own centroid can be nearest: with u the distance to it and
s that from it to its nearest other, all that matter lie within 2u + s.  Each
centroid's list of the others, sorted by distance, gives them as a prefix.

Everything is decided on exact whole numbers.  Bounds are floating-point numbers with a
margin for their rounding; a vector stays only where its bounds part *strictly*, and
the ball includes its border, so that a centroid of equal distance and smaller number
is always seen.

One round is one pass over the vectors, which carry their bounds with them as a
written table, and one sum by centroid.  Only the centroids go through the driver."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import forget, materialize

#: Components after scaling lie below this, so that squared distances of up to 2**10
#: components fit in a long.
MOST_COMPONENT, MOST_DIMENSIONS = 1 << 25, 1 << 10
#: Centroids at most: their sorted lists are k * k numbers in every worker.
MOST_CENTROIDS = 4096
#: Bounds are moved outwards by this share for each step of rounding.
SLACK = 1e-9
STATE = "key long, v array<int>, cluster int, distance long, upper double, lower double"


class Centroids:
    """Centroids as whole numbers, with what a search needs of them."""

    def __init__(self, at: np.ndarray, moved: np.ndarray | None = None):
        self.at = np.asarray(at, np.int64)
        k = len(self.at)
        self.moved = np.zeros(k) if moved is None else moved
        apart = np.stack([np.sqrt(((self.at - c) ** 2).sum(1).astype(float)) for c in self.at]) if k else np.empty((0, 0))
        np.fill_diagonal(apart, -1.0)  # itself first
        self.order = np.argsort(apart, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(apart, self.order, axis=1)
        self.nearest_other = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        # How far any but the own centroid can have moved.
        top = np.argsort(self.moved)[::-1][:2]
        self.others_moved = np.full(k, self.moved[top[0]] if k else 0.0)
        if k:
            self.others_moved[top[0]] = self.moved[top[1]] if k > 1 else 0.0

    def squared(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of the rows of ``x`` to centroids ``which``, exact."""
        out = np.empty((len(x), len(which)), np.int64)
        for i, c in enumerate(which):
            d = x - self.at[c]
            out[:, i] = np.einsum("ij,ij->i", d, d)
        return out


class Looked:
    """Counts of what a search looked at."""

    def __init__(self):
        self.distances = 0


def first_search(x: np.ndarray, centroids: Centroids, looked: Looked | None = None):
    """(cluster, squared distance, upper, lower) from all centroids."""
    d = centroids.squared(x, np.arange(len(centroids.at)))
    if looked:
        looked.distances += d.size
    return _closest(d, np.broadcast_to(np.arange(d.shape[1]), d.shape))


def _closest(d: np.ndarray, number: np.ndarray):
    """The nearest, of equally near ones that of the smallest number, and bounds."""
    best = d.min(axis=1, initial=np.iinfo(np.int64).max)
    tied = np.where(d == best[:, None], number, np.iinfo(np.int32).max)
    cluster = tied.min(axis=1).astype(np.int32)
    other = np.where(number == cluster[:, None], np.iinfo(np.int64).max, d).min(axis=1)
    second = np.where(other == np.iinfo(np.int64).max, np.inf, np.sqrt(other.astype(float)) * (1 - SLACK))
    return cluster, best, np.sqrt(best.astype(float)) * (1 + SLACK), second


def search(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids, looked: Looked | None = None):
    """As ``first_search``, from the bounds of a round before and how far the
    centroids moved since.  The distance is -1 where it was not needed."""
    cluster, distance = cluster.copy(), np.full(len(x), -1, np.int64)
    upper = (upper + centroids.moved[cluster]) * (1 + SLACK)
    lower = np.maximum(0.0, (lower - centroids.others_moved[cluster]) * (1 - SLACK))
    gate = np.maximum(lower, centroids.nearest_other[cluster] / 2 * (1 - SLACK))
    unsure = np.flatnonzero(upper >= gate)
    if not len(unsure):
        return cluster, distance, upper, lower
    own = x[unsure] - centroids.at[cluster[unsure]]
    exact = np.einsum("ij,ij->i", own, own)
    distance[unsure] = exact
    upper[unsure] = np.sqrt(exact.astype(float)) * (1 + SLACK)
    if looked:
        looked.distances += len(unsure)
    unsure = unsure[upper[unsure] >= gate[unsure]]
    old = cluster[unsure]
    for c in np.unique(old):
        mine = unsure[old == c]
        radius = (2 * upper[mine] + centroids.nearest_other[c]) * (1 + SLACK)
        reach = np.searchsorted(centroids.sorted[c], radius, side="right")
        for n in np.unique(reach):  # rows whose balls hold the same centroids
            rows = mine[reach == n]
            near = centroids.order[c][:n]
            d = centroids.squared(x[rows], near)
            if looked:
                looked.distances += d.size
            at, best, u, second = _closest(d, np.broadcast_to(near, d.shape))
            # Centroids outside of the ball are at least this far from the vector.
            outside = centroids.sorted[c][n] * (1 - SLACK) - upper[rows] if n < len(centroids.at) else np.inf
            cluster[rows], distance[rows], upper[rows], lower[rows] = at, best, u, np.maximum(0.0, np.minimum(second, outside))
    return cluster, distance, upper, lower


def whole_vectors(df: DataFrame, key: str, vector: str, dimensions: int, scale: float) -> DataFrame:
    """(key, v): vectors of the right size with only finite components, each
    floor(scale * x)."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where((F.size("v") == dimensions) & ~odd)
    scaled = F.transform("v", lambda x: F.floor(x * scale))
    wide = F.exists("s", lambda x: F.abs(x) >= MOST_COMPONENT)
    checked = F.when(wide, F.raise_error(F.lit(f"a scaled component reaches {MOST_COMPONENT}"))).otherwise(F.col("s").cast("array<int>"))
    return kept.select("key", scaled.alias("s")).select("key", checked.alias("v"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of their keys, in that order; at most
    that many rows reach the driver."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), -1 if rows else 0)


def _pass(vectors: DataFrame, centroids: Centroids, begin: bool, end: bool) -> DataFrame:
    """One assignment of all vectors; ``begin`` without bounds, ``end`` with every distance."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.int64).reshape(b.num_rows, -1)
            found = first_search(x, c) if begin else search(x, *(b.column(i).to_numpy() for i in (2, 4, 5)), c)
            cluster, distance = found[:2]
            if end and len(left := np.flatnonzero(distance < 0)):
                own = x[left] - c.at[cluster[left]]
                distance[left] = np.einsum("ij,ij->i", own, own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, found)], ["key", "v", "cluster", "distance", "upper", "lower"])

    return vectors.mapInArrow(run, STATE)


def _floored_means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count); a centroid without vectors stays."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(before.shape[1])]
    after = before.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        after[r.cluster] = [s // r.n for s in r[2:]]
    return after


def cluster_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dimensions: int = 64, scale: float = 64.0
) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): one row per vector that takes part, ``vec_id``, ``cluster``
    and ``distance`` (squared), and the final centroids as whole numbers.

    Vectors take part if they have ``dimensions`` components, none of them null or not
    finite; each component x becomes floor(scale * x).  The first centroids are the
    ``k`` vectors of the smallest hashes of their keys (of equal keys, the smaller
    vector first; a null key hashes as the empty one).  Every round assigns all vectors
    to their nearest centroid, ties to the smaller number, and moves each centroid that
    has vectors to the componentwise floor of their mean; then all are assigned again.

    Repeated rows are vectors of their own.  With fewer than ``k`` vectors there are as
    many centroids as vectors, and an empty table gives an empty one.  A scaled component
    of ``MOST_COMPONENT`` or more is an error, as its distances may not fit a long.
    Other columns are ignored, whatever their names."""
    if not 1 <= k <= MOST_CENTROIDS or not 1 <= dimensions <= MOST_DIMENSIONS:
        raise ValueError(f"k must be 1 to {MOST_CENTROIDS} and dimensions 1 to {MOST_DIMENSIONS}")
    state = materialize(whole_vectors(df, key, vector, dimensions, scale), "cluster-vectors")
    at, moved = first_centroids(state, k), None
    for turn in range(rounds + 1 if len(at) else 0):
        before, centroids = state, Centroids(at, moved)
        state = materialize(_pass(before, centroids, turn == 0, turn == rounds), "cluster-round")
        forget(before)
        if turn < rounds:
            after = _floored_means(state, at)
            moved = np.sqrt(((after - at) ** 2).sum(1).astype(float)) * (1 + SLACK)
            at = after
    if not len(at):
        state = state.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    return state.select(F.col("key").alias("vec_id"), "cluster", "distance"), at


def centroid_digests(df: DataFrame, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """``cluster_vectors`` with what its clusters add up to: ``cluster_inertia`` and
    ``inertia`` (distances summed over the cluster and over all) and
    ``centroid_sha256``, of the centroid's components with commas between them.  The
    table that is joined for it has one row per centroid, ``MOST_CENTROIDS`` at most."""
    rows, at = cluster_vectors(df, key, vector, **options)
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = [(i, s, sum(sums.values()), hashlib.sha256(",".join(map(str, at[i].tolist())).encode()).hexdigest()) for i, s in sums.items()]
    table = df.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustering_sql(k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64) -> str:
    """The same in SQL, each round against every centroid."""
    assign = """, a{r} as (
    select vec_id, v, arg_min(c, (d, c)) as c, min(d) as d from (
        select k.id, k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept k, c{r} c
    ) group by id, vec_id, v
)"""
    move = """, c{n} as (
    select c.c, coalesce(m.v, c.v) as v from c{r} c left join (
        select c, list(m order by i) as v from (
            select c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as m
            from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by c, i
        ) group by c
    ) m on m.c = c.c
)"""
    steps = "".join(assign.format(r=r) + (move.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
with kept as (
    select row_number() over () as id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
    where len(embedding) = {dimensions} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
    select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v from kept qualify row_number() over (order by sha256('1:' || vec_id), v) <= {k}
){steps}
select a.vec_id, a.c::integer as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,
    sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.c = a.c
"""
