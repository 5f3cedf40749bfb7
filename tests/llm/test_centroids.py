import hashlib
import math

import numpy as np
import pytest

from echoframe.llm.centroids import Centroids, Looked, centroid_digests, cluster_vectors, first_search, search


def brute(vectors, k, rounds):
    """Lloyd's rounds in whole numbers, every vector against every centroid."""
    start = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in vectors)[:k]
    at = [v for _, v in start]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at)) for _, v in vectors]
        if turn < rounds:
            for n in range(len(at)):
                mine = [v for (_, v), (_, m) in zip(vectors, found) if m == n]
                if mine:
                    at[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, n, d) for (i, _), (d, n) in zip(vectors, found)], at


def test_search_equals_all_centroids_and_looks_at_fewer():
    rng = np.random.default_rng(5)
    hubs = rng.integers(-400, 400, (40, 8))
    x = np.concatenate([hubs[rng.integers(0, 40, 3000)] + rng.integers(-9, 10, (3000, 8)), rng.integers(-2, 3, (500, 8))]).astype(np.int64)
    at, moved, looked = x[:40].copy(), None, Looked()
    state = None
    for turn in range(8):
        c = Centroids(at, moved)
        state = first_search(x, c) if turn == 0 else search(x, state[0], state[2], state[3], c, looked)
        d = ((x[:, None, :] - at[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()  # argmin takes the smaller number of equal ones
        own = np.sqrt(d.min(1))
        assert (state[2] >= own).all()
        d[np.arange(len(x)), state[0]] = np.iinfo(np.int64).max
        assert (state[3] <= np.sqrt(d.min(1))).all()
        after = np.array([x[state[0] == n].sum(0) // max(1, (state[0] == n).sum()) if (state[0] == n).any() else at[n] for n in range(40)])
        moved = np.sqrt(((after - at) ** 2).sum(1)) * (1 + 1e-9)
        at = after
    assert looked.distances < 0.4 * 7 * len(x) * 40


def test_ties_are_found_on_the_border_of_the_ball():
    # The vector at 10 belongs to centroid 2 at 0; centroids 0 and 1 come to 20 and 30.
    c = Centroids(np.array([[20], [30], [0]]), np.zeros(3))
    cluster, distance, _, _ = search(np.array([[10]]), np.array([2], np.int32), np.array([10.0]), np.array([10.0]), c)
    assert cluster.tolist() == [0] and distance.tolist() == [100]


def rows_of(n, d, seed):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=d)]) for i in range(n)]


def test_table_against_brute_force(spark):
    good = rows_of(300, 6, 1) + rows_of(20, 6, 1) + [(None, [0.5] * 6)] * 2 + [(901 + i, [0.25 * (i % 3), 0, 0, 0, 0, -0.015625]) for i in range(30)]
    bad = [(700, None), (701, []), (702, [0.0] * 5), (703, [1.0, None, 0, 0, 0, 0]), (704, [float("nan")] + [0.0] * 5), (705, [float("-inf")] + [0.0] * 5)]
    rows = [(i, v and list(map(lambda x: None if x is None else float(x), v)), "x", 1) for i, v in good + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, `a.b` int").repartition(3)
    for k, rounds in ((7, 3), (1, 2), (16, 0), (400, 1)):
        found, at = cluster_vectors(df, k=k, rounds=rounds, dimensions=6)
        want, centroids = brute([(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in good], k, rounds)
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
        assert at.tolist() == centroids
    digests = centroid_digests(df, k=7, dimensions=6).collect()
    want, centroids = brute([(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in good], 7, 3)
    for r in digests:
        assert r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, n, d in want if n == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_empty_few_and_wide(spark):
    df = spark.createDataFrame(rows_of(3, 4, 2), "`v.id` long, `e e` array<double>")
    assert len(centroid_digests(df, "v.id", "e e", dimensions=4).collect()) == 3
    assert centroid_digests(df.limit(0), "v.id", "e e", dimensions=4).collect() == []
    assert centroid_digests(df, "v.id", "e e", dimensions=5).collect() == []
    wide = spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a scaled component reaches"):
        cluster_vectors(wide, dimensions=1)
    with pytest.raises(ValueError):
        cluster_vectors(df, k=0)
