import numpy as np
import pytest

from echoframe.llm.neighbours import fit_forest, nearest


def exact(rows, k, every):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in sorted({i for i, _ in rows if i % every == 0}):
        best = {}
        for _, v in [r for r in rows if r[0] == q]:
            for i, x in rows:
                if i != q:
                    s = 0.0
                    for a, b in zip(v, x):
                        s += a * b
                    best[i] = max(best.get(i, -1e300), s)
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def check(spark, rows, k=5, every=4, least=0.9, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = {}
    for r in nearest(df, k=k, query_every=every, **options).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = exact(rows, k, every)
    assert set(got) == {q for q in want if want[q]}
    hit = total = 0
    for q, l in got.items():
        l.sort()
        assert [x[0] for x in l] == list(range(1, len(l) + 1)) and len(l) == len(want[q])
        assert [(-s, i) for _, i, s in l] == sorted((-s, i) for _, i, s in l)
        true = {i: -s for s, i in want[q]}
        for _, i, s in l:
            total += 1
            if i in true:
                hit += 1
                assert s == pytest.approx(true[i], rel=1e-12)
    assert total == 0 or hit / total >= least
    return got


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(900)]
    check(spark, rows, k=10, every=20, leaf_rows=16)


def test_odd_rows_ties_and_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 4)).tolist()
    rows = [(i, base[i % 12]) for i in range(300)] + [(i, base[0]) for i in range(300, 700)]
    rows += [(1000, None), (None, base[1]), (1004, []), (1008, [0.0] * 4), (1012, [1.0, None, 0.0, 0.0]), (1016, [float("nan")] * 4), (1020, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(4, base[4])] * 3
    check(spark, rows, k=7, every=4, least=0.99)


def test_few_rows_and_empty(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (20, [3.0, -1.0])], every=20, least=1.0)
    check(spark, [(0, [1.0, 2.0])], every=20)
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(df).count() == 0


def test_queue_opens_every_leaf_once_and_nearest_first():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 8))
    f = fit_forest(x, 3, 4, float(np.sqrt((x * x).sum(1).max())))
    seen = list(f.order(f.projections(x[:1], True)[0]))
    assert len({s[1:] for s in seen}) == len(seen) == 3 * 16
    assert [s[0] for s in seen] == sorted(s[0] for s in seen)
