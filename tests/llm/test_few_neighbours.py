import numpy as np

from echoframe.llm.neighbours import nearest


def lists(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = {}
    for r in nearest(df, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return got


def test_fewer_candidates_than_k_are_all_returned(spark):
    rng = np.random.default_rng(1)
    for n in (12, 23):
        ids = [20 * i for i in range(n)]
        got = lists(spark, [(i, rng.standard_normal(8).tolist()) for i in ids], k=20)
        assert set(got) == set(ids)
        assert all(len(got[i]) == min(20, n - 1) and i not in got[i] for i in ids)


def test_a_small_budget_still_fills_the_lists(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (10 * np.eye(8)[i % 8] + rng.standard_normal(8)).tolist()) for i in range(400)]
    rows += [(i, rng.standard_normal(8).tolist()) for i in range(0, 80)]  # ids with two vectors
    got = lists(spark, rows, k=20, query_every=20, leaf_rows=8, trees=2, recall=0.01)
    assert len(got) == 20 and all(len(x) == 20 for x in got.values())
