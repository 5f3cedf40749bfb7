import zlib

import numpy as np

from echoframe.llm.quality import N_STATS, classify, isotonic, keep_quality, statistics


def test_isotonic_against_the_definition():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = rng.integers(1, 12)
        s, c = rng.integers(0, 5, n).astype(float), rng.integers(1, 6, n).astype(float)
        got = isotonic(np.arange(n), s, c)
        want = [max(min(s[a : b + 1].sum() / c[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(got, want) and (np.diff(got) >= -1e-12).all()


def test_statistics_are_finite():
    for t in ("", " ", "\n", "a", "É" * 9, "x " * 100000, "\x00\U0001f600"):
        x = statistics(t)
        assert len(x) == N_STATS and np.isfinite(x).all()


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    right = np.mean([rows[k].predicted == truth[k] for k in held])
    assert right > 0.9


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "a b", 6), (None, "", 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, score int")
    rows = classify(docs, labels).collect()
    assert len(rows) == 3 and {r.score for r in rows} == {0.5} and not [r for r in rows if r.doc_id is None][0].held_out
    assert classify(docs.limit(0), labels).count() == 0 and classify(docs, labels.limit(0)).count() == 3
    assert keep_quality(docs, labels).columns == docs.columns


def test_scores_against_plain_equations(spark):
    """Labels, features, normal equations and calibration once more, a row at a time."""
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(["good", "words", "Here"][j] if i % 3 else "x#! 99"[j::3] for j in rng.integers(0, 3, 5 + i % 40)), 1) for i in range(160)] + [(7, "again " * 9, 1), (None, None, 1)]
    labels = [(i, int(i % 3 > 0) if i % 11 else 1 - int(i % 3 > 0), 0) for i in range(160)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string, score int").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fold = lambda k: zlib.crc32(str(k).encode()) % 5
    x = {k: statistics(t) for k, t, _ in docs if k is not None and k != 7}
    rows = [(k, statistics(t), dict((a, b) for a, b, _ in labels)[k]) for k, t, _ in docs if k is not None and fold(k)]
    train, rest = [r for r in rows if fold(r[0]) > 1], [r for r in rows if fold(r[0]) == 1]
    stats = np.array([r[1] for r in train])
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    draw = np.random.default_rng(7)
    weights, phase = draw.standard_normal((N_STATS, 192)) / np.sqrt(N_STATS / 2), draw.uniform(0, 2 * np.pi, 192)

    def features(v):
        z = np.clip((np.array(v) - mean) / scale, -8, 8)
        return np.concatenate([np.cos(z @ weights + phase) * np.sqrt(2 / 192), z, [1.0]])

    a, b = np.zeros((192 + N_STATS + 1,) * 2), np.zeros(192 + N_STATS + 1)
    for _, v, y in train:
        f = features(v)
        a, b = a + np.outer(f, f), b + f * y
    ridge = np.linalg.solve(a + 1e-3 * len(train) * np.diag([1.0] * (len(b) - 1) + [1e-6]), b)
    pools = {}
    for _, v, y in rest:
        pools.setdefault(round(min(max(features(v) @ ridge, -0.5), 1.5) * 1000), []).append(y)
    at = sorted(pools)
    n = np.array([len(pools[k]) for k in at], float)
    s = np.array([sum(pools[k]) for k in at], float)
    chance = [max(min(s[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    got = {r.doc_id: r.score for r in classify(df, known).collect()}
    for k, v in x.items():
        assert abs(got[k] - np.interp(features(v) @ ridge, np.array(at) / 1000, chance)) < 1e-6


def test_repeated_rows_and_long_texts(spark):
    docs = spark.createDataFrame([(i % 9, ("fine words " * 3000 if i % 2 else "## " * 40), i) for i in range(60)] + [(5, None, 0)] * 3, "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(3, None), (3, 1)], "doc_id long, quality int")
    rows = classify(docs, labels).collect()
    assert len(rows) == 63 and all(0 <= r.score <= 1 for r in rows)
    assert keep_quality(docs, labels).columns == docs.columns
