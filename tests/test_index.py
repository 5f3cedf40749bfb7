"""Candidates from the rarest fingerprints against the plain join."""

import random

from pyspark.sql import functions as F

from echoframe.operators import index


def test_candidates_against_plain_counts(spark, monkeypatch):
    rng, rows, lone = random.Random(5), [], {}
    for g in range(10):
        base = [rng.randrange(60) + 1000 * (g % 6) for _ in range(rng.randrange(1, 25))]
        for i in range(rng.randrange(1, 8)):
            rows += [(100 * g + i, fp) for fp in {x if rng.random() < 0.8 or i < 3 else rng.randrange(9000) for x in base}]
    # Many fragments that share one fingerprint and little else.
    rows += [(5000 + i, fp) for i in range(40) for fp in [70_000, *range(100_000 + 10 * i, 100_010 + 10 * i)]]
    sets: dict = {}
    for rank, fp in rows:
        sets.setdefault(rank, set()).add(fp)
    written, kept_as = {}, index.materialize
    monkeypatch.setattr(index, "materialize", lambda df, name, *more: written.setdefault(name, kept_as(df, name, *more)))
    kept = spark.createDataFrame(rows, "rank long, fp long").coalesce(2)
    for least, similarity in ((1, 0), (2, 450), (1, 777)):
        want = set()
        for l in sets:
            for r in sets:
                n = len(sets[l] & sets[r])
                contained = 1000 * n // min(len(sets[l]), len(sets[r]))
                if l < r and n >= least and contained >= similarity:
                    want.add((l, r, n, 1000 * n // len(sets[l] | sets[r]), contained))
        written.clear()
        found = [tuple(x) for x in index.candidates(kept, least, similarity).collect()]
        assert len(found) == len(set(found)) and set(found) == want
        if similarity == 450:  # no pair of those is even met
            assert written["met"].where(F.greatest("x", "y") >= 5000).count() == 0


def test_fingerprints_are_counted_once(spark, monkeypatch):
    """the buckets are one shuffle, whatever asks for them; too full ones are left out on the way."""
    from echoframe.config import CloneConfig
    from echoframe.plans import detector

    rng, times = random.Random(6), []
    rows = sorted({(rank, rng.randrange(12) ** 2 // 4 + 40 * (rank % 5)) for rank in range(60) for _ in range(9)} | {(rank, 999) for rank in range(60)})
    fps = spark.createDataFrame(rows, "rank long, fp long")
    counted = index.buckets
    monkeypatch.setattr(index, "buckets", lambda df: times.append(1) or counted(df))
    config = CloneConfig(mode="exact", max_bucket_size=7)
    got = {tuple(x) for x in detector.candidate_pairs(fps, config).collect()}
    assert len(times) == 1
    plain = index.live(fps, 7)
    want = {tuple(x) for x in index.candidates(plain, config.min_shared_fingerprints, config.candidate_similarity).collect()}
    assert want and got == want and plain.count() < fps.count()
