import random

import numpy as np

from echoframe.llm.jaccard import choose_bands, keep_one, links_within, near_duplicates, ngram_set


def grams(t, n=5):
    w = (t or "").encode().split()
    if not w:
        return set()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(links[i]), len({frozenset(sets[j]) for j in links[i]} - {frozenset(sets[i])}), len(sets[i])))
    return sorted(out, key=str)


def corpus(rng, n_base=12):
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n_base):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200, 400]))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(8)):
            t = list(base)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(rng.choice([" ", "\n"]).join(t))
    return rows


def test_all_links_found(spark):
    rng = random.Random(12)
    texts = corpus(rng, 20) + [None, "", " \n", "", "a b", "a  b", "a b c", "x " * 30000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[0]), (None, "null id only here"), (None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int").repartition(4)
    got = sorted([tuple(r) for r in near_duplicates(df).collect()], key=str)
    assert got == brute(rows)
    kept = keep_one(df)
    assert kept.columns == df.columns
    want = {i: c for i, c, *_ in got}
    assert {r.doc_id for r in kept.collect()} - {None} == {c for i, c in want.items() if i == c and i is not None}


def test_blocks_of_a_large_group(spark, monkeypatch):
    import echoframe.llm.jaccard as J

    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "BUCKET", 5)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        t[rng.randrange(120)] = f"x{i}"
        t[rng.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in near_duplicates(df).collect()], key=str) == brute(rows)


def test_empty_and_parameters(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0 and keep_one(df).count() == 0
    b, r = choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= 160
    a = ngram_set("a b c d e f", 5)
    near = links_within([a, a[:1], np.array([5], np.uint64)], np.ones(3, bool), np.ones(3, bool), 0.5)
    assert near.tolist() == [[False, True, False], [True, False, False], [False, False, False]]


def test_unlike_sets_of_a_bucket(spark, monkeypatch):
    """One bucket for all sets: its first is unlike most, and paths join just the like ones."""
    import echoframe.llm.jaccard as J

    monkeypatch.setattr(J, "BUCKET", 6)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for group in range(9):
        base = rng.integers(0, 256, 60)
        for i in range(7):
            sketch = base.copy()
            sketch[rng.integers(0, 60, 6)] = rng.integers(0, 256, 6)
            key = bytes(rng.integers(0, 256, 16).tolist())
            want[key] = group
            rows.append((bytearray(key), bytearray(sketch.astype(np.uint8).tobytes()), [5, 100 + group, 200 + len(rows)]))
    sets = spark.createDataFrame(rows, "set_key binary, sketch binary, bands array<long>").repartition(3)
    root = {k: k for k in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in J._sketched(sets, 40).collect():
        a, b = bytes(r.set_key), bytes(r.root)
        assert want[a] == want[b]
        root[find(a)] = find(b)
    assert len({find(k) for k in want}) == 9


def test_least_agreement():
    import echoframe.llm.jaccard as J

    rng = np.random.default_rng(1)
    assert (rng.binomial(120, 0.8, 200_000) < J.least_agreement(120, 0.8)).mean() <= 1e-5
    assert 55 < J.least_agreement(120, 0.8) < 80 and J.least_agreement(8, 1.0) == 8


def test_sizes_that_rule_a_link_out(spark):
    """Sets inside each other, each a little larger: links reach over size classes."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[: 60 + 5 * i])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in near_duplicates(df).collect()], key=str) == brute(rows)
