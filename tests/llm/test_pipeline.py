import os
import sys


sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from test_jaccard import brute as near_brute  # noqa: E402
from test_rules import brute as rule_brute  # noqa: E402


def test_stages(spark, sf):
    import corpus_pipeline as P
    from echoframe.llm.quality import classify
    from echoframe.plans.scratch import materialize

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns = docs.columns
    names = [n for n, _ in P.STAGES]
    assert names == ["quality classifier", "quality rules", "n-gram Jaccard join", "packing"]
    one = materialize(P.quality_classifier(spark, docs, sf), "t1")
    good = {r.doc_id for r in classify(docs, labels).collect() if r.predicted == 1}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == good

    two = materialize(P.quality_rules(spark, one, sf), "t2")
    texts = {r.doc_id: r.text for r in one.collect()}
    kept = {r.doc_id for r in two.collect()}
    assert two.columns == columns
    for k, t in texts.items():
        n, _, _, _, rep = rule_brute(t)
        if n < 50 or 100 * rep > 50 * n:
            assert k not in kept
    assert len(kept) > 0.5 * len(texts)

    three = materialize(P.near_duplicates(spark, two, sf), "t3")
    want = {c for i, c, *_ in near_brute([(k, texts[k]) for k in kept])}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == want

    last = P.packing(spark, three, sf).collect()
    by = {}
    for r in last:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(by) == want
    for v in by.values():
        at = 0
        for s, n, total in sorted(v):
            assert s == at
            at += n
        assert at == v[0][2]


def test_odd_rows_in_every_stage(spark, tmp_path):
    """Nulls, repeated rows, long texts, clashing columns and an empty table."""
    import corpus_pipeline as P

    words = " ".join(f"word{i}" for i in range(70))
    rows = [(1, words, "en", "a", 9), (1, words, "en", "a", 9), (None, words, None, None, None), (2, None, "en", None, 1), (None, None, None, None, None), (3, "", "de", "b", 2)]
    rows += [(4, " ".join(f"long{i}" for i in range(60_000)), "en", "c", 3), (5, words + " more", "en", "c", 3)]
    schema = "doc_id long, text string, lang string, source string, n_words long"
    for name, some in (("full", rows), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None)][: len(some)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = P.run(spark, sf).collect()
        assert ({r.doc_id for r in out} == {1, 4}) if some else not out
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, step in P.STAGES[:-1]:
            assert step(spark, docs, sf).columns == docs.columns, stage
