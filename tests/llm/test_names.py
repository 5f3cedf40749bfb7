"""Keys and texts of names that SQL would take apart."""

from echoframe.llm.bpe import encode_and_decode, encode_column
from echoframe.llm.neighbours import nearest
from echoframe.llm.rules import judge


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "`k.x` long, `a.text` string")
    assert {r.doc_id: r.n_tokens for r in encode_and_decode(df, "k.x", "a.text").collect()} == {1: 2, 2: 0}
    assert sorted(len(r.ids) for r in encode_column(df, "a.text", "ids").collect()) == [0, 2]
    assert {r.doc_id: r.n_words for r in judge(df, "k.x", "a.text").collect()} == {1: 2, 2: 0}
    assert judge(df.limit(0), "k.x", "a.text").count() == encode_and_decode(df.limit(0), "k.x", "a.text").count() == 0
    vectors = spark.createDataFrame([(20, [1.0, 0.0]), (21, [1.0, 1.0])], "`v.id` long, `e.v` array<float>")
    assert [(r.query_id, r.vec_id) for r in nearest(vectors, "v.id", "e.v", k=5, query_every=20).collect()] == [(20, 21)]
