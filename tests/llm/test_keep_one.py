from echoframe.llm.jaccard import keep_one


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def test_rows_are_told_apart_by_more_than_their_id(spark):
    near = words("a", 39) + " other"
    rows = [(5, words("r"))] * 3  # repeated rows are one document
    rows += [(None, words("n"))] * 4  # and so are those of a null id
    rows += [(None, words("m")), (3, words("m"))]  # a null id comes last
    rows += [(1, words("a")), (2, near), (2, words("clean"))]  # id 2 is near id 1 with one of its texts only
    rows += [(7, ""), (7, ""), (None, None)]  # no n-grams: classes of their own
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string").repartition(3)
    got = keep_one(df)
    assert got.columns == df.columns
    want = [(5, words("r")), (None, words("n")), (3, words("m")), (1, words("a")), (2, words("clean")), (7, ""), (7, ""), (None, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_columns_of_any_name_are_carried(spark):
    rows = [(1, words("a"), 77, "x", 5, 0, "q"), (2, words("a"), 88, "y", 6, 1, "r"), (3, words("b"), 99, "z", 7, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, `a.b` string, number int, c0 int, `t``k` string")
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
    named = df.toDF("k.x", "the text", "doc_id", "text_hash", "set_key", "component", "ROW")
    assert sorted(map(tuple, keep_one(named, "k.x", "the text").collect())) == [rows[0], rows[2]]
    assert keep_one(df.limit(0)).collect() == []
