import hashlib
import re

from echoframe.llm.infilling import fill_in_middle, infilling_digests, restored
from pyspark.sql import functions as F

TEXTS = [
    "", None, "a", " ", "abc def", "héllo wörld, 12\n\r\t", "\x01", "\x02", "\x01\x02\x01a\x020b\x021", "x<P>y", "<S>", "a<M", "<<S>>", "<P", "<S<M", ">", "a" * 5000, " b" * 3000,
    "\U0001f600a\U0001f600\U0001f600b", "$1 \\1 ${x} '", "\\u0001", "a b\u0085c", "é" * 200, "<" * 50, "<S " * 40, "M>" * 30, "0" * 100, "\x021" * 9,
]


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_units_in_python(spark):
    rows = [(None if i % 97 == 5 else i, TEXTS[i % len(TEXTS)], "x", i) for i in range(20 * len(TEXTS))]
    rows += rows[:5]  # repeated rows give repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, `_n.x` int").repartition(3)
    made = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    want = sorted(((i, t or "", *brute(i, t)) for i, t, _, _ in rows), key=str)
    assert got == want
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert made.where("back <> text").count() == 0
    h = {(r.doc_id, r.output_sha256) for r in infilling_digests(df).collect()}
    assert h == {(i, hashlib.sha256(o.encode()).hexdigest()) for i, _, _, _, _, _, o in got}


def test_names_long_texts_and_empty_table(spark):
    df = spark.createDataFrame([(3, "word, " * 200_000), (4, "é" * 300_000)], "`k.x` long, `text y` string")
    got = {r.doc_id: (r.n, r.form, r.output) for r in fill_in_middle(df, "k.x", "text y").collect()}
    for i, text in ((3, "word, " * 200_000), (4, "é" * 300_000)):
        n, form, _, _, output = brute(i, text)
        assert got[i] == (n, form, output)
    assert infilling_digests(df.limit(0), "k.x", "text y").count() == 0


def test_no_python_in_the_plan(spark, sf):
    df = infilling_digests(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
