"""Report files and families of any size."""

import json
import os

from pyspark.sql import functions as F

from echoframe.operators.families import family_tables
from echoframe.plans import encode
from echoframe.plans.detector import STATISTICS, CloneReport
from echoframe.schema import PAIR
from echoframe.sources.document import write_document


def pair(i, left, right, kind="type1"):
    place = lambda n: (f'selected/{n}"é.java', (0, 10, 2, 8), f"f{n}")
    return (f"clone:v1:pair:{i:06}", kind, 1000, place(left), place(right), (True, True, 1, 1000, 1000, 0, 30))


def report_of(spark, rows):
    pairs = spark.createDataFrame(rows, PAIR).repartition(3)
    row = spark.createDataFrame([tuple(range(len(STATISTICS)))], ", ".join(f"{k} long" for k in STATISTICS))
    return CloneReport(pairs, family_tables(pairs), row)


def test_ordered_document(spark, tmp_path):
    rows = [(i, f"é{i};" if i % 5 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "n int, text string").repartition(7)
    path = str(tmp_path / "out" / "doc.txt")
    os.mkdir(tmp_path / "out")
    for _ in range(2):  # a file that is there is replaced
        write_document(df, ["n"], path, head="<", tail=">")
    assert open(path).read() == "<" + "".join(t for _, t in rows if t) + ">"
    assert os.listdir(tmp_path / "out") == ["doc.txt"]
    write_document(df.limit(0), ["n"], f"file://{path}", head="a", tail="b")
    assert open(path).read() == "ab"


def test_documents_equal_their_rows(spark, tmp_path):
    rows = [pair(i, 2 * i, 2 * i + 1 if i % 3 else 2 * i + 2, f"type{1 + i % 3}") for i in range(40)]
    report = report_of(spark, rows)
    joined = lambda df: ",".join(r.json for r in sorted(df.collect(), key=lambda r: r.id))
    pairs, families = joined(encode.json_pairs(report.pairs)), joined(encode.json_families(report.families))
    statistics = json.dumps({encode._camel(k): i for i, k in enumerate(STATISTICS)}, separators=(",", ":"))
    whole = f'{{"schema":"{encode.SCHEMA_ID}","version":1,"pairs":[{pairs}],"families":[{families}],"statistics":{statistics}}}'
    assert encode.to_json(report) == whole and len(json.loads(whole)["families"]) > 10
    log = json.loads(encode.to_sarif(report))
    assert log["runs"][0]["results"] == [json.loads(r.json) for r in sorted(encode.sarif_results(report.pairs).collect(), key=lambda r: r.id)]
    lines = encode.to_bigcloneeval(report).splitlines()
    assert lines[0] == 'selected,0"é.java,2,8,selected,2"é.java,2,8' and len(lines) == 40
    text = encode.to_text(report).splitlines()
    assert len(text) == 41 and text[-1].endswith("type1=14 type2=13 type3=13 elapsed_ms=0.000")
    assert encode.to_text(report, summary=True).count("\n") == 1
    none = json.loads(encode.to_json(report_of(spark, [])))
    assert none["pairs"] == none["families"] == []


def test_a_large_family_has_small_rows(spark):
    n = 20_000
    place = lambda c: F.struct(F.concat(F.lit("p/"), c).alias("path"), F.struct(F.lit(0).cast("long").alias("start_byte"), F.lit(9).cast("long").alias("end_byte"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line")).alias("span"), c.alias("fragment_id"))
    name = lambda c: F.lpad(c.cast("string"), 6, "0")
    pairs = spark.range(1, n).select(name(F.col("id")).alias("id"), place(name(F.lit(0))).alias("left"), place(name(F.col("id"))).alias("right"))
    f = family_tables(pairs)
    size = f.sizes.collect()
    assert [(r.n_members, r.n_pairs, r["first"].fragment_id) for r in size] == [(n, n - 1, "000000")]
    pieces = encode.family_pieces(f)
    assert pieces.agg(F.max(F.length("text"))).first()[0] < 200 and pieces.count() == 2 * n - 1 + 3
    # The id follows from what the family has, whatever the order and repeats.
    again = family_tables(pairs.union(pairs).select("id", F.col("right").alias("left"), F.col("left").alias("right")))
    assert again.sizes.first().id == size[0].id
    assert family_tables(pairs.where("id <> '000007'")).sizes.first().id != size[0].id


def test_semantic_candidates_are_verified(spark):
    """A pair too far apart in fingerprints is found only if a provider proposes it."""
    from echoframe.config import CloneConfig
    from echoframe.plans.detector import detect_fragments

    # Every third statement differs, so few k-grams are shared, but edits are few enough.
    body = lambda mark: "".join(f"    step({i});\n" if i % 2 else f"    step({i} {mark} 1);\n" for i in range(30))
    rows = [(n, f"{n}.rs", f"fn run() {{\n{body(mark)}}}\n") for n, mark in (("a", "+"), ("b", "-"))] + [("c", "c.rs", "fn other() {}\n")]
    df = spark.createDataFrame(rows, "id string, path string, text string")

    class Pairs:
        def candidates(self, fragments, limit):
            return spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "a"), ("a", "c"), ("a", "unknown")], "fragment_id string, candidate_id string")

    config = CloneConfig(candidate_similarity=790)
    assert detect_fragments(df, config).pairs.count() == 0
    shared = spark.conf.get("spark.checkpoint.dir")
    there = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    report = detect_fragments(df, config, provider=Pairs())
    # Nothing stays in the shared folder but what the report reads.
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared)) - there}
    assert left == {"pairs", "family-nodes", "family-pair-ids", "family-sizes"}
    (p,) = report.pairs.collect()
    assert (p.left.fragment_id, p.right.fragment_id, p.kind, p.evidence.shared_fingerprints) == ("a", "b", "type3", 0)
    assert report.semantic_candidates == 1 and report.statistics.first().candidate_pairs == 0
