"""Whole reports against known results."""

import random

import pytest

from echoframe.config import CloneConfig, RepositoryOptions, options_from_json
from echoframe.errors import AccuracyGateFailed, CapacityExceeded, CloneError, DuplicateFragment, InvalidConfig, InvalidFragment, InvalidOutput
from echoframe.operators.families import families_for_pairs
from echoframe.plans.accuracy import AccuracyGate
from echoframe.plans.detector import detect_files, detect_fragments, detect_repository
from echoframe.schema import FRAGMENT, ORACLE, PAIR
from test_units import by_character


def freight(weight, boxes, extra=""):
    """A small function in which two names and one more statement can differ."""
    return (
        f"pub fn freight({weight}: u32, rate: u32) -> u32 {{\n"
        f"    let mut {boxes} = {weight} / 12;\n"
        f"    if {weight} % 12 != 0 {{\n        {boxes} += 1;\n    }}\n"
        f"{extra}"
        f"    while {boxes} > 400 {{\n        {boxes} -= rate * 3;\n    }}\n"
        f"    let fee = {boxes} * rate + 250;\n"
        f"    return fee.max({weight}) - rate / 2;\n"
        "}\n"
    )


def fragment(name, text, path=None, start=0, lines=10):
    return (name, path or f"{name}.rs", "rust", text, (start, start + len(text.encode()), 1, lines))


def table(spark, rows):
    return spark.createDataFrame(rows, FRAGMENT)


FOUR = [
    fragment("a", freight("weight", "boxes")), fragment("b", freight("weight", "boxes")), fragment("c", freight("mass", "crates")),
    fragment("d", freight("mass", "crates", "    log(crates, rate);\n")),
]


def test_three_kinds(spark):
    report = detect_fragments(table(spark, FOUR))
    pairs = {(p.left.fragment_id, p.right.fragment_id): p for p in report.pairs.collect()}
    kinds = sorted(p.kind for p in pairs.values())
    assert kinds == ["type1", "type2", "type2", "type3", "type3", "type3"]
    assert pairs["a", "b"].kind == "type1" and pairs["a", "c"].kind == "type2"
    e = pairs["a", "d"].evidence
    n = len(by_character(FOUR[3][3], "rust"))
    assert e.edit_distance == 7 and e.compared_tokens == n and pairs["a", "d"].similarity == (n - 7) * 1000 // n  # log ( crates , rate ) ;
    s = report.statistics.first()
    assert s.tokens == sum(len(by_character(f[3], "rust")) for f in FOUR) and (s.candidate_pairs, s.input_fragments, s.analyzed_fragments) == (6, 4, 4)
    family = report.families.collect()
    assert len(family) == 1 and len(family[0].members) == 4 and len(family[0].pair_ids) == 6
    backwards = detect_fragments(table(spark, FOUR[::-1]))
    assert sorted(backwards.pairs.collect()) == sorted(report.pairs.collect()) and backwards.families.collect() == family


def test_modes_and_lookalikes(spark):
    exact = detect_fragments(table(spark, FOUR[:3]), CloneConfig(mode="exact"))
    assert [p.kind for p in exact.pairs.collect()] == ["type1"]
    renamed = detect_fragments(table(spark, FOUR), CloneConfig(mode="renamed"))
    assert sorted(p.kind for p in renamed.pairs.collect()) == ["type1", "type2", "type2"]

    def rows(first):
        """Statements that differ in nothing but their numbers."""
        return "pub fn fill(out: Grid) {\n" + "".join(f"    out.put(row, {first + 7 * i});\n" for i in range(25)) + "}\n"

    assert detect_fragments(table(spark, [fragment("x", rows(1)), fragment("y", rows(5000))])).pairs.count() == 0


def test_overlap_and_checks(spark):
    text = freight("weight", "boxes")
    rows = [fragment("a", text, "same.rs"), fragment("b", text, "same.rs", 10)]
    assert detect_fragments(table(spark, rows)).pairs.count() == 0
    assert detect_fragments(table(spark, rows), CloneConfig(compare_overlapping_fragments=True)).pairs.count() == 1
    with pytest.raises(InvalidConfig):
        detect_fragments(table(spark, rows), CloneConfig(candidate_similarity=900))
    with pytest.raises(DuplicateFragment):
        detect_fragments(table(spark, [rows[0], rows[0]]))
    with pytest.raises(InvalidFragment):
        detect_fragments(table(spark, [fragment(" ", text)]))
    with pytest.raises(CapacityExceeded):
        detect_fragments(table(spark, rows), CloneConfig(max_fragments=1))
    with pytest.raises(CapacityExceeded):
        detect_fragments(table(spark, rows), CloneConfig(max_tokens_per_fragment=5))
    empty = detect_fragments(table(spark, []))
    assert empty.pairs.count() == empty.families.count() == 0 and empty.statistics.first().tokens == 0


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", ".").replace("_S_", "/"), v) for k, v in texts.items()], "path string, text string")


def family_member(family, name):
    """Functions of one family differ in a name, those of two in a number."""
    return (
        f"pub fn shelf_{family}({name}: u64) -> u64 {{\n    let mut room = {family} + 3;\n    for step in list({name}) {{\n        room = room * 5 % 1009;\n"
        f"        if room == {family} {{\n            break;\n        }}\n    }}\n    room + {name} * {family}\n}}\n"
    )


def test_generated_fragments(spark):
    rows = [fragment(f"f{i}", family_member(i // 2, "depth" if i % 2 else "width"), f"lib/f{i}.rs") for i in range(600)]
    report = detect_fragments(table(spark, rows))
    found = {tuple(sorted((p.left.fragment_id, p.right.fragment_id))) for p in report.pairs.collect()}
    assert found == {tuple(sorted((f"f{i}", f"f{i + 1}"))) for i in range(0, 600, 2)}  # every planted pair and no other
    assert {p.kind for p in report.pairs.collect()} == {"type2"}


def test_files_with_renamed_functions(spark):
    def source(a, b):
        return f"pub fn total({a}: &[i64]) -> i64 {{\n    let mut {b} = 0;\n    for item in {a} {{\n        {b} += item * 31 + 7;\n        {b} = {b}.max(0);\n    }}\n    {b} + {a}.len() as i64\n}}\n"

    report = detect_files(files(spark, a__rs=source("values", "sum"), b__rs=source("items", "acc")))
    pair = report.pairs.collect()
    assert [p.kind for p in pair] == ["type2"] and report.families.count() == 1 and report.statistics.first().source_files == 2


def module(i):
    """Two parts that all modules share, with a line between them that none does."""
    head = "import { open } from 'store';\nexport async function load(key: string, tries: number) {\n  const box = await open(key);\n  if (box === null) {\n    return tries;\n  }\n"
    tail = "  for (let at = 0; at < tries; at++) {\n    box.push(at * 2);\n    box.trim();\n  }\n  box.close();\n  return box.size + tries;\n}\n"
    return head + f"  const mark{i} = {i};\n" + tail


def test_generated_files(spark):
    rows = [(f"src/m{i}.{'tsx' if i % 2 else 'ts'}", module(i)) for i in range(64)]
    report = detect_files(spark.createDataFrame(rows, "path string, text string"), CloneConfig(mode="exact"))
    pairs = report.pairs.collect()
    # Both parts of every module pair with those of the first one of its extension.
    assert len(pairs) == 2 * 2 * 31 and {p.left.path for p in pairs} == {"src/m0.ts", "src/m1.tsx"}
    assert report.statistics.first().source_files == 64


def test_copies_extensions_and_lines(spark):
    exact = CloneConfig(mode="exact")
    copies = spark.createDataFrame([(f"f{i:03}.rs", freight("weight", "boxes")) for i in range(130)], "path string, text string")
    report = detect_files(copies, exact)
    assert report.pairs.count() == 129 and report.families.count() == 1 and report.statistics.first().suppressed_exact_buckets == 0
    both = files(spark, a__ts=module(1), a__tsx=module(1))
    assert detect_files(both, exact).pairs.count() == 0
    assert detect_files(both, exact, RepositoryOptions(cross_extensions=True)).pairs.count() == 1
    one = " ".join(f"call_{i}(value);" for i in range(30))
    assert detect_files(files(spark, a__rs=one, b__rs=one), exact).pairs.count() == 0


def test_part_of_a_function(spark):
    inside = "    let first = input.alpha() + input.beta();\n    let second = first * input.gamma();\n    let third = second.max(first).min(100);\n"
    report = detect_files(files(spark, a__rs=f"fn one() {{\n{inside}    a();\n}}\n", b__rs=f"fn two(x: u8) {{\n    start(x);\n{inside}    return b(x);\n}}\n"), CloneConfig(mode="exact"))
    pair = report.pairs.collect()
    assert len(pair) == 1 and pair[0].kind == "type1" and pair[0].left.span.start_line == 2 and pair[0].left.span.end_line == 4
    assert pair[0].right.span.start_line == 3 and pair[0].left.fragment_id.startswith("a.rs#tokens:")


def test_folder(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    for name in ("__init__.py", "pkg/_b.py", "pkg/c.txt"):
        (tmp_path / name).write_text("def total(values):\n    result = 0\n    for value in values:\n        result += value * 31 + 7\n        result = max(result, 0)\n    return result + len(values)\n")
    report = detect_repository(spark, str(tmp_path), CloneConfig(mode="exact"))
    assert [(p.left.path, p.right.path) for p in report.pairs.collect()] == [("__init__.py", "pkg/_b.py")]
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    with pytest.raises(CloneError):
        detect_repository(spark, str(tmp_path))


def made_pair(a, b, name=None, kind="type1", path="selected/{}.java", lines=(2, 8)):
    place = lambda x: (path.format(x), (0, 10, *lines), x)
    return (name or f"clone:v1:pair:{a}{b}", kind, 1000, place(a), place(b), (True, True, 1, 1000, 1000, 0, 30))


def test_families_of_filtered_pairs(spark):
    rows = [made_pair("a", "b"), made_pair("b", "c"), made_pair("d", "e")]
    one = families_for_pairs(spark.createDataFrame(rows, PAIR)).collect()
    two = families_for_pairs(spark.createDataFrame(rows[::-1], PAIR)).collect()
    assert sorted(one) == sorted(two) and sorted(len(f.members) for f in one) == [2, 3]


def test_gate(spark):
    pairs = spark.createDataFrame([made_pair("a", "b"), made_pair("c", "d")], PAIR)
    rows = [("1", "selected/b.java", 1, 8, "selected/a.java", 2, 8, True, "type1"), ("2", "selected/c.java", 1, 30, "selected/d.java", 1, 8, False, None), ("3", "selected/c.java", 9, 3, "selected/d.java", 1, 8, False, "type3")]
    got = {r.scope: r for r in AccuracyGate().check(pairs, spark.createDataFrame(rows, ORACLE)).collect()}
    assert (got["overall"].tp, got["overall"].fp, got["overall"].fn, got["overall"].tn) == (1, 0, 0, 2) and got["overall"].f1 == 1000
    assert got["type3"].tn == 1 and got["type3"].precision == 1000
    with pytest.raises(AccuracyGateFailed):
        AccuracyGate().check(pairs, spark.createDataFrame([(*rows[1][:7], True, None)], ORACLE))


def test_json_options():
    config, repository = options_from_json({"mode": "renamed", "minTokens": 30, "extensions": [".RS", "py", ""], "crossExtensions": True})
    assert config.mode == "renamed" and config.min_tokens == 30 and repository.extensions == ("py", "rs") and repository.cross_extensions
    for bad in ({"minToken": 3}, {"mode": "near"}, {"minSimilarity": 2000}, {"kGram": 0}, {"kGram": True}, {"minTokens": 1}):
        with pytest.raises(InvalidConfig):
            options_from_json(bad)


LEDGER = """class Ledger:
    def __init__(self, name):
        self.name = name
        self.rows = []

    def add(self, day, amount):
        if amount == 0:
            return self
        self.rows.append((day, amount))
        self.rows.sort()
        return self

    def total(self, until):
        return sum(amount for day, amount in self.rows if day <= until)
"""


@pytest.mark.parametrize("mode, found", [("exact", {"same"}), ("renamed", {"same", "names"}), ("nearMiss", {"same", "names", "edited"})])
def test_labelled_files(spark, mode, found):
    """Three related pairs of files, one unrelated pair; the gate sees what each mode can."""
    other = LEDGER
    for a, b in (("Ledger", "Journal"), ("rows", "lines"), ("amount", "value"), ("until", "limit"), ("day", "when")):
        other = other.replace(a, b)
    add = LEDGER[LEDGER.index("    def add") : LEDGER.index("    def total")]
    edited = "class Other:\n" + add.replace("amount == 0", "amount == 0 or day is None").replace("def add", "def put")
    texts = {
        "same/a.py": LEDGER.replace("Ledger", "Book"), "same/b.py": LEDGER.replace("Ledger", "Book"), "names/a.py": LEDGER.replace("5", "6").replace("== 0", "== 17").replace("[]", "[17]"),
        "names/b.py": other.replace("== 0", "== 17").replace("[]", "[17]"), "edited/a.py": "class One:\n" + add.replace("== 0", "== 23"), "edited/b.py": edited.replace("== 0", "== 23"),
        "none/a.py": "def walk(tree):\n    for leaf in tree:\n        print(leaf, end='')\n    while tree:\n        tree = tree.parent\n    return [x ** 2 for x in range(9)]\n",
        "none/b.py": "def area(w, h):\n    if w < 0 or h < 0:\n        raise ValueError('negative')\n    half = w * h / 2\n    return {'half': half, 'whole': half * 2}\n",
    }
    report = detect_files(spark.createDataFrame(list(texts.items()), "path string, text string"), CloneConfig(mode=mode))
    linked = {(p.left.path, p.right.path) for p in report.pairs.collect()}
    assert found <= {a.split("/")[0] for a, b in linked if a.split("/")[0] == b.split("/")[0]}
    assert not any("none" in a or "none" in b for a, b in linked)
    lines = {p: t.count("\n") for p, t in texts.items()}
    labels = [(n, f"{n}/a.py", 1, lines[f"{n}/a.py"], f"{n}/b.py", 1, lines[f"{n}/b.py"], n in found, n) for n in ("same", "none")]
    got = AccuracyGate().check(report.pairs, spark.createDataFrame(labels, ORACLE)).where("scope = 'overall'").first()
    assert (got.tp, got.fp, got.fn, got.tn) == (1, 0, 0, 1)


def test_equal_pairs_are_those_of_all_candidates(spark, monkeypatch):
    """F5 F6 F7 F8 F10: equal streams first, the same pairs, with full buckets, few live fingerprints and overlaps."""
    from pyspark.sql import functions as F

    from echoframe.operators import tokens
    from echoframe.plans import detector

    rng, rows = random.Random(8), []
    word = lambda: f"w{rng.randrange(40)}"
    bases = [" ".join(word() for _ in range(rng.randrange(20, 60))) for _ in range(25)] + [" ".join(f"v{k}{i}" for i in range(n)) for k, n in enumerate((23, 24, 25, 400))]
    for b, text in enumerate(bases):
        for i in range((1, 2, 5, 9)[b % 4]):
            rows.append(fragment(f"f{b}-{i}", text.replace(" ", rng.choice((" ", "  ", "\n"))), start=rng.choice((0, 5)), path=f"p{b}-{i % 3}.rs"))
    df = table(spark, rows).repartition(3)
    config = CloneConfig(mode="exact", max_bucket_size=6)
    p = detector.prepare(detector.normalized(df), config)
    want = sorted(detector.fragment_pairs(p, detector.candidate_pairs(p.fps, config), config).collect())
    monkeypatch.setattr(tokens, "MOST_SENT", 30)
    seen = {}
    kept_as = detector.materialize
    monkeypatch.setattr(detector, "materialize", lambda d, name, *more: seen.setdefault(name, kept_as(d, name, *more)))
    assert sorted(detector.equal_pairs(detector.normalized(df), config).collect()) == want and want
    # Streams are not written for it, and only one fragment of each group is looked up.
    assert "streams" not in seen and "fingerprints" not in seen
    assert seen["own-fingerprints"].select("rank").distinct().count() <= seen["equal-streams"].agg(F.countDistinct("rep")).first()[0]
