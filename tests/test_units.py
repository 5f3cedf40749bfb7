"""Operators against small definitions of their own."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe.config import RepositoryOptions
from echoframe.errors import InvalidConfig, InvalidFragment, InvalidOutput
from echoframe.functions.ids import digest
from echoframe.functions.languages import LANGUAGES, is_keyword, language_from_path, language_named, permille
from echoframe.functions.lexing import lex
from echoframe.operators import blocks
from echoframe.operators.fingerprints import rolling, winnowed
from echoframe.operators.fragments import braced_functions, indented_functions, ranges, without_noise
from echoframe.operators.ordering import numbered
from echoframe.operators.suppress import suppress_contained
from echoframe.operators.verify import bounded_distance
from echoframe.plans.encode import bigcloneeval_rows, json_pairs, json_schema, sarif_results, uri
from echoframe.schema import PAIR


def test_languages(spark):
    names = ["a.rs", "A.GO", "x.h", "x.hxx", "x.zsh", "x.psql", "x.cjs", "x.cts", "x.pyi", "x.java", "x.cs", "x.mdx", "x.txt", ".rs", "dir.go/x", "noext"]
    want = ["rust", "go", "c", "cpp", "bash", "sql", "javascript", "typescript", "python", "java", "csharp", "markup", "text", "text", "text", "text"]
    df = spark.createDataFrame(list(zip(names, want)), "path string, want string")
    assert df.where(language_from_path(F.col("path")) != F.col("want")).count() == 0
    assert language_named(" .C++ ") == "cpp" and language_named("ts") == "typescript"
    with pytest.raises(InvalidFragment):
        language_named("cobol")
    words = spark.createDataFrame([("SELECT", "sql", True), ("SELECT", "go", False), ("select", "go", True), ("const", "java", False), ("self", "text", True), ("fn", "rust", True)], "w string, l string, k boolean")
    assert words.where(is_keyword(F.col("w"), F.col("l")) != F.col("k")).count() == 0
    p = spark.createDataFrame([(1, 0, 0), (1, 2, 500), (2, 3, 666), (9, 3, 1000), (0, 5, 0)], "a long, b long, w int")
    assert p.where(permille(F.col("a"), F.col("b")) != F.col("w")).count() == 0


OPERATORS = ">>>= >>= <<= === !== ... >= >> <= << <- => == != .. -> -- -= :: := && &= || |= ++ += ** *= // /= %= ^= ?? ?.".split()


def by_character(text, language):
    """The lexer once more, a character at a time."""
    out, i, n = [], 0, len(text)
    slashed = language not in ("python", "bash", "sql", "markup", "text")
    letter = lambda c: c.isascii() and (c.isalpha() or c in "_$") or not c.isascii() and c.isalnum()
    while i < n:
        c, j = text[i], i
        if c in " \t\n\f\r":
            i += 1
            continue
        if (language in ("python", "bash") and c == "#") or (slashed and text.startswith("//", i)) or (language == "sql" and text.startswith("--", i)):
            i = text.find("\n", i) + 1 or n
            continue
        if slashed and text.startswith("/*", i):
            depth = 0
            while i < n:
                if text.startswith("/*", i) and (language == "rust" or depth == 0):
                    depth, i = depth + 1, i + 2
                elif text.startswith("*/", i):
                    depth, i = depth - 1, i + 2
                    if not depth:
                        break
                else:
                    i += 1
            continue
        if letter(c):
            kind = "I"
            while j < n and (letter(text[j]) or text[j].isascii() and text[j].isdigit()):
                j += 1
        elif c.isascii() and c.isdigit():
            kind = "N"
            j += 1
            while j < n:
                if text[j].isascii() and (text[j].isalnum() or text[j] in "_."):
                    j += 1
                elif text[j] in "+-" and text[j - 1] in "eEpP":
                    j += 1
                else:
                    break
        elif c in "'\"`":
            kind, mark = "S", c * 3 if language == "python" and c != "`" and text.startswith(c * 3, i) else c
            j += len(mark)
            while j < n and not text.startswith(mark, j):
                j += 2 if text[j] == "\\" else 1
            j = min(n, j + len(mark) if j < n else n)
        else:
            kind = "X"
            j = i + next((len(o) for o in OPERATORS if text.startswith(o, i)), 1)
        out.append((kind, text[i:j], len(text[:i].encode()), len(text[:j].encode()), text.count("\n", 0, i) + 1, text.count("\n", 0, j) + 1))
        i = j
    return out


def test_lexer_against_characters(spark):
    rng = random.Random(11)
    alphabet = list("ab_$09.eE+-'\"`\\/#*=<>!&|?:;{} \n\t\r") + ["/*", "*/", "//", "é", "ü", "1e", '"""', "'''", "--", "≥", "\x0b", "²"]
    rows = [(i, LANGUAGES[i % 13], "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(2600)]
    rows += [(9000 + i, lang, t) for i, lang in enumerate(LANGUAGES) for t in ("", "x = '" + "a" * 200000, "'" + "\\a" * 100000 + "'", "0xE+1 1..2 3e-4", "a/*b/*c*/d*/e", "# x\r\ny // z")]
    df = spark.createDataFrame(rows, "id int, language string, text string").repartition(4)
    got = {}
    for r in lex(df, positions=True).collect():
        got.setdefault((r.id, r.text), [tuple(t) for t in r.tokens])
    for i, language, text in rows:
        assert got[i, text] == by_character(text, language), (language, text[:80])
    plain = {(r.id, r.text): [tuple(t) for t in r.tokens] for r in lex(df).collect()}
    assert all(plain[k] == [t[:2] for t in v] for k, v in got.items())


def test_winnowing():
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(6) for _ in range(rng.randrange(40))]
        k, w = rng.randrange(1, 6), rng.randrange(1, 5)
        h = [sum((ids[i + j] + 1) * pow(1099511628211, k - 1 - j, 1 << 64) for j in range(k)) % (1 << 64) for i in range(len(ids) - k + 1)]
        assert rolling(np.array(ids), k).tolist() == h
        assert winnowed(np.array(ids), k, w).tolist() == sorted({min(h[i : i + w]) for i in range(len(h) - w + 1)})


def test_bounded_distance(spark):
    rng = random.Random(4)
    rows = [([1, 2, 3], [1, 4, 3], 1), ([1, 2, 3], [1, 3], 1), ([1, 2], [], 2), ([1, 2, 3], [4, 5, 6], 2), ([], [], 0)]
    rows += [([rng.randrange(4) + 10**12 for _ in range(rng.randrange(9))], [rng.randrange(4) + 10**12 for _ in range(rng.randrange(9))], rng.randrange(6)) for _ in range(300)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    df = spark.createDataFrame(rows, "a array<long>, b array<long>, bound int")
    for r in bounded_distance(df, "a", "b", "bound", "d").collect():
        d = distance(r.a, r.b)
        assert r.d == (d if d <= r.bound else -1)


def test_regions_and_numbering(spark):
    rng = random.Random(6)
    hits, want = [], []
    for src in range(6):
        run = None
        for pos in range(40):
            if rng.random() < 0.3:
                run = None
                continue
            left = (run[1], run[2] + 1) if run and rng.random() < 0.8 else (rng.randrange(src + 1), rng.randrange(30))
            hits.append((src, pos, *left))
            if run and run[0] == pos - 1 and (run[1], run[2] + 1) == left:
                want[-1][-1] += 1
            else:
                want.append([left[0], left[1], src, pos, 5])
            run = (pos, *left)
    df = spark.createDataFrame(hits, "src int, pos int, left_src int, left_pos int").repartition(3)
    got = [tuple(r) for r in blocks.regions(df, 5, overlapping=True).collect()]
    assert sorted(got) == sorted(map(tuple, want))
    values = [(rng.randrange(50), i) for i in range(500)]
    n = numbered(spark.createDataFrame(values, "a int, b int").repartition(7), ["a", "b"], "n").collect()
    assert [(r.a, r.b) for r in sorted(n, key=lambda r: r.n)] == sorted(values) and sorted(r.n for r in n) == list(range(500))
    assert numbered(spark.createDataFrame([], "a int, b int"), ["a", "b"], "n").count() == 0


def test_snapping(spark):
    def side(lines):
        return [(i, i + 1, x, x) for i, x in enumerate(lines)]

    token = "array<struct<start_byte:long,end_byte:long,start_line:int,end_line:int>>"
    rows = [
        (side([1, 1, 2, 2, 3, 3, 4, 4]), side([1, 2, 2, 3, 3, 4, 4, 4]), 1, 0, 6),
        (side([1, 1, 2, 2]), side([7, 7, 8, 8]), 0, 0, 4),
        (side([1, 1, 1, 1]), side([2, 2, 2, 2]), 1, 1, 2),
    ]
    df = spark.createDataFrame(rows, f"l_tokens {token}, r_tokens {token}, left_start int, right_start int, length int")
    assert sorted((r.left_start, r.right_start, r.length) for r in blocks.snapped(df).collect()) == [(0, 0, 4), (1, 1, 2), (2, 1, 4)]


def pair(name, a, b, tokens=30, similarity=1000, kind="type1", paths=("p", "q")):
    place = lambda p, s: (p, (*s, 1, 5), name + p)
    return (name, kind, similarity, place(paths[0], a), place(paths[1], b), (True, True, 1, 1000, 1000, 0, tokens))


def test_suppression_is_the_greedy_one(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        a, b = rng.randrange(20), rng.randrange(20)
        rows.append(pair(f"{i:03}", (a, a + rng.randrange(1, 15)), (b, b + rng.randrange(1, 15)), rng.randrange(20, 24), rng.choice([900, 1000]), paths=rng.choice([("p", "q"), ("p", "r")])))
    rows += [pair(f"w{i:03}", (100, 164), (7, 9), 20 + i % 2, 900 + 50 * (i % 3), paths=("p", "q")) for i in range(9)]  # equal spans
    rows += [pair(f"x{i}", (1000 + i, 2024 - i), (64, 128 + i % 2), paths=("p", "r")) for i in range(12)]  # nested, on borders of cells
    rows += [pair("y", (5, 5), (5, 5), paths=("p", "s")), pair("z", (5, 6), (4, 5), paths=("p", "s"))]
    kept = []
    size = lambda r: sum(s[1][1] - s[1][0] for s in (r[3], r[4]))
    for r in sorted(rows, key=lambda r: (-size(r), -r[5][6], -r[2], r[0])):
        if not any(k[2] >= r[2] and all(k[i][0] == r[i][0] and k[i][1][0] <= r[i][1][0] and k[i][1][1] >= r[i][1][1] for i in (3, 4)) for k in kept):
            kept.append(r)
    got = suppress_contained(spark.createDataFrame(rows + rows[:5], PAIR))
    assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in kept)


def test_gate_against_all_labels_and_pairs(spark):
    from echoframe.plans.accuracy import detected
    from echoframe.schema import ORACLE

    rng = random.Random(13)

    def span(longest):
        a = rng.randrange(1, 60)
        return a, a + rng.randrange(longest)

    pairs = [("i", "type1", 1000, (rng.choice("pq"), (0, 9, *span(40)), "x"), (rng.choice("pq"), (0, 9, *span(40)), "y"), (True, True, 1, 1, 1, 0, 30)) for _ in range(150)]
    labels = []
    for i in range(250):
        (a, b), (c, d) = span(30), span(30)
        labels.append((str(i), rng.choice("pqr"), a, b if i % 9 else a - 1, rng.choice("pq"), c, d, True, None))
    labels.append(("none", "p", None, 3, "q", 1, 2, True, None))

    def covers(place, path, start, end, coverage):
        shared = max(0, min(place[1][3], end) - max(place[1][2], start) + 1)
        return place[0] == path and start <= end and shared * 1000 >= (end - start + 1) * coverage

    for coverage in (700, 1000, 300, 1, 0):
        want = {}
        for x in labels:
            sides = (x[1:4], x[4:7])
            want[x[0]] = x[2] is not None and any(covers(p[3 + k], *sides[0], coverage) and covers(p[4 - k], *sides[1], coverage) for p in pairs for k in (0, 1))
        got = detected(spark.createDataFrame(pairs, PAIR), spark.createDataFrame(labels, ORACLE), coverage)
        assert {r.id: r.detected for r in got.collect()} == want and 3 < sum(want.values()) < 250


def test_fragment_ranges():
    two = "fn a(x: u8) {\n    x();\n}\n\npub fn b() {\n    if (x) {\n        y();\n    }\n}\n"
    assert ranges("rust", two, 3, 100) == [(0, 2), (4, 8)]
    assert ranges("python", "def a():\n    x\n    y\n\nasync def b():\n    z\n    z\n", 3, 100) == [(0, 2), (4, 6)]
    assert ranges("text", "one line\n", 3, 100) == [(0, 1)] and ranges("text", "one line", 3, 100) == [] and ranges("rust", "", 3, 100) == []
    assert without_noise("a('x{') // }") == "a() " and without_noise("let c: &'a str {") == "let c: &" and without_noise('f("\\"{") { # }') == "f() { "
    assert ranges("rust", "fn a() {\n1\n2\n3\n4\n}\n", 3, 4) == [(0, 3)]


def test_fragment_ranges_against_their_definition():
    rng = random.Random(9)
    for _ in range(400):
        lines = [rng.choice(["", "  ", " " * rng.randrange(7) + rng.choice(["def f():", "async def g():", "x = 1", "# y"])]) for _ in range(rng.randrange(1, 25))] + ["end"]
        least, most = rng.randrange(1, 4), rng.randrange(1, 12)
        filled = {i: len(x) - len(x.lstrip()) for i, x in enumerate(lines) if x.strip()}
        want = []
        for i in filled:
            if lines[i].lstrip().startswith(("def ", "async def ")):
                stop = min((k for k in filled if k > i and filled[k] <= filled[i]), default=len(lines))
                inside = [k for k in filled if i < k < stop]
                last = next((k for k in inside if k - i + 1 >= most), max(inside, default=i))
                want += [(i, last)] * (last - i + 1 >= least)
        assert indented_functions(lines, least, most) == want
        lines = [rng.choice(["{", "}", "f() {", "if (x) {", "g({ x", "} }", "fn y", "h(1) { k() {", "z"]) for _ in range(rng.randrange(1, 30))]
        before = lambda i: sum(x.count("{") - x.count("}") for x in lines[:i])
        want, free = [], 0
        for i, x in enumerate(lines):
            if i >= free and before(i) <= 1 and before(i + 1) > before(i) and not x.startswith("if") and ("(" in x or "fn " in x):
                last = next((j for j in range(i, len(lines)) if before(j + 1) <= before(i) or j - i + 1 >= most), None)
                free = len(lines) if last is None else last + 1
                want += [(i, last)] * (last is not None and last - i + 1 >= least)
        assert braced_functions(lines, least, most) == want


def test_tables_are_removed_when_settled(spark):
    from echoframe.plans.scratch import materialize, settled

    kept = materialize(spark.range(3), "kept")
    inner = []

    def made():
        inner.append(materialize(spark.range(5), "inner"))
        return inner[0].union(kept)

    out = settled(spark, made, "outer")
    assert out.count() == 8 and kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(inner[0].inputFiles()[0]).count()


def test_dictionary_and_streams(spark):
    """Ids by first appearance, a token before its placeholder, and streams of them."""
    from echoframe.functions.lexing import own_dictionaries
    from echoframe.operators.tokens import IDENTIFIER, STRING, dictionary, encoded

    rows = [(i, "python" if i % 2 else "rust", f"def f{i}(x): # {i}\n    return 'a{i % 3}' + x * {i} // 2 -- 3") for i in range(30)] + [(99, "text", ""), (98, "sql", None), (97, "text", "def é fn \x0b")]
    df = own_dictionaries(spark.createDataFrame(rows, "rank long, language string, text string").repartition(3))
    assert df.columns == ["rank", "language", "n_tokens", "words", "first", "codes"]
    keywords = {"python": {"def", "return"}, "rust": {"fn", "return"}, "text": {"return"}}
    number, strict, loose = {}, {}, {}
    for rank, language, text in sorted(rows):
        for kind, raw, *_ in by_character(text or "", language):
            name = STRING if kind == "S" else IDENTIFIER if kind == "I" and raw not in keywords[language] else raw
            for token, stream in ((raw, strict), (name, loose)):
                stream.setdefault(rank, []).append(number.setdefault(token, len(number)))
    words = dictionary(df)
    assert {r.token: r.token_id for r in words.collect()} == number
    assert {r.rank: (r.strict, r.renamed) for r in encoded(df, words).collect()} == {k: (strict[k], loose[k]) for k in strict}
    assert {r.rank: r.n_tokens for r in df.collect()} == {r[0]: len(strict.get(r[0], [])) for r in rows}


def test_common_tokens_are_looked_up_in_place(spark, monkeypatch):
    """F5 F6 F7 F8 F10: streams are the same however many tokens the tasks are given; one that all rows have is shuffled by none."""
    from echoframe.functions.lexing import own_dictionaries
    from echoframe.operators import tokens

    rows = [(i, ("python", "rust", None)[i % 3], " ".join(["let", "fn", "x", "é", f"a{i % 4}", f"b{i}", str(i), "'s'", "y" * 70] * (i % 3 + 1))) for i in range(40)] + [(50, "text", "")]
    df = own_dictionaries(spark.createDataFrame(rows, "rank long, language string, text string").repartition(3))
    words = tokens.dictionary(df)
    found, sent = {}, {}
    made = tokens._sent
    monkeypatch.setattr(tokens, "_sent", lambda *args: sent.setdefault(tokens.MOST_SENT, made(*args)))
    for most in (0, 7, 1 << 17):
        monkeypatch.setattr(tokens, "MOST_SENT", most)
        found[most] = {r.rank: (r.strict, r.renamed) for r in tokens.encoded(df, words).collect()}
    assert found[0] == found[7] == found[1 << 17] and len(found[0]) == len(rows) - 1 - sum(r[1] is None for r in rows)
    names = {most: set(s[0].to_pylist()) for most, s in sent.items()}
    assert not names[0] and {"let", "fn", "x"} <= names[7] and len(names[7]) <= 7 and "a1" in names[1 << 17] and "b1" not in names[1 << 17]


def test_equal_digests_are_equal_tokens():
    from echoframe.functions import lexing
    import pyarrow as pa

    texts = [["ab", " ", "c"], ["ab", "c"], ["a", " ", "bc"], ["a", "bc"], ["abc"], ["c", "ab"], [], [" "]]
    digest = [x["digest"] for x in lexing._dictionary_of(pa.array([["zz"], *texts], pa.list_(pa.string())).slice(1), pa.array([0] * 8, pa.int32())).to_pylist()]
    same = lambda t: [x for x in t if x != " "]
    assert all((digest[i] == digest[j]) == (same(texts[i]) == same(texts[j])) for i in range(8) for j in range(8))


def test_encoders(spark):
    rows = [pair("clone:v1:pair:b", (0, 9), (3, 8), paths=('a"\n', "C:\\x y%.rs")), pair("clone:v1:pair:a", (0, 9), (3, 8), similarity=876, kind="type3")]
    df = spark.createDataFrame(rows, PAIR)
    import json

    made = {r.id: json.loads(r.json) for r in json_pairs(df).collect()}
    first = made["clone:v1:pair:b"]
    assert list(first) == ["id", "kind", "similarityPermille", "left", "right", "evidence"] and first["left"]["path"] == 'a"\n' and first["right"]["span"]["endByte"] == 8
    assert set(json_schema()["properties"]["pairs"]["items"]["properties"]) == set(first)
    sarif = {r.id: json.loads(r.json) for r in sarif_results(df).collect()}
    assert sarif["clone:v1:pair:a"]["message"]["text"].endswith(": 87.6 % alike, kind 3") and sarif["clone:v1:pair:a"]["ruleIndex"] == 2
    assert sarif["clone:v1:pair:b"]["relatedLocations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "file:///C:/x%20y%25.rs"
    paths = spark.createDataFrame([("/a b",), ("é",), ("x/y:z",)], "p string").select(uri("p")).collect()
    assert [r[0] for r in paths] == ["file:///a%20b", "%C3%A9", "x/y:z"]
    good = spark.createDataFrame([pair("i", (0, 9), (3, 8), paths=("s/selected/1.java", "default/2.java"))], PAIR)
    assert tuple(bigcloneeval_rows(good).first())[1:] == ("selected", "1.java", 1, 5, "default", "2.java", 1, 5)
    for bad in ("x.java", "selected/a/b.java", "selected/a,b.java", "selected/"):
        with pytest.raises(InvalidOutput):
            bigcloneeval_rows(spark.createDataFrame([pair("i", (0, 9), (3, 8), paths=(bad, "default/2.java"))], PAIR))
    assert re.fullmatch(r"clone:v1:pair:[0-9a-f]{32}", digest("pair", ["a", "b"])) and digest("pair", ["ab"]) != digest("pair", ["a", "b"])


def test_options():
    o = RepositoryOptions().with_extensions([".RS", "", "Py"])
    assert o.extensions == ("py", "rs")
    for bad in (dict(max_file_bytes=0), dict(min_fragment_lines=0), dict(max_fragment_lines=2), dict(extensions=())):
        with pytest.raises(InvalidConfig):
            RepositoryOptions(**bad).validate()
