import numpy as np
import pyarrow as pa

from echoframe.functions import lexing
from echoframe.operators import fingerprints, fragments


def test_python_works_on_bounded_parts_with_the_same_result():
    rng = np.random.default_rng(5)
    texts = [None, "", *[" ".join(f"w{i}" for i in rng.integers(0, 9, n)) for n in (1, 700, 40, 40, 3, 0, 25)]]
    lexemes = pa.array([[] if t is None else [x for w in t.split(" ") for x in (w, " ")] for t in texts], pa.list_(pa.string()))
    marks = pa.array([0] * len(texts), pa.int32())
    # A dictionary's order is free, so tokens are compared with their places and counts.
    plain = lambda x: [(x["words"][c], x["first"][c], x["times"][c]) for c in x["codes"]] if isinstance(x, dict) else x
    for work in (lexing._dictionary_of, lexing._places_of):
        seen = []

        def watched(*columns):
            seen.append((len(columns[0]), len(columns[0].flatten())))
            return work(*columns)

        parts = list(lexing.in_parts(watched, (lexemes, marks), 100))
        assert [plain(x) for p in parts for x in p.to_pylist()] == [plain(x) for x in work(lexemes, marks).to_pylist()]
        assert len(seen) > 2 and all(rows == 1 or values <= 100 for rows, values in seen)
    own = lexing._dictionary_of(lexemes, marks).to_pylist()
    assert all(sorted(x["times"]) == sorted(x["codes"].count(i) for i in range(len(x["words"]))) for x in own)
    none = lexemes.slice(0, 0)
    assert [len(p) for p in lexing.in_parts(lexing._dictionary_of, (none, marks.slice(0, 0)))] == [0]
    ids = pa.array([None, [], [1, 2, 3], list(range(300))], pa.list_(pa.int64()))
    found = [x for p in lexing.in_parts(lambda x: fingerprints._each(x, lambda v: fingerprints.rolling(v, 2)), (ids,), 10) for x in p.to_pylist()]
    assert [len(x) for x in found] == [0, 0, 2, 299] and found[2] == fingerprints.rolling(np.array([1, 2, 3]), 2).view(np.int64).tolist()


def test_fragments_are_handed_on_in_bounded_batches(spark):
    code = "".join(f"def f{i}():\n    a = 1\n    return '{'é' * 200}'\n" for i in range(300))
    files = spark.createDataFrame([("a.py", "python", code), ("b.py", "python", None), ("c.py", "python", ""), ("d.py", "python", code)], "path string, language string, text string")
    rows = fragments.fragment_files(files.coalesce(1), least=3, most=9).collect()
    assert len(rows) == 600 and "".join(r.text for r in rows if r.path == "d.py") == code
    assert {r.id for r in rows} == {f"{p}#fragment:{i}" for p in ("a.py", "d.py") for i in range(300)}
    assert all(len(r.text.encode()) == r.span.end_byte - r.span.start_byte for r in rows)


def test_nested_comments_are_scanned_in_runs(monkeypatch):
    """the pattern is made once, and a text is matched anew only behind a comment."""
    def plain(text):
        out, at = [], 0
        while at < len(text):
            end = at + 2 if text.startswith("/*", at) else lexing._rust_token().match(text, at).end()
            depth = int(text.startswith("/*", at))
            while depth and end < len(text):
                two = text[end : end + 2]
                depth += (two == "/*") - (two == "*/")
                end += 2 if two in ("/*", "*/") else 1
            out.append(text[at : min(end, len(text))])
            at = end
        return out

    rng = np.random.default_rng(4)
    bits = ["/*", "*/", "/", "*", "//", "\n", "'", '"', "\\", "a", " ", "é", "1e+", "::", "/**/"]
    for n in rng.integers(0, 25, 2000):
        text = "".join(rng.choice(bits, n))
        assert lexing._nested_rust(text) == plain(text) and "".join(plain(text)) == text
    made = []
    monkeypatch.setattr(lexing, "pattern", lambda *args: made.append(1))
    assert lexing._nested_rust("a /* b /* c */ d */ e") == ["a", " ", "/* b /* c */ d */", " ", "e"] and not made
