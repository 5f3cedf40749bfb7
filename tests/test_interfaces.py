"""The JSON interface and the command line."""

import json

import pytest

from echoframe.api import SCHEMA_ID, detect_json_fragments, detect_repository, json_schema
from echoframe.cli import arguments, main
from echoframe.errors import CloneError
from echoframe.functions.languages import EXTENSIONS, LANGUAGES

CODE = "function total(values) {\n  let sum = 0;\n  for (const value of values) {\n    sum += value * 31 + 7;\n    sum = max(sum, 0);\n  }\n  return sum + values.length;\n}\n"


def test_json_fragments(spark):
    rows = [{"id": "a", "path": "a.ts", "text": CODE}, {"id": "b", "path": "b.ts", "text": CODE.replace("values", "items").replace("sum", "acc")}, {"id": "c", "path": "c.ts", "text": "let nothing = 1;"}]
    r = detect_json_fragments(spark, rows)
    found = r.to_json()
    assert r.pair_count == 1 and r.family_count == 1 and found["schema"] == SCHEMA_ID
    assert found["pairs"][0]["kind"] == "type2" and found["pairs"][0]["similarityPermille"] == 1000
    assert set(found) == set(json_schema()["required"]) and found["statistics"]["inputFragments"] == 3
    assert json.loads(r.to_sarif())["runs"][0]["results"][0]["ruleId"] == "CLONE.TYPE2"
    assert detect_json_fragments(spark, rows, {"mode": "exact"}).pair_count == 0
    for bad in ([{"id": "a", "path": "a.ts"}], [{**rows[0], "extra": 1}], [{**rows[0], "language": "cobol"}], [{**rows[0], "path": ""}], [{**rows[0], "span": {"startByte": 1}}]):
        with pytest.raises(CloneError):
            detect_json_fragments(spark, bad)
    with pytest.raises(CloneError):
        detect_json_fragments(spark, rows, {"maxFragments": 1})


def test_every_language(spark):
    rows = []
    for name in LANGUAGES:
        ext = EXTENSIONS.get(name, ["txt"])[0]
        rows += [{"id": f"{name}{i}", "path": f"{name}{i}.{ext}", "text": CODE.replace("total", f"total_{name}")} for i in (1, 2)]
    pairs = {(p["left"]["fragmentId"], p["right"]["fragmentId"]) for p in detect_json_fragments(spark, rows, {"mode": "exact"}).to_json()["pairs"]}
    assert pairs == {(f"{n}1", f"{n}2") for n in LANGUAGES}


def test_command_line(spark, tmp_path, capsys):
    for name in ("a.js", "b.js"):
        (tmp_path / name).write_text(CODE)
    assert main([str(tmp_path), "--mode", "exact", "--summary"], spark) == 0
    line = capsys.readouterr().out
    assert line.startswith("files=2 fragments=0 ") and "pairs=1 families=1 type1=1" in line
    assert main([str(tmp_path / "none")], spark) == 1 and "error:" in capsys.readouterr().err
    assert main([str(tmp_path), "--mode", "exact", "--output-format", "bigcloneeval"], spark) == 1
    with pytest.raises(SystemExit):
        arguments([str(tmp_path), "--summary", "--output-format", "json"])
    assert detect_repository(spark, str(tmp_path), {"mode": "exact"}).pair_count == 1
