"""Report encoders: versioned JSON, SARIF 2.1.0, BigCloneEval rows and text.

Each result is encoded by a column expression and comes as rows.  A document is the
rows' texts in order between a head and a tail, written by the tasks; the forms that
return a string read that file again and are for small reports."""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidOutput
from ..operators.families import Families, placed
from ..operators.ordering import numbered
from ..sources.document import file_system, write_document
from .detector import STATISTICS, CloneReport
from .scratch import shared_dir

SCHEMA_ID = "clone-report/v1"
CATEGORIES = ("default", "selected", "sample")


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.title() for x in rest)


def _span(s: Column) -> Column:
    return F.struct(*[s[n].alias(_camel(n)) for n in ("start_byte", "end_byte", "start_line", "end_line")])


def _location(c: Column) -> Column:
    return F.struct(c["fragment_id"].alias("fragmentId"), c["path"].alias("path"), _span(c["span"]).alias("span"))


def _evidence(e: Column) -> Column:
    return F.struct(
        e["strict_equal"].alias("strictEqual"), e["renamed_equal"].alias("renamedEqual"), e["shared_fingerprints"].alias("sharedFingerprints"),
        e["fingerprint_jaccard"].alias("fingerprintJaccardPermille"), e["fingerprint_containment"].alias("fingerprintContainmentPermille"),
        e["edit_distance"].alias("editDistance"), e["compared_tokens"].alias("comparedTokens"),
    )


def json_pairs(pairs: DataFrame) -> DataFrame:
    """(id, json), one row per pair."""
    body = F.struct(
        "id", "kind", F.col("similarity").alias("similarityPermille"), _location(F.col("left")).alias("left"), _location(F.col("right")).alias("right"),
        _evidence(F.col("evidence")).alias("evidence"),
    )
    return pairs.select("id", F.to_json(body).alias("json"))


def json_families(families: DataFrame) -> DataFrame:
    body = F.struct("id", F.transform(F.array_sort("members"), _location).alias("members"), F.array_sort("pair_ids").alias("pairIds"))
    return families.select("id", F.to_json(body).alias("json"))


def _separated(rows: DataFrame, order: str) -> DataFrame:
    """Rows of ``json`` as ``text`` with a comma before each but the first in ``order``."""
    first = numbered(rows, [order], "_n")
    return first.select(order, F.concat(F.when(F.col("_n") > 0, ",").otherwise(""), "json").alias("text"))


def family_pieces(families: Families) -> DataFrame:
    """(id, part, place, text): families in pieces, of which none grows with its family;
    in this order they are the families with commas between them."""
    opened = F.concat(F.lit('{"id":'), F.to_json(F.struct("id")).substr(F.lit(7), F.length("id") + 2), F.lit(',"members":['))
    heads = _separated(families.sizes.select("id", opened.alias("json")), "id")
    comma = F.when(F.col("place") > 0, ",").otherwise("")
    members = placed(families.members, "member").select("id", "place", F.concat(comma, F.to_json(_location(F.col("member")))).alias("text"))
    ids = placed(families.pairs, "pair_id").select("id", "place", F.concat(comma, F.lit('"'), "pair_id", F.lit('"')).alias("text"))
    fixed = lambda part, text: families.sizes.select("id", F.lit(part).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(text).alias("text"))
    at = lambda df, part: df.select("id", F.lit(part).alias("part"), "place", "text")
    return (
        at(heads.withColumn("place", F.lit(0).cast("long")), 0)
        .unionByName(at(members, 1))
        .unionByName(fixed(2, '],"pairIds":['))
        .unionByName(at(ids, 3))
        .unionByName(fixed(4, "]}"))
    )


def write_json(report: CloneReport, path: str) -> None:
    """The JSON document as a file: pairs and families by id, then statistics."""
    statistics = report.statistics.select(F.to_json(F.struct(*[F.col(s).alias(_camel(s)) for s in STATISTICS])).alias("json")).first().json
    nothing = [F.lit(0).alias("part"), F.lit(0).cast("long").alias("place")]
    pairs = _separated(json_pairs(report.pairs), "id").select(F.lit(0).alias("section"), "id", *nothing, "text")
    between = report.statistics.select(F.lit(1).alias("section"), F.lit("").alias("id"), *nothing, F.lit('],"families":[').alias("text"))
    families = family_pieces(report.family_tables).select(F.lit(2).alias("section"), "id", "part", "place", "text")
    head, tail = f'{{"schema":"{SCHEMA_ID}","version":1,"pairs":[', f'],"statistics":{statistics}}}'
    write_document(pairs.unionByName(between).unionByName(families), ["section", "id", "part", "place"], path, head, tail)


def _text_of(write, report: CloneReport, *more) -> str:
    """What ``write`` writes, as a string."""
    path = f"{shared_dir(report.pairs.sparkSession)}/document-{uuid.uuid4().hex}"
    write(report, path, *more)
    fs, at = file_system(path)
    with fs.open_input_stream(at) as f:
        text = f.read().decode()
    fs.delete_file(at)
    return text


def to_json(report: CloneReport) -> str:
    return _text_of(write_json, report)


@F.pandas_udf(T.StringType())
def uri(paths: pd.Series) -> pd.Series:
    """A path as a URI: percent-encoded, absolute ones with ``file://``."""

    def one(path):
        if path is None:
            return None
        path = path.replace("\\", "/")
        prefix = "file://" if path.startswith("/") else "file:///" if path.encode()[1:2] == b":" else ""
        return prefix + quote(path, safe="/:")

    return paths.map(one)


def sarif_results(pairs: DataFrame) -> DataFrame:
    """(id, json), one SARIF result per pair."""

    def place(side: str) -> Column:
        s = F.col(f"{side}.span")
        region = F.struct(
            s["start_line"].alias("startLine"), s["end_line"].alias("endLine"), s["start_byte"].alias("byteOffset"),
            F.greatest(F.lit(0), s["end_byte"] - s["start_byte"]).alias("byteLength"),
        )
        return F.struct(F.struct(uri(F.col(f"{side}.path")).alias("uri")).alias("artifactLocation"), region.alias("region"))

    number = F.substring("kind", 5, 1).cast("int")
    percent = F.format_string("%d.%d", F.expr("similarity div 10"), F.expr("similarity % 10"))
    message = F.concat(F.lit("These lines are repeated elsewhere: "), percent, F.lit(" % alike, kind "), number.cast("string"))
    text = lambda c: F.struct(c.alias("text"))
    related = F.struct(F.lit(1).alias("id"), text(F.lit("the same lines again")).alias("message"), place("right").alias("physicalLocation"))
    e = F.col("evidence")
    body = F.struct(
        F.concat(F.lit("CLONE.TYPE"), number).alias("ruleId"),
        (number - 1).alias("ruleIndex"),
        F.lit("warning").alias("level"),
        text(message).alias("message"),
        F.array(F.struct(place("left").alias("physicalLocation"))).alias("locations"),
        F.array(related).alias("relatedLocations"),
        F.struct(F.col("id").alias("clonePairId/v1")).alias("partialFingerprints"),
        F.struct(F.col("kind").alias("kind"), F.col("similarity").alias("similarityPermille"), *[_evidence(e)[n].alias(n) for n in (
            "strictEqual", "renamedEqual", "sharedFingerprints", "fingerprintJaccardPermille", "fingerprintContainmentPermille", "editDistance", "comparedTokens")]).alias("properties"),
    )
    return pairs.select("id", F.to_json(body).alias("json"))


def write_sarif(report: CloneReport, path: str) -> None:
    """The SARIF log as a file, results by pair id."""
    names = [("SameTokens", "Equal token for token"), ("OtherNames", "Equal but for names and strings"), ("FewEdits", "Equal but for a few tokens")]
    rules = [{"id": f"CLONE.TYPE{i}", "name": n, "shortDescription": {"text": t}} for i, (n, t) in enumerate(names, 1)]
    driver = json.dumps({"driver": {"name": "echoframe", "semanticVersion": "0.1.0", "rules": rules}}, separators=(",", ":"))
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":'
    write_document(_separated(sarif_results(report.pairs), "id"), ["id"], path, f'{head}{driver},"results":[', "]}]}")


def to_sarif(report: CloneReport) -> str:
    return _text_of(write_sarif, report)


def bigcloneeval_rows(pairs: DataFrame) -> DataFrame:
    """Eight columns per pair, sorted by pair id when written: category, file,
    first and last line, twice.  A path must be ``.../category/file``; one that is
    not is an error, found before any row is returned."""

    def parts(side: str):
        path = F.replace(F.col(f"{side}.path"), F.lit("\\"), F.lit("/"))
        name = "|".join(CATEGORIES)
        return F.regexp_extract(path, rf"(?:^|/)({name})/([^/]+)$", 1), F.regexp_extract(path, rf"(?:^|/)({name})/([^/]+)$", 2), path

    columns, bad = ["id"], F.lit(False)
    for side in ("left", "right"):
        category, file, path = parts(side)
        bad = bad | (category == "") | path.contains(",")
        columns += [category.alias(f"{side}_category"), file.alias(f"{side}_file")]
        columns += [F.col(f"{side}.span.start_line").alias(f"{side}_start"), F.col(f"{side}.span.end_line").alias(f"{side}_end")]
    wrong = pairs.where(bad).agg(F.min("id")).first()[0]
    if wrong is not None:
        raise InvalidOutput(f"BigCloneEval needs paths of a category and a file without commas: pair {wrong}")
    return pairs.select(*columns)


def write_bigcloneeval(report: CloneReport, path: str) -> None:
    """The rows as a file of lines, by pair id."""
    rows = bigcloneeval_rows(report.pairs)
    line = F.concat(F.concat_ws(",", *[F.col(c).cast("string") for c in rows.columns[1:]]), F.lit("\n"))
    write_document(rows.select("id", line.alias("text")), ["id"], path)


def to_bigcloneeval(report: CloneReport) -> str:
    return _text_of(write_bigcloneeval, report)


def write_text(report: CloneReport, path: str, summary: bool = False, elapsed_ms: float = 0.0) -> None:
    """A line per pair, then a line of counts.  The words of the lines are fixed values."""
    pairs = report.pairs
    place = lambda s: F.format_string("%s:%d-%d", F.col(f"{s}.path"), F.col(f"{s}.span.start_line"), F.col(f"{s}.span.end_line"))
    line = F.concat(place("left"), F.lit(" ~ "), place("right"), F.lit(" type="), F.initcap("kind"), F.lit(" similarity="),
                    F.format_string("%d.%d%%", F.expr("similarity div 10"), F.expr("similarity % 10")), F.lit("\n"))
    s = report.statistics.first()
    kinds = {r.kind: r["count"] for r in pairs.groupBy("kind").count().collect()}
    counts = " ".join(f"{k}={kinds.get(k, 0)}" for k in ("type1", "type2", "type3"))
    last = (
        f"files={s.source_files} fragments={s.analyzed_fragments} candidates={s.candidate_pairs} pairs={sum(kinds.values())} "
        f"families={report.family_tables.sizes.count()} {counts} elapsed_ms={elapsed_ms:.3f}\n"
    )
    write_document(pairs.where(F.lit(not summary)).select("left", "right", "kind", line.alias("text")), ["left", "right", "kind"], path, tail=last)


def to_text(report: CloneReport, summary: bool = False, elapsed_ms: float = 0.0) -> str:
    return _text_of(write_text, report, summary, elapsed_ms)


def json_schema() -> dict:
    """JSON Schema of ``to_json``."""

    def obj(**properties):
        return {"type": "object", "additionalProperties": False, "required": list(properties), "properties": properties}

    whole, text, flag = {"type": "integer", "minimum": 0}, {"type": "string"}, {"type": "boolean"}
    permille = {"type": "integer", "minimum": 0, "maximum": 1000}
    many = lambda x: {"type": "array", "items": x}
    location = obj(fragmentId=text, path=text, span=obj(startByte=whole, endByte=whole, startLine=whole, endLine=whole))
    evidence = obj(strictEqual=flag, renamedEqual=flag, sharedFingerprints=whole, fingerprintJaccardPermille=permille, fingerprintContainmentPermille=permille, editDistance=whole, comparedTokens=whole)
    pair = obj(id=text, kind={"enum": ["type1", "type2", "type3"]}, similarityPermille=permille, left=location, right=location, evidence=evidence)
    family = obj(id=text, members=many(location), pairIds=many(text))
    body = obj(schema={"const": SCHEMA_ID}, version={"const": 1}, pairs=many(pair), families=many(family), statistics=obj(**{_camel(s): whole for s in STATISTICS}))
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$id": SCHEMA_ID, **body}
