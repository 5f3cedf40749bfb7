"""The queries once more, as SQL for DuckDB.

Each step of the engine is a named table; a query is the chain of the steps that
it needs."""

from __future__ import annotations

from .functions.languages import COMMON_KEYWORDS
from .functions.lexing import OPERATORS
from .operators.fingerprints import BASE
from .queries import BRACED, BRACED_LINE, INDENTED, INDENTED_LINE, NAMES, QUERY


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _pattern() -> str:
    """The lexer for prose and markup, in RE2's terms."""
    letter, more = r"[A-Za-z_$\p{L}\p{Nl}\p{No}]", r"[A-Za-z0-9_$\p{L}\p{N}]*"
    quoted = [rf"{q}(?:[^{q}\\]|\\.)*(?:{q}|\\?\z)" for q in ("'", '"', "`")]
    operators = ["".join("\\" + c for c in op) for op in OPERATORS]
    number = r"[0-9](?:[A-Za-z0-9_.]*[eEpP][+-])*[A-Za-z0-9_.]*"
    return "(?s)" + "|".join([r"[ \t\n\f\r]+", letter + more, number, *quoted, *operators, "."])


PATTERN = _pattern().replace("'", "''")
SPACE = r"^[ \t\n\f\r]"
KIND = (
    "CASE WHEN regexp_matches({x}, '^[0-9]') THEN 'N' WHEN left({x}, 1) IN ('''', '\"', '`') THEN 'S' "
    r"WHEN regexp_matches({x}, '^[A-Za-z_$\p{{L}}\p{{Nl}}\p{{No}}]') THEN 'I' ELSE 'X' END"
)
TEXTS = {
    "documents": "SELECT doc_id::VARCHAR AS id, source || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents",
    "turns": "SELECT conv_id || '-' || turn AS id, 'c/' || conv_id || '-' || turn || '.txt' AS path, coalesce(text, '') AS text FROM conversations",
    "pages": "SELECT page_id::VARCHAR AS id, page_id || '.html' AS path, coalesce(html, '') AS text FROM pages",
}
POWERS = [pow(BASE, 7 - j, 1 << 64) for j in range(8)]


def steps(texts: str = "documents", stream: str = "strict", mode: str = "exact") -> list[tuple[str, str]]:
    renamed = f"CASE WHEN kind = 'I' AND raw NOT IN ({_list(COMMON_KEYWORDS)}) THEN chr(0) || 'identifier' WHEN kind = 'S' THEN chr(0) || 'string' ELSE raw END"
    lead = " + ".join(f"(lead({stream}, {j}) OVER w + 1)::HUGEINT * {p}::HUGEINT % 18446744073709551616" for j, p in enumerate(POWERS))
    return [
        ("texts", TEXTS[texts]),
        ("lexed", f"SELECT *, regexp_extract_all(text, '{PATTERN}') AS lexemes, row_number() OVER (ORDER BY path, id) - 1 AS rank FROM texts"),
        ("toks", f"SELECT id, path, rank, list_filter(lexemes, lambda x: NOT regexp_matches(x, '{SPACE}')) AS raws FROM lexed"),
        ("flat", "SELECT id, rank, pos - 1 AS pos, raws[pos] AS raw FROM (SELECT id, rank, raws, unnest(range(1, len(raws) + 1)) AS pos FROM toks)"),
        ("tok", f"SELECT *, {renamed} AS renamed_raw FROM (SELECT *, {KIND.format(x='raw')} AS kind FROM flat)"),
        ("seen", "SELECT token, min((rank, pos, slot)) AS first FROM (SELECT raw AS token, rank, pos, 0 AS slot FROM tok UNION ALL SELECT renamed_raw, rank, pos, 1 FROM tok) GROUP BY token"),
        ("dict", "SELECT token, row_number() OVER (ORDER BY first) - 1 AS token_id FROM seen"),
        ("ids", "SELECT t.id, t.rank, t.pos, a.token_id AS strict, b.token_id AS renamed FROM tok t JOIN dict a ON a.token = t.raw JOIN dict b ON b.token = t.renamed_raw"),
        ("streams", "SELECT id, rank, list(strict ORDER BY pos) AS strict, list(renamed ORDER BY pos) AS renamed FROM ids GROUP BY id, rank HAVING count(*) >= 24"),
        ("kgrams", f"SELECT id, rank, pos, h FROM (SELECT id, rank, pos, ({lead}) % 18446744073709551616 AS h FROM ids SEMI JOIN streams USING (rank) WINDOW w AS (PARTITION BY rank ORDER BY pos)) WHERE h IS NOT NULL"),
        ("fps", "SELECT DISTINCT id, rank, fp FROM (SELECT id, rank, pos, min(h) OVER (PARTITION BY rank ORDER BY pos ROWS 3 PRECEDING) AS fp FROM kgrams) WHERE pos >= 3"),
        ("buckets", "SELECT fp, count(*) AS n FROM fps GROUP BY fp"),
        ("live", "SELECT * FROM fps WHERE fp IN (SELECT fp FROM buckets WHERE n <= 128)"),
        ("sizes", "SELECT rank, id, count(*) AS size FROM live GROUP BY rank, id"),
        ("shared", "SELECT a.rank AS l, b.rank AS r, count(*) AS shared FROM live a JOIN live b ON a.fp = b.fp AND a.rank < b.rank GROUP BY ALL HAVING count(*) >= 2"),
        ("cand", "SELECT * FROM (SELECT l, r, a.id AS left_id, b.id AS right_id, shared, shared * 1000 // (a.size + b.size - shared) AS jaccard, shared * 1000 // least(a.size, b.size) AS containment FROM shared JOIN sizes a ON a.rank = l JOIN sizes b ON b.rank = r) WHERE greatest(jaccard, containment) >= 450"),
        ("clones", f"""SELECT left_id, right_id, CASE WHEN a.strict = b.strict THEN 'type1' ELSE 'type2' END AS kind, shared, jaccard, containment, 1000::BIGINT AS similarity,
            0::BIGINT AS edit_distance, len(a.renamed)::BIGINT AS compared_tokens, l, r FROM cand JOIN streams a ON a.rank = l JOIN streams b ON b.rank = r WHERE a.{'strict' if mode == 'exact' else 'renamed'} = b.{'strict' if mode == 'exact' else 'renamed'}"""),
    ]


def chain(parts: list[tuple[str, str]], last: str, query: str) -> str:
    """The steps up to ``last``, then the query."""
    names = [n for n, _ in parts]
    used = parts[: names.index(last) + 1]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in used) + "\n" + query


DOCS, RENAMED = steps(), steps(stream="renamed", mode="renamed")
PRINT = "printf('%016x', {}::UBIGINT)"


def block_steps(texts: str = "documents", lines: int = 3) -> list[tuple[str, str]]:
    """Blocks: lexemes with positions, windows, first windows, runs, lines."""
    return [
        *steps(texts)[:2],
        ("pieces", "SELECT id, path, rank AS src, i, lexemes[i] AS x FROM (SELECT *, unnest(range(1, len(lexemes) + 1)) AS i FROM lexed)"),
        ("placed", "SELECT *, sum(strlen(x)) OVER w AS e, sum(len(x) - len(replace(x, chr(10), ''))) OVER w AS n FROM pieces WINDOW w AS (PARTITION BY src ORDER BY i)"),
        ("pt", f"""SELECT id, path, src, row_number() OVER (PARTITION BY src ORDER BY i) - 1 AS pos, x, (e - strlen(x))::BIGINT AS start_byte, e::BIGINT AS end_byte,
            (n - (len(x) - len(replace(x, chr(10), ''))) + 1)::BIGINT AS start_line, (n + 1)::BIGINT AS end_line FROM placed WHERE NOT regexp_matches(x, '{SPACE}')"""),
        ("wins", "SELECT id, path, src, pos, k FROM (SELECT id, path, src, pos, string_agg(x, chr(1)) OVER (PARTITION BY src ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS k, count(*) OVER (PARTITION BY src ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS c FROM pt) WHERE c = 24"),
        ("firsts", "SELECT k, min(src * 10000000 + pos) AS m FROM wins GROUP BY k HAVING count(*) > 1"),
        ("hits", "SELECT id, src, pos, m // 10000000 AS left_src, m % 10000000 AS left_pos FROM wins JOIN firsts USING (k) WHERE src * 10000000 + pos <> m"),
        ("runs", "SELECT *, pos - row_number() OVER (PARTITION BY src, left_src, pos - left_pos ORDER BY pos) AS g FROM hits"),
        ("every", "SELECT left_src, src AS right_src, min(left_pos) AS left_start, min(pos) AS right_start, (count(*) + 23)::BIGINT AS length FROM runs GROUP BY src, left_src, pos - left_pos, g"),
        ("regions", "SELECT * FROM every WHERE NOT (left_src = right_src AND left_start < right_start + length AND right_start < left_start + length)"),
        ("edges", "SELECT src, pos, path, start_byte, end_byte, start_line, end_line, coalesce(lag(end_line) OVER w < start_line, true) AS b, coalesce(lead(start_line) OVER w > end_line, true) AS z FROM pt WINDOW w AS (PARTITION BY src ORDER BY pos)"),
        ("offs", "SELECT r.*, o, a.b AND c.b AS starts, a.z AND c.z AS ends FROM (SELECT *, unnest(range(0, length)) AS o FROM regions) r JOIN edges a ON a.src = left_src AND a.pos = left_start + o JOIN edges c ON c.src = right_src AND c.pos = right_start + o"),
        ("lined", "SELECT left_src, right_src, left_start, right_start, length, min(o) FILTER (starts) AS h, max(o) FILTER (ends) AS t FROM offs GROUP BY ALL"),
        ("snap", "SELECT left_src, right_src, left_start + d AS left_start, right_start + d AS right_start, n AS length FROM (SELECT *, CASE WHEN coalesce(h <= t, false) THEN h ELSE 0 END AS d, CASE WHEN coalesce(h <= t, false) THEN t - h + 1 ELSE length END AS n FROM lined)"),
        ("block", f"""SELECT 'type1' AS kind, 1000::BIGINT AS similarity, a.path AS left_path, a.start_byte AS left_start_byte, b.end_byte AS left_end_byte, a.start_line AS left_start_line,
            b.end_line AS left_end_line, c.path AS right_path, c.start_byte AS right_start_byte, d.end_byte AS right_end_byte, c.start_line AS right_start_line, d.end_line AS right_end_line,
            length::BIGINT AS compared_tokens FROM snap JOIN edges a ON a.src = left_src AND a.pos = left_start JOIN edges b ON b.src = left_src AND b.pos = left_start + length - 1
            JOIN edges c ON c.src = right_src AND c.pos = right_start JOIN edges d ON d.src = right_src AND d.pos = right_start + length - 1
            WHERE b.end_line - a.start_line >= {lines - 1} AND d.end_line - c.start_line >= {lines - 1}"""),
    ]


BLOCKS, PAGE_BLOCKS = block_steps(), block_steps("pages", 1)
_LINES = "greatest(1, len(text) - len(replace(text, chr(10), '')) + CASE WHEN text = '' OR suffix(text, chr(10)) THEN 0 ELSE 1 END)::BIGINT"


def _near(texts):
    """Near misses: of few distinct renamed tokens, each gets a character."""
    return [
        *steps(texts, "renamed", "renamed"),
        ("alphabet", "SELECT renamed, chr((dense_rank() OVER (ORDER BY renamed))::INTEGER) AS c FROM (SELECT DISTINCT renamed FROM ids)"),
        ("written", "SELECT rank, string_agg(c, '' ORDER BY pos) AS s, count(*) AS n FROM ids JOIN alphabet USING (renamed) GROUP BY rank"),
        ("far", """SELECT left_id, right_id, shared, jaccard, containment, greatest(a.n, b.n) AS compared_tokens, a.s AS x, b.s AS y FROM cand JOIN written a ON a.rank = l JOIN written b ON b.rank = r
            WHERE abs(a.n - b.n) <= greatest(a.n, b.n) * 200 // 1000 AND a.s <> b.s"""),
        ("near", "SELECT *, levenshtein(x, y) AS edit_distance FROM far"),
    ]


_NEAR_COLUMNS = """SELECT left_id, right_id, 'type3' AS kind, shared, jaccard, containment, (compared_tokens - edit_distance) * 1000 // compared_tokens AS similarity, edit_distance, compared_tokens
FROM near WHERE edit_distance <= compared_tokens * 200 // 1000"""

_WHOLE = [
    *DOCS,
    ("spans", f"SELECT id, path, strlen(text)::BIGINT AS bytes, {_LINES} AS lines FROM texts"),
    ("frag", """SELECT kind, similarity, a.path AS left_path, 0::BIGINT AS left_start_byte, a.bytes AS left_end_byte, 1::BIGINT AS left_start_line, a.lines AS left_end_line, b.path AS right_path,
        0::BIGINT AS right_start_byte, b.bytes AS right_end_byte, 1::BIGINT AS right_start_line, b.lines AS right_end_line, compared_tokens FROM clones JOIN spans a ON a.id = left_id JOIN spans b ON b.id = right_id"""),
]
_FLAT = [("texts", "SELECT doc_id::VARCHAR AS id, 'x/selected/' || doc_id || '.java' AS path, coalesce(text, '') AS text FROM documents"), *_WHOLE[1:]]
_BOTH = [
    *_WHOLE,
    *BLOCKS[2:],
    ("pairs", "SELECT *, (left_end_byte - left_start_byte) + (right_end_byte - right_start_byte) AS covered FROM (SELECT *, 0 AS u FROM frag UNION ALL SELECT *, 1 FROM block)"),
]
_FAMILIES = [
    *DOCS,
    ("edge", "SELECT left_id AS a, right_id AS b FROM clones UNION SELECT right_id, left_id FROM clones"),
    ("walk", "SELECT a, a AS c FROM edge UNION SELECT e.b, w.c FROM walk w JOIN edge e ON e.a = w.a"),
    ("path", "SELECT id, path FROM texts"),
    ("comp", "SELECT w.a AS member_id, min(p.path) AS c FROM walk w JOIN path p ON p.id = w.c GROUP BY w.a"),
]


def _recursive(parts, last, query):
    """The same for chains with steps that use themselves, which have ``walk`` in their names."""
    return chain(parts, last, query).replace("WITH ", "WITH RECURSIVE ", 1).replace("walk AS MATERIALIZED", "walk AS")


#: Digests are two running 64-bit values over bytes, in 128 bits so that products can be
#: cut back.  Their starts and multipliers are the digest's fixed values.
_CUT = "18446744073709551616::UHUGEINT"


def _digest(kind: str, parts: str) -> list[tuple[str, str]]:
    """``{kind}_id`` (key, id) for the table ``parts`` (key, list of texts)."""
    a = f"(xor(a, x) * 1099511628211::UHUGEINT) % {_CUT}"
    turned = f"(a * 131072) % {_CUT} + a // 140737488355328::UHUGEINT"
    b = f"(xor(b, (x + {turned}) % {_CUT}) * 11400714785074694791::UHUGEINT) % {_CUT}"
    byte = "('0x' || substr(h, 2 * i + 1, 2))::INTEGER::UHUGEINT"
    return [
        (f"{kind}_hex", f"SELECT key, hex('{kind}') || array_to_string(list_transform(parts, lambda p: hex(p) || '00'), '') AS h FROM {parts}"),
        (f"{kind}_walk", f"""SELECT key, h, 0 AS i, 14695981039346656037::UHUGEINT AS a, 11400714819323198485::UHUGEINT AS b FROM {kind}_hex
            UNION ALL SELECT key, h, i + 1, a, {b} FROM (SELECT key, h, i, x, {a} AS a, b FROM (SELECT *, {byte} AS x FROM {kind}_walk WHERE 2 * i < length(h)))"""),
        (f"{kind}_id", f"SELECT key, 'clone:v1:{kind}:' || {PRINT.format('a')} || {PRINT.format('b')} AS id FROM {kind}_walk WHERE 2 * i = length(h)"),
    ]


def _place(side: str) -> str:
    spans = ", ".join(f"'{name}': {side}_{column}" for name, column in (("startByte", "start_byte"), ("endByte", "end_byte"), ("startLine", "start_line"), ("endLine", "end_line")))
    return f"{{'fragmentId': {side}_id, 'path': {side}_path, 'span': {{{spans}}}}}"


def _sarif_place(side: str) -> str:
    region = f"{{'startLine': {side}_start_line, 'endLine': {side}_end_line, 'byteOffset': {side}_start_byte, 'byteLength': {side}_end_byte - {side}_start_byte}}"
    return f"{{'artifactLocation': {{'uri': {side}_path}}, 'region': {region}}}"


_PAIR_EVIDENCE = """'strictEqual': true, 'renamedEqual': true, 'sharedFingerprints': shared, 'fingerprintJaccardPermille': jaccard,
  'fingerprintContainmentPermille': containment, 'editDistance': edit_distance, 'comparedTokens': compared_tokens"""
_TOLD = [
    *_WHOLE[:-1],
    ("named", """SELECT c.*, a.path AS left_path, 0::BIGINT AS left_start_byte, a.bytes AS left_end_byte, 1::BIGINT AS left_start_line, a.lines AS left_end_line, b.path AS right_path,
        0::BIGINT AS right_start_byte, b.bytes AS right_end_byte, 1::BIGINT AS right_start_line, b.lines AS right_end_line FROM clones c JOIN spans a ON a.id = left_id JOIN spans b ON b.id = right_id"""),
    ("pair_parts", "SELECT (l, r) AS key, [left_id, right_id, left_path, right_path] AS parts FROM named"),
    *_digest("pair", "pair_parts"),
    ("told", "SELECT n.*, p.id FROM named n JOIN pair_id p ON p.key = (n.l, n.r)"),
]
_TOLD_FAMILIES = [
    *_TOLD,
    *_FAMILIES[len(DOCS) :],
    ("family_parts", """SELECT key, members, ids, n, a, b, m, c, d FROM (SELECT c AS key, count(*) AS n, sum(('0x' || md5(member_id)[1:15])::BIGINT) AS a, sum(('0x' || md5(member_id)[17:31])::BIGINT) AS b,
        list({'fragmentId': member_id, 'path': s.path, 'span': {'startByte': 0::BIGINT, 'endByte': s.bytes, 'startLine': 1::BIGINT, 'endLine': s.lines}} ORDER BY s.path) AS members FROM comp JOIN spans s ON s.id = member_id GROUP BY c)
        JOIN (SELECT c AS key, count(*) AS m, sum(('0x' || md5(told.id)[1:15])::BIGINT) AS c, sum(('0x' || md5(told.id)[17:31])::BIGINT) AS d, list(told.id ORDER BY told.id) AS ids FROM told JOIN comp ON member_id = left_id GROUP BY c) USING (key)"""),
    ("family_id", "SELECT key, 'clone:v1:family:' || md5(concat_ws(':', n, a, b, m, c, d)) AS id FROM family_parts"),
]

_GATE = [
    *DOCS,
    ("own", "SELECT id::BIGINT AS n, id, path, text, min(id::BIGINT) OVER (PARTITION BY text) AS f FROM texts"),
    ("label", """SELECT a.id AS one, b.id AS two, a.text = b.text AS expected, 'type1' AS kind FROM own a JOIN own b ON b.n = a.f AND a.n <> a.f
        UNION ALL SELECT a.id, b.id, a.text = b.text, NULL FROM own a JOIN own b ON b.n = a.n + 1"""),
    ("judged", "SELECT expected, kind, EXISTS (SELECT 1 FROM clones c WHERE (c.left_id = one AND c.right_id = two) OR (c.left_id = two AND c.right_id = one)) AS detected FROM label"),
    ("counted", """SELECT scope, count(*) FILTER (expected AND detected) AS tp, count(*) FILTER (NOT expected AND detected) AS fp, count(*) FILTER (expected AND NOT detected) AS fn,
        count(*) FILTER (NOT expected AND NOT detected) AS tn FROM (SELECT 'overall' AS scope, * FROM judged UNION ALL SELECT kind, * FROM judged WHERE kind IS NOT NULL) GROUP BY scope"""),
]

_CLONE_COLUMNS = "left_id, right_id, kind, shared, jaccard, containment, similarity, edit_distance, compared_tokens"
_NAMED = f"SELECT doc_id, 'p/' || ([{_list(NAMES)}])[doc_id % {len(NAMES)} + 1] AS path FROM documents"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _code(text: str, line: str) -> str:
    made = f"replace(replace({_quote(text)}, '@B', repeat({_quote(line)}, n % 9)), '@C', CASE WHEN n % 5 = 0 THEN '' ELSE '}}' END)"
    return f"""SELECT n, replace(replace({made}, '@N', n::VARCHAR), '@T', t) AS text
  FROM (SELECT doc_id AS n, translate(coalesce(text, ''), chr(10) || chr(13) || chr(92), '   ') AS t FROM documents)"""


def _code_lines(text: str, line: str, ext: str, clean: str) -> str:
    """Lines of generated code, from 0, with the byte behind each; a last line end opens no line."""
    return f"""WITH RECURSIVE code AS MATERIALIZED ({_code(text, line)}),
split AS MATERIALIZED (SELECT n, n || '{ext}' AS path, i - 1 AS i, x[i] AS s FROM (SELECT n, x, unnest(range(1, len(x) + CASE WHEN x[len(x)] = '' THEN 0 ELSE 1 END)) AS i FROM (SELECT n, string_split(text, chr(10)) AS x FROM code))),
line AS MATERIALIZED (SELECT *, sum(strlen(s) + 1) OVER (PARTITION BY n ORDER BY i) AS e, count(*) OVER (PARTITION BY n) AS lines, {clean} AS c FROM split)"""


#: What a line of code loses: comments and quoted text, an open quote up to the line's end.
_LOST = "//.*|#.*|" + "|".join(rf"{q}(?:[^{q}\\]|\\.)*(?:{q}|\\?$)" for q in ("'", '"', "`"))
_CONTROL = "^(if[ (]|for[ (]|while[ (]|switch[ (]|match |catch[ (]|else|try )"
_FRAGMENT_COLUMNS = """SELECT path || '#fragment:' || (row_number() OVER (PARTITION BY f.n ORDER BY a) - 1) AS id, path, (x.e - strlen(x.s) - 1)::BIGINT AS start_byte, y.e::BIGINT AS end_byte,
  a + 1 AS start_line, z + 1 AS end_line FROM found f JOIN line x ON x.n = f.n AND x.i = a JOIN (SELECT n, i, e FROM line) y ON y.n = f.n AND y.i = z WHERE z > a"""
_BRACES = _code_lines(BRACED, BRACED_LINE, ".rs", f"regexp_replace(s, {_quote(_LOST)}, '', 'g')") + f""",
deep AS MATERIALIZED (SELECT n, i, lines, c, sum(len(c) - len(replace(c, '{{', '')) - len(c) + len(replace(c, '}}', ''))) OVER (PARTITION BY n ORDER BY i) AS d FROM line),
step AS MATERIALIZED (SELECT *, coalesce(lag(d) OVER (PARTITION BY n ORDER BY i), 0) AS p FROM deep),
head AS MATERIALIZED (SELECT n, i, p, lines FROM step WHERE p <= 1 AND d > p AND NOT regexp_matches(ltrim(c), '{_CONTROL}') AND (contains(c, '(') OR contains(c, 'fn ') OR contains(c, 'func ') OR contains(c, 'function '))),
span AS MATERIALIZED (SELECT h.n, h.i AS a, least(coalesce(min(s.i), h.lines), h.i + 8) AS z, h.lines FROM head h LEFT JOIN step s ON s.n = h.n AND s.i >= h.i AND s.d <= h.p GROUP BY h.n, h.i, h.lines),
pick AS (SELECT n, a, z, lines FROM span WHERE (n, a) IN (SELECT (n, min(a)) FROM span GROUP BY n)
  UNION ALL SELECT s.n, s.a, s.z, s.lines FROM (SELECT p.n, p.z, min(s.a) AS a FROM pick p JOIN span s ON s.n = p.n AND s.a > p.z WHERE p.z < p.lines GROUP BY p.n, p.z) q JOIN span s ON s.n = q.n AND s.a = q.a),
found AS (SELECT n, a, z FROM pick WHERE z < lines AND z - a >= 2)
""" + _FRAGMENT_COLUMNS
_INDENTS = _code_lines(INDENTED, INDENTED_LINE, ".py", "strlen(s) - strlen(ltrim(s))") + """,
full_ AS MATERIALIZED (SELECT n, i, c, s, lines FROM line WHERE trim(s) <> ''),
def_ AS MATERIALIZED (SELECT d.n, d.i, coalesce(min(f.i), max(d.lines)) AS stop FROM full_ d LEFT JOIN full_ f ON f.n = d.n AND f.i > d.i AND f.c <= d.c WHERE regexp_matches(ltrim(d.s), '^(async )?def ') GROUP BY d.n, d.i),
found AS (SELECT d.n, d.i AS a, coalesce(min(f.i) FILTER (f.i - d.i >= 8), max(f.i), d.i) AS z FROM def_ d LEFT JOIN full_ f ON f.n = d.n AND f.i > d.i AND f.i < d.stop GROUP BY d.n, d.i HAVING coalesce(min(f.i) FILTER (f.i - d.i >= 8), max(f.i), d.i) - d.i >= 2)
""" + _FRAGMENT_COLUMNS

#: By language: how its comments and strings go in RE2's terms, and its own keywords.
_SLASHES = r"//[^\n]*\n?|/\*(?:[^*]|\*+[^*/])*(?:\*+/|\z)"
_TRIPLES = "|".join(rf"{q}{{3}}(?:[^{q}\\]|\\.|{q}{{1,2}}[^{q}\\])*{q}{{3}}" for q in ("'", '"'))
_CODE = [
    ("rust", BRACED, BRACED_LINE, r"/\* out /\* in \*/ again \*/|" + _SLASHES, "", "^//|^/[*]", "fn let mut impl trait pub crate super where".split()),
    ("typescript", BRACED, BRACED_LINE, _SLASHES, "", "^//|^/[*]", []),
    ("python", INDENTED, INDENTED_LINE, r"#[^\n]*\n?", _TRIPLES, "^#", "def lambda elif except with as pass raise in is".split()),
    ("sql", QUERY, "", r"--[^\n]*\n?", "", "^--", []),
]


def _code_tokens() -> str:
    """The lexer's alternatives in order, with the language's comments before names."""
    space, plain = _pattern().removeprefix("(?s)").split("|", 1)
    parts = []
    for language, text, line, comment, triples, lost, words in _CODE:
        pattern = "(?s)" + "|".join([space, comment, *([triples] if triples else []), plain])
        known = f"raw IN ({_list([*COMMON_KEYWORDS, *words])})"
        if language == "sql":
            known += " OR lower(raw) IN ('select', 'insert', 'update', 'delete', 'from', 'where', 'join', 'group', 'order', 'having', 'create', 'alter', 'drop')"
        parts.append(
            f"""SELECT '{language}' AS language, n AS id, kind, CASE WHEN kind = 'I' AND NOT ({known}) THEN '~identifier' WHEN kind = 'S' THEN '~string' ELSE raw END AS token
  FROM (SELECT *, {KIND.format(x="raw")} AS kind FROM (SELECT n, unnest(regexp_extract_all(text, {_quote(pattern)})) AS raw FROM ({_code(text, line)})) WHERE NOT regexp_matches(raw, '{SPACE}') AND NOT regexp_matches(raw, '{lost}'))"""
        )
    return "SELECT language, kind, token, count(*) AS n, count(DISTINCT id) AS n_docs FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL"


#: Extensions by language, written out once more.
_EXTENSIONS = (
    "rs:rust go:go c:c h:c cc:cpp cpp:cpp cxx:cpp hh:cpp hpp:cpp hxx:cpp sh:bash bash:bash zsh:bash sql:sql psql:sql js:javascript jsx:javascript mjs:javascript cjs:javascript "
    "ts:typescript tsx:typescript mts:typescript cts:typescript py:python pyi:python java:java cs:csharp html:markup htm:markup xml:markup vue:markup svelte:markup md:markup mdx:markup"
).split()


ORACLE_SQL = {
    "language_from_path": f"""WITH d AS ({_NAMED}), e AS (SELECT *, lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) AS extension FROM d)
SELECT doc_id, path, extension, CASE extension {" ".join("WHEN '{}' THEN '{}'".format(*x.split(":")) for x in _EXTENSIONS)} ELSE 'text' END AS language FROM e""",
    "lex_token_counts": chain(DOCS, "toks", "SELECT id, len(raws)::BIGINT AS n_tokens, len(raws) < 24 AS is_small FROM toks"),
    "lex_token_kinds": chain(DOCS, "tok", "SELECT kind, count(*) AS n, sum(strlen(raw))::BIGINT AS n_bytes FROM tok GROUP BY kind"),
    "token_positions": chain(block_steps("turns"), "pt", "SELECT id, pos, start_byte, end_byte, start_line, end_line FROM pt"),
    "renamed_tokens": chain(DOCS, "tok", "SELECT replace(renamed_raw, chr(0), '~') AS token, count(*) AS n, count(DISTINCT id) AS n_docs FROM tok GROUP BY renamed_raw"),
    "token_dictionary": chain(DOCS, "dict", "SELECT replace(token, chr(0), '~') AS token, token_id FROM dict"),
    "kgram_hashes": chain(steps("turns"), "kgrams", f"SELECT id, pos, {PRINT.format('h')} AS hash FROM kgrams"),
    "winnow_fingerprints": chain(DOCS, "fps", f"SELECT id, {PRINT.format('fp')} AS fp FROM fps"),
    "fingerprint_buckets": chain(RENAMED, "buckets", f"SELECT {PRINT.format('fp')} AS fp, n, n > 128 AS suppressed FROM buckets"),
    "effective_sizes": chain(RENAMED, "sizes", "SELECT id, size FROM sizes"),
    "candidate_pairs_exact": chain(DOCS, "cand", "SELECT left_id, right_id, shared, jaccard, containment FROM cand"),
    "candidate_pairs_renamed": chain(RENAMED, "cand", "SELECT left_id, right_id, shared, jaccard, containment FROM cand"),
    "type1_document_pairs": chain(DOCS, "clones", f"SELECT {_CLONE_COLUMNS} FROM clones"),
    "type2_document_pairs": chain(RENAMED, "clones", f"SELECT {_CLONE_COLUMNS} FROM clones WHERE kind = 'type2'"),
    "type3_document_pairs": chain(_near("documents"), "near", _NEAR_COLUMNS),
    "type3_conversation_pairs": chain(_near("turns"), "near", _NEAR_COLUMNS),
    "verified_pairs": chain(RENAMED, "clones", f"SELECT {_CLONE_COLUMNS} FROM clones"),
    "window_representatives": chain(BLOCKS, "hits", "SELECT h.id, h.pos, t.id AS left_id, h.left_pos FROM hits h JOIN lexed t ON t.rank = h.left_src"),
    "block_regions": chain(BLOCKS, "regions", "SELECT a.id AS left_id, b.id AS right_id, left_start, right_start, length FROM regions JOIN lexed a ON a.rank = left_src JOIN lexed b ON b.rank = right_src"),
    "block_pairs_snapped": chain(BLOCKS, "block", "SELECT * FROM block"),
    "page_block_pairs": chain(PAGE_BLOCKS, "block", "SELECT * FROM block"),
    "suppressed_pairs": chain(_BOTH, "pairs", """SELECT kind, similarity, left_path, left_start_byte, left_end_byte, left_start_line, left_end_line, right_path, right_start_byte, right_end_byte,
  right_start_line, right_end_line, compared_tokens FROM pairs a WHERE NOT EXISTS (SELECT 1 FROM pairs b WHERE b.left_path = a.left_path AND b.right_path = a.right_path
  AND b.left_start_byte <= a.left_start_byte AND b.left_end_byte >= a.left_end_byte AND b.right_start_byte <= a.right_start_byte AND b.right_end_byte >= a.right_end_byte
  AND (b.covered, b.compared_tokens, -b.u) > (a.covered, a.compared_tokens, -a.u))"""),
    "families": _recursive(_FAMILIES, "comp", "SELECT p.id AS first_id, member_id FROM comp JOIN path p ON p.path = comp.c"),
    "family_sizes": _recursive(_FAMILIES, "comp", "SELECT p.id AS first_id, count(DISTINCT member_id) AS n_members, count(l.left_id) AS n_pairs FROM comp JOIN path p ON p.path = comp.c LEFT JOIN clones l ON l.left_id = member_id GROUP BY p.id"),
    "clone_statistics": chain(DOCS, "clones", """SELECT 0::BIGINT AS source_files, 0::BIGINT AS source_tokens, (SELECT count(*) FROM texts) AS input_fragments, (SELECT count(*) FROM streams) AS analyzed_fragments,
  (SELECT count(*) FROM texts) - (SELECT count(*) FROM streams) AS skipped_small_fragments, (SELECT sum(len(strict))::BIGINT FROM streams) AS tokens, (SELECT count(*) FROM fps) AS fingerprints,
  (SELECT count(*) FROM cand) AS candidate_pairs, 0::BIGINT AS exact_block_candidates, (SELECT count(*) FROM clones) AS verified_pairs, (SELECT count(*) FROM buckets WHERE n > 128) AS suppressed_buckets,
  0::BIGINT AS suppressed_exact_buckets"""),
    "overlap_policy": chain(BLOCKS, "regions", """SELECT 'dropped' AS policy, count(*) AS n, coalesce(sum(length), 0)::BIGINT AS n_tokens FROM regions WHERE left_src = right_src
UNION ALL SELECT 'kept', count(*), coalesce(sum(length), 0)::BIGINT FROM every WHERE left_src = right_src"""),
    "extension_isolation": chain(BLOCKS, "wins", """SELECT domain, count(*) AS n_hits FROM (SELECT string_split(path, '/')[1] AS domain, row_number() OVER (PARTITION BY string_split(path, '/')[1], k ORDER BY src, pos) AS r FROM wins) WHERE r > 1 GROUP BY domain"""),
    "accuracy_counts": chain(_GATE, "counted", "SELECT * FROM counted"),
    "accuracy_metrics": chain(_GATE, "counted", """SELECT scope, precision::BIGINT AS precision, recall::BIGINT AS recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall // (precision + recall) END::BIGINT AS f1
FROM (SELECT scope, CASE WHEN tp + fp = 0 THEN 1000 ELSE tp * 1000 // (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1000 ELSE tp * 1000 // (tp + fn) END AS recall FROM counted)"""),
    "brace_fragments": _BRACES,
    "python_fragments": _INDENTS,
    "whole_file_fragments": chain(DOCS, "texts", """SELECT path || '#fragment:0' AS id, path, 0::BIGINT AS start_byte, strlen(text)::BIGINT AS end_byte, 1::BIGINT AS start_line,
  (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS end_line FROM texts WHERE contains(text, chr(10))"""),
    "code_tokens": _code_tokens(),
    "near_miss_statistics": chain(_near("documents"), "near", """SELECT 0::BIGINT AS source_files, 0::BIGINT AS source_tokens, (SELECT count(*) FROM texts) AS input_fragments, (SELECT count(*) FROM streams) AS analyzed_fragments,
  (SELECT count(*) FROM texts) - (SELECT count(*) FROM streams) AS skipped_small_fragments, (SELECT sum(len(strict))::BIGINT FROM streams) AS tokens, (SELECT count(*) FROM fps) AS fingerprints,
  (SELECT count(*) FROM cand) AS candidate_pairs, 0::BIGINT AS exact_block_candidates, (SELECT count(*) FROM clones) + (SELECT count(*) FROM near WHERE edit_distance <= compared_tokens * 200 // 1000) AS verified_pairs,
  (SELECT count(*) FROM buckets WHERE n > 128) AS suppressed_buckets, 0::BIGINT AS suppressed_exact_buckets"""),
    "bigcloneeval_rows": chain(_FLAT, "frag", """SELECT 'selected' AS left_category, string_split(left_path, '/')[3] AS left_file, left_start_line AS left_start, left_end_line AS left_end,
  'selected' AS right_category, string_split(right_path, '/')[3] AS right_file, right_start_line AS right_start, right_end_line AS right_end FROM frag"""),
    "pair_ids": _recursive(_TOLD, "told", "SELECT id, left_id, right_id FROM told"),
    "report_json": _recursive(_TOLD, "told", f"""SELECT id, to_json({{'id': id, 'kind': kind, 'similarityPermille': similarity, 'left': {_place("left")}, 'right': {_place("right")},
  'evidence': {{{_PAIR_EVIDENCE}}}}})::VARCHAR AS json FROM told"""),
    "report_family_json": _recursive(_TOLD_FAMILIES, "family_id", "SELECT f.id, to_json({'id': f.id, 'members': members, 'pairIds': ids})::VARCHAR AS json FROM family_parts JOIN family_id f USING (key)"),
    "sarif_results": _recursive(_TOLD, "told", f"""SELECT id, to_json({{'ruleId': 'CLONE.TYPE1', 'ruleIndex': 0, 'level': 'warning', 'message': {{'text': 'These lines are repeated elsewhere: 100.0 % alike, kind 1'}},
  'locations': [{{'physicalLocation': {_sarif_place("left")}}}], 'relatedLocations': [{{'id': 1, 'message': {{'text': 'the same lines again'}}, 'physicalLocation': {_sarif_place("right")}}}],
  'partialFingerprints': {{'clonePairId/v1': id}}, 'properties': {{'kind': kind, 'similarityPermille': similarity, {_PAIR_EVIDENCE}}}}})::VARCHAR AS json FROM told"""),
    "stable_ids": _recursive([("parts", "SELECT doc_id AS key, [doc_id::VARCHAR, source] AS parts FROM documents"), *_digest("pair", "parts")], "pair_id", "SELECT key AS doc_id, id FROM pair_id"),
}
