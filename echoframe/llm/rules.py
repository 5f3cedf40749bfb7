"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and
one bit per failed rule.  What a policy rejects, and what each of its rules
alone is to blame for, then follows from the bits: policies are masks with a
version, and ablations are counts of bit patterns, of which there are at most
two to the number of rules, however many documents there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Rule names in bit order, each with the condition on which a document fails it.
#: The first two are the base; the others are lenient, so that a clean document
#: with an odd trait passes.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 5 and 2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 16 * n_words or word_chars < 2 * n_words",
    "upper_case": "2 * n_upper > word_chars",
    "exclamations": "2 * n_exclamations > n_words",
}


def bits_of(*names: str) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document with any of their bits goes."""

    name: str
    version: int
    mask: int


BASE = Policy("base", 1, bits_of("few_words", "repeated_words"))
STRICT = Policy("web", 1, bits_of(*RULES))


def _removed(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


_LOW = (1 << 24) - 1


def _window_hash(i: Column) -> Column:
    return F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))


def _places(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 3)


def _packed_windows(n: Column) -> Column:
    """The three-word windows in the order of their hashes, as plain longs: 40 bits
    of the hash and the position in the low 24; nothing for longer texts."""
    packed = F.transform(_places(n), lambda i: F.shiftleft(_window_hash(i), 24).bitwiseOR(i.cast("long")))
    return F.when((n >= 3) & (n < _LOW), F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))


def _at(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW).cast("long")).cast("int")


def _same_words(i: Column, j: Column) -> Column:
    words = [F.get("_words", i + k) == F.get("_words", j + k) for k in range(3)]
    return words[0] & words[1] & words[2]


def _same_key(x: Column, y: Column) -> Column:
    return F.shiftright(x, 24) == F.shiftright(y, 24)


def _clash(ordered: str) -> Column:
    """Whether different windows share their 40 bits: then repeats may not be neighbours."""
    places = F.sequence(F.lit(1), F.size(ordered) - 1)
    apart = lambda j: _same_key(F.get(ordered, j), F.get(ordered, j - 1)) & ~_same_words(_at(F.get(ordered, j)), _at(F.get(ordered, j - 1)))
    return F.when(F.size(ordered) > 1, F.exists(places, apart)).otherwise(F.lit(False))


def _spelled_windows(n: Column, wanted: Column) -> Column:
    """The windows in the order of their words, of the rows ``wanted``."""
    spelled = F.transform(_places(n), lambda i: F.struct(F.concat_ws(" ", *[F.get("_words", i + k) for k in range(3)]).alias("w"), i.alias("i")))
    return F.when(wanted & (n >= 3), F.sort_array(spelled)).otherwise(F.array().cast("array<struct<w:string,i:int>>"))


def _repeats(ordered: str, same, at) -> Column:
    """Positions, ascending, of the windows that are the ``same`` as a neighbour in the
    order; ``ordered`` must be a column of the table, or every step would sort anew."""
    like = lambda x, y: F.coalesce(same(x, y), F.lit(False))
    found = F.filter(ordered, lambda x, j: like(x, F.get(ordered, j - 1)) | like(x, F.get(ordered, j + 1)))
    return F.sort_array(F.transform(found, at))


def _covered(starts: Column) -> Column:
    """How many words stand in windows of three that begin at ``starts``."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measurements ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_lines`` (with a word), ``n_dup_lines``, ``n_repeat_words``, ``n_upper`` and
    ``n_exclamations``, and ``failed``, the bits of the rules that failed.

    A null or empty text has no words and fails ``few_words``.  Columns of the
    input with one of these names are replaced.  Each row is measured on its own,
    so repeated rows give equal ledgers, and an empty table an empty one."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclamations", "failed"]
    keep = [f"`{c}`" for c in df.columns if c.lower() not in {*made, "_body", "_words", "_lines", "_packed", "_clash", "_spelled", "_mark"}]
    if text in made:
        raise ValueError(f"the text column must not be named {text}")
    split = df.select(
        *keep,
        body.alias("_body"),
        F.array_remove(F.split(body, SPACE), "").alias("_words"),
        F.filter(F.split(body, "\n"), lambda x: F.length(_removed(x, " \t\r\f\v")) > 0).alias("_lines"),
    )
    n = F.size("_words")
    # The number keeps a later filter from being moved below this step, where the
    # sorted windows would be made anew for every one of them; it is never negative.
    ordered = split.select("*", _packed_windows(n).alias("_packed"), F.monotonically_increasing_id().alias("_mark"))
    ordered = ordered.withColumn("_clash", _clash("_packed") | (n >= _LOW))
    ordered = ordered.withColumn("_spelled", _spelled_windows(n, F.col("_clash")))
    nothing = F.when(F.col("_mark") < 0, F.lit(1)).otherwise(F.lit(0))
    few = _repeats("_packed", lambda x, y: _same_key(x, y) & _same_words(_at(x), _at(y)), _at)
    many = _repeats("_spelled", lambda x, y: x["w"] == y["w"], lambda x: x["i"])
    repeated = F.when(F.col("_clash"), _covered(many)).otherwise(_covered(few))
    counted = ordered.select(
        *keep,
        (n + nothing).cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_body") - F.length(_removed(F.col("_body"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        (repeated + nothing).alias("n_repeat_words"),
        F.regexp_count("_body", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        (F.length("_body") - F.length(_removed(F.col("_body"), "!"))).cast("long").alias("n_exclamations"),
    )
    failed = F.lit(0).cast("long")
    for bit, rule in enumerate(RULES.values()):
        failed = failed + F.when(F.expr(rule), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return counted.withColumn("failed", failed)


def passes(policy: Policy, failed: Column | None = None) -> Column:
    """Whether a document of the ledger passes the policy."""
    failed = F.col("failed") if failed is None else failed
    return failed.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(measured: DataFrame, policies: list[Policy]) -> DataFrame:
    """One row per policy and rule of it: ``policy``, ``version``, ``rule``,
    ``n_docs``, ``n_rejected`` by the policy, ``n_failed`` this rule, and
    ``n_only`` rejected by this rule alone, which would stay without it.

    The documents are counted once by bit pattern; the rest is bit arithmetic on
    the patterns.  An empty ledger gives no rows."""
    patterns = measured.groupBy("failed").agg(F.count("*").alias("n"))
    rules = [
        F.struct(
            F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"),
            F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << i).cast("long").alias("bit"),
        )
        for p in policies for i, r in enumerate(RULES) if p.mask >> i & 1
    ]
    each = patterns.select("failed", "n", F.inline(F.array(*rules)))
    hit = F.col("failed").bitwiseAND(F.col("mask"))

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    return each.groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(hit != 0).alias("n_rejected"),
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only"),
    )


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", policy: Policy = STRICT) -> DataFrame:
    """One row per document: its key, the base measurements, ``base_failed``, the
    ledger's ``failed`` bits and ``kept``, the verdict of ``policy``.

    A null text has no words, as an empty one, and fails; null and repeated keys are
    rows like any others; an empty table gives an empty one; other columns are ignored."""
    out = ledger(df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"), (passes(BASE) & passes(policy)).alias("kept"), F.col("failed").alias("failed_rules"),
    )


def keep_good(df: DataFrame, text: str = "text", policy: Policy = STRICT) -> DataFrame:
    """The rows of ``df`` that pass the policy, with the columns of ``df``.  Null and
    empty texts fail, as they have no words; nulls elsewhere, repeated rows and columns
    named like measurements stay as they are; an empty table gives an empty one."""
    carried = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("rule_text"))
    kept = ledger(carried, "rule_text").where(passes(BASE) & passes(policy))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


JUDGE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT rid, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
pos AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '\P{Lu}', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclamations
  FROM d LEFT JOIN pos USING (rid)),
f AS (SELECT *, (%s)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & %d <> 0 AS base_failed, failed & %d = 0 AS kept, failed AS failed_rules
FROM f
""" % (
    " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values())),
    BASE.mask,
    BASE.mask | STRICT.mask,
)
