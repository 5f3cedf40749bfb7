"""Fill-in-the-middle transformation by escaped markers.

A text's units are runs of letters and single other characters.  Where a text is
cut depends on how many units it has, so they must be counted and the k-th found,
which no built-in function does on its own.  Here a *mark* is put behind every unit:

1. the mark and the escape character, where the text has them, are escaped by
   pairs that stay one unit each;
2. ``regexp_replace`` appends the mark behind every unit;
3. the number of marks is the number of units, and ``substring_index`` gives what
   lies before the k-th of them, or behind it;
4. marks are taken out and pairs unescaped, and the parts are put together.

All of it is column expressions within one row: no shuffle and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Behind units, before escaped characters, and what follows that for either of the
#: two.  Neither follower is a letter, so escaping joins no units.
MARK, ESCAPE, FOR_ESCAPE, FOR_MARK = "\x01", "\x02", "0", "1"
#: The markers of prefix, suffix and middle in the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One unit of an escaped text.
UNIT = rf"[A-Za-z]+|{ESCAPE}[{FOR_ESCAPE}{FOR_MARK}]|[^A-Za-z{ESCAPE}]"


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def marked(text: Column) -> Column:
    """The escaped text with a mark behind every unit."""
    escaped = _swap(text, (ESCAPE, ESCAPE + FOR_ESCAPE), (MARK, ESCAPE + FOR_MARK))
    return F.regexp_replace(escaped, f"({UNIT})", f"$1{MARK}")


def plain(marked_text: Column) -> Column:
    """What ``marked`` was made of."""
    return _swap(marked_text, (MARK, ""), (ESCAPE + FOR_MARK, MARK), (ESCAPE + FOR_ESCAPE, ESCAPE))


def unit_count(marked_text: Column) -> Column:
    return (F.octet_length(marked_text) - F.octet_length(F.replace(marked_text, F.lit(MARK), F.lit("")))).cast("long")


def _draw(key: str, which: int) -> Column:
    """The ``which``-th 32-bit number, from 1, of the hash of a key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * which - 7, 8), 16, 10).cast("long")


def _upto(c: str, k: str) -> Column:
    """The first ``k`` units."""
    return F.expr(f"substring_index({c}, '\\u0001', cast({k} as int))")


def _behind(c: str, k: str) -> Column:
    """All units behind the first ``k`` of ``_n``."""
    return F.expr(f"substring_index({c}, '\\u0001', cast({k} - _n - 1 as int))")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  Markers are found by their first place:
    none can begin in a part or across its border, since markers begin with ``<``,
    end with ``>`` and no part holds one."""
    body = F.substr(output, F.lit(4))
    first, rest = F.substring_index(body, SUFFIX, 1), F.substring_index(body, SUFFIX, -1)
    psm = F.concat(first, F.substring_index(rest, MIDDLE, -1), F.substring_index(rest, MIDDLE, 1))
    suffix, rest = F.substring_index(body, PREFIX, 1), F.substring_index(body, PREFIX, -1)
    spm = F.concat(F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1), suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 90, suffix_first: int = 20) -> DataFrame:
    """One row per input row: the key as ``doc_id``, ``text``, ``n`` (units), ``form``,
    ``prefix_chars``, ``middle_chars`` and ``output``.

    Four numbers are drawn from a hash of the key.  The first two, modulo n + 1, are
    the cuts; the third leaves 100 - ``rate`` percent of the texts plain, the fourth
    gives ``suffix_first`` percent of the others the suffix first.  A text that is
    empty or holds a marker is plain; for plain texts the two lengths are null.

    A null text is empty.  A null key draws as the empty key does; rows of one key
    draw alike, and repeated rows give repeated rows.  A part may be empty.  Texts are
    taken whole, up to what one string of three times their size may be.  An empty
    table gives an empty table, and other columns are ignored, whatever their names."""
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("_marked", marked(F.col("text"))).withColumn("_n", unit_count(F.col("_marked")))
    cuts = [F.pmod(_draw("doc_id", i), F.col("_n") + 1) for i in (1, 2)]
    held = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when(held | (_draw("doc_id", 3) % 100 >= rate), "plain").when(_draw("doc_id", 4) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumns({"_a": F.least(*cuts), "_b": F.greatest(*cuts), "form": form})
    rows = rows.withColumn("_head", _upto("_marked", "_b"))
    # What lies behind the first cut of the head: it has _b marks but the last.
    inner = F.expr("substring_index(_head, '\\u0001', cast(_a - _b as int))")
    middle = F.when(F.col("_a") == F.col("_b"), F.lit("")).otherwise(inner)
    parts = {"prefix": plain(_upto("_marked", "_a")), "middle": plain(middle), "suffix": plain(_behind("_marked", "_b"))}
    rows = rows.withColumns(parts)
    p, s, m = (F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE))
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
    size = lambda c: F.when(F.col("form") != "plain", F.char_length(c).cast("long"))
    return rows.select(
        "doc_id", "text", F.col("_n").alias("n"), "form", size("prefix").alias("prefix_chars"), size("middle").alias("middle_chars"),
        output.alias("_output"),
    ).select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", F.coalesce("_output", "text").alias("output"))


def infilling_digests(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``fill_in_middle`` with hashes in place of texts: ``output_sha256`` and
    ``restored_sha256``, the latter of what ``restored`` makes of output and form."""
    made = fill_in_middle(df, key, text, **options)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


INFILLING_SQL = """
with units as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || doc_id) as h from documents
), drawn as (
    select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as c1, ('0x' || h[9:16])::bigint % (len(u) + 1) as c2,
        ('0x' || h[17:24])::bigint % 100 as h3, ('0x' || h[25:32])::bigint % 100 as h4
    from units
), cut as (
    select doc_id, t, n, array_to_string(u[1:least(c1, c2)], '') as p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') as m,
        array_to_string(u[greatest(c1, c2) + 1:], '') as s,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain' when h4 < 20 then 'spm' else 'psm' end as form
    from drawn
)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
    sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) as output_sha256,
    sha256(t) as restored_sha256
from cut
"""
