"""Renaming and dictionary encoding of token streams.

Every fragment has a dictionary of its own: its distinct tokens, each with the place
where it comes first, and the fragment as numbers into that.  Only distinct tokens take
part in building the common dictionary, and only those that few fragments have are
shuffled to get numbers back from it; there is one plan for every size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.languages import is_keyword
from ..functions.lexing import in_parts, kind_of, list_starts
from .ordering import numbered, spot

IDENTIFIER, STRING = "\0identifier", "\0string"


def renamed(kind: Column, raw: Column, language: Column) -> Column:
    """Blind renaming: every identifier but keywords becomes one placeholder, and
    so does every string; the rest stays."""
    return F.when((kind == "I") & ~is_keyword(raw, language), F.lit(IDENTIFIER)).when(kind == "S", F.lit(STRING)).otherwise(raw)


def exploded(lexed: DataFrame, *keys: str) -> DataFrame:
    """One row per token: the keys, ``pos`` from 0, ``kind``, ``raw``, ``renamed``."""
    rows = lexed.select(*keys, "language", F.posexplode("tokens").alias("pos", "t"))
    return rows.select(*keys, "pos", F.col("t.kind").alias("kind"), F.col("t.raw").alias("raw"), renamed(F.col("t.kind"), F.col("t.raw"), F.col("language")).alias("renamed"))


def _own_words(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per distinct token of a fragment: the keys, ``language``, ``i``, ``first``, ``raw``."""
    words = rows.select(*keys, "language", F.posexplode(F.arrays_zip("words", "first")).alias("i", "w"))
    return words.select(*keys, "language", "i", F.col("w.first").alias("first"), F.col("w.words").alias("raw"))


def dictionary(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """(token, token_id, rows) of all tokens of rows of ``own_dictionaries``: ids from 0 by
    first appearance over rows in the order of ``rank`` and place, a token before the
    placeholder it is renamed to; ``rows`` counts those that have the token as it stands."""
    # A placeholder's first place is the first of the tokens renamed to it, so it
    # follows from the distinct ones.
    seen = _own_words(rows, rank).groupBy("raw", "language").agg(F.min(spot(F.col(rank), F.col("first"))).alias("at"), F.count("*").alias("rows"))
    own = F.struct(F.col("raw").alias("token"), (F.col("at") * 2).alias("at"), "rows")
    name = renamed(kind_of(F.col("raw")), F.col("raw"), F.col("language"))
    other = F.struct(name.alias("token"), (F.col("at") * 2 + 1).alias("at"), F.lit(0).cast("long").alias("rows"))
    both = seen.select(F.inline(F.when(name == F.col("raw"), F.array(own)).otherwise(F.array(own, other))))
    first = both.groupBy("token").agg(F.min("at").alias("at"), F.sum("rows").alias("rows"))
    return numbered(first, ["at"], "token_id").select("token", "token_id", "rows")


#: Tokens whose numbers every task is given; the others get theirs by a join.
MOST_SENT = 1 << 17
_STREAMS = T.StructType([T.StructField(name, T.ArrayType(T.LongType())) for name in ("strict", "renamed")])


def _sent(words: DataFrame, other: Column, languages: list[str]) -> tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]:
    """The tokens that most rows have, at most ``MOST_SENT`` of no more than 64
    characters, with their numbers and, by language, those of what they are renamed to."""
    level = F.length(F.bin("rows"))
    short = words.where((F.col("rows") > 1) & (F.length("token") <= 64))
    least, total = 64, 0
    for r in sorted(short.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # one row for each power of two
        total += r["count"]
        if total > MOST_SENT:
            break
        least = r["level"]
    by = [F.coalesce(other(F.col("token"), kind_of(F.col("token")), F.lit(x)), F.col("token_id")).alias(f"l{i}") for i, x in enumerate(languages)]
    found = short.where(level >= least).select("token", "token_id", *by).toArrow()
    numbers = lambda c: np.asarray(found.column(c).combine_chunks(), np.int64)
    return found.column("token").combine_chunks().cast(pa.string()), numbers("token_id"), {x: numbers(f"l{i}") for i, x in enumerate(languages)}


def encoded(rows: DataFrame, words: DataFrame, rank: str = "rank") -> DataFrame:
    """(rank, strict, renamed): id arrays of all rows of ``own_dictionaries`` that have
    tokens.  The tokens that most fragments have are few, and are looked up in place;
    only the other distinct tokens meet the dictionary in a join, and come back to
    their fragment's codes by its rank."""
    held = {r.token: r.token_id for r in words.where(F.col("token").isin(IDENTIFIER, STRING)).select("token", "token_id").collect()}  # two rows at most

    def other(raw: Column, kind: Column, language: Column) -> Column:
        name = renamed(kind, raw, language)
        return F.when(name == IDENTIFIER, F.lit(held.get(IDENTIFIER))).when(name == STRING, F.lit(held.get(STRING))).cast("long")

    rows = rows.where(F.size("codes") > 0)
    languages = [r.language for r in rows.select("language").distinct().collect()]  # no more than the lexer knows
    sent = rows.sparkSession.sparkContext.broadcast(_sent(words, other, [x for x in languages if x is not None]))

    def places(own: pa.Array) -> np.ndarray:
        """Where each word is among those that were sent, -1 if it is not."""
        names = sent.value[0]
        flat = own.flatten()
        return np.asarray(pc.index_in(flat, names.cast(flat.type)).fill_null(-1), np.int64)

    def unsent(own: pa.Array) -> pa.Array:
        starts, missing = list_starts(own), np.flatnonzero(places(own) < 0)
        row = np.searchsorted(starts, missing, "right") - 1
        values = [pa.array((missing - starts[row]).astype(np.int32)), own.flatten().take(pa.array(missing)).cast(pa.string())]
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, starts).astype(np.int32)), pa.StructArray.from_arrays(values, ["i", "raw"]))

    def known(own: pa.Array, language: pa.Array) -> pa.Array:
        starts, at = list_starts(own), places(own)
        _, ids, by = sent.value
        strict = np.append(ids, -1)[at]
        loose = np.full(len(at), -1, np.int64)
        of = np.repeat(np.array([x if x is not None else "" for x in language.to_pylist()], object), np.diff(starts))
        for x, numbers in by.items():
            loose = np.where(of == x, np.append(numbers, -1)[at], loose)
        offsets = pa.array(starts.astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (strict, loose)], ["strict", "renamed"])

    @F.arrow_udf("array<struct<i: int, raw: string>>")
    def unsent_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in batches:
            yield from in_parts(unsent, (own,))

    @F.arrow_udf(_STREAMS)
    def known_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield from in_parts(known, columns)

    rare = rows.select(rank, "language", F.inline(unsent_of("words")))
    found = rare.join(words.select(F.col("token").alias("raw"), "token_id"), "raw")
    one = F.struct("i", "token_id", F.coalesce(other(F.col("raw"), kind_of(F.col("raw")), F.col("language")), F.col("token_id")).alias("renamed_id"))
    back = found.select(rank, one.alias("w")).groupBy(rank).agg(F.collect_list("w").alias("more"))
    own = rows.select(rank, "codes", known_of("words", "language").alias("known")).select(rank, "codes", "known.*").join(back, rank, "left")
    return own.select(rank, _filled(F.col("codes"), F.col("strict"), F.col("renamed"), F.coalesce("more", F.array().cast(back.schema["more"].dataType))).alias("t")).select(rank, "t.strict", "t.renamed")


def _streams_of(codes: pa.Array, strict: pa.Array, loose: pa.Array, more: pa.Array) -> pa.Array:
    """Codes as the numbers that a fragment's words have, in the order of their codes:
    those that are known, and ``more`` of (word, its numbers)."""
    starts, own = list_starts(codes), list_starts(strict)
    at = np.asarray(codes.flatten(), np.int64) + np.repeat(own[:-1], np.diff(starts))
    rest = more.flatten()
    filled = np.asarray(rest.field("i"), np.int64) + np.repeat(own[:-1], np.diff(list_starts(more)))
    offsets, parts = pa.array(starts.astype(np.int32)), []
    for lists, name in ((strict, "token_id"), (loose, "renamed_id")):
        values = np.array(lists.flatten(), np.int64)
        values[filled] = np.asarray(rest.field(name), np.int64)
        parts.append(pa.ListArray.from_arrays(offsets, pa.array(values[at])))
    return pa.StructArray.from_arrays(parts, ["strict", "renamed"])


@F.arrow_udf(_STREAMS)
def _filled(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        yield from in_parts(_streams_of, columns)
