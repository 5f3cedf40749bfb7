"""Lexing with one regular expression per language, run by Spark's own
``regexp_extract_all``.

The alternatives cover every character, so the lexemes of a text joined are the
text, and running sums over their lengths give byte and line positions.  Every
repetition is possessive: no input, however long a string or comment in it,
makes the matcher recurse.

Comments that nest (Rust only) are not a regular language; Rust texts in which a
comment opens inside a comment are split by a small Python helper instead.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .languages import LANGUAGES

WHITE = r" \t\n\f\r"
SPACE = rf"[{WHITE}]++"
LETTER = r"[\p{IsAlphabetic}\p{N}&&[^\x00-\x7F]]"
IDENTIFIER = rf"(?:[A-Za-z_$]|{LETTER})(?:[A-Za-z0-9_$]|{LETTER})*+"
NUMBER = r"[0-9][A-Za-z0-9_.]*+(?:(?<=[eEpP])[+-][A-Za-z0-9_.]*+)*+"
#: The operators of more than one character, longer ones first.
OPERATORS = (
    ">>>= >>= <<= === !== ... >= >> <= << <- => == != .. -> -- -= :: := && &= || |= ++ += ** *= // /= %= ^= ?? ?."
).split()


def _quoted(mark: str) -> str:
    return rf"{mark}[^{mark}\\]*+(?:\\.[^{mark}\\]*+)*+(?:{mark}|\\?\z)"


def _tripled(mark: str) -> str:
    inner = rf"(?:\\.|{mark}(?!{mark}{mark}))"
    return rf"{mark}{{3}}[^{mark}\\]*+(?:{inner}[^{mark}\\]*+)*+(?:{mark}{{3}}|\\?\z)"


LINE = {"python": "#", "bash": "#", "sql": "--"}
SLASHED = ("rust", "go", "c", "cpp", "javascript", "typescript", "java", "csharp")


def pattern(language: str, spaced: bool = True) -> str:
    """The pattern of a language, for Java's matcher.  Without ``spaced``, white space
    belongs to what stands before it, and a lexeme without it is the first group."""
    comments = []
    if language in LINE:
        comments = [LINE[language] + r"[^\n]*+\n?+"]
    elif language in SLASHED:
        comments = [r"//[^\n]*+\n?+", r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)"]
    strings = [_quoted("'"), _quoted('"'), _quoted("`")]
    if language == "python":
        strings = [_tripled("'"), _tripled('"'), *strings]
    operators = ["".join("\\" + c for c in op) for op in OPERATORS]
    others = [*comments, IDENTIFIER, NUMBER, *strings, *operators]
    if spaced:
        return "(?s)" + "|".join([SPACE, *others, "."])
    return rf"(?s)({'|'.join([*others, f'[^{WHITE}]'])})[{WHITE}]*+"


@functools.cache
def _rust_token() -> re.Pattern:
    """A lexeme of Rust, of a comment only how it opens."""
    plain = pattern("rust").removeprefix("(?s)").replace(r"\z", r"\Z").replace(LETTER, r"[^\W\x00-\x7f]").replace(r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|", "")
    return re.compile(r"/\*|" + plain, re.S)


_COMMENT_ENDS = re.compile(r"/\*|\*/")


def _nested_rust(text: str) -> list[str]:
    """Lexemes of a Rust text whose comments may nest."""
    out, at = [], 0
    while at < len(text):
        for m in _rust_token().finditer(text, at):
            if m[0] == "/*":
                at = m.start()
                break
            out.append(m[0])
        else:
            break
        depth, end = 0, len(text)
        for m in _COMMENT_ENDS.finditer(text, at):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                end = m.end()
                break
        out.append(text[at:end])
        at = end
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nested_lexemes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([_nested_rust(t.as_py()) if t.is_valid else None for t in texts], pa.list_(pa.string()))


def lexemes(df: DataFrame, text: str = "text", language: str = "language", spaced: bool = True, once: bool = False) -> DataFrame:
    """``df`` with ``lexemes``: the whole text in pieces, comments among them, and white
    space too, which may be left out without ``spaced``.  With ``once`` each row of
    ``df`` is made once; else it is in two parts, and only texts with nested comments
    go through Python."""
    by_language = F.create_map(*[F.lit(x) for name in LANGUAGES for x in (name, pattern(name, spaced))])
    native = F.regexp_extract_all(F.col(text), by_language[F.col(language)], F.lit(0 if spaced else 1))
    nests = (F.col(language) == "rust") & F.col(text).rlike(r"(?s)/\*(?:[^*/]|\*(?!/)|/(?!\*))*+/\*")
    if once:
        return df.withColumn("lexemes", F.coalesce(_nested_lexemes(F.when(nests, F.col(text))), native))
    odd = df.where(nests).withColumn("lexemes", _nested_lexemes(F.col(text)))
    return df.where(~F.coalesce(nests, F.lit(False))).withColumn("lexemes", native).unionByName(odd)


def _marks(language: Column) -> Column:
    """Which comments a language has, as bits: 1 slashed, 2 hashed, 4 dashed."""
    return F.when(language.isin(*SLASHED), 1).when(language.isin("python", "bash"), 2).when(language == "sql", 4).otherwise(0).cast("int")


def list_starts(lists: pa.Array) -> np.ndarray:
    """Where the values of each list begin, and one more bound."""
    offsets = np.asarray(lists.offsets, np.int64)
    return offsets - offsets[0]


#: Values of lists that a Python function works on at once: its own arrays take some
#: hundred bytes for each, whatever a batch of Spark's holds.
MOST_VALUES = 1 << 18


def in_parts(work: Callable[..., pa.Array], columns: tuple[pa.Array, ...], most: int = 0) -> Iterator[pa.Array]:
    """What ``work`` makes of the rows of ``columns``, a part of the rows after the other:
    as many as hold about ``most`` values in the first column's lists, or one row."""
    most = most or MOST_VALUES
    starts, at, n = list_starts(columns[0]), 0, len(columns[0])
    while at < n:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
        yield work(*[c.slice(at, end - at) for c in columns])
        at = end
    if not n:
        yield work(*columns)


def _bytes_of(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text of an array begins among all bytes, with one more bound, and those bytes."""
    width = np.int64 if pa.types.is_large_string(pieces.type) else np.int32
    at = np.frombuffer(pieces.buffers()[1], width, len(pieces) + 1, pieces.offset * np.dtype(width).itemsize).astype(np.int64)
    return at, np.frombuffer(pieces.buffers()[2], np.uint8)


def _tokens_among(pieces: pa.Array, starts: np.ndarray, marks: pa.Array) -> np.ndarray:
    """False for lexemes that are white space or, by their row's marks, comments."""
    if len(pieces) == 0:
        return np.zeros(0, bool)
    at, raw = _bytes_of(pieces)
    first = raw[at[:-1]]  # no lexeme is empty
    second = np.where(np.diff(at) > 1, raw[np.minimum(at[:-1] + 1, len(raw) - 1)], 0)
    bits = np.repeat(np.asarray(marks.fill_null(0), np.int64), np.diff(starts))
    space = (first == 32) | ((first >= 9) & (first <= 13) & (first != 11))
    slashed = (first == 47) & ((second == 47) | (second == 42)) & (bits & 1 > 0)
    return ~(space | slashed | ((first == 35) & (bits & 2 > 0)) | ((first == 45) & (second == 45) & (bits & 4 > 0)))


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)


def _arrays(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in kinds.items()])


_PLACES = [T.StructField("raw", T.StringType())] + [T.StructField(f"{side}_byte", T.LongType()) for side in ("start", "end")] + [T.StructField(f"{side}_line", T.IntegerType()) for side in ("start", "end")]


def _places_of(lexemes: pa.Array, marks: pa.Array) -> pa.Array:
    """The tokens among lexemes, with their places: running sums of the lexemes' bytes
    and line ends, less those before their text."""
    starts, pieces = list_starts(lexemes), lexemes.flatten()
    kept = _tokens_among(pieces, starts, marks)
    row = np.repeat(np.arange(len(lexemes)), np.diff(starts))[kept]

    def before_and_after(sizes):
        total = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
        return total[:-1][kept] - total[starts[row]], total[1:][kept] - total[starts[row]]

    bytes_at = before_and_after(pc.binary_length(pieces))
    lines_at = [x.astype(np.int32) + 1 for x in before_and_after(pc.count_substring(pieces, "\n"))]
    values = [pieces.filter(pa.array(kept)).cast(pa.string()), *map(pa.array, bytes_at), *map(pa.array, lines_at)]
    own = np.concatenate([[0], np.cumsum(kept)])[starts]
    return _lists(own, pa.StructArray.from_arrays(values, [f.name for f in _PLACES]))


@F.arrow_udf(T.ArrayType(T.StructType(_PLACES)))
def _placed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        yield from in_parts(_places_of, columns)


def _lines_of(lexemes: pa.Array, marks: pa.Array) -> pa.Array:
    """The lines that the tokens among lexemes begin and end in, from 1."""
    starts, pieces = list_starts(lexemes), lexemes.flatten()
    kept = _tokens_among(pieces, starts, marks)
    row = np.repeat(np.arange(len(lexemes)), np.diff(starts))[kept]
    total = np.concatenate([[0], np.cumsum(np.asarray(pc.count_substring(pieces, "\n"), np.int64))])
    own = np.concatenate([[0], np.cumsum(kept)])[starts]
    parts = [_lists(own, pa.array((x[kept] - total[starts[row]] + 1).astype(np.int32))) for x in (total[:-1], total[1:])]
    return pa.StructArray.from_arrays(parts, ["from_line", "to_line"])


@F.arrow_udf(_arrays(from_line=T.IntegerType(), to_line=T.IntegerType()))
def _lined(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        yield from in_parts(_lines_of, columns)


def _hashes_of(lexemes: pa.Array, marks: pa.Array) -> pa.Array:
    """64-bit hashes of the tokens among lexemes; each distinct lexeme is hashed once."""
    starts, pieces = list_starts(lexemes), lexemes.flatten()
    kept = _tokens_among(pieces, starts, marks)
    coded = pieces.dictionary_encode()
    kinds = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, kinds)), np.uint64).view(np.int64)
    return _lists(np.concatenate([[0], np.cumsum(kept)])[starts], pa.array(hashes[np.asarray(coded.indices)[kept]]))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _hashed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        yield from in_parts(_hashes_of, columns)


def _dictionary_of(lexemes: pa.Array, marks: pa.Array) -> pa.Array:
    """For each text its distinct tokens in any order, the first place of each among the
    text's tokens, how often each occurs, the tokens as places in the array of distinct
    ones, and a SHA-256 of the tokens with their lengths."""
    starts, pieces = list_starts(lexemes), lexemes.flatten()
    kept = _tokens_among(pieces, starts, marks)
    row = np.repeat(np.arange(len(lexemes)), np.diff(starts))[kept]
    starts = np.concatenate([[0], np.cumsum(kept)])[starts]
    pieces = pieces.filter(pa.array(kept))
    coded = pieces.dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    # One sort finds the distinct tokens of all texts of the batch.
    found, first, codes, times = np.unique(row * kinds + np.asarray(coded.indices, np.int64), return_index=True, return_inverse=True, return_counts=True)
    own = np.searchsorted(found, np.arange(len(lexemes) + 1) * kinds)
    parts = [
        _lists(own, coded.dictionary.take(pa.array(found % kinds)).cast(pa.string())),
        _lists(own, pa.array((first - starts[found // kinds]).astype(np.int32))),
        _lists(own, pa.array(times.astype(np.int32))),
        _lists(starts, pa.array((codes.ravel() - own[row]).astype(np.int32))),
        _digests(pieces, starts),
    ]
    return pa.StructArray.from_arrays(parts, ["words", "first", "times", "codes", "digest"])


def _digests(pieces: pa.Array, starts: np.ndarray) -> pa.Array:
    """A SHA-256 for each text's pieces: of their lengths, then their bytes."""
    at, raw = _bytes_of(pieces) if len(pieces) else (np.zeros(1, np.int64), np.empty(0, np.uint8))
    made = [hashlib.sha256(np.diff(at[a : b + 1]).tobytes() + raw[at[a] : at[b]].tobytes()).digest() for a, b in zip(starts, starts[1:])]
    return pa.array(made, pa.binary())


@F.arrow_udf(_arrays(words=T.StringType(), first=T.IntegerType(), times=T.IntegerType(), codes=T.IntegerType()).add("digest", T.BinaryType()))
def _own_dictionary(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        yield from in_parts(_dictionary_of, columns)


def kind_of(raw: Column) -> Column:
    """The kind of a token, which follows from its text: I identifier, N number, S
    string, X syntax."""
    c = F.ascii(raw)
    letter = ((c >= 97) & (c <= 122)) | ((c >= 65) & (c <= 90)) | (c == 95) | (c == 36)
    return (
        F.when(letter, "I")
        .when((c >= 48) & (c <= 57), "N")
        .when((c == 39) | (c == 34) | (c == 96), "S")
        .when((c > 127) & raw.rlike(f"^{LETTER}"), "I")
        .otherwise("X")
    )


def _with_own(df: DataFrame, text: str, language: str, once: bool = False) -> DataFrame:
    return lexemes(df, text, language, spaced=False, once=once).withColumn("_own", _own_dictionary(F.coalesce("lexemes", F.array().cast("array<string>")), _marks(F.col(language))))


def counted_words(df: DataFrame, text: str = "text", language: str = "language", marks: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``df`` without the text, one row for each distinct token of a row: ``raw``, and
    ``times``, how often it occurs there.  With ``marks``, conditions on tokens by name,
    there is one more row, with that name as ``mark``, where some token meets one."""
    own = [c for c in df.columns if c != text]
    words = _with_own(df, text, language, once=True).select(*own, "_own.words", "_own.times")
    zipped = F.arrays_zip("words", "times")
    if marks:
        some = [F.when(F.exists("words", holds), F.array(F.struct(F.lit(name).alias("mark")))).otherwise(F.array().cast("array<struct<mark: string>>")) for name, holds in marks.items()]
        none = F.transform(zipped, lambda w: F.struct(w["words"].alias("raw"), w["times"].alias("times"), F.lit(None).cast("string").alias("mark")))
        zipped = F.concat(none, *[F.transform(x, lambda m: F.struct(F.lit("").alias("raw"), F.lit(0).alias("times"), m["mark"].alias("mark"))) for x in some])
        return words.select(*own, F.inline(zipped))
    return words.select(*own, F.explode(zipped).alias("_w")).select(*own, F.col("_w.words").alias("raw"), F.col("_w.times").alias("times"))


def own_dictionaries(df: DataFrame, text: str = "text", language: str = "language", digests: bool = False, once: bool = False) -> DataFrame:
    """``df`` without the text, with ``n_tokens``, ``words`` (its distinct tokens),
    ``first`` (where each comes first) and ``codes`` (the tokens as places in ``words``);
    with ``digests`` also ``digest``, which texts with the same tokens in a row share.
    A null text has none."""
    own, more = _with_own(df, text, language, once), ["digest"] if digests else []
    return own.select(*[c for c in df.columns if c != text], F.size("_own.codes").alias("n_tokens"), *[F.col(f"_own.{c}").alias(c) for c in ["words", "first", "codes", *more]])


def placed_tokens(df: DataFrame, text: str = "text", language: str = "language", once: bool = False) -> DataFrame:
    """``df`` with ``tokens``, an array of (raw, start_byte, end_byte, start_line,
    end_line); lines count from 1 and spans are half open in bytes.  A null text has none."""
    split = lexemes(df, text, language, once=once)
    return split.withColumn("tokens", _placed(F.coalesce("lexemes", F.array().cast("array<string>")), _marks(F.col(language)))).drop("lexemes")


def hashed_tokens(df: DataFrame, lines: bool, text: str = "text", language: str = "language", once: bool = False) -> DataFrame:
    """``df`` with ``hashes``, 64 bits of each token, and with ``lines`` also ``from_line``
    and ``to_line``, where each begins and ends.  A null text has none."""
    split = lexemes(df, text, language, spaced=lines, once=once)
    pieces, marks = F.coalesce("lexemes", F.array().cast("array<string>")), _marks(F.col(language))
    made = split.withColumns({"hashes": _hashed(pieces, marks), **({"_lines": _lined(pieces, marks)} if lines else {})}).drop("lexemes")
    return made.withColumns({c: F.col(f"_lines.{c}") for c in ("from_line", "to_line")}).drop("_lines") if lines else made


def lex(df: DataFrame, text: str = "text", language: str = "language", positions: bool = False) -> DataFrame:
    """``df`` with ``tokens``, an array of (kind, raw) or, with ``positions``, of
    (kind, raw, start_byte, end_byte, start_line, end_line); lines count from 1
    and token spans are half open in bytes.  A null text gives a null array."""
    if positions:
        names = [f.name for f in _PLACES]
        kinds = F.transform("tokens", lambda t: F.struct(kind_of(t["raw"]).alias("kind"), *[t[n].alias(n) for n in names]))
        return placed_tokens(df, text, language).withColumn("tokens", F.when(F.col(text).isNotNull(), kinds))
    split = lexemes(df, text, language).withColumn("_bits", _marks(F.col(language)))

    def is_token(t: Column) -> Column:
        c, raw, bits = t["c"], t["raw"], F.col("_bits")
        space = (c == 32) | ((c >= 9) & (c <= 13) & (c != 11))
        slashed = (c == 47) & (bits == 1) & (raw.startswith("//") | raw.startswith("/*"))
        return ~(space | slashed | ((c == 35) & (bits == 2)) | ((c == 45) & (bits == 4) & raw.startswith("--")))

    kept = F.filter(F.transform("lexemes", lambda x: F.struct(F.ascii(x).alias("c"), x.alias("raw"))), is_token)
    return split.withColumn("tokens", F.transform(kept, lambda t: F.struct(kind_of(t["raw"]).alias("kind"), t["raw"].alias("raw")))).drop("lexemes", "_bits")
