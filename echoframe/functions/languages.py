"""Languages: names, extensions, aliases and keywords.

The tables below are fixed values: results depend on every entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidFragment

#: language -> extensions
EXTENSIONS = {
    "rust": ["rs"],
    "go": ["go"],
    "c": ["c", "h"],
    "cpp": ["cc", "cpp", "cxx", "hh", "hpp", "hxx"],
    "bash": ["sh", "bash", "zsh"],
    "sql": ["sql", "psql"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx", "mts", "cts"],
    "python": ["py", "pyi"],
    "java": ["java"],
    "csharp": ["cs"],
    "markup": ["html", "htm", "xml", "vue", "svelte", "md", "mdx"],
}
LANGUAGES = [*EXTENSIONS, "text"]
BRACES = ("rust", "go", "c", "cpp", "bash", "javascript", "typescript", "java", "csharp")

#: further names that a language goes by, besides its own
ALIASES = {
    "rust": ["rs"],
    "c": ["h"],
    "cpp": ["c++", "cc", "cxx", "hpp"],
    "bash": ["sh", "zsh"],
    "sql": ["psql"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx", "mts", "cts"],
    "python": ["py", "pyi"],
    "csharp": ["cs"],
    "markup": ["html", "xml", "vue", "svelte", "md", "mdx"],
}

COMMON_KEYWORDS = (
    "if else for while loop match switch case break continue return throw try catch finally new class struct enum interface "
    "type import export from async await yield true false null nil this self"
).split()
KEYWORDS = {
    "rust": "fn let mut impl trait pub crate super where".split(),
    "go": "func var const package defer go chan range select".split(),
    "python": "def lambda elif except with as pass raise in is".split(),
}
SQL_KEYWORDS = "select insert update delete from where join group order having create alter drop".split()


def extension(path: Column) -> Column:
    """The lower-case extension of the last path component; a name that only
    begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def language_from_path(path: Column) -> Column:
    ext, out = extension(path), None
    for language, names in EXTENSIONS.items():
        out = (F if out is None else out).when(ext.isin(names), F.lit(language))
    return out.otherwise(F.lit("text"))


def language_named(name: str) -> str:
    """The language that a user calls ``name``."""
    key = name.strip().lstrip(".").lower()
    for language in LANGUAGES:
        if key == language or key in ALIASES.get(language, ()):
            return language
    raise InvalidFragment(name, "no language has this name")


def is_keyword(token: Column, language: Column) -> Column:
    out = token.isin(COMMON_KEYWORDS)
    for name, words in KEYWORDS.items():
        out = out | ((language == name) & token.isin(words))
    return out | ((language == "sql") & F.lower(token).isin(SQL_KEYWORDS))


def permille(part: Column, whole: Column) -> Column:
    """floor(1000 * part / whole), at most 1000, and 0 for a whole of 0."""
    safe = F.when(whole == 0, F.lit(1)).otherwise(whole).cast("long")
    return F.when(whole == 0, F.lit(0)).otherwise(F.least(F.lit(1000), F.floor((part.cast("long") * 1000 - F.pmod(part.cast("long") * 1000, safe)) / safe))).cast("int")
