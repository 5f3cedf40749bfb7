"""Fragmentation: functions found by their lines, or else the whole file."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.languages import BRACES
from ..llm.words import text_slices
from ..schema import FRAGMENT

#: Characters of fragments that a task holds before it hands them on.
MOST_HELD = 1 << 23

# Beginnings of lines that open a block which is no function, and
# words that a function may begin with.
NOT_CALLABLE = ("if ", "if(", "for ", "for(", "while ", "while(", "switch ", "switch(", "match ", "catch ", "catch(", "else", "try ")
CALLABLE = ("fn ", "func ", "function ")

_NOISE = re.compile(r"""//.*|\#.*|(['"`])(?:\\.|(?!\1)[^\\])*+(?:\1|\\?$)""", re.S | re.X)


def without_noise(line: str) -> str:
    """A line without its comment and without quoted text, quotes included."""
    return _NOISE.sub("", line)


def text_lines(text: str) -> list[str]:
    """Lines without their ends; a final newline opens no further line."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def indented_functions(lines: list[str], least: int, most: int) -> list[tuple[int, int]]:
    """Python functions: from ``def`` to the last line that is indented deeper,
    blank lines aside; nested ones too.  A line's block ends before the next line
    of no deeper indentation, which one pass from the end finds for all lines."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    indent = [len(lines[i].encode()) - len(lines[i].lstrip().encode()) for i in filled]
    after, open_ = [len(filled)] * len(filled), []
    for at in reversed(range(len(filled))):
        while open_ and indent[open_[-1]] > indent[at]:
            open_.pop()
        after[at] = open_[-1] if open_ else len(filled)
        open_.append(at)
    out = []
    for at, first in enumerate(filled):
        if lines[first].lstrip().startswith(("def ", "async def ")):
            long = max(at + 1, bisect_left(filled, first + most - 1))  # the first line that makes it too long
            last = filled[long if long < after[at] else after[at] - 1]
            if last - first + 1 >= least:
                out.append((first, last))
    return out


def braced_functions(lines: list[str], least: int, most: int) -> list[tuple[int, int]]:
    """Blocks in braces, at most one level deep, whose first line looks like a
    function's.  The depth of braces is a running sum over lines; a block ends on
    the first line behind which the sum is back at what it was before the block."""
    clean = [without_noise(x) for x in lines]
    depth = [0, *accumulate(x.count("{") - x.count("}") for x in clean)]  # before each line, and behind the last
    heads = [i for i, x in enumerate(clean) if depth[i] <= 1 and depth[i + 1] > depth[i] and _looks_callable(x.lstrip())]
    shallow = {d: [i for i in range(len(lines)) if depth[i + 1] <= d] for d in {depth[i] for i in heads}}
    out, free = [], 0
    for first in heads:
        if first < free:
            continue
        closing = shallow[depth[first]]
        at = bisect_left(closing, first)
        last = min(closing[at] if at < len(closing) else len(lines), first + most - 1)
        if last >= len(lines):
            break  # open to the end, and so is nothing behind it
        free = last + 1
        if free - first >= least:
            out.append((first, last))
    return out


def _looks_callable(head: str) -> bool:
    return not head.startswith(NOT_CALLABLE) and ("(" in head or any(w in head for w in CALLABLE))


def ranges(language: str, text: str, least: int, most: int) -> list[tuple[int, int]]:
    """First and last lines, from 0, of the fragments of one file."""
    found = []
    if language == "python":
        found = indented_functions(text_lines(text), least, most)
    elif language in BRACES:
        found = braced_functions(text_lines(text), least, most)
    return [r for r in found or [(0, text.count("\n"))] if r[1] > r[0]]


def fragment_files(files: DataFrame, least: int = 3, most: int = 400) -> DataFrame:
    """Fragments of every file (path, language, text), ``path#fragment:N`` by name.
    Rows with a null text give none; an empty table gives an empty table."""

    def found(b):
        for path, language, text in zip(*[c.to_pylist() for c in b.columns]):
            if text is None:
                continue
            raw = text.encode()
            starts = [0] + [m.end() for m in re.finditer(rb"\n", raw)] + [len(raw)]
            for n, (a, z) in enumerate(ranges(language, text, least, most)):
                lo, hi = starts[a], starts[z + 1] if z + 1 < len(starts) else len(raw)
                span = {"start_byte": lo, "end_byte": hi, "start_line": a + 1, "end_line": z + 1}
                yield f"{path}#fragment:{n}", path, language, raw[lo:hi].decode(), span

    names = [f.name for f in FRAGMENT.fields]
    kinds = to_arrow_schema(FRAGMENT)

    def handed(rows):
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.field(name).type) for name, c in zip(names, columns)], schema=kinds)

    def run(batches):
        # Fragments may lie inside one another, so what is held is bounded by their sizes too.
        for whole in batches:
            for at, n in text_slices(whole.column(2)):
                rows, size = [], 0
                for row in found(whole.slice(at, n)):
                    rows.append(row)
                    size += len(row[3])
                    if size > MOST_HELD:
                        yield handed(rows)
                        rows, size = [], 0
                if rows:
                    yield handed(rows)

    return files.select("path", "language", F.col("text")).mapInArrow(run, FRAGMENT)
