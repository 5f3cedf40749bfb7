"""Exact token blocks anywhere in files.

Every window of a fixed number of tokens is filed under its *minimizer*, the smallest
hash of a few tokens in a row inside it.  Neighbouring windows mostly share theirs, so
a file hands on one row per run of such windows, and equal windows have equal ones:
where a minimizer occurs once, no window of its run can occur twice.  The other runs
are keyed whole, by 128 bits of all their tokens: the windows of a run that occurs
again are those of its first one, by file and position, one by one.  Only where first
runs share a minimizer are their windows keyed, again by 128 bits; a key's
representative is the first window.
Windows that have an earlier one are hits, and stay together while they advance
together; hits that follow one another are regions (gaps and islands).  Regions
shrink to whole lines where they cover any.  The tokens' texts of both sides are compared,
by SHA-256, before a region is reported, so the keys decide nothing alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import stable_id
from ..functions.languages import extension
from ..functions.lexing import hashed_tokens, in_parts, list_starts, placed_tokens
from ..plans.scratch import materialize
from .fingerprints import rolling
from .ordering import numbered, place_of, row_of, spot

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Tokens of a minimizer, if a window has so many.
MINIMIZER = 8
_NUMBERS = {"pos": T.IntegerType(), "start": T.IntegerType(), "run": T.IntegerType(), "n": T.IntegerType(), "m": T.LongType(), "a": T.LongType(), "b": T.LongType()}
#: Windows whose minima are sought at once.
CHUNK = 1 << 16


def _records(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, _NUMBERS[name]) for name in names]))


def leftmost_minima(h: np.ndarray, size: int) -> np.ndarray:
    """Where the leftmost smallest of every ``size`` numbers in a row is."""
    out = [np.empty(0, np.int64)]
    for lo in range(0, len(h) - size + 1, CHUNK):
        part, step = h[lo : lo + CHUNK + size - 1], 1
        at = np.arange(len(part))
        while step < size:  # at: where the smallest of the next ``step`` is
            shift = min(step, size - step)
            at = np.where(part[at[shift:]] < part[at[:-shift]], at[shift:], at[:-shift])
            step += shift
        out.append(at + lo)
    return np.concatenate(out)


def minimizer_runs(tokens: np.ndarray, width: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of the runs of windows with one minimizer: the
    leftmost smallest hash of ``MINIMIZER`` tokens in a row inside of each.  A window's
    choice depends on nothing but its tokens.  ``starts``: where each of several texts
    begins in ``tokens``, and one more bound; no window reaches into two."""
    k = min(MINIMIZER, width)
    if len(tokens) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = rolling(tokens, k)
    h ^= h >> np.uint64(29)
    h *= _BASES[0]
    h ^= h >> np.uint64(32)
    at = leftmost_minima(h, width - k + 1)
    here = np.arange(len(at))
    if starts is not None:
        here = here[here + width <= starts[np.searchsorted(starts, here, "right")]]
        at = at[here]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    return h[at[first]].view(np.int64), here[first], np.diff(np.append(first, len(at)))


def span_keys(tokens: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit keys of the tokens of each span."""
    x = tokens.astype(np.int64).view(np.uint64)
    keys = []
    for base in _BASES:
        h = np.zeros(len(begins), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(int(sizes.max(initial=0))):
                more = (h ^ x[np.minimum(begins + j, len(x) - 1)]) * base
                h = np.where(j < sizes, more ^ (more >> np.uint64(31)), h)
        keys.append(h.view(np.int64))
    return keys


def _numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list of numbers begins, with one more bound, and all numbers."""
    return list_starts(lists), np.asarray(lists.flatten(), np.int64)


def _listed(bounds: np.ndarray, **fields: np.ndarray) -> pa.Array:
    """Lists of structs of numbers, which begin and end at ``bounds``."""
    narrow = {name: pa.array(x.astype(np.int32 if isinstance(_NUMBERS[name], T.IntegerType) else np.int64)) for name, x in fields.items()}
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(list(narrow.values()), list(narrow)))


def block_sources(files: DataFrame, cross_extensions: bool = False, places: bool = True) -> DataFrame:
    """Files (id, path, language, text) numbered by path and lexed: ``src``, ``domain``
    (what is matched with what: the extension, or everything), ``hashes`` of the tokens
    and, with ``places``, the lines they begin and end in, and the text.  ``tokens`` with
    their texts and positions are not written but made from it where they are asked for."""
    texts = files.select("id", "path", "language", F.coalesce("text", F.lit("")).alias("text"))
    domain = F.lit("") if cross_extensions else extension(F.col("path"))

    def lexed(rows: DataFrame) -> DataFrame:
        made = hashed_tokens(rows, places, once=True)
        return made if places else made.drop("text")

    sources = numbered(texts, ["path", "id"], "src", lexed).withColumn("domain", domain)
    return placed_tokens(sources, once=True) if places else sources


def repeated_runs(sources: DataFrame, width: int) -> DataFrame:
    """(domain, m, src, start, n, a, b): the runs of windows whose minimizer ``m`` occurs
    more than once in their domain, with keys of all tokens of their ``n`` windows."""

    def minimizers(rows: pa.Array) -> pa.Array:
        starts, x = _numbers(rows)
        m, first, _ = minimizer_runs(x, width, starts)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, starts).astype(np.int32)), pa.array(m))

    @F.arrow_udf("array<long>")
    def minimizers_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield from in_parts(minimizers, (rows,))

    def runs(rows: pa.Array) -> pa.Array:
        starts, x = _numbers(rows)
        m, first, n = minimizer_runs(x, width, starts)
        a, b = span_keys(x, first, n + width - 1)
        bounds = np.searchsorted(first, starts)
        return _listed(bounds, m=m, start=first - np.repeat(starts[:-1], np.diff(bounds)), n=n, a=a, b=b)

    @F.arrow_udf(_records("m", "start", "n", "a", "b"))
    def runs_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield from in_parts(runs, (rows,))

    # Minimizers are made twice, so that only those that occur again are written with their keys.
    enough = sources.where(F.size("hashes") >= width)
    counted = enough.select("domain", F.explode(minimizers_of("hashes")).alias("m")).groupBy("domain", "m").agg(F.count("*").alias("times"))
    again = materialize(counted.where("times > 1").drop("times"), "repeated-minimizers")
    found = enough.select("domain", "src", F.explode(runs_of("hashes")).alias("r")).select("domain", "src", "r.*")
    return materialize(found.join(again, ["domain", "m"], "left_semi"), "repeated-runs")


def windows(sources: DataFrame, width: int) -> DataFrame:
    """(domain, src, pos, run, a, b, n, first): what may have an earlier equal one.  A row
    is either a window of a run that is the first of its key, where others share its
    minimizer: ``run`` is where the run starts, ``a`` and ``b`` are the window's key, ``n``
    is 1.  Or it is a whole run of ``n`` windows, and ``first`` the spot of its first one."""
    runs = repeated_runs(sources, width)
    here, same = spot(F.col("src"), F.col("start")), ["domain", "m", "n", "a", "b"]
    firsts = materialize(runs.groupBy(*same).agg(F.min(here).alias("first"), F.count("*").alias("times")), "first-runs")
    # Equal windows lie at the same place before their minimizer, so a run has none of its own.
    shared = firsts.groupBy("domain", "m").agg(F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    spans = firsts.join(shared, ["domain", "m"], "left_semi").select(row_of(F.col("first")).alias("src"), place_of(F.col("first")).cast("int").alias("start"), "n")
    spans = spans.groupBy("src").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))

    def keys(hashes: pa.Array, starts: pa.Array, counts: pa.Array) -> pa.Array:
        text, x = _numbers(hashes)
        own, start = _numbers(starts)
        n = _numbers(counts)[1]
        past = np.concatenate([[0], np.cumsum(n)])
        run = np.repeat(np.arange(len(n)), n)
        pos = start[run] + np.arange(past[-1]) - past[run]
        row = np.repeat(np.arange(len(hashes)), np.diff(own))
        a, b = span_keys(x, text[row[run]] + pos, np.full(len(pos), width))
        return _listed(past[own], pos=pos, run=start[run], a=a, b=b)

    @F.arrow_udf(_records("pos", "run", "a", "b"))
    def keyed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield from in_parts(keys, columns)

    single = sources.select("domain", "src", "hashes").join(spans, "src").select("domain", "src", F.explode(keyed("hashes", "starts", "counts")).alias("w"))
    single = single.select("domain", "src", "w.*", F.lit(1).alias("n"), F.lit(None).cast("long").alias("first"))
    copies = runs.join(firsts.where("times > 1"), same).where(here != F.col("first"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return single.unionByName(copies.select("domain", "src", F.col("start").alias("pos"), none("int", "run"), none("long", "a"), none("long", "b"), "n", "first"))


def _stretches(df: DataFrame, entries: Column) -> DataFrame:
    """``df`` with ``src`` and ``run``, one row for each stretch of ``entries`` (j, left) in
    which both advance together: (src, pos, left, n)."""
    at = lambda i: F.get("_e", i)
    breaks = lambda i: (i == 0) | (at(i)["j"] != at(i - 1)["j"] + 1) | (at(i)["left"] != at(i - 1)["left"] + 1)
    heads = df.withColumn("_e", entries).withColumn("_heads", F.filter(F.sequence(F.lit(0), F.size("_e") - 1), breaks))
    end = lambda k: F.coalesce(F.get("_heads", k + 1), F.size("_e"))
    cut = F.transform("_heads", lambda i, k: F.struct(at(i)["j"].alias("j"), at(i)["left"].alias("left"), (end(k) - i).alias("n")))
    return heads.select("src", "run", F.explode(cut).alias("_s")).select("src", (F.col("run") + F.col("_s.j")).alias("pos"), "_s.left", "_s.n")


def hit_runs(found: DataFrame) -> DataFrame:
    """Windows with an earlier equal one, by stretches of them that advance together:
    (src, pos, left_src, left_pos, n).  The first window of every key is found with a
    grouped minimum, which combines before it shuffles, and only keys that occur again
    are joined; what was found of a run holds for all runs that are equal to it."""
    found = materialize(found, "windows")
    here, run = spot(F.col("src"), F.col("pos")), spot(F.col("src"), F.col("run"))
    single = found.where("first IS NULL")
    left = single.groupBy("domain", "a", "b").agg(F.min(here).alias("left"), F.count("*").alias("times")).where("times > 1").drop("times")
    hits = single.join(materialize(left, "first-windows"), ["domain", "a", "b"]).where(here != F.col("left"))
    entry = F.struct((F.col("pos") - F.col("run")).alias("j"), "left")
    own = materialize(hits.groupBy("src", "run").agg(F.sort_array(F.collect_list(entry)).alias("e")), "first-run-hits")
    earlier = own.select(run.alias("first"), F.map_from_entries("e").alias("earlier"))
    copies = found.where("first IS NOT NULL").select("src", F.col("pos").alias("run"), "n", "first").join(earlier, "first", "left")
    whole = copies.where("earlier IS NULL").select("src", F.col("run").alias("pos"), F.col("first").alias("left"), "n")
    each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(j.alias("j"), F.coalesce(F.try_element_at("earlier", j), F.col("first") + j).alias("left")))
    every = whole.unionByName(_stretches(copies.where("earlier IS NOT NULL"), each)).unionByName(_stretches(own, F.col("e")))
    return every.select("src", "pos", row_of(F.col("left")).alias("left_src"), place_of(F.col("left")).cast("int").alias("left_pos"), "n")


def each_window(hits: DataFrame) -> DataFrame:
    """One row per window of stretches of hits, with their other columns."""
    out = hits.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return out.withColumns({c: F.col(c) + F.col("_i") for c in ("pos", "left_pos")}).drop("n", "_i")


def window_hits(found: DataFrame) -> DataFrame:
    """Windows with an earlier equal one: (src, pos, left_src, left_pos)."""
    return each_window(hit_runs(found))


def regions(hits: DataFrame, width: int, overlapping: bool = False) -> DataFrame:
    """Maximal runs of hits, which are windows or stretches of ``n`` of them: (left_src,
    left_start, right_src, right_start, length)."""
    hits = hits if "n" in hits.columns else hits.withColumn("n", F.lit(1))
    shift = F.col("pos") - F.col("left_pos")
    before = W.partitionBy("src", "left_src", "shift").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    runs = (
        hits.withColumn("shift", shift)
        .withColumn("run", F.col("pos") - F.coalesce(F.sum("n").over(before), F.lit(0)))
        .groupBy("src", "left_src", "shift", "run")
        .agg(F.min("left_pos").alias("left_start"), F.min("pos").alias("right_start"), (F.sum("n") + width - 1).cast("int").alias("length"))
        .select("left_src", "left_start", F.col("src").alias("right_src"), "right_start", "length")
    )
    if overlapping:
        return runs
    meet = (F.col("left_src") == F.col("right_src")) & (F.col("left_start") < F.col("right_start") + F.col("length")) & (F.col("right_start") < F.col("left_start") + F.col("length"))
    return runs.where(~meet)


def enough_lines(found: DataFrame, sources: DataFrame, least: int) -> DataFrame:
    """Regions that touch at least ``least`` lines on both sides: shrinking one to whole
    lines leaves it no more.  Only the lines of tokens meet the regions, not their texts."""
    if least <= 1:
        return found
    lines = sources.select("src", F.col("from_line").alias("_from"), F.col("to_line").alias("_to"))
    for s in ("right", "left"):
        start = F.col(f"{s}_start")
        many = F.get("_to", start + F.col("length") - 1) - F.get("_from", start) + 1 >= least
        found = found.join(lines.withColumnRenamed("src", f"{s}_src"), f"{s}_src").where(many).drop("_from", "_to")
    return found


def _begins(tokens: str, i):
    return (i == 0) | (F.get(tokens, i - 1)["end_line"] < F.get(tokens, i)["start_line"])


def _ends(tokens: str, i):
    return F.coalesce(F.get(tokens, i + 1)["start_line"] > F.get(tokens, i)["end_line"], F.lit(True))


def _edges(tokens: str, start: Column, length: Column) -> tuple[Column, Column]:
    """The places of a stretch, from its own start, with which a line begins, and those
    with which one ends: (o, byte, line)."""
    offsets = F.sequence(F.lit(0), length - 1)

    def at(side: str):
        return lambda o: F.struct(o.alias("o"), F.get(tokens, start + o)[f"{side}_byte"].alias("byte"), F.get(tokens, start + o)[f"{side}_line"].alias("line"))

    heads, tails = F.filter(offsets, lambda o: _begins(tokens, start + o)), F.filter(offsets, lambda o: _ends(tokens, start + o))
    return F.transform(heads, at("start")), F.transform(tails, at("end"))


def _shrunk(found: DataFrame) -> DataFrame:
    """Regions (with ``l_heads``, ``l_tails``, ``r_heads`` and ``r_tails``) shrunk to the
    lines that both sides cover whole, unchanged where there is none; ``_head`` and
    ``_last`` are the new ends as places from the old start."""
    common = lambda c: F.array_intersect(F.col(f"l_{c}.o"), F.col(f"r_{c}.o"))
    edges = found.withColumns({"_head": F.array_min(common("heads")), "_last": F.array_max(common("tails"))})
    whole = F.coalesce(F.col("_head") <= F.col("_last"), F.lit(False))
    edges = edges.withColumns({"_head": F.when(whole, F.col("_head")).otherwise(0), "_last": F.when(whole, F.col("_last")).otherwise(F.col("length") - 1)})
    return edges.withColumns({"length": F.col("_last") - F.col("_head") + 1, **{f"{s}_start": F.col(f"{s}_start") + F.col("_head") for s in ("left", "right")}})


def snapped(found: DataFrame) -> DataFrame:
    """Regions (with ``l_tokens`` and ``r_tokens``) shrunk to the lines that both
    sides cover whole; unchanged where there is none."""
    for s in ("left", "right"):
        heads, tails = _edges(f"{s[0]}_tokens", F.col(f"{s}_start"), F.col("length"))
        found = found.withColumns({f"{s[0]}_heads": heads, f"{s[0]}_tails": tails})
    return _shrunk(found).drop("_head", "_last", *[f"{s}_{c}" for s in "lr" for c in ("heads", "tails")])


def _span(side: str) -> Column:
    """The span of a shrunk region's side, by its edges, or by its ends if there are none."""
    edge = lambda c, o, end: F.coalesce(F.get(F.filter(f"{side}_{c}", lambda x: x["o"] == F.col(o)), F.lit(0)), F.col(f"{side}_{end}"))
    first, last = edge("heads", "_head", "first"), edge("tails", "_last", "last")
    return F.struct(first["byte"].alias("start_byte"), last["byte"].alias("end_byte"), first["line"].alias("start_line"), last["line"].alias("end_line"))


def block_pairs(found: DataFrame, sources: DataFrame, width: int, min_lines: int) -> DataFrame:
    """Clone pairs of the regions, with at least ``min_lines`` lines on both sides."""
    # Most regions lie within a line or two; those are left out before any text is lexed again.
    # Each stretch of tokens that some other region has is read once, however many regions
    # share it, and handed on as a digest of its texts and the places of its line ends.
    found = materialize(enough_lines(materialize(found, "regions"), sources, min_lines), "long-regions")
    ends = [found.select(F.col(f"{s}_src").alias("src"), F.col(f"{s}_start").alias("start"), "length") for s in ("left", "right")]
    cuts = ends[0].unionByName(ends[1]).groupBy("src").agg(F.collect_set(F.struct("start", "length")).alias("cuts"))
    lexed = placed_tokens(sources.select("src", "path", "id", "language", "text").join(cuts, "src"), once=True)

    def stretch(c: Column) -> Column:
        start, size = c["start"], c["length"]
        texts = F.transform(F.slice("tokens", start + 1, size), lambda t: F.concat(F.octet_length(t["raw"]).cast("string"), F.lit(":"), t["raw"]))
        heads, tails = _edges("tokens", start, size)
        end = lambda i, side: F.struct(F.lit(-1).alias("o"), F.get("tokens", i)[f"{side}_byte"].alias("byte"), F.get("tokens", i)[f"{side}_line"].alias("line"))
        digest = F.unhex(F.sha2(F.array_join(texts, "").cast("binary"), 256))
        return F.struct(start.alias("start"), size.alias("length"), digest.alias("digest"), heads.alias("heads"), tails.alias("tails"), end(start, "start").alias("first"), end(start + size - 1, "end").alias("last"))

    stretches = lexed.select("src", "path", "id", F.explode(F.transform("cuts", stretch)).alias("s")).select("src", "s.*", "path", "id")
    stretches = materialize(stretches, "stretches")
    both = found
    for s in ("left", "right"):
        own = {"src": f"{s}_src", "start": f"{s}_start", **{c: f"{s[0]}_{c}" for c in ("digest", "heads", "tails", "first", "last", "path", "id")}}
        both = both.join(stretches.withColumnsRenamed(own), [f"{s}_src", f"{s}_start", "length"])
    spans = _shrunk(both.where(F.col("l_digest") == F.col("r_digest")))
    spans = spans.select("length", *[f"{s}_start" for s in ("left", "right")], *[f"{s}_{c}" for s in "lr" for c in ("path", "id")], _span("l").alias("l_span"), _span("r").alias("r_span"))
    # Written, or Spark would put the shrinking into the filter below once for each use of it.
    spans = materialize(spans, "spans")
    lines = lambda s: F.col(f"{s}.end_line") - F.col(f"{s}.start_line") + 1
    kept = spans.where((lines("l_span") >= min_lines) & (lines("r_span") >= min_lines))

    def name(side):
        start = F.col(f"{side}_start")
        return F.format_string("%s#tokens:%d-%d", F.col(f"{side[0]}_path"), start, start + F.col("length"))

    kept = kept.withColumn("l_id", name("left")).withColumn("r_id", name("right"))
    shared = F.greatest(F.col("length") - width, F.lit(0)).cast("long") + 1
    return kept.select(
        stable_id("pair", F.array("l_id", "r_id", "l_path", "r_path")).alias("id"),
        F.lit("type1").alias("kind"),
        F.lit(1000).alias("similarity"),
        F.struct(F.col("l_path").alias("path"), F.col("l_span").alias("span"), F.col("l_id").alias("fragment_id")).alias("left"),
        F.struct(F.col("r_path").alias("path"), F.col("r_span").alias("span"), F.col("r_id").alias("fragment_id")).alias("right"),
        F.struct(
            F.lit(True).alias("strict_equal"), F.lit(True).alias("renamed_equal"), shared.alias("shared_fingerprints"), F.lit(1000).alias("fingerprint_jaccard"),
            F.lit(1000).alias("fingerprint_containment"), F.lit(0).cast("long").alias("edit_distance"), F.col("length").cast("long").alias("compared_tokens"),
        ).alias("evidence"),
    )
