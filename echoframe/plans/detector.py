"""The detectors: fragments in, or a folder in; pairs, families, statistics out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CloneConfig, RepositoryOptions
from ..errors import CapacityExceeded, DuplicateFragment, InvalidFragment, RepositoryError
from ..functions.ids import stable_id
from ..functions.languages import language_from_path
from ..functions.lexing import own_dictionaries
from ..operators import blocks, fingerprints, index, tokens
from ..operators.families import Families, family_tables
from ..operators.fragments import fragment_files
from ..operators.ordering import numbered
from ..operators.suppress import suppress_contained
from ..operators.verify import verified
from .scratch import forget, materialize, settled

STATISTICS = (
    "source_files", "source_tokens", "input_fragments", "analyzed_fragments", "skipped_small_fragments", "tokens",
    "fingerprints", "candidate_pairs", "exact_block_candidates", "verified_pairs", "suppressed_buckets", "suppressed_exact_buckets",
)


@dataclass
class CloneReport:
    """Pairs, families and one row of statistics."""

    pairs: DataFrame
    family_tables: Families
    statistics: DataFrame
    #: How many candidates a provider added to those with shared fingerprints.
    semantic_candidates: int = 0

    @property
    def families(self) -> DataFrame:
        """One row per family with its members and pairs as arrays."""
        return self.family_tables.arrays()


def normalized(fragments: DataFrame) -> DataFrame:
    """Fragments with ``/`` for ``\\`` in paths, and what may be left out filled in:
    the language from the path, the span from the text."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    has = set(fragments.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = F.greatest(F.lit(1), newlines + F.when(text.endswith("\n") | (text == ""), 0).otherwise(1))
    whole = F.struct(F.lit(0).cast("long").alias("start_byte"), F.octet_length(text).cast("long").alias("end_byte"), F.lit(1).alias("start_line"), lines.cast("int").alias("end_line"))
    span = F.coalesce(F.col("span"), whole) if "span" in has else whole
    language = F.coalesce(F.col("language"), language_from_path(path)) if "language" in has else language_from_path(path)
    return fragments.select("id", path.alias("path"), language.alias("language"), text.alias("text"), span.alias("span"))


def validate_fragments(fragments: DataFrame, config: CloneConfig) -> int:
    """Check all fragments before anything is computed; returns how many there are."""
    s = F.col("span")
    reason = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "it has no id")
        .when(F.coalesce(F.trim("path"), F.lit("")) == "", "it has no path")
        .when(s.isNull() | (s["start_byte"] > s["end_byte"]), "its bytes end before they begin")
        .when((s["start_line"] < 1) | (s["start_line"] > s["end_line"]), "its lines do not count up from 1")
    )
    seen = fragments.agg(F.count("*").alias("n"), F.min(F.when(reason.isNotNull(), F.struct("id", reason.alias("reason")))).alias("bad")).first()
    if seen.n > config.max_fragments:
        raise CapacityExceeded("fragments", config.max_fragments)
    if seen.bad is not None:
        raise InvalidFragment(seen.bad.id or "", seen.bad.reason)
    twice = fragments.groupBy("id").count().where("count > 1").agg(F.min("id")).first()[0]
    if twice is not None:
        raise DuplicateFragment(twice)
    return seen.n


@dataclass
class Prepared:
    """Tables up to the fingerprints, each written once."""

    lexed: DataFrame  # rank, id, path, language, span, n_tokens, words, first, codes
    words: DataFrame  # token, token_id
    streams: DataFrame  # rank, strict, renamed; of fragments that are large enough
    fps: DataFrame  # rank, fp


def lexed_fragments(fragments: DataFrame, config: CloneConfig, digests: bool = False) -> DataFrame:
    """Ranked by (path, span, id), as codes into each fragment's own dictionary."""
    lexed = numbered(fragments, ["path", "span", "id"], "rank", lambda rows: own_dictionaries(rows, digests=digests, once=True))
    if (lexed.agg(F.max("n_tokens")).first()[0] or 0) > config.max_tokens_per_fragment:
        raise CapacityExceeded("tokens per fragment", config.max_tokens_per_fragment)
    return lexed


def prepare(fragments: DataFrame, config: CloneConfig) -> Prepared:
    lexed = lexed_fragments(fragments, config)
    words = materialize(tokens.dictionary(lexed), "dictionary")
    streams = materialize(tokens.encoded(lexed.where(F.col("n_tokens") >= config.min_tokens), words), "streams")
    fps = materialize(fingerprints.fingerprint_rows(streams, config.stream, config.k_gram, config.winnowing_window), "fingerprints")
    return Prepared(lexed, words, streams, fps)


def candidate_pairs(fps: DataFrame, config: CloneConfig, often: DataFrame | None = None) -> DataFrame:
    """``often``: what ``index.common`` gives for ``fps``, if it is there already."""
    often, most = index.common(fps) if often is None else often, config.max_bucket_size
    # The limit is on all pairs with a common fingerprint; they are only made where it may be reached.
    if index.most_pairs(often.where(F.col("n") <= most)) > config.max_candidates and index.shared_pairs(index.live(fps, most)).count() > config.max_candidates:
        raise CapacityExceeded("candidate pairs", config.max_candidates)
    return materialize(index.candidates(fps, config.min_shared_fingerprints, config.candidate_similarity, often, most), "candidates")


def proposed_pairs(provider, fragments: DataFrame, p: Prepared, found: DataFrame, limit: int) -> DataFrame:
    """Candidates that ``provider`` proposes beyond ``found``, in the form of those, with
    nothing shared.  Ids that are no analyzed fragment's are left out, a fragment is not
    its own candidate, and a pair counts once in either order; more than ``limit``
    candidates of one fragment are an error."""
    rows = materialize(provider.candidates(fragments, limit).select(F.col("fragment_id").alias("a"), F.col("candidate_id").alias("b")).distinct(), "proposed")
    if (rows.groupBy("a").count().agg(F.max("count")).first()[0] or 0) > limit:
        raise CapacityExceeded("semantic candidates per fragment", limit)
    rank = p.lexed.join(p.streams.select("rank"), "rank", "left_semi").select("id", "rank")
    ranks = rows.join(rank.select(F.col("id").alias("a"), F.col("rank").alias("x")), "a").join(rank.select(F.col("id").alias("b"), F.col("rank").alias("y")), "b")
    fresh = ranks.where("x <> y").select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("r")).distinct().join(found, ["l", "r"], "left_anti")
    none = [F.lit(0).cast(found.schema[c].dataType).alias(c) for c in ("shared", "jaccard", "containment")]
    return materialize(fresh.select("l", "r", *none), "proposed-pairs")


def _overlap(rows: DataFrame) -> DataFrame:
    a, b = F.col("left.span"), F.col("right.span")
    meet = (F.col("left.path") == F.col("right.path")) & (a["start_byte"] < b["end_byte"]) & (b["start_byte"] < a["end_byte"])
    return rows.where(~meet)


def _located(p_lexed: DataFrame, found: DataFrame, config: CloneConfig) -> DataFrame:
    """``found`` with the locations of both sides, without those that overlap."""
    place = p_lexed.select("rank", F.struct("path", "span", F.col("id").alias("fragment_id")).alias("place"))
    located = found.join(place.select(F.col("rank").alias("l"), F.col("place").alias("left")), "l").join(place.select(F.col("rank").alias("r"), F.col("place").alias("right")), "r")
    return located if config.compare_overlapping_fragments else _overlap(located)


def _as_pairs(rows: DataFrame) -> DataFrame:
    return rows.select(
        stable_id("pair", F.array("left.fragment_id", "right.fragment_id", "left.path", "right.path")).alias("id"),
        "kind",
        "similarity",
        "left",
        "right",
        F.struct(
            (F.col("kind") == "type1").alias("strict_equal"), F.col("kind").isin("type1", "type2").alias("renamed_equal"), F.col("shared").alias("shared_fingerprints"),
            F.col("jaccard").alias("fingerprint_jaccard"), F.col("containment").alias("fingerprint_containment"), "edit_distance", "compared_tokens",
        ).alias("evidence"),
    )


def fragment_pairs(p: Prepared, found: DataFrame, config: CloneConfig) -> DataFrame:
    """Verified pairs with locations, ids and evidence; before suppression."""
    located = _located(p.lexed, found, config)
    clones = verified(located.select("l", "r", "shared", "jaccard", "containment"), p.streams, config)
    return _as_pairs(clones.join(located.select("l", "r", "left", "right"), ["l", "r"]))


def equal_pairs(fragments: DataFrame, config: CloneConfig) -> DataFrame:
    """What ``fragment_pairs`` finds among all candidates in the mode ``exact``, from the
    other end.  Only equal streams are verified there; they have equal fingerprints, so
    such a pair is a candidate if its fragments have enough of them in buckets that are
    not too full.  So equal streams are grouped first, by their digests; fingerprints of
    all fragments are counted, but only one fragment of each group is looked up."""
    lexed = lexed_fragments(fragments, config, digests=True)
    words = materialize(tokens.dictionary(lexed), "dictionary")
    enough = lexed.where(F.col("n_tokens") >= config.min_tokens)
    # A group that is larger than a bucket may be has no fingerprint in one that is not.
    groups = enough.groupBy("digest").agg(F.min("rank").alias("rep"), F.count("*").alias("k")).where((F.col("k") > 1) & (F.col("k") <= config.max_bucket_size))
    members = materialize(enough.select("rank", "digest", "n_tokens").join(groups, "digest").select("rank", "rep", "n_tokens"), "equal-streams")
    prints = lambda rows: fingerprints.fingerprint_rows(tokens.encoded(rows, words), "strict", config.k_gram, config.winnowing_window)
    own = materialize(prints(enough.join(members.where("rank = rep").select("rank"), "rank", "left_semi")), "own-fingerprints")
    held = prints(enough).select("fp").join(own.select("fp").distinct(), "fp", "left_semi")
    live = index.buckets(held).where(F.col("n") <= config.max_bucket_size)
    shared = own.join(live, "fp").groupBy(F.col("rank").alias("rep")).agg(F.count("*").alias("shared"))
    shared = materialize(shared.where(F.col("shared") >= config.min_shared_fingerprints), "shared-fingerprints")
    l, r = members.select("rep", F.col("rank").alias("l"), F.col("n_tokens").cast("long").alias("compared_tokens")), members.select("rep", F.col("rank").alias("r"))
    found = l.join(r, "rep").where("l < r").join(shared, "rep")
    alike = {c: F.lit(1000) for c in ("jaccard", "containment", "similarity")}
    return _as_pairs(_located(lexed, found, config).withColumns({"kind": F.lit("type1"), "edit_distance": F.lit(0).cast("long"), **alike}))


def _fragment_stage(fragments: DataFrame, config: CloneConfig, provider=None, limit: int = 0) -> tuple[DataFrame, dict]:
    n = validate_fragments(fragments, config)
    p = prepare(fragments, config)
    often = index.common(p.fps)
    found = candidate_pairs(p.fps, config, often)
    sizes = p.streams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("strict")), F.lit(0)).alias("t")).first()
    stats = {
        "input_fragments": n, "analyzed_fragments": sizes.n, "skipped_small_fragments": n - sizes.n, "tokens": sizes.t, "fingerprints": p.fps.count(),
        "candidate_pairs": found.count(), "suppressed_buckets": often.where(F.col("n") > config.max_bucket_size).count(),
    }
    if provider is not None:
        more = proposed_pairs(provider, fragments, p, found, limit)
        stats["semantic_candidates"] = more.count()
        found = found.unionByName(more)
    return fragment_pairs(p, found, config), stats


def _report(spark: SparkSession, stage) -> CloneReport:
    """The report on what ``stage`` returns, pairs and counts.  Of the tables that are
    written for it only those stay that the report reads."""
    stats: dict = {}

    def made() -> DataFrame:
        pairs, counts = stage()
        stats.update(counts)
        return suppress_contained(pairs)

    pairs = settled(spark, made, "pairs")
    stats["verified_pairs"] = pairs.count()
    row = spark.createDataFrame([tuple(int(stats.get(k, 0)) for k in STATISTICS)], ", ".join(f"{k} long" for k in STATISTICS))
    return CloneReport(pairs.orderBy("left", "right", "kind"), family_tables(pairs), row, stats.get("semantic_candidates", 0))


def detect_fragments(fragments: DataFrame, config: CloneConfig | None = None, provider=None, provider_limit: int = 64) -> CloneReport:
    """Clones among given fragments (id, path, text; language and span optional).  A
    ``provider`` of semantic candidates may propose pairs that share no fingerprints;
    they are verified like all others and counted on their own."""
    config = (config or CloneConfig()).validate()
    return _report(fragments.sparkSession, lambda: _fragment_stage(normalized(fragments), config, provider, provider_limit))


def _file_stage(files: DataFrame, config: CloneConfig, options: RepositoryOptions) -> tuple[DataFrame, dict]:
    sources = blocks.block_sources(files, options.cross_extensions)
    size = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("t"), F.max(F.size("hashes")).alias("m")).first()
    if (size.m or 0) > config.max_tokens_per_fragment:
        raise CapacityExceeded("tokens per fragment", config.max_tokens_per_fragment)
    hits = materialize(blocks.hit_runs(blocks.windows(sources, config.min_tokens)), "window-hits")
    n_hits = hits.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n_hits > config.max_candidates:
        raise CapacityExceeded("block candidates", config.max_candidates)
    found = blocks.regions(hits, config.min_tokens, config.compare_overlapping_fragments)
    pairs = blocks.block_pairs(found, sources, config.min_tokens, options.min_fragment_lines)
    stats: dict = {}
    if config.mode != "exact":
        whole = fragment_files(files, options.min_fragment_lines, options.max_fragment_lines)
        more, stats = _fragment_stage(materialize(whole, "fragments"), config)
        pairs = pairs.unionByName(more)
    stats |= {"source_files": size.n, "source_tokens": size.t, "exact_block_candidates": n_hits, "candidate_pairs": stats.get("candidate_pairs", 0) + n_hits}
    return pairs, stats


def detect_files(files: DataFrame, config: CloneConfig | None = None, options: RepositoryOptions | None = None) -> CloneReport:
    """Clones among whole files (path, text): their fragments, unless the mode is
    exact, and exact blocks anywhere in them."""
    config, options = (config or CloneConfig()).validate(), (options or RepositoryOptions()).validate()
    files = files.select(F.col("path").alias("id"), "path", language_from_path(F.col("path")).alias("language"), "text")
    return _report(files.sparkSession, lambda: _file_stage(files, config, options))


def detect_repository(spark: SparkSession, root: str, config: CloneConfig | None = None, options: RepositoryOptions | None = None) -> CloneReport:
    """Clones in the files below a folder."""
    from ..sources.repository import scan

    options = (options or RepositoryOptions()).validate()
    files = materialize(scan(spark, root, options), "scan")
    bad = files.where(~F.is_valid_utf8(F.col("content"))).agg(F.min("path")).first()[0]
    if bad is not None:
        raise RepositoryError(f"{bad} holds bytes that are not UTF-8")
    report = detect_files(files.select("path", F.col("content").cast("string").alias("text")), config, options)
    forget(files)
    return report
