"""Language-model scoring with a probabilistic suffix tree.

States are contexts of one or more words.  A context becomes a state if it is
frequent and its next-word distribution diverges from that of its suffix (Ron,
Singer and Tishby, "The Power of Amnesia", 1996).  A token is scored in the
longest suffix of what stands before it that is a state.  A state's distribution
is its discounted counts, the rest going to its parent; the root is the add-one
unigram distribution over all words of the training texts and one unseen word.

Workers hold what is explicit: words, contexts and next words that have at least
the shares ``word_share``, ``context_share`` and ``next_share`` of all tokens.  The
shares fall with the corpus, as the fourth root of its tokens beyond ``FULL``: so
the explicit part grows with the corpus, and is at most the root over the share of
each (and depth times that of the last two).  The counts of all other words stay
in a table, however many there are, and what a text needs of them comes by a join.

Texts are read twice, to count words and to number them; contexts are counted on
the numbers, one pass for each depth.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .words import hashed_words, text_slices, word_hashes

#: White space can't be in a word, so this is none.
END = int(word_hashes([b"\n"]).view(np.int64)[0])
GATHER = 1 << 22  # tokens that a counting task holds before it hands on counts
DISCOUNT = 0.75
FULL = 10_000_000  # tokens up to which the shares are as given


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, ASCII letters in lower case, with one end
    behind each text, and where each text begins (one more bound than texts)."""
    h, bounds = hashed_words(texts, "lower")
    return np.insert(h.view(np.int64), bounds[1:], END), bounds + np.arange(len(bounds))


def _find(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of ``values`` in the sorted ``table``, -1 where absent."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)


@dataclass
class Tree:
    """The part of the model that each worker holds."""

    total: int
    kinds: int
    words: np.ndarray  # sorted hashes of frequent words
    counts: np.ndarray
    #: By depth: sorted context keys (parent context's place << 32 | the word before).
    contexts: list[np.ndarray] = field(default_factory=list)
    #: By depth: whether the context is a state, and the log10 of what its parent gets.
    kept: list[np.ndarray] = field(default_factory=list)
    rest: list[np.ndarray] = field(default_factory=list)
    #: By depth: sorted (context << 32 | next word), and the log10 probability.
    next_keys: list[np.ndarray] = field(default_factory=list)
    next_logs: list[np.ndarray] = field(default_factory=list)

    @property
    def denominator(self) -> float:
        return float(np.log10(self.total + self.kinds + 1))

    def places(self, at: np.ndarray, depth: int) -> list[np.ndarray]:
        """For each token, per depth, the place of the context before it, or -1.
        ``at``: places of words, -1 if not frequent, -2 at the end of a text."""
        out: list[np.ndarray] = []
        for d in range(depth):
            before = np.full(len(at), -1, np.int64)
            before[d + 1 :] = at[: -(d + 1)]
            if d == 0:
                key = before
            else:
                key = np.where((out[-1] >= 0) & (before >= 0), out[-1] << 32 | before, -1)
                # the nearer words must belong to this text, which out[-1] >= 0 says
            out.append(_find(key, self.contexts[d]))
        return out

    def logs(self, places: list[np.ndarray], word: np.ndarray, root: np.ndarray) -> np.ndarray:
        """log10 probability of each token, ``root`` being the root's."""
        value = root.copy()
        for d, place in enumerate(places):
            state = np.zeros(len(place), bool)
            state[place >= 0] = self.kept[d][place[place >= 0]]
            ask = np.flatnonzero(state)
            value[ask] += self.rest[d][place[ask]]
            ask = ask[word[ask] >= 0]
            hit = _find(place[ask] << 32 | word[ask], self.next_keys[d])
            found = hit >= 0
            value[ask[found]] = self.next_logs[d][hit[found]]
        return value


@dataclass
class Model:
    tree: Tree
    rare: DataFrame  # (word, count) of the words that workers do not hold


def _counted(df: DataFrame, column: str, keys_of) -> DataFrame:
    """(key, count) over all rows, ``keys_of`` giving the keys of a slice of texts."""

    def flush(held):
        k, c = np.unique(np.concatenate(held), return_counts=True)
        for lo in range(0, len(k), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array(c[part])], ["key", "n"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for at, n in text_slices(b.column(0)):
                held.append(keys_of(b.column(0).slice(at, n)))
                size += len(held[-1])
                if size > GATHER:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return df.select(column).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _bar(total: int, share: float, least: int) -> float:
    """The count from which something is explicit."""
    return max(least, total * share / max(1.0, total / FULL) ** 0.25)


def count_words(df: DataFrame, text: str, word_share: float, least: int) -> Model:
    """The root: counts of all words, of which the frequent ones are explicit."""
    texts = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    words = materialize(_counted(texts, "t", lambda ts: token_hashes(ts)[0]), "lm-words")
    about = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, kinds = about.n or 0, about.v
    bar = _bar(total, word_share, least)
    frequent = words.where(F.col("n") >= bar).toArrow()
    h, c = frequent.column(0).to_numpy(), frequent.column(1).to_numpy()
    order = np.argsort(h)
    return Model(Tree(total, kinds, h[order], c[order]), words.where(F.col("n") < bar))


def numbered_words(df: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """One row for each of ``df``: the columns ``keep``, and its tokens as places
    among the explicit words (-1 for others), its number of tokens and of explicit
    ones, and the hashes and counts of its other words.  Written once."""
    held = df.sparkSession.sparkContext.broadcast((model.tree.words,))

    def run(batches):
        (words,) = held.value
        for whole in batches:
            for begin, some in text_slices(whole.column(0)):
                b = whole.slice(begin, some)
                h, bounds = token_hashes(b.column(0))
                at = _find(h, words).astype("<i4")
                row = np.repeat(np.arange(some), np.diff(bounds))
                rare = at < 0
                known = np.bincount(row[~rare], minlength=some)
                order = np.lexsort((h[rare], row[rare]))
                hr, rr = h[rare][order], row[rare][order]
                new = np.flatnonzero(np.concatenate([[True], (hr[1:] != hr[:-1]) | (rr[1:] != rr[:-1])]) if len(hr) else np.empty(0, bool))
                offsets = np.searchsorted(rr[new], np.arange(some + 1)).astype(np.int32)
                times = np.diff(np.append(new, len(hr)))
                raw = at.tobytes()
                cut = bounds.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        *b.columns[1:],
                        pa.array([raw[4 * x : 4 * y] for x, y in zip(cut, cut[1:])], pa.binary()),
                        pa.array(np.diff(bounds)),
                        pa.array(known),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(hr[new])),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(times)),
                    ],
                    [*keep, "at", "n_tokens", "known", "rare", "times"],
                )

    rows = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"), *keep)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    schema = ", ".join([*([kept] if kept else []), "at binary, n_tokens long, known long, rare array<long>, times array<long>"])
    return materialize(rows.mapInArrow(run, schema), "lm-numbers")


def _places(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)


def grow(
    model: Model, numbers: DataFrame, depth: int, context_share: float, next_share: float, divergence: float, least: int
) -> None:
    """Count contexts on numbered texts, one depth after the other, and prune."""
    tree, spark = model.tree, numbers.sparkSession
    root = np.log10(tree.counts + 1.0) - tree.denominator
    bar_context, bar_next = _bar(tree.total, context_share, least), _bar(tree.total, next_share, least)
    for d in range(depth):
        if d == 0:
            wide = np.flatnonzero((tree.counts >= bar_context) & (tree.words != END))
            tree.contexts.append(wide.astype(np.int64))
            size = tree.counts[wide].astype(float)
        else:
            frequent_pairs = (pair_n >= bar_context) & (tree.words[pair_next] != END)
            # (older context, newer word) seen as: nearer context = the newer word alone
            key, size = _turned(tree, d, pair_context[frequent_pairs], pair_next[frequent_pairs], pair_n[frequent_pairs])
            tree.contexts.append(key)
        held = spark.sparkContext.broadcast(tree)

        def keys_of(numbered, d=d, held=held):
            t, at = held.value, _places(numbered)
            place = t.places(_ended(t, at), d + 1)[d]
            use = (place >= 0) & (at >= 0)
            return place[use] << 32 | at[use]

        pairs = _counted(numbers, "at", keys_of) if len(tree.contexts[d]) else None
        found = pairs.where(F.col("n") >= bar_next).toArrow() if pairs is not None else None
        key = found.column(0).to_numpy() if found is not None else np.empty(0, np.int64)
        n = found.column(1).to_numpy() if found is not None else np.empty(0, np.int64)
        order = np.argsort(key)
        key, pair_n = key[order], n[order]
        pair_context, pair_next = key >> 32, key & 0xFFFFFFFF
        discounted = (pair_n - DISCOUNT) / size[pair_context] if len(key) else np.empty(0)
        rest = np.maximum(1 - np.bincount(pair_context, discounted, len(size)), 1e-9)
        parent = tree.logs(_parents(tree, d, pair_context), pair_next, root[pair_next])
        logs = np.log10(discounted + rest[pair_context] * 10.0**parent)
        share = pair_n / size[pair_context] if len(key) else np.empty(0)
        gain = np.bincount(pair_context, share * (logs - parent), len(size)).astype(float)
        gain += (1 - np.bincount(pair_context, share, len(size))) * np.log10(rest)
        tree.kept.append(gain / np.log10(2) >= divergence)
        tree.rest.append(np.log10(rest))
        tree.next_keys.append(key)
        tree.next_logs.append(logs)


def train(
    df: DataFrame, text: str = "text", depth: int = 4, word_share: float = 1e-6, context_share: float = 1e-5,
    next_share: float = 1e-6, divergence: float = 0.02, least: int = 2,
) -> Model:
    """Count and prune.  Contexts have at most ``depth`` words.  A context is kept as
    a state if its distribution diverges from its parent's by ``divergence`` bits a
    token or more.  ``least`` is the smallest count of anything explicit.

    Null and empty texts are ends alone; an empty table gives a model of nothing."""
    model = count_words(df, text, word_share, least)
    grow(model, numbered_words(df, model, text=text), depth, context_share, next_share, divergence, least)
    return model


def _ended(tree: Tree, at: np.ndarray) -> np.ndarray:
    """Places with -1 for the end, which is before no token of its text."""
    end = _find(np.array([END]), tree.words)[0]
    return np.where(at == end, -1, at) if end >= 0 else at


def _turned(tree: Tree, d: int, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the contexts one word longer: ``word`` behind the
    context of depth ``d``.  A key is (place of the context without its oldest
    word) << 32 | oldest word."""
    chain = [word]  # from the newest word to the oldest
    at, older = context, []
    for level in range(d - 1, -1, -1):
        key = tree.contexts[level][at]
        older.append(key & 0xFFFFFFFF if level else key)
        at = key >> 32
    chain += older[::-1]
    place = _find(chain[0], tree.contexts[0])
    for level in range(1, d):
        place = np.where(place >= 0, _find(place << 32 | chain[level], tree.contexts[level]), -1)
    good = place >= 0
    key = place[good] << 32 | chain[d][good]
    order = np.argsort(key)
    return key[order], n[good][order].astype(float)


def _parents(tree: Tree, d: int, context: np.ndarray) -> list[np.ndarray]:
    """Per depth below ``d``, the places of the suffixes of the contexts."""
    out, at = [], context
    for level in range(d, 0, -1):
        at = tree.contexts[level][at] >> 32
        out.append(at)
    return out[::-1]


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_tokens``, ``n_known`` (tokens seen
    in training), ``train_tokens``, ``base_score`` (of the root alone) and
    ``score``, both sums of log10 probabilities.

    A null or empty text has one token, its end.  Null and repeated keys are
    scored row by row; an empty table gives an empty table; a model of no texts
    gives every token probability one."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return _scored(numbered_words(rows, model, "doc_id"), model)


def _scored(numbers: DataFrame, model: Model) -> DataFrame:
    held = numbers.sparkSession.sparkContext.broadcast(model.tree)

    def run(batches):
        t = held.value
        for whole in batches:
            for begin, some in text_slices(whole.column(1)):
                b = whole.slice(begin, some)
                at, sizes = _places(b.column(1)), b.column(2).to_numpy()
                first = np.cumsum(sizes) - sizes
                frequent = at >= 0
                root = np.full(len(at), -t.denominator)
                root[frequent] += np.log10(t.counts[at[frequent]] + 1.0)
                logs = t.logs(t.places(_ended(t, at), len(t.contexts)), at, root)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), b.column(3), *(pa.array(np.add.reduceat(x, first)) for x in (root, logs)), b.column(4), b.column(5)],
                    ["doc_id", "n_tokens", "known", "base", "logs", "rare", "times"],
                )

    seen = numbers.select("doc_id", "at", "n_tokens", "known", "rare", "times").mapInArrow(
        run, "doc_id long, n_tokens long, known long, base double, logs double, rare array<long>, times array<long>"
    )
    seen = materialize(seen.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    asked = seen.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("k"))
    # Words that no training text has add nothing: log10(0 + 1).
    more = (
        asked.join(model.rare, "key")
        .groupBy("row")
        .agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"))
    )
    zero = F.lit(0.0)
    return seen.drop("rare", "times").join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tree.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero)).alias("base_score"),
        (F.col("logs") + F.coalesce("more", zero)).alias("score"),
    )


def held_out(key, by: int = 7, at: int = 2):
    """Whether crc32 of the key's decimal digits leaves ``at``; false for null keys."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % by == at, F.lit(False))


def train_and_score(
    df: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 4, word_share: float = 1e-6, context_share: float = 1e-5,
    next_share: float = 1e-6, divergence: float = 0.02, least: int = 2,
) -> DataFrame:
    """Learn from the rows whose key is not held out, and score all rows; the texts
    are numbered once for both.  Odd rows are as for ``train`` and ``score``."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), held_out(F.col(f"`{key}`")).alias("held_out"), F.col(f"`{text}`").alias("text"))
    model = count_words(rows.where("not held_out"), "text", word_share, least)
    numbers = numbered_words(rows, model, "doc_id", "held_out")
    grow(model, numbers.where("not held_out"), depth, context_share, next_share, divergence, least)
    scored = _scored(numbers, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *[c for c in scored.columns if c != "doc_id"])
