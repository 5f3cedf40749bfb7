"""A quality classifier over document statistics.

A Gaussian kernel over about twenty statistics of a text is approximated by
random Fourier features (Rahimi and Recht, 2007).  Ridge scores come from normal
equations that every partition sums for its own rows; isotonic regression on
rows that the fit did not see turns scores into probabilities.

Learning uses a sample of labelled rows with a stated bound; scoring is one pass
over all rows without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .words import text_slices

#: Labelled rows that are used for learning, at most about so many.
MAX_LABELLED = 200_000

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_STOPS = [ord(c) for c in ".,;:"]
N_STATS = 20


def statistics(text: str) -> list[float]:
    """Twenty numbers about a whole text; an empty one has them too."""
    raw = text.encode()
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    size = max(1.0, h.sum())
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, share = max(1, len(words)), h[h > 0] / size
    kinds = len(set(words))
    upper, lower = h[_UPPER].sum(), h[_LOWER].sum()
    return [
        np.log1p(len(words)),
        np.log1p(size / n),
        kinds / n,
        np.log1p(kinds),
        upper / max(1.0, upper + lower),
        upper / n,
        lower / size,
        h[_DIGIT].sum() / size,
        h[128:].sum() / size,
        h[32] / size,
        np.log1p(h[10]) - np.log1p(size / 80),
        h[_STOPS].sum() / n,
        h[[33, 63]].sum() / n,
        np.sqrt(h[_SYMBOLS].sum() / n),
        np.sqrt(h[124] / n),
        np.sqrt(h[33] / n),
        float(-(share * np.log2(share)).sum()),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(size / max(1, len(lines))),
        np.sqrt(h[[34, 40, 41, 47, 64, 91, 92, 93, 95, 123, 125]].sum() / n),
    ]


@dataclass
class QualityModel:
    """All that scoring needs; a few hundred kilobytes whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray
    levels: np.ndarray
    chances: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale, self.weights, self.phase) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.levels, self.chances), 0.0, 1.0)


def fourier(stats, mean, scale, weights, phase) -> np.ndarray:
    z = np.clip((stats - mean) / scale, -8, 8)
    f = np.cos(z @ weights + phase) * np.sqrt(2.0 / len(phase))
    return np.hstack([f, z, np.ones((len(z), 1))])


def isotonic(values: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means of ``sums / counts`` in
    the order of ``values``."""
    pools: list[list[float]] = []
    for i in np.argsort(values, kind="stable"):
        pools.append([sums[i], counts[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, c, k = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += c
            pools[-1][2] += k
    return np.concatenate([np.full(int(k), s / c) for s, c, k in pools]) if pools else np.empty(0)


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key's decimal digits, modulo ``by``; null keys count as no digits."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % by


def _normal_sums(rows: DataFrame, mean, scale, weights, phase) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y, summed within partitions.  The rows are the labelled ones, of which
    there is a stated bound, so sixteen partitions hold them however many there are
    documents, and the driver adds sixteen sums at most."""
    width = len(phase) + N_STATS + 1

    def partial(batches):
        a, b, seen = np.zeros((width, width)), np.zeros(width), False
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, N_STATS)
            if len(x):
                f, seen = fourier(x, mean, scale, weights, phase), True
                a += f.T @ f
                b += f.T @ batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["a", "b"])

    sums = rows.select("x", "y").coalesce(16).mapInArrow(partial, "a binary, b binary").collect()
    a = sum((np.frombuffer(bytes(r.a)) for r in sums), np.zeros(width * width)).reshape(width, width)
    return a, sum((np.frombuffer(bytes(r.b)) for r in sums), np.zeros(width))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    features: int = 192, ridge: float = 1e-3, max_labelled: int = MAX_LABELLED, seed: int = 7,
) -> QualityModel | None:
    """Learn from the labelled rows whose key has a remainder (crc32 mod 5) other
    than 0: remainder 1 calibrates, 2 to 4 fit.

    A key with several labels counts with their mean, at least one half being 1.
    Null keys and labels are not used.  Of more than ``max_labelled`` labelled
    keys about that many are taken, chosen by a hash of the key.  Without usable
    rows, or with one class only, there is no model and the result is None."""
    known = (
        labels.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{label}`").cast("double").alias("v"))
        .where(F.col("k").isNotNull() & F.col("v").isNotNull() & (remainder(F.col("k"), 5) != 0))
        .groupBy("k")
        .agg((F.avg("v") >= 0.5).cast("double").alias("y"))
    )
    known = materialize(known, "quality-labels")
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    # At most about max_labelled rows of two numbers: a few megabytes.
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).join(F.broadcast(known), "k")

    def measure(batches):
        for whole in batches:
            for at, some in text_slices(whole.column(1)):
                b = whole.slice(at, some)
                x = [statistics(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], ["k", "x", "y"])

    rows = materialize(rows.select("k", "t", "y").mapInArrow(measure, "k long, x array<double>, y double"), "quality-stats")
    fold = remainder(F.col("k"), 5)
    training, calibration = rows.where(fold > 1), rows.where(fold == 1)
    about = training.agg(
        F.count("*").alias("n"), F.sum("y").alias("y"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N_STATS)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(N_STATS)],
    ).first()
    if not about.n or about.y in (0, about.n):
        return None
    mean = np.array([about[f"m{i}"] for i in range(N_STATS)])
    scale = np.maximum(np.array([about[f"s{i}"] for i in range(N_STATS)]), 1e-3)
    rng = np.random.default_rng(seed)
    weights = rng.standard_normal((N_STATS, features)) / np.sqrt(N_STATS / 2)
    phase = rng.uniform(0, 2 * np.pi, features)
    a, b = _normal_sums(training, mean, scale, weights, phase)
    w = np.linalg.solve(a + ridge * about.n * np.diag([1.0] * (len(b) - 1) + [1e-6]), b)
    model = QualityModel(mean, scale, weights, phase, w, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.array(x.tolist(), float).reshape(-1, N_STATS)))

    # 2,001 levels at most reach the driver.
    level = (F.round(F.least(F.greatest(raw("x"), F.lit(-0.5)), F.lit(1.5)) * 1000).cast("int")).alias("level")
    levels = calibration.select(level, "y").groupBy("level").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    if levels:
        levels.sort()
        at = np.array([r.level / 1000 for r in levels])
        model.levels = at
        model.chances = isotonic(at, np.array([r.y for r in levels]), np.array([r.n for r in levels], float))
    return model


def score_column(model: QualityModel | None, text: Column) -> Column:
    """The chance of label 1 for each whole text; one half without a model."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts], float).reshape(-1, N_STATS)))

    return score(F.coalesce(text, F.lit("")))


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, **options
) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` and ``predicted``.

    A null text is an empty one and is scored like any other; null and repeated
    keys are scored row by row (a null key is never learned from, and is not
    held out); an empty table gives an empty table; other columns are ignored."""
    model = fit(docs, labels, key, text, **options)
    return docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.coalesce(remainder(F.col(f"`{key}`").cast("long"), 5) == 0, F.lit(False)).alias("held_out"),
        score_column(model, F.col(f"`{text}`")).alias("score"),
    ).select("doc_id", F.col("held_out") & F.col("doc_id").isNotNull(), "score", (F.col("score") >= threshold).cast("int").alias("predicted")).toDF(
        "doc_id", "held_out", "score", "predicted"
    )


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns as before.

    Rows are judged one by one, so null and repeated keys are allowed and repeated
    rows share their fate; a null text is scored as an empty one.  Without usable
    labels there is no model, every score is one half, and at a threshold of at most
    that all rows stay.  An empty table gives an empty table."""
    model = fit(docs, labels, key, text, **options)
    return docs.where(score_column(model, F.col(f"`{text}`")) >= threshold)
