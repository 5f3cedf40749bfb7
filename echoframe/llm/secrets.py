"""Secret scans: rules for the known kinds, and a character convolutional network over
every candidate with what stands around it.

The rules' findings are the labels: candidates that meet one are positive examples, the
others negative.  The network is a convolution over characters, its maxima over the
text before, the candidate and the text behind, and two dense layers, all in numpy.
It learns from every distinct window of the table, so neither partitions nor copies
change it: a start is trained on a few windows of each class, those of the smallest
hashes, and then ``ROUNDS`` steps follow the slopes over all windows, which are dealt by
hash into packs and summed as whole numbers.  Negative windows that a network trained on
the other half of the start takes for positive are left out.  Scores are calibrated on
the quarter of all windows that training does not see, as counts on a fine scale, and a
candidate is a finding from the highest threshold that keeps ``recall`` of the
calibration's positive ones: one threshold for candidates with a keyword before them, one
for the others, for which the keywords are taken from the calibration's positive windows.

Two passes over the texts, one for examples and one for findings, without a shuffle of
either; distinct windows are shuffled, and only the start's examples, sums and the model
go through the driver."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import forget, materialize
from .words import text_slices

#: Windows of each class that the start is trained on, at most; all are learned from after it.
MAX_EXAMPLES = 2000
#: Steps over all windows, windows of a pack, and what a task holds before it hands on.
ROUNDS, PACK, HELD = 8, 2048, 20_000
#: Slopes are summed as whole numbers of this part, logits counted by this part up to a bound.
SLOPE_PART, LOGIT_PART, LOGIT_MOST = 2.0**-40, 2.0**-8, 64.0
#: Characters before a candidate, in one piece of it, and behind it.
BEFORE, PIECE, BEHIND = 24, 64, 16
WIDTH, FILTERS, HIDDEN = 5, 48, 32
BLOCK = 512  # windows that are scored at once

#: The rules, with the least lengths of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "net")

_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}+")
_WORDS = ("pass", "secret", "token", "key", "credential")
_KEYWORD = re.compile("|".join(_WORDS), re.I | re.A)
_DIGIT = re.compile("[0-9]")
LEAST_RUN, PLAIN_RUN = 8, 20

# Characters as numbers: 0 nothing, 1 white space and control, 2 not ASCII, then ASCII.
_NUMBER = np.full(256, 2, np.uint8)
_NUMBER[:33] = _NUMBER[127] = 1
_NUMBER[33:127] = np.arange(3, 97)
SYMBOLS = 97


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the rules' findings, of each kind leftmost first and not
    overlapping; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "key")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # A greedy run of 32 or more is the run that the plain rule takes.
    found += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether a keyword stands shortly before) of the candidates: runs of
    value characters, without full stops at their ends, of at least ``LEAST_RUN``, that
    have a digit, or ``PLAIN_RUN`` characters, or a keyword before them."""
    out = []
    low = text.lower()
    keys = [m.start() for m in _KEYWORD.finditer(text)] if any(w in low for w in _WORDS) else []
    for m in _RUN.finditer(text):
        run = m.group()
        start, end = m.start() + len(run) - len(run.lstrip(".")), m.end() - (len(run) - len(run.rstrip(".")))
        if end - start < LEAST_RUN:
            continue
        at = bisect.bisect_left(keys, start - BEFORE)
        near = at < len(keys) and keys[at] < start
        if near or end - start >= PLAIN_RUN or _DIGIT.search(run):
            out.append((start, end, near))
    return out


def windows(text: str, start: int, end: int) -> np.ndarray:
    """One row of symbols for every piece of a candidate: what stands before the
    candidate, the piece, what stands behind the candidate."""
    points = np.frombuffer(text[max(0, start - BEFORE) : end + BEHIND].encode("utf-32-le"), "<u4")
    codes = _NUMBER[np.minimum(points, 255)]
    first = start - max(0, start - BEFORE)
    pieces = -(-(end - start) // PIECE)
    out = np.zeros((pieces, BEFORE + PIECE + BEHIND), np.uint8)
    out[:, BEFORE - first : BEFORE] = codes[:first]
    tail = codes[first + end - start :]
    out[:, BEFORE + PIECE : BEFORE + PIECE + len(tail)] = tail
    body = np.zeros(pieces * PIECE, np.uint8)
    body[: end - start] = codes[first : first + end - start]
    out[:, BEFORE : BEFORE + PIECE] = body.reshape(pieces, PIECE)
    return out


#: Where the convolution begins to look, for each of the three parts.
_PARTS = ((0, BEFORE), (BEFORE - 2, BEFORE + PIECE), (BEFORE + PIECE - 2, BEFORE + PIECE + BEHIND - WIDTH + 1))


@dataclass
class Network:
    """``filters[j, symbol]`` is what a symbol at place j of a filter's field adds."""

    filters: np.ndarray
    shift: np.ndarray
    first: np.ndarray
    first_shift: np.ndarray
    last: np.ndarray
    last_shift: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> "Network":
        n = FILTERS * len(_PARTS)
        made = rng.normal(0, 0.25, (WIDTH, SYMBOLS, FILTERS))
        made[:, 0] = 0
        return cls(made, np.zeros(FILTERS), rng.normal(0, (2 / n) ** 0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1))

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.shift, self.first, self.first_shift, self.last, self.last_shift]

    def convolved(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1] - WIDTH + 1
        h = np.zeros((len(x), n, FILTERS))
        for j in range(WIDTH):
            h += self.filters[j][x[:, j : j + n]]
        return h + self.shift

    def forward(self, x: np.ndarray):
        """(logits, what the backward pass needs)."""
        h = self.convolved(x)
        places = [h[:, a:b].argmax(axis=1) + a for a, b in _PARTS]
        tops = np.concatenate([np.take_along_axis(h, p[:, None], axis=1)[:, 0] for p in places], axis=1)
        pooled = np.maximum(tops, 0)
        hidden = np.maximum(pooled @ self.first + self.first_shift, 0)
        return hidden @ self.last + self.last_shift[0], (places, tops, pooled, hidden)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean logistic loss and its derivatives, in the order of ``parameters``."""
        z, (places, tops, pooled, hidden) = self.forward(x)
        loss = float(np.mean(np.logaddexp(0, z) - y * z))
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        d_hidden = np.outer(dz, self.last) * (hidden > 0)
        d_tops = d_hidden @ self.first.T * (tops > 0)
        d_filters, d_shift = np.zeros_like(self.filters), np.zeros(FILTERS)
        rows, which = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
        for i, p in enumerate(places):
            g = d_tops[:, i * FILTERS : (i + 1) * FILTERS]
            d_shift += g.sum(0)
            for j in range(WIDTH):
                flat = x[rows, p + j].astype(np.int64) * FILTERS + which
                d_filters[j] += np.bincount(flat.ravel(), g.ravel(), SYMBOLS * FILTERS).reshape(SYMBOLS, FILTERS)
        return loss, [d_filters, d_shift, pooled.T @ d_hidden, d_hidden.sum(0), hidden.T @ dz, dz.sum()[None]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[lo : lo + BLOCK])[0] for lo in range(0, len(x), BLOCK)]) if len(x) else np.empty(0)


_VALUE = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", np.uint8)


def varied(x: np.ndarray, y: np.ndarray, others: np.ndarray, rng: np.random.Generator, moved: float = 0.4, recast: float = 0.4) -> np.ndarray:
    """Windows with changes that leave what they are: a share ``moved`` of the positive
    ones get the surroundings of one of the ``others``, and a share ``recast`` other
    characters for those of their value, each for the same one throughout."""
    x = x.copy()
    for i in np.flatnonzero(y > 0):
        draw = rng.random(2)
        if draw[0] < moved and len(others):
            o = others[rng.integers(len(others))]
            x[i, :BEFORE], x[i, BEFORE + PIECE :] = o[:BEFORE], o[BEFORE + PIECE :]
        if draw[1] < recast:
            table = np.arange(256, dtype=np.uint8)
            table[_NUMBER[_VALUE]] = rng.permutation(_NUMBER[_VALUE])
            x[i, BEFORE : BEFORE + PIECE] = table[x[i, BEFORE : BEFORE + PIECE]]
    return x


def train(x: np.ndarray, y: np.ndarray, steps: int = 600, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """A network by Adam on batches of which half are positive."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    mean = [np.zeros_like(p) for p in net.parameters()]
    square = [np.zeros_like(p) for p in net.parameters()]
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    for step in range(1, steps + 1):
        some = np.concatenate([rng.choice(good, batch // 2), rng.choice(bad, batch // 2)])
        _, slopes = net.gradients(varied(x[some], y[some], x[bad], rng), y[some])
        for p, g, m, s in zip(net.parameters(), slopes, mean, square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + decay * p)
    return net


def logistic_fit(z: np.ndarray, y: np.ndarray, rounds: int = 50, times: np.ndarray | None = None) -> tuple[float, float]:
    """(a, b) of the chance 1 / (1 + exp(-(a z + b))), by Newton's method with steps
    halved until they help, and a little weight on a = 1, b = 0.  ``times``: how often
    each example occurs, once if it is not given."""
    times = np.ones(len(z)) if times is None else times
    good, bad = (times * y).sum(), (times * (1 - y)).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))  # Platt's
    prior, x = np.array([1.0, 0.0]), np.stack([z, np.ones(len(z))], axis=1)

    def loss(w):
        t = x @ w
        return float((times * (np.logaddexp(0, t) - target * t)).sum() + 0.05 * ((w - prior) ** 2).sum())

    w, now = prior, loss(prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (times * (p - target)) + 0.1 * (w - prior))
        while (after := loss(w - step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        if now - after < 1e-9:
            break
        w, now = w - step, after
    return max(float(w[0]), 1e-6), float(w[1])


def threshold_for(chances: np.ndarray, recall: float, times: np.ndarray | None = None) -> float:
    """The highest threshold that at least ``recall`` of the chances reach, each of
    which occurs once or so many ``times``."""
    order = np.argsort(-chances, kind="stable")
    reached = np.cumsum(np.ones(len(chances)) if times is None else times[order])
    wanted = max(1, np.ceil(recall * reached[-1] - 1e-9))
    return float(chances[order][np.searchsorted(reached, wanted)])


@dataclass
class SecretModel:
    network: Network
    slope: float
    offset: float
    #: Thresholds for candidates without and with a keyword before them.
    thresholds: tuple[float, float]
    #: On the calibration's windows, against the rules: recall, and the share of negative ones that are said to be findings.
    measured: dict = field(default_factory=dict)

    def chances(self, x: np.ndarray) -> np.ndarray:
        return self.chances_of(self.network.logits(x))

    def chances_of(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -500, 500)))


#: Fewer examples than this, in a class, teach nothing.
LEAST_EXAMPLES, LEAST_CHECKED = 8, 4


def _side(h: np.ndarray) -> np.ndarray:
    """0 or 1 by hash, apart from what chooses the calibration's quarter."""
    return h >> 2 & 1


def doubters(x: np.ndarray, y: np.ndarray, h: np.ndarray) -> list[Network | None]:
    """By side, a network that was trained on the other one."""
    rest = [_side(h) != f for f in (0, 1)]
    return [train(x[r], y[r], steps=300) if min((y[r] > 0).sum(), (y[r] == 0).sum()) else None for r in rest]


def doubtful(x: np.ndarray, y: np.ndarray, h: np.ndarray, nets: list[Network | None]) -> np.ndarray:
    """Negative windows that a network takes for positive which was trained without
    them: secrets that no rule knows stand among the negative ones, and training on
    them would teach to miss their like."""
    out = np.zeros(len(x), bool)
    for f in (0, 1):
        mine = np.flatnonzero((_side(h) == f) & (y == 0))
        if nets[f] is not None:
            out[mine] = nets[f].logits(x[mine]) > 0
    return out


def _packed(windows: DataFrame, total: int, nets: list[Network | None]) -> DataFrame:
    """All windows in packs of some ``PACK``, dealt and ordered by hash, without the
    doubtful ones: (g, h, y, near, win, doubted, bad), the last two being numbers."""
    held = windows.sparkSession.sparkContext.broadcast(nets)
    names = ["g", "h", "y", "near", "win", "doubted", "bad"]

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("h")
        h, y, near = (rows[c].to_numpy().astype(k) for c, k in (("h", np.int64), ("label", np.uint8), ("near", np.uint8)))
        x = np.frombuffer(b"".join(rows["win"].to_pylist()), np.uint8).reshape(len(h), -1)
        kept = ~doubtful(x, y, h, held.value)
        bad = int(((y == 0) & (h % 4 != 0) & kept).sum())
        values = [rows["g"][0].as_py(), *[v[kept].tobytes() for v in (h, y, near, x)], int((~kept).sum()), bad]
        return pa.table([pa.array([v]) for v in values], names)

    dealt = windows.withColumn("g", F.pmod(F.xxhash64("h"), F.lit(-(-total // PACK))))
    return dealt.groupBy("g").applyInArrow(pack, "g long, h binary, y binary, near binary, win binary, doubted long, bad long")


def _of_packs(batches):
    """(g, whether for the calibration, y, near, windows) of every pack."""
    for b in batches:
        for g, h, y, near, win in zip(*[c.to_pylist() for c in b.columns[:5]]):
            h, y, near = np.frombuffer(h, np.int64), np.frombuffer(y, np.uint8), np.frombuffer(near, np.uint8)
            yield g, h % 4 == 0, y > 0, near > 0, np.frombuffer(win, np.uint8).reshape(len(h), -1)


def _slopes(packs: DataFrame, net: Network, turn: int, sizes: tuple[int, int]) -> list[np.ndarray]:
    """The slopes over all windows that are for training, both classes weighing the same."""
    held = packs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net, sums = held.value, None
        for g, calibration, y, _, x in _of_packs(batches):
            x, y = x[~calibration], y[~calibration]
            x = varied(x, y, x[~y], np.random.default_rng([turn, g]))
            for label in (False, True):
                some = x[y == label]
                for lo in range(0, len(some), BLOCK):
                    part = some[lo : lo + BLOCK]
                    share = len(part) / (2 * sizes[label])
                    found = net.gradients(part, np.full(len(part), float(label)))[1]
                    whole = np.concatenate([np.rint(s.ravel() * (share / SLOPE_PART)) for s in found]).astype(np.int64)
                    sums = whole if sums is None else sums + whole
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], ["sums"])

    total = sum(np.frombuffer(r.sums, np.int64) for r in packs.mapInArrow(run, "sums binary").collect()) * SLOPE_PART
    ends = np.cumsum([p.size for p in net.parameters()])
    return [part.reshape(p.shape) for part, p in zip(np.split(total, ends[:-1]), net.parameters())]


def refine(packs: DataFrame, net: Network, sizes: tuple[int, int], rate: float = 1e-3) -> Network:
    """``net`` after ``ROUNDS`` of Adam's steps over all windows."""
    mean, square = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    for turn in range(1, ROUNDS + 1):
        for p, g, m, s in zip(net.parameters(), _slopes(packs, net, turn, sizes), mean, square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * m / (1 - 0.9**turn) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-4)
    return net


def calibrated(packs: DataFrame, net: Network, recall: float) -> SecretModel:
    """The model by the logits of all of the calibration's windows, counted by parts of
    ``LOGIT_PART``, at the lower end of each."""
    held = packs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = held.value
        for g, calibration, y, near, x in _of_packs(batches):
            x, y, near = x[calibration], y[calibration], near[calibration]
            # Where no keyword stands before it, a value must tell by itself: positive windows
            # are held to that threshold in the surroundings of negative ones.
            alone = varied(x[y], y[y], x[~y & ~near], np.random.default_rng([0, g]), moved=1.0, recast=0.5)
            z = np.concatenate([net.logits(x), net.logits(alone)])
            sets = np.concatenate([2 * y + near, np.full(len(alone), 4)])
            parts = np.floor(np.clip(z, -LOGIT_MOST, LOGIT_MOST) / LOGIT_PART).astype(np.int64)
            kinds, n = np.unique(np.stack([sets, parts]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[0]), pa.array(kinds[1]), pa.array(n)], ["of", "part", "n"])

    counted = packs.mapInArrow(run, "of long, part long, n long").groupBy("of", "part").agg(F.sum("n").alias("n"))
    of, part, n = np.array(sorted(tuple(r) for r in counted.collect()), np.int64).reshape(-1, 3).T
    z, real = part * LOGIT_PART, of < 4
    model = SecretModel(net, 1.0, 0.0, (1.0, 1.0))
    model.slope, model.offset = logistic_fit(z[real], (of[real] >= 2).astype(float), times=n[real].astype(float))
    chances = model.chances_of(z)
    sets = ([of == 4], [])
    for near in (0, 1):
        if (of == 2 + near).any():
            sets[near].append(of == 2 + near)
    model.thresholds = tuple(min(threshold_for(chances[s], recall, n[s]) for s in chosen or sets[0]) for chosen in sets)
    said = chances >= np.where(of % 2 == 1, model.thresholds[1], model.thresholds[0])
    share = lambda s: float(n[s & said].sum() / n[s].sum()) if s.any() else 0.0
    good = (of == 2) | (of == 3)
    model.measured = {"windows": int(n[real].sum()), "positive": int(n[good].sum()), "recall": share(good), "false": share(of < 2), "recall_alone": share(of == 4)}
    return model


def _overlaps(found: list[tuple[str, int, int]]):
    """A test of whether a span meets one of the findings."""
    spans = sorted((a, b) for _, a, b in found)
    starts = [a for a, _ in spans]
    ends, most = [], 0
    for _, b in spans:
        most = max(most, b)
        ends.append(most)

    def meets(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        return i > 0 and ends[i - 1] > a

    return meets


def _batches_of_texts(batches, column: int):
    for whole in batches:
        for at, n in text_slices(whole.column(column)):
            yield whole.slice(at, n)


def _examples(batches):
    """The windows of both classes, of one task; those it still holds only once."""
    held: dict = {}

    def handed() -> pa.RecordBatch:
        rows = [(label, h, near, row) for (label, h), (near, row) in held.items()]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        held.clear()
        kinds = (pa.bool_(), pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["label", "h", "near", "win"])

    for b in _batches_of_texts(batches, 0):
        for text in b.column(0).to_pylist():
            meets = _overlaps(base_findings(text))
            for start, end, near in candidates(text):
                row = windows(text, start, min(end, start + PIECE))[0].tobytes()
                key = meets(start, end), xxhash.xxh3_64_intdigest(row) >> 1
                held[key] = (near or held.get(key, (False,))[0], row)
                if len(held) > HELD:
                    yield handed()
    yield handed()


def fit_secrets(df: DataFrame, text: str = "text", recall: float = 0.95) -> SecretModel | None:
    """A model from the rules' findings in all texts; None if there are too few.

    Every distinct window counts.  A window that the rules judge in both ways in
    different places counts as positive."""
    rows = materialize(df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(_examples, "label boolean, h long, near boolean, win binary"), "secret-examples")
    once = materialize(rows.groupBy("h").agg(F.max("label").alias("label"), F.max("near").alias("near"), F.min("win").alias("win")), "secret-windows")
    forget(rows)
    # Levels of the hashes: the first one at which a class has enough of them for the start.
    level, quarter = F.floor(F.log2(F.col("h") + 1)).cast("int"), F.col("h") % 4 == 0
    counts: dict = {False: {}, True: {}}
    total, fit, checked = 0, [0, 0], 0
    for r in once.groupBy("label", level.alias("level"), quarter.alias("quarter")).count().collect():
        n = r["count"]
        counts[r.label][r.level] = counts[r.label].get(r.level, 0) + n
        total += n
        fit[r.label] += 0 if r.quarter else n
        checked += n if r.label and r.quarter else 0
    if min(fit) < LEAST_EXAMPLES or checked < LEAST_CHECKED:
        forget(once)
        return None
    keep = F.lit(False)
    for label, of in counts.items():
        so_far, most = 0, 0
        for most in sorted(of):
            so_far += of[most]
            if so_far >= MAX_EXAMPLES:
                break
        keep = keep | ((F.col("label") == label) & (level <= most))
    sample = sorted(once.where(keep & ~quarter).toArrow().to_pylist(), key=lambda r: r["h"])
    taken = [r for label in (False, True) for r in [r for r in sample if r["label"] == label][:MAX_EXAMPLES]]
    x = np.frombuffer(b"".join(r["win"] for r in taken), np.uint8).reshape(len(taken), -1)
    y, h = np.array([float(r["label"]) for r in taken]), np.array([r["h"] for r in taken])
    nets = doubters(x, y, h)
    sure = ~doubtful(x, y, h, nets)
    packs = materialize(_packed(once, total, nets).repartition(df.sparkSession.sparkContext.defaultParallelism, "g"), "secret-packs")
    forget(once)
    bad = packs.agg(F.sum("bad")).first()[0]
    if not bad or not (y[sure] == 0).any() or not (y[sure] > 0).any():
        forget(packs)
        return None
    model = calibrated(packs, refine(packs, train(x[sure], y[sure]), (bad, fit[True])), recall)
    model.measured["doubtful"] = packs.agg(F.sum("doubted")).first()[0]
    forget(packs)
    return model


def network_findings(texts: list[str], found: list[list[tuple]], model: SecretModel) -> list[list[tuple]]:
    """The network's findings in every text: candidates that meet no rule's finding and
    of which some piece reaches the threshold."""
    places, rows = [], []
    out: list[list[tuple]] = [[] for _ in texts]

    def score():
        if not rows:
            return
        x = np.concatenate(rows)
        kinds, back = np.unique(x.view(f"V{x.shape[1]}").ravel(), return_inverse=True)
        chances = model.chances(kinds.view(np.uint8).reshape(len(kinds), -1))[back.ravel()]
        tops: dict = {}
        for place, c in zip(places, chances):
            tops[place] = max(tops.get(place, 0.0), c)
        for (i, start, end, near), c in tops.items():
            if c >= model.thresholds[int(near)]:
                out[i].append(("net", start, end))
        places.clear(), rows.clear()

    for i, text in enumerate(texts):
        meets = _overlaps(found[i])
        for start, end, near in candidates(text):
            if not meets(start, end):
                rows.append(windows(text, start, end))
                places.extend([(i, start, end, near)] * len(rows[-1]))
                if len(places) > 16 * BLOCK:
                    score()
    score()
    return out


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", recall: float = 0.95, model: SecretModel | None = None) -> DataFrame:
    """One row per input row: the key as ``doc_id``, ``base`` and ``added``, arrays of
    (kind, start, end) in code points with the end exclusive.  ``base`` has the rules'
    findings, ``added`` the network's, of kind "net"; neither is cut off at any number.
    Without a ``model`` one is fitted on the same table; where its rules find too
    little to learn from, nothing is added.

    A null text is empty.  Null and repeated keys are rows like any other.  An empty
    table gives an empty table, and other columns are ignored, whatever their names."""
    model = model or fit_secrets(df, text, recall)
    shared = df.sparkSession.sparkContext.broadcast(model)  # some 30,000 numbers
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        net = shared.value
        for b in _batches_of_texts(batches, 1):
            texts = b.column(1).to_pylist()
            base = [base_findings(t) for t in texts]
            added = network_findings(texts, base, net) if net else [[] for _ in texts]
            rows = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f] for f in found], span) for found in (base, added)]
            yield pa.RecordBatch.from_arrays([b.column(0), *rows], ["doc_id", "base", "added"])

    own = "array<struct<kind:string,start:long,end:long>>"
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, base {own}, added {own}")


def secret_digests(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``find_secrets`` as counts by kind (``n_assign``, ``n_access``, ``n_hex``,
    ``n_net``), ``base_sha256`` and ``spans``: kind:start:end of the rules' findings,
    hashed, and of all, by start and then by kind."""
    found = find_secrets(df, key, text, **options)
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])

    def joined(spans):
        placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("k"), s["end"].alias("b"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(placed, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    n = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[n("base", k) for k in KINDS[:3]], F.sha2(joined("base"), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), n("added", "net"),
    )
