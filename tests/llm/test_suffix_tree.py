import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from echoframe.llm.suffix_tree import DISCOUNT, token_hashes, train_and_score
from echoframe.llm.words import _BATCH_BYTES, hashed_words, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def toks(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]


def out(k):
    return k is not None and zlib.crc32(str(k).encode()) % 7 == 2


def brute(rows, depth, word_share, context_share, next_share, divergence, least):
    """The tree by dictionaries: contexts are tuples of words, oldest first."""
    train = [toks(t) for k, t in rows if not out(k)]
    c = Counter(w for d in train for w in d)
    n, v = sum(c.values()), len(c)
    root = lambda w: (c[w] + 1) / (n + v + 1)
    frequent = {w for w in c if c[w] >= max(least, n * word_share)}
    states = {}

    def prob(context, w):
        p = root(w)
        for d in range(1, len(context) + 1):
            s = states.get(context[-d:])
            if s:
                p = s[1] * p + max(0.0, s[0].get(w, 0) - DISCOUNT) / s[2]
        return p

    size = {(w,): c[w] for w in frequent if w != "\n" and c[w] >= max(least, n * context_share)}
    seen = set(size)
    for d in range(1, depth + 1):
        new = {}
        pairs = {s: Counter() for s in size}
        for doc in train:
            for i in range(d, len(doc)):
                s = tuple(doc[i - d : i])
                if s in pairs and doc[i] in frequent:
                    pairs[s][doc[i]] += 1
        longer = {}
        for s, cnt in pairs.items():
            cnt = {w: k for w, k in cnt.items() if k >= max(least, n * next_share)}
            rest = max(1e-9, 1 - sum(k - DISCOUNT for k in cnt.values()) / size[s])
            gain = (1 - sum(cnt.values()) / size[s]) * math.log2(rest)
            for w, k in cnt.items():
                parent = prob(s[1:], w)
                gain += k / size[s] * math.log2(((k - DISCOUNT) / size[s] + rest * parent) / parent)
                if w != "\n" and k >= max(least, n * context_share) and (s + (w,))[1:] in seen:
                    longer[s + (w,)] = k
            if gain >= divergence:
                new[s] = (cnt, rest, size[s])
        states.update(new)
        size = longer
        seen |= set(longer)
    res = []
    for k, t in rows:
        d = toks(t)
        score = sum(math.log10(prob(tuple(d[max(0, i - depth) : i]), w)) for i, w in enumerate(d))
        res.append((k, out(k), len(d), sum(c[w] > 0 for w in d), n, sum(math.log10(root(w)) for w in d), score))
    return res, len(states)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_against_dictionaries(spark, depth):
    rng = random.Random(depth)
    rows = []
    for i in range(120):
        w, text = "a", []
        for _ in range(rng.randrange(60)):
            w = rng.choice({"a": "abbb", "b": "ccaD", "c": "aae", "D": "aB", "e": "ef", "f": "cé", "B": "c", "é": "xyz"}.get(w, "abc"))
            text.append(w if rng.random() < 0.9 else f"r{rng.randrange(40)}")
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [(None, None), (None, "a b"), (500, ""), (7, "a b c"), (7, "a b c"), (501, "zz " * 3000)]
    options = dict(word_share=1e-6, context_share=5e-3, next_share=1e-3, divergence=0.02, least=2)
    want, states = brute(rows, depth, **options)
    assert states > 3
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = train_and_score(df, depth=depth, **options).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-7) and a[6] == pytest.approx(b[6], abs=1e-7)


def test_held_out_texts_score_better_than_the_base(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    rows = [r for r in train_and_score(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert train_and_score(df).count() == 0


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_hashes_of_slices(kind):
    texts = ["Aé b", "Bb  İK", None, "\x0bCC\x00 c\x1fD ", "", "ÀZ", " d"]
    for held in (texts, [t or "" for t in texts]):  # with nulls Arrow copies a slice, without it does not
        column = pa.array(held, kind)
        for first in range(len(held)):
            for count in range(1, len(held) - first + 1):
                some = held[first : first + count]
                hashes, bounds = token_hashes(column.slice(first, count))
                want = [w.encode() for t in some for w in toks(t)]
                assert hashes.view(np.uint64).tolist() == word_hashes(want).tolist()
                assert np.diff(bounds).tolist() == [len(toks(t)) for t in some]
                cased = [w.encode() for t in some for w in WORD.findall(t or "")]
                assert hashed_words(column.slice(first, count), None)[0].tolist() == word_hashes(cased).tolist()


def test_batches_of_several_slices(spark):
    """One task's batch holds more than is read at once, so all but its first texts are slices."""
    words = ["The", "the", "cat", "Sat", "on", "É", "mats"]
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words, k=30_000)) + f" R{i % 90}") for i in range(180)]
    assert sum(len(t.encode()) for _, t in rows) > 2 * _BATCH_BYTES
    c = Counter(w for k, t in rows if not out(k) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for k, t in rows:
        own = Counter(toks(t))
        base = sum(m * math.log10((c[w] + 1) / (n + v + 1)) for w, m in own.items())
        want[k] = (out(k), sum(own.values()), sum(m for w, m in own.items() if c[w]), n, pytest.approx(base, rel=1e-9))
    got = train_and_score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), depth=1).collect()
    assert len(got) == len(want)
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == want
