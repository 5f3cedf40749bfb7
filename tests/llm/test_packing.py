import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from echoframe.llm import packing
from echoframe.llm.packing import CapacityTree, balanced_plan, best_fit_plan, pack_balanced, pack_best_fit, read_matrix, write_packed
from echoframe.llm.words import WordIds, default_words


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_words())
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_word_ids(plain):
    rng = random.Random(2)
    alphabet = "abIÉÀİßΣσ' .,-12\n\t\x0b\x1c\x1f\x85\xa0  ​́eé<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(2000)]
    texts += ["", " ", "it's they'll", "<|endoftext|> x", "a" * 5000] + [f"a{chr(c)}b" for c in range(0x3100)]
    ours = WordIds(default_words(), remember=500)
    for lo in range(0, len(texts), 300):
        ids, bounds = ours.encode(pa.array(texts[lo : lo + 300]))
        for i, t in enumerate(texts[lo : lo + 300]):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == plain(t), repr(t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40))
def test_plans_hold_every_token_once(lengths):
    for plan, size in ((balanced_plan(lengths, 64), 64), (best_fit_plan(lengths, 64), 64)):
        seen = {}
        for d, s, n, q, o in plan:
            for i in range(n):
                assert (d, s + i) not in seen
                seen[d, s + i] = (q, o + i)
        assert set(seen) == {(d, i) for d, n in enumerate(lengths) for i in range(n)}
        assert len(set(seen.values())) == len(seen)
        filled = {}
        for q, o in seen.values():
            filled.setdefault(q, set()).add(o)
        assert all(v == set(range(len(v))) and len(v) <= size for v in filled.values())
        assert sorted(filled) == list(range(len(filled)))
    used = {}
    for d, s, n, q, o in balanced_plan(lengths, 64):
        used[q] = used.get(q, 0) + n
    assert all(v == 64 or v & (v - 1) == 0 for v in used.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 37)), max_size=80))
def test_capacity_tree(steps):
    tree, held = CapacityTree(37), []
    for put, c in steps:
        if put:
            tree.put(c, len(held))
            held.append(c)
        else:
            fit = [x for x in held if x is not None and x >= c]
            got = tree.take(c)
            assert (got is None) == (not fit)
            if got:
                assert got[0] == min(fit)
                held[got[1]] = None


def test_best_fit_matches_a_plain_search():
    rng = random.Random(9)
    lengths = [rng.randrange(1, 100) for _ in range(300)]
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(100 - n)
    assert max(p[3] for p in best_fit_plan(lengths, 100)) + 1 == len(rooms)


def test_costs_are_balanced():
    rng = random.Random(1)
    lengths = [rng.randrange(20, 3000) for _ in range(800)]
    cost = {}
    for _, _, n, q, _ in balanced_plan(lengths, 4096):
        cost.setdefault(q, []).append(n + n * n / 4096)
    full = np.array([sum(v) for v in cost.values()])
    assert np.percentile(full, 90) / np.median(full) < 1.5


ROWS = [(1, "the cat sat. " * 900, 1), (1, "the cat", 2), (None, "x y", 3), (3, None, 4), (4, "", 5), (5, "word " * 30, 6)]


def test_tables(spark, plain, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, length int").repartition(2)
    want = sorted(str((k, plain(t or "") + [2])) for k, t, _ in ROWS)
    rows = pack_balanced(df, size=256, with_ids=True).collect()
    docs = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids)
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert sorted(str((k[0], [x for _, p in sorted(v) for x in p])) for k, v in docs.items()) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 256 and at & (at - 1) == 0
    assert pack_balanced(df.limit(0)).count() == 0 == pack_best_fit(df.limit(0)).count()

    write_packed(df, str(tmp_path / "m"), size=256)
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    matrix, docs = read_matrix(rows, 256), {}
    for r, ids in zip(rows, matrix):
        assert r.cu_seqlens[-1] == r.n_tokens == 256 - r.n_padding
        assert r.position_resets == [x for x in r.cu_seqlens if x < 256]
        for k, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            docs.setdefault(k, []).append((s, ids[a:b].tolist()))
    got = sorted(x for v in docs.values() for _, p in v for x in p)
    assert got == sorted(x for k, t, _ in ROWS for x in plain(t or "") + [2])


def test_balanced_assignment_matches_a_plain_search():
    """Longest first, each to the cheapest sequence with room, by sorting anew at every step."""
    rng = random.Random(4)
    for _ in range(40):
        size = rng.choice([8, 16, 50, 64])
        lengths = [rng.randrange(1, 120) for _ in range(rng.randrange(1, 25))]
        total = sum(lengths)
        rooms = [size] * (total // size) + [1 << i for i in range(12, -1, -1) if (total % size) >> i & 1]
        load = [[0.0, r, 0] for r in rooms]  # cost, room, used
        waiting = [(min(n - s, size), d, s) for d, n in enumerate(lengths) for s in range(0, n, size)]
        want = []
        while waiting:
            waiting.sort(key=lambda x: (-x[0], x[1], x[2]))
            n, d, s = waiting.pop(0)
            fit = [i for i, x in enumerate(load) if x[1] >= n] or [i for i, x in enumerate(load) if x[1]]
            at = min(fit, key=lambda i: (load[i][0], i))
            take = min(n, load[at][1])
            want.append((d, s, take, at, load[at][2]))
            load[at] = [load[at][0] + take + take * take / size, load[at][1] - take, load[at][2] + take]
            if take < n:
                waiting.append((n - take, d, s + take))
        assert balanced_plan(lengths, size) == want


def test_blocks_end_at_documents(monkeypatch, plain):
    """A document longer than a block makes one of its own; none is lost or cut."""
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 50)
    texts = ["a b c", "word " * 400, "", None, "x y", "z " * 60, "the end"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["k", "t"])
    seen = []
    for keys, bounds, ids in packing._blocks([batch], default_words(), 2):
        assert len(keys) == len(bounds) - 1 and all(bounds[:-1] < 50) and bounds[-1] == len(ids)
        seen += [(k, ids[a:b].tolist()) for k, a, b in zip(keys, bounds, bounds[1:])]
    assert seen == [(i, [*plain(t or ""), 2]) for i, t in enumerate(texts)]


def test_wide_ids_and_clashing_names(spark):
    assert packing.id_type(default_words(), 2, 0) == "<u2" and packing.id_type(default_words(), 70_000, 0) == "<u4"
    df = spark.createDataFrame([(1, "the cat", 5, 6, "x"), (2, None, 7, 8, "y")], "doc_id long, text string, start int, sequence_id int, ids string")
    rows = pack_best_fit(df, size=16, end_id=70_000).collect()
    matrix = read_matrix(rows, 16)
    assert matrix.dtype == np.dtype("<u4") and (matrix == 70_000).sum() == 2
    assert sum(r.length for r in pack_balanced(df, size=16).collect()) == sum(r.n_tokens for r in rows)
    with pytest.raises(ValueError):
        packing.id_type(default_words(), -1)
