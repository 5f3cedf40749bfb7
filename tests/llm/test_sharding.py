import zlib

import numpy as np

from echoframe.llm.sharding import assign_shards, jump_hash, spread, write_shards


def test_jump_hash_moves_only_into_the_new_shard():
    keys = spread(np.arange(20000))
    for n in range(1, 20):
        a, b = jump_hash(keys, n), jump_hash(keys, n + 1)
        moved = a != b
        assert (b[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.02
        assert np.bincount(a, minlength=n).min() > 20000 / n * 0.85


def test_table(spark):
    rows = [(i, f"t{i % 7}é", i) for i in range(500)] + [(None, None, 1)] * 3 + [(7, "", 2)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5)
    got = assign_shards(df, shards=8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    assert assign_shards(df.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x", 9) for i in range(100)], "doc_id long, text string, shard int")
    write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100
    want = {r.doc_id: r.shard for r in assign_shards(df, shards=4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want


def one_jump(key, shards):
    """The hash of one key by whole numbers, as its authors define it."""
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash_against_single_keys():
    keys = spread(np.concatenate([np.arange(300), np.array([-1, -(2**63), 2**63 - 1])]))
    for n in (1, 2, 7, 8, 9, 100, 5000):
        assert jump_hash(keys, n).tolist() == [one_jump(int(k), n) for k in keys]


def test_long_texts_and_null_keys(spark, tmp_path):
    rows = [(None, "é" * 300_000, "a"), (None, None, None), (3, "x" * 1_000_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string")
    assert sorted(r["size"] for r in assign_shards(df, shards=3).collect()) == [1, 600_001, 1_000_001]
    write_shards(df, str(tmp_path / "odd"), shards=3)
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert back.count() == 3 and len({r.shard for r in back.collect() if r.doc_id is None}) == 1
    write_shards(df.limit(0), str(tmp_path / "none"), shards=3)
