"""The minimizer index against all windows, and stretches of hot files."""

import random

import numpy as np
from pyspark.sql import functions as F

from echoframe.operators import blocks


def test_minimizer_runs():
    rng = np.random.default_rng(2)
    for width in (3, 8, 9, 24):
        for n in (0, width - 1, width, width + 1, 70, 400):
            x = rng.integers(0, 3, n).astype(np.int64)
            m, start, count = blocks.minimizer_runs(x, width)
            assert count.sum() == max(0, n - width + 1)
            assert start.tolist() == np.concatenate([[0], np.cumsum(count)[:-1]]).astype(int).tolist() if len(start) else n < width
            # The choice of a window follows from its tokens alone.
            for s, c, h in zip(start, count, m):
                for w in range(s, s + c):
                    assert blocks.minimizer_runs(x[w : w + width], width)[0].tolist() == [h]


def sources_of(spark, texts):
    rows = [(name, name, "text", text) for name, text in texts.items()]
    return blocks.block_sources(spark.createDataFrame(rows, "id string, path string, language string, text string"))


def test_hits_against_all_windows(spark):
    rng = random.Random(8)
    texts = {f"f{i:02}.{'ab'[i % 2]}": " ".join(rng.choice("xyz") + str(rng.randrange(3)) for _ in range(rng.randrange(60))) for i in range(40)}
    texts |= {"same.a": "w " * 300, "same2.a": "w " * 40, "null.a": None, "short.b": "a b"}
    for i in range(4):
        texts[f"long{i}.b"] = " ".join(f"u{i}_{j}" for j in range(900)) + " " + " ".join(f"t{j}" for j in range(100, 400 + i))
    sources = sources_of(spark, texts)
    width = 6
    seen, want = {}, []
    for r in sorted(sources.collect(), key=lambda r: r.src):
        raws = [t.raw for t in r.tokens]
        for p in range(len(raws) - width + 1):
            key = (r.domain, *raws[p : p + width])
            if key in seen:
                want.append((r.src, p, *seen[key]))
            seen.setdefault(key, (r.src, p))
    found = blocks.windows(sources, width)
    assert sorted(map(tuple, blocks.window_hits(found).collect())) == sorted(want)
    every = sum(max(0, len(r.tokens) - width + 1) for r in sources.collect())
    assert found.count() < every
    long = found.join(sources.where(F.col("path").startswith("long")).select("src"), "src").count()
    assert long < 4 * 400  # of the 900 tokens of each that nothing shares, none is keyed


def test_shared_stretch_is_cut_once(spark):
    body = "\n".join(f"call_{i}(value);" for i in range(12))
    texts = {f"f{i:03}.rs": f"start_{i}();\n{body}\nend_{i}();\n" for i in range(60)}
    sources = sources_of(spark, texts)
    found = blocks.regions(blocks.window_hits(blocks.windows(sources, 24)), 24)
    pairs = blocks.block_pairs(found, sources, 24, 3).collect()
    assert len(pairs) == 59 and {p.left.path for p in pairs} == {"f000.rs"}
    assert {(p.left.span.start_line, p.left.span.end_line, p.right.span.start_line, p.right.span.end_line) for p in pairs} == {(2, 13, 2, 13)}
    assert blocks.block_pairs(found.limit(0), sources, 24, 3).count() == 0


def test_regions_of_too_few_lines_are_not_cut(spark, monkeypatch):
    flat = " ".join(f"w{i}" for i in range(30))
    body = "\n".join(f"call_{i}(value);" for i in range(12))
    texts = {f"flat{i}.txt": f"{i} {flat} {i}" for i in range(20)} | {f"long{i}.txt": f"start_{i}();\n{body}\nend_{i}();\n" for i in range(2)}
    # One side on a line, the other on many: that is none either.
    texts |= {"z0.txt": " ".join(f"v{i}" for i in range(40)), "z1.txt": "\n".join(f"v{i}" for i in range(40))}
    sources, written = sources_of(spark, texts), {}
    kept = blocks.materialize
    monkeypatch.setattr(blocks, "materialize", lambda df, name, *more: written.setdefault(name, kept(df, name, *more)))
    found = blocks.regions(blocks.window_hits(blocks.windows(sources, 24)), 24)
    pairs = blocks.block_pairs(found, sources, 24, 3).collect()
    assert [(p.left.path, p.right.path, p.left.span.start_line, p.right.span.end_line) for p in pairs] == [("long0.txt", "long1.txt", 2, 13)]
    assert written["regions"].count() == 21 and written["stretches"].count() == 2
    written.clear()
    assert blocks.block_pairs(found, sources, 24, 1).count() == 21


def test_equal_runs_are_keyed_once(spark):
    """a window of a text that occurs again is not keyed anew in each copy."""
    rng = random.Random(5)
    body = [f"w{rng.randrange(60)}" for _ in range(400)]
    texts = {f"f{i:02}": " ".join(body) for i in range(30)}
    for i in range(8):  # near copies, which share some windows of a run and not others
        near = list(body)
        near[50 * i + 7] = f"own{i}"
        texts[f"g{i}"] = " ".join(near[rng.randrange(9) :])
    sources = sources_of(spark, texts)
    found = blocks.windows(sources, 24)
    every = {r.src: [t.raw for t in r.tokens] for r in sources.collect()}
    seen, want = {}, []
    for src in sorted(every):
        for p in range(len(every[src]) - 23):
            first = seen.setdefault(tuple(every[src][p : p + 24]), (src, p))
            if first != (src, p):
                want.append((src, p, *first))
    assert sorted(map(tuple, blocks.window_hits(found).collect())) == sorted(want)
    assert found.count() < len(want) / 4
    stretches = blocks.hit_runs(found)
    assert stretches.count() < len(want) / 4 and stretches.agg(F.sum("n")).first()[0] == len(want)
    plain = blocks.regions(blocks.each_window(stretches), 24).collect()
    assert sorted(plain) == sorted(blocks.regions(stretches, 24).collect()) and len(plain) < 60


def test_tokens_are_not_written_and_texts_decide(spark, monkeypatch):
    """F3 F9: sources keep hashes, lines and the text; stretches hold digests and line ends; a region of unequal texts is no pair."""
    from echoframe.operators import ordering

    body = "\n".join(f"call_{i}(value, 'é\n{i}'); /* a /* b */\n c */" for i in range(12))
    texts = {f"f{i}.rs": f"start_{i}();\n{body}\nend_{i}();" for i in range(3)} | {"g.rs": "\n".join(f"other_{i}(value, 'x');" for i in range(40)), "null.rs": None}
    written = {}
    for module in (blocks, ordering):
        kept = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, *more, kept=kept: written.setdefault(name, kept(df, name, *more)))
    rows = [(name, name, "rust", text) for name, text in texts.items()]
    sources = blocks.block_sources(spark.createDataFrame(rows, "id string, path string, language string, text string"))
    assert "tokens" not in written["numbered"].columns
    for r in sources.collect():
        assert [(t.start_line, t.end_line) for t in r.tokens] == list(zip(r.from_line, r.to_line)) and len(r.hashes) == len(r.tokens)
        assert all((texts[r.path] or "").encode()[t.start_byte : t.end_byte].decode() == t.raw for t in r.tokens)
    found = blocks.regions(blocks.window_hits(blocks.windows(sources, 24)), 24)
    src = {r.path: r.src for r in sources.collect()}
    wrong = spark.createDataFrame([(src["f0.rs"], 0, src["g.rs"], 5, 60)], found.schema)
    pairs = blocks.block_pairs(found.unionByName(wrong), sources, 24, 3).collect()
    assert {(p.left.path, p.right.path) for p in pairs} == {("f0.rs", "f1.rs"), ("f0.rs", "f2.rs")} and wrong.join(written["long-regions"], wrong.columns).count() == 1
    assert not {"tokens", "raw", "text"} & set(written["stretches"].columns)
