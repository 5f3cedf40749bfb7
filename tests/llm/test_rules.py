import random
import re

from echoframe.llm.rules import BASE, RULES, STRICT, Policy, ablations, bits_of, judge, keep_good, ledger

SP = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = SP.findall(t)
    lines = [x for x in t.split("\n") if SP.search(x)]
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in grams.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    rng = random.Random(8)
    words = ["a", "bb", "Ccé", "d#", "|", "e!!", " f", "\U0001f600"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "  ", "\x0b", "\n\n"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    texts += [None, "", " ", "\n\n", "one", "a b", "a b c a b c", "x " * 60000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "a", "z")] * 2, "doc_id long, text string, n_words string")
    rows = judge(df).collect()
    assert len(rows) == len(df.collect())
    for r in rows:
        if r.doc_id is None:
            continue
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert judge(df.limit(0)).count() == 0


def test_policy_and_ablations(spark):
    good = " ".join(f"w{i}ord" for i in range(80))
    loud = " ".join(f"W{i}ORD!!" for i in range(80))
    df = spark.createDataFrame([(1, good, 5), (2, loud, 6), (3, "short", 7), (4, good + " ###" * 80, 8), (5, None, 9)], "doc_id long, text string, failed int")
    kept = keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1] and kept.first().failed == 5
    table = {r.rule: r for r in ablations(ledger(df), [STRICT, Policy("loose", 2, bits_of("few_words"))]).where("policy = 'web'").collect()}
    assert set(table) == set(RULES)
    assert table["few_words"].n_docs == 5 and table["few_words"].n_rejected == 4
    assert table["exclamations"].n_failed == 1 and table["exclamations"].n_only == (1 if table["upper_case"].n_failed == 0 else 0)
    assert BASE.mask == 3


def test_windows_of_one_hash(spark, monkeypatch):
    """Repeats are found though many different windows have one hash."""
    from pyspark.sql import functions as F

    import echoframe.llm.rules as R

    plain = R._window_hash
    monkeypatch.setattr(R, "_window_hash", lambda i: F.pmod(plain(i), F.lit(3)))
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in judge(df).collect()} == {i: brute(t)[4] for i, t in enumerate(texts)}
