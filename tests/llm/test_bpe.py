import hashlib
import random

import pytest
import public_tokenizers
import tiktoken

from echoframe.llm.bpe import ByteBPE, EncodedText, PrefixTable, default_vocabulary, encode_and_decode, load_ranks

PATH, PATTERN = default_vocabulary()


@pytest.fixture(scope="module")
def pair():
    ranks = load_ranks(PATH)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ByteBPE(ranks, PATTERN, remember=2000), theirs


ALPHABET = "abthenIL  \n\t.,'s1éü你\U0001f600_ \x1c\x85 #"


def test_same_ids_as_tiktoken(pair):
    ours, theirs = pair
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "  ", "a" * 3000, " " * 500, "the   end  ", "it's we'll I'M", "=" * 700]
    texts += ["".join(map(chr, range(lo, lo + 64))) for lo in range(0, 0x3100, 64)]
    for t in texts:
        assert ours.encode(t) == theirs.encode_ordinary(t), repr(t)
        assert ours.decode(ours.encode(t)) == t.encode()


def test_prefix_table_append_and_replace(pair):
    ours, _ = pair
    rng = random.Random(4)
    for _ in range(200):
        word = "".join(rng.choice("abthening") for _ in range(20)).encode()
        grown = PrefixTable(ours, word[:7])
        grown.append(word[7:])
        assert grown.tokens() == PrefixTable(ours, word).tokens() == ours.merge(word)
        assert all(grown.tokens(n) == ours.merge(word[:n]) for n in range(21))
        grown.replace(5, 9, b"xyz")
        assert grown.tokens() == ours.merge(word[:5] + b"xyz" + word[9:])


def test_edits_of_a_text(pair):
    ours, theirs = pair
    rng = random.Random(6)
    text = "".join(rng.choice(ALPHABET) for _ in range(300))
    kept = EncodedText(ours, text)
    for _ in range(300):
        a = rng.randrange(len(text) + 1)
        b = min(len(text), a + rng.randrange(6))
        new = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(6)))
        text = text[:a] + new + text[b:]
        kept.replace(a, b, new)
        assert kept.tokens() == theirs.encode_ordinary(text)
    long = EncodedText(ours, "the end of a line. " * 500)
    assert long.replace(4000, 4003, "xx") < 12
    long.append("more")
    assert long.tokens() == theirs.encode_ordinary(long.text)


def test_table(spark, pair):
    rows = [(1, "the cat", 5), (1, "the cat", 5), (None, "x", 1), (3, None, 2), (4, "", 3), (5, "ab " * 40000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = encode_and_decode(df).collect()
    assert len(got) == 6
    _, theirs = pair
    want = sorted(
        str((k, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        for k, t, _ in rows
        for i in [theirs.encode_ordinary(t or "")]
    )
    assert sorted(str(tuple(r)) for r in got) == want
    assert encode_and_decode(df.limit(0)).count() == 0
