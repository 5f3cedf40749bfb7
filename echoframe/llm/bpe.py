"""Byte-level BPE by dynamic programming over prefixes.

Every byte string has exactly one valid encoding, and every prefix of it has
exactly one valid encoding too.  So one number per prefix is enough: the last
token of the prefix's encoding.  It is found from the prefixes before it: a
token that ends the prefix is its last token if and only if it may follow the
last token of what stands before it, that is, if merging the bytes of these two
tokens alone gives the two tokens back.

Kept per prefix, these numbers make an append exact (the table only grows) and
an edit local (what stands before the edit keeps its table, and what stands
behind the next split that is unchanged keeps its tokens).
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_SPACED = re.compile(r" \s")
_LONG = 64  # bytes; longer pieces are not remembered
_TAIL = 3  # bytes by which the tokens that may end a prefix are looked up


def default_vocabulary() -> tuple[str, str]:
    """The rank file and the split pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, bpe: "ByteBPE", piece: bytes = b""):
        self.bpe, self.bytes, self.last = bpe, bytearray(), []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Extend the piece; earlier prefixes keep their tokens."""
        start = len(self.bytes)
        self.bytes += more
        data, last, bpe = bytes(self.bytes), self.last, self.bpe
        for end in range(start + 1, len(data) + 1):
            for n in bpe.sizes[data[max(0, end - _TAIL) : end]]:
                if n > end:
                    continue
                token = bpe.ranks.get(data[end - n : end])
                if token is None:
                    continue
                if bpe.whole(token) if n == end else bpe.fits(last[end - n - 1], token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary lacks byte {data[end - 1]}")

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put ``new`` in place of bytes ``start`` to ``end``; the table before
        ``start`` stays as it is."""
        tail = bytes(self.bytes[end:])
        del self.bytes[start:], self.last[start:]
        self.append(new + tail)

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        at, out = len(self.bytes) if end is None else end, []
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.bpe.vocab[token])
        return out[::-1]


class _Sizes(dict):
    """From the last bytes of a prefix to the sizes of tokens that end so, longest
    first; at most about a million are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        found: dict[bytes, set[int]] = {}
        for token in ranks:
            for n in range(1, min(_TAIL, len(token)) + 1):
                if n == _TAIL or n == len(token):
                    found.setdefault(token[-n:], set()).add(len(token))
        self.found = found

    def __missing__(self, tail: bytes) -> tuple[int, ...]:
        own = set().union(*(self.found.get(tail[-n:], ()) for n in range(1, len(tail) + 1)))
        sizes = tuple(sorted(own, reverse=True))
        if len(self) < 1 << 20:
            self[tail] = sizes
        return sizes


class ByteBPE:
    """Encoder and decoder for one vocabulary.  What it remembers is bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 400_000):
        self.ranks, self.vocab = ranks, {v: k for k, v in ranks.items()}
        self.sizes = _Sizes(ranks)
        self.split = regex.compile(pattern)
        self.remember = remember
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.ends: dict[bytes, int] = {}  # the last token of short prefixes, shared by all pieces
        self.named = {str(k): v for k, v in self.vocab.items()}
        self.pieces: dict[str, str] = {}
        self.chunks = _Chunks(self)

    def merge(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; for the short strings of two tokens."""
        parts, ranks, none = [data[i : i + 1] for i in range(len(data))], self.ranks, float("inf")
        while len(parts) > 1:
            best, at = none, 0
            for i, both in enumerate(map(bytes.__add__, parts, parts[1:])):
                rank = ranks.get(both, none)
                if rank < best:
                    best, at = rank, i
            if best == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether the token's bytes are encoded as this one token."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merge(self.vocab[token]) == [token]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 4 * self.remember:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.vocab[left] + self.vocab[right]) == [left, right]
        return known

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        n = len(data)
        if n > _LONG:
            return PrefixTable(self, data).tokens()
        ends, ranks, sizes = self.ends, self.ranks, self.sizes
        start = n
        while start and data[:start] not in ends:
            start -= 1
        for end in range(start + 1, n + 1):
            for size in sizes[data[max(0, end - _TAIL) : end]]:
                if size > end:
                    continue
                token = ranks.get(data[end - size : end])
                if token is None:
                    continue
                if self.whole(token) if size == end else self.fits(ends[data[: end - size]], token):
                    ends[data[:end]] = token
                    break
            else:
                raise ValueError(f"the vocabulary lacks byte {data[end - 1]}")
        out, at = [], n
        while at:
            token = ends[data[:at]]
            out.append(token)
            at -= len(self.vocab[token])
        if len(ends) > self.remember:
            ends.clear()
        return out[::-1]

    def named_piece(self, piece: str) -> str:
        known = self.pieces.get(piece)
        if known is None:
            known = " ".join(map(str, self.piece(piece.encode())))
            if len(piece) <= _LONG:
                if len(self.pieces) >= self.remember:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def named_ids(self, text: str) -> str:
        """Decimal ids of a whole text, joined by one space.

        A space with no white space behind it always starts a match of the
        pattern, so texts can be cut there and equal cuts looked up at once."""
        if not text:
            return ""
        if _SPACED.search(text):
            return " ".join(map(self.named_piece, self.split.findall(text)))
        first, *rest = text.split(" ")
        found = map(self.chunks.__getitem__, rest)
        return " ".join([" ".join(map(self.named_piece, self.split.findall(first))), *found] if first else found)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.named_ids(text).split(" ")] if text else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))

    def decode_named(self, ids: str) -> bytes:
        return b"".join(map(self.named.__getitem__, ids.split(" "))) if ids else b""


class _Chunks(dict):
    """From what follows a space, up to the next space, to decimal ids."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, rest: str) -> str:
        bpe = self.bpe
        named = " ".join(map(bpe.named_piece, bpe.split.findall(" " + rest)))
        if len(rest) <= _LONG:
            if len(self) >= bpe.remember:
                self.clear()
            self[rest] = named
        return named


class EncodedText:
    """A text kept with its pieces, so that appends and edits re-encode little."""

    def __init__(self, bpe: ByteBPE, text: str = ""):
        self.bpe, self.text, self.pieces = bpe, "", []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of characters ``start`` to ``end``.  Returns how many
        pieces were encoded anew."""
        old, shift = self.pieces, len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        at, keep = 0, 0
        # A piece can depend on one character behind it, so the piece that touches the edit goes too.
        while keep < len(old) and at + len(old[keep][0]) < start:
            at += len(old[keep][0])
            keep += 1
        keep = max(0, keep - 1)
        at = sum(len(p) for p, _ in old[:keep])
        begins, pos = {}, 0
        for i, (p, _) in enumerate(old):
            if pos >= end:
                begins[pos + shift] = i
            pos += len(p)
        fresh, rest = [], []
        for m in self.bpe.split.finditer(self.text, at):
            if m.start() in begins and m.start() > start + len(new):
                rest = old[begins[m.start()] :]
                break
            fresh.append((m.group(), self.bpe.piece(m.group().encode())))
        self.pieces = old[:keep] + fresh + rest
        return len(fresh)

    def tokens(self) -> list[int]:
        return [t for _, ids in self.pieces for t in ids]


_ENCODERS: dict[tuple[str, str], ByteBPE] = {}


def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder per worker process, vocabulary and pattern."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_column(df: DataFrame, text: str, out: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with an array of token ids in column ``out`` (which is replaced if
    it exists); a null text has no tokens.  Repeated rows each get theirs, an empty
    table stays empty, and Spark bounds what a batch of texts holds."""
    path, pattern = (path or default_vocabulary()[0]), (pattern or default_vocabulary()[1])

    @F.pandas_udf("array<int>")
    def ids(texts):
        bpe = encoder(path, pattern)
        return texts.map(lambda t: bpe.encode(t or ""))

    return df.withColumn(out, ids(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def encode_and_decode(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Encode each whole text, decode the ids, and return per row ``doc_id``,
    ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space) and
    ``decoded_sha256`` (of the decoded bytes), both in lower-case hex.

    Needs no shuffle.  A null text is an empty one: no tokens, both digests those
    of no bytes.  A null key stays null, repeated rows each give a row, an empty
    table gives an empty one, and other columns are ignored."""
    path, pattern = (path or default_vocabulary()[0]), (pattern or default_vocabulary()[1])
    sha = hashlib.sha256

    def run(batches):
        bpe = encoder(path, pattern)
        for b in batches:
            n, ids, back = [], [], []
            for text in b.column(1).to_pylist():
                named = bpe.named_ids(text)
                n.append(named.count(" ") + 1 if named else 0)
                ids.append(sha(named.encode()).hexdigest())
                back.append(sha(bpe.decode_named(named)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
