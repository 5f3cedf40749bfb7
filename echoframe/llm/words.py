"""Token ids of whole texts by a public word-level tokenizer, looked up by word.

The tokenizer drops white space and never joins what white space parts, so the
ids of a text are those of its words one after another.  Arrow splits a batch of
texts and numbers its distinct words; only those are looked up, and their ids
are then spread over the batch by place.  Each worker remembers the ids of words
and of runs of letters, within a bound, and asks the tokenizer for the others."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: White space to Python, but a symbol to the tokenizer, or unlike in the two.
_UNLIKE = "[\x1c-\x1f\x85᠎​-‏⁠﻿]"
_LONG = 64
_BATCH_BYTES = 1 << 23

#: Texts and words of these characters alone are taken apart here, as the tokenizer
#: does it: they have no other normal form, and each has one lower-case form.
_SIMPLE = r"^[\t-\r -~À-ÖØ-öø-ÿ]*$"
#: The tokenizer's own parts besides runs of letters, in lower case.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9ß-öø-ÿ]+"


def default_words() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def text_slices(texts: pa.Array, most: int = _BATCH_BYTES):
    """(first, count) of slices of an array of texts that hold about ``most`` bytes
    or one text."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(sizes):
        before = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield at, end - at
        at = end


#: Words whose hashes a worker remembers, some 20 MB.
MOST_HASHES = 100_000
_HASHES: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; a bounded number is remembered in each worker."""
    known, h = _HASHES, xxhash.xxh3_64_intdigest
    if len(known) > MOST_HASHES:
        known.clear()
    found = list(map(known.get, words))
    for i in [i for i, x in enumerate(found) if x is None]:
        found[i] = h(words[i])
        if len(words[i]) <= _LONG:
            known[words[i]] = found[i]
    return np.array(found, np.uint64)


def hashed_words(texts: pa.Array, case: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, words being what ASCII white space
    parts, and where each text's begin (one more bound than texts); with
    ``case`` "lower", of the words with A to Z in lower case.  Null texts have none.

    Distinct words are put in lower case, not texts: Arrow's ``ascii_lower`` gives
    wrong bytes for a slice that was cast, as its first offset is not zero."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    kinds = coded.dictionary
    if len(kinds) == 0:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    words = kinds.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = word_hashes([w.lower() for w in words] if case == "lower" else words)
    place = np.asarray(coded.indices)
    offsets = np.asarray(split.offsets, np.int64)
    bounds = offsets - offsets[0]
    none = pc.index(kinds, "").as_py()  # before white space at a text's beginning, and behind it
    if none < 0:
        return hashes[place], bounds
    word = place != none
    return hashes[place[word]], np.concatenate([[0], np.cumsum(word)])[bounds]


class _Recent:
    """What was looked up lately, by two generations of at most ``most`` entries."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, keys: list[str]) -> list[bytes | None]:
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        if old:
            for i in [i for i, x in enumerate(found) if x is None]:
                if (x := old.get(keys[i])) is not None:
                    found[i] = young[keys[i]] = x
        return found

    def add(self, keys: list[str], values: list[bytes]) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        self.young.update((k, v) for k, v in zip(keys, values) if len(k) <= _LONG)


class WordIds:
    """Ids as unsigned 32-bit integers."""

    def __init__(self, path: str, remember: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.largest = max(vocabulary.values(), default=0)
        self.ends = np.zeros(self.largest + 1, bool)  # the tokens that end a run of letters
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.parts = _Recent(remember), _Recent(remember)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of single parts.  Runs of letters go to the tokenizer many at a time,
        as one text: each ends with its only token that can end a word."""
        out: dict[str, bytes] = {}
        letters = [r for r in parts if r[:1].isalpha() and len(r) <= _LONG]
        for lo in range(0, len(letters), 4096):
            some = letters[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                out.update(zip(some, _cut(ids, stops)))
        rest = [r for r in parts if r not in out]
        out.update(zip(rest, self._whole(rest)))
        return [out[r] for r in parts]

    def _simple(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parted = pc.replace_substring_regex(pc.utf8_lower(texts), _PARTS, r" \0 ")
        return _spread(pc.ascii_split_whitespace(parted), self.parts, self._of_parts)

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of single words: of their parts, or of the whole word if it is odd."""
        column = pa.array(words, pa.large_string())
        simple = pc.match_substring_regex(column, _SIMPLE)
        ids, bounds = self._simple(column.filter(simple))
        easy = iter(_cut(ids, bounds[1:]))
        odd = iter(self._whole(column.filter(pc.invert(simple)).to_pylist()))
        return [next(easy if s else odd) for s in simple.to_pylist()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more
        bound than texts).  Null texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        simple = np.asarray(pc.match_substring_regex(texts, _SIMPLE))
        if simple.all():
            return self._simple(texts)
        whole = np.asarray(pc.match_substring_regex(texts, _UNLIKE))
        worded = ~simple & ~whole
        found = [
            (np.flatnonzero(simple), *self._simple(texts.filter(pa.array(simple)))),
            (np.flatnonzero(worded), *_spread(pc.utf8_split_whitespace(texts.filter(pa.array(worded))), self.words, self._of_words)),
        ]
        pieces: list = [None] * len(texts)
        for rows, ids, bounds in found:
            for i, a, b in zip(rows.tolist(), bounds.tolist(), bounds[1:].tolist()):
                pieces[i] = ids[a:b]
        rows = np.flatnonzero(whole & ~simple)
        for i, x in zip(rows.tolist(), self._whole(texts.take(pa.array(rows)).to_pylist())):
            pieces[i] = np.frombuffer(x, "<u4")
        return np.concatenate(pieces), np.cumsum([0, *map(len, pieces)])


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _cut(ids: np.ndarray, stops: np.ndarray) -> list[bytes]:
    raw, at, out = ids.tobytes(), 0, []
    for stop in (4 * stops).tolist():
        out.append(raw[at:stop])
        at = stop
    return out


def _spread(split: pa.Array, known: _Recent, ask) -> tuple[np.ndarray, np.ndarray]:
    """The ids of lists of strings, and where each list's begin.  Every distinct
    string is looked up once; those that are not ``known`` are ``ask``ed for."""
    coded = split.flatten().dictionary_encode()
    kinds, place = _strings(coded.dictionary), np.asarray(coded.indices)
    ids_of = known.get(kinds)
    new = [i for i, x in enumerate(ids_of) if x is None]
    if new:
        asked = [kinds[i] for i in new]
        found = ask(asked)
        for i, x in zip(new, found):
            ids_of[i] = x
        known.add(asked, found)
    sizes = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) >> 2
    held = np.frombuffer(b"".join(ids_of), "<u4")
    first = np.cumsum(sizes) - sizes
    size = sizes[place]
    before = np.concatenate([[0], np.cumsum(size)])
    ids = held[np.repeat(first[place] - before[:-1], size) + np.arange(before[-1])]
    offsets = np.asarray(split.offsets, np.int64)
    return ids, before[offsets - offsets[0]]


_BY_PATH: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process and file."""
    if path not in _BY_PATH:
        _BY_PATH[path] = WordIds(path)
    return _BY_PATH[path]
