"""Pieces of public vocabularies for whole texts, found once for each distinct word and kept in a bounded cache."""

from __future__ import annotations

import json
import os
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import regex

#: Words kept by one cache; beyond it, the cache starts anew.
CACHE_WORDS = 300_000
#: Words with one of these go the long way. Without, NFC changes nothing, lower case goes by character, and no character
#: is white space to one library and not to the other; nor is there a special token.
_ODD = regex.compile(r"[^\n\x21-\x7e\u00a1-\u012f\u0131-\u024f]|<\|")

#: Ids of several keys in a row, and how many each has.
Rows = tuple[np.ndarray, np.ndarray]


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """An object that this Python worker keeps for its next tasks."""
    store = sys.modules.setdefault("_sievewright_kept", types.ModuleType("_sievewright_kept"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


class PairMerges:
    """Byte-pair merges of a vocabulary, applied to many parts of words at a time.

    Of a part's neighbours the pair of the least rank merges, the leftmost of equals, until no pair is left. Parts of
    one length make a matrix: every step merges one pair in each row, so all rows shrink alike.
    """

    NONE = np.int32(1 << 30)

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint64)
        self.keys, first = np.unique(keys, return_index=True)
        self.rank = first.astype(np.int32)
        self.new = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)[first]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int32)
        # Two tables of places in keys; what collides in the first is in the second.
        self.bits, self.factors, self.tables = 20, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), []
        left = np.arange(len(self.keys))
        for i in range(2):
            slots = self._slots(self.keys[left], i)
            table = np.zeros(1 << self.bits, dtype=np.int32)
            table[slots] = left
            self.tables.append(table)
            left = left[table[slots] != left]
        self.rest = {int(self.keys[i]): int(i) for i in left}

    def _slots(self, keys: np.ndarray, i: int) -> np.ndarray:
        return (keys * np.uint64(self.factors[i])) >> np.uint64(64 - self.bits)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; NONE where they don't merge."""
        keys = a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)
        at = self.tables[0][self._slots(keys, 0)]
        missed = self.keys[at] != keys
        at = np.where(missed, self.tables[1][self._slots(keys, 1)], at)
        if self.rest:
            for k, i in self.rest.items():
                at[keys == np.uint64(k)] = i
        return np.where(self.keys[at] == keys, self.rank[at], self.NONE), self.new[at]

    def apply(self, parts: list[bytes]) -> Rows:
        """The ids of every part."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        count, done = np.zeros(len(parts), dtype=np.int64), []
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            codes = np.frombuffer(b"".join([parts[i] for i in at]), dtype=np.uint8).reshape(len(at), n)
            ids = self.inner[codes]
            ids[:, -1] = self.last[codes[:, -1]]
            for rows, found in self._merged(ids):
                count[at[rows]] = found.shape[1]
                done.append((at[rows], found))
        start = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), dtype=np.int32)
        for at, found in done:
            flat[start[at][:, None] + np.arange(found.shape[1])] = found
        return flat, count

    def _merged(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows that are done, with their ids."""
        rows = np.arange(len(ids))
        rank, new = self.find(ids[:, :-1], ids[:, 1:])
        while len(rows):
            width = ids.shape[1]
            if width == 1:
                yield rows, ids
                return
            j = rank.argmin(axis=1)
            here = np.arange(len(rows))
            live = rank[here, j] < self.NONE
            if not live.all():
                yield rows[~live], ids[~live]
                rows, ids, rank, new, j = rows[live], ids[live], rank[live], new[live], j[live]
                here = here[: len(rows)]
                if not len(rows):
                    return
            merged = new[here, j]
            columns = np.arange(width - 1)
            ids = np.where(columns > j[:, None], ids[:, 1:], ids[:, :-1])
            ids[here, j] = merged
            columns = columns[:-1]
            after = columns >= j[:, None]
            rank, new = np.where(after, rank[:, 1:], rank[:, :-1]), np.where(after, new[:, 1:], new[:, :-1])
            if width == 2:
                continue
            for side in (j - 1, j):  # the pairs that the merged one is in now
                ok = np.flatnonzero((side >= 0) & (side < width - 2))
                k = side[ok]
                rank[ok, k], new[ok, k] = self.find(ids[ok, k], ids[ok, k + 1])


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + hidden.index(b)) for b in range(256)]


#: Longer parts of words are left to the library.
PART_CHARS = 32


def rows_of(lists: list[list[int]]) -> Rows:
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(count.sum())), count


class Ragged:
    """Rows of ids of any length, which grow in number."""

    def __init__(self):
        self.rows = self.used = 0
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.count = np.zeros(1 << 14, dtype=np.int64)

    def add(self, rows: Rows) -> None:
        flat, count = rows
        n, end = self.rows + len(count), self.used + len(flat)
        self.start, self.count, self.flat = _room(self.start, n), _room(self.count, n), _room(self.flat, end)
        self.start[self.rows : n] = self.used + np.cumsum(count) - count
        self.count[self.rows : n] = count
        self.flat[self.used : end] = flat
        self.rows, self.used = n, end

    def take(self, numbers: np.ndarray) -> Rows:
        """These rows one after the other, and their lengths."""
        count = self.count[numbers]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[numbers] - (ends - count), count)], count


class _Numbers(dict):
    """Numbers what it is asked for, in the order of first asking; new ones are also listed."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Cache:
    """Ids of keys, each found once; past its limit it starts anew."""

    def __init__(self, encode: Callable[[list], Rows], limit: int):
        self.encode, self.limit = encode, limit
        self.index, self.known = _Numbers(), Ragged()

    def numbers(self, keys: Iterable, n: int) -> np.ndarray:
        """Numbers of n keys, for take(); they are void after the next call."""
        if len(self.index) > self.limit:
            self.index, self.known = _Numbers(), Ragged()
        found = np.fromiter(map(self.index.__getitem__, keys), np.int64, n)
        if self.index.new:
            fresh, self.index.new = self.index.new, []
            self.known.add(self.encode(fresh))
        return found


class WordPieces(Cache):
    """Ids of words."""

    def __init__(self, encode: Callable[[list[bytes]], Rows], limit: int = CACHE_WORDS):
        super().__init__(encode, limit)

    def of_texts(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Each text's words as numbers, for ids(); they are void after the next call."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        found = self.numbers(chain.from_iterable(texts), int(lengths.sum()))
        return np.split(found, np.cumsum(lengths)[:-1]) if len(texts) else []

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these words in a row."""
        return self.known.take(numbers)[0]


def word_encoder(path: str, limit: int = CACHE_WORDS) -> Callable[[list[bytes]], Rows]:
    """Ids of each word, as the tokenizers library gives them; limit: the parts of words that are kept.

    White space always ends a piece of these vocabularies, so the ids of a text are those of its words in a row. The
    library takes much longer for single words than their merges need; for plain words its pattern and merges are
    applied here, to all new words at once. Other words go to the library itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    model = stored["model"]
    merges = PairMerges(model["vocab"], model["merges"], model["end_of_word_suffix"])
    split = regex.compile(stored["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n").findall

    def library(words: Iterable[str]) -> Rows:
        return rows_of([tokenizer.encode(w, add_special_tokens=False).ids for w in words])

    def encode_parts(parts: list[str]) -> Rows:
        short = [p for p in parts if len(p) <= PART_CHARS]
        if len(short) == len(parts):
            return merges.apply([p.encode() for p in parts])
        return joined(np.array([len(p) <= PART_CHARS for p in parts]), encode_parts(short), library(p for p in parts if len(p) > PART_CHARS))

    parts = Cache(encode_parts, limit)

    def encode(words: list[bytes]) -> Rows:
        texts = b"\n".join(words).decode("utf-8", "replace")
        if _ODD.search(texts):
            each = texts.split("\n")
            plain = np.array([not _ODD.search(w) for w in each])
            rest = library(w for w, p in zip(each, plain) if not p)
            if not plain.any():
                return rest
            return joined(plain, encode([w for w, p in zip(words, plain) if p]), rest)
        found = split(texts.lower())
        found.append("\n")
        # The numbers of all parts; a line end closes a word and has no ids.
        numbers = parts.numbers(found, len(found))
        ends = np.flatnonzero(numbers == numbers[-1])
        inner = np.ones(len(numbers), dtype=bool)
        inner[ends] = False
        flat, count = parts.known.take(numbers[inner])
        upto = np.concatenate([[0], np.cumsum(count)])
        return flat, np.diff(upto[ends - np.arange(len(ends))], prepend=0)

    return encode


def joined(first: np.ndarray, yes: Rows, no: Rows) -> Rows:
    """Rows of two tables in one order: first tells of which each is."""
    both, place = Ragged(), np.empty(len(first), dtype=np.int64)
    both.add(yes)
    both.add(no)
    place[first] = np.arange(first.sum())
    place[~first] = first.sum() + np.arange((~first).sum())
    return both.take(place)


def piece_encoder(path: str) -> Callable[[list[bytes]], Rows]:
    """Ids of each word, by the sentencepiece library."""
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)
    return lambda words: rows_of(processor.encode([w.decode("utf-8", "replace") for w in words], num_threads=1))


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out
