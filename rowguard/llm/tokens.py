"""Token ids of whole texts by a tokenizers file, one library call per new word.

The vocabulary splits at white space and merges never cross it, so the ids of
a text are those of its words in order. Each Python worker keeps the words it
has met, up to a bound, and asks the library only for others. Words are found
in a slice of texts, hashed and looked up as arrays.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from .common import kept

WORD_BPE = "word_bpe_49k.json"
CACHED_WORDS = 600_000

_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]*\Z")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself if printable, else the next free one from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_alphabet()


def letters(piece: str) -> str:
    """The UTF-8 bytes of `piece` in the byte-level alphabet."""
    return piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(_LETTERS)


def split_words(text: str) -> list[str]:
    """Words between single blanks and line ends, empty ones too; any other white space stays inside."""
    return text.replace("\n", " ").split(" ")


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1, modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class WordEncoder:
    """Ids of words, kept under two 64-bit hashes of their bytes in an open table.

    Words of over LONGEST bytes, for which such hashes can be made to meet, are
    not kept.
    """

    BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
    ROOTS = tuple(pow(b, -1, 2**64) for b in BASES)
    LONGEST = 64

    def __init__(self, path: str | None = None, most: int = CACHED_WORDS):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(WORD_BPE))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self.most = most
        self.bits = max(8, (2 * most).bit_length())
        self.place = np.zeros(1 << self.bits, np.int32)  # the number of the word that is there plus 1
        self.pieces: dict[str, list[int]] = {}
        self.tables = [(powers(b, 1), powers(r, 1)) for b, r in zip(self.BASES, self.ROOTS)]
        self.clear()

    def clear(self) -> None:
        self.place[:] = 0
        self.n = 0
        self.keys = [np.zeros(self.most + 1, np.uint64) for _ in self.BASES]
        self.seen = np.zeros(self.most + 1, np.int64)
        self.starts, self.ids = array("q", [0]), array("I")

    def forget(self) -> None:
        """Keep only words that came again, and no more than half of the bound."""
        kept = np.flatnonzero(self.seen[: self.n] > 1)[: self.most // 2]
        one, two = self.keys[0][kept], self.keys[1][kept]
        starts, ids = np.array(self.starts), np.array(self.ids)
        length = starts[kept + 1] - starts[kept]
        take = np.repeat(starts[kept] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        self.clear()
        self.put(one, two, ids[take], length)

    def put(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Add words that are not there."""
        number = np.arange(self.n, self.n + len(one))
        self.keys[0][number], self.keys[1][number] = one, two
        slot, mask = (one >> np.uint64(64 - self.bits)).astype(np.int64), len(self.place) - 1
        while len(number):
            free = self.place[slot] == 0
            self.place[slot[free]] = number[free] + 1
            lost = self.place[slot] != number + 1
            number, slot = number[lost], (slot[lost] + 1) & mask
        self.n += len(one)
        self.starts.frombytes((len(self.ids) + np.cumsum(length)).astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for those that are not there."""
        out = np.full(len(one), -1, np.int64)
        left, slot, mask = np.arange(len(one)), (one >> np.uint64(64 - self.bits)).astype(np.int64), len(self.place) - 1
        while len(left):
            number = self.place[slot] - 1
            full = number >= 0
            left, slot, number = left[full], slot[full], number[full]
            same = (self.keys[0][number] == one[left]) & (self.keys[1][number] == two[left])
            out[left[same]] = number[same]
            left, slot = left[~same], (slot[~same] + 1) & mask
        return out

    def hashes(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        out = []
        with np.errstate(over="ignore"):
            for i, (up, down) in enumerate(self.tables):
                if len(up) <= len(raw):
                    up, down = self.tables[i] = powers(self.BASES[i], len(raw) + len(raw) // 8), powers(self.ROOTS[i], len(raw) + len(raw) // 8)
                sums = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
                h = (sums[end] - sums[start]) * down[start]
                out.append((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9))
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of what the pre-tokeniser leaves whole, in lower case."""
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.most // 5:
                self.pieces.clear()
            ids = self.pieces[piece] = [t.id for t in self.model.tokenize(piece if piece.isascii() else letters(piece))]
        return ids

    def encode_word(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            return self.encode_piece(word.lower())
        stem = word[:-1]
        if word[-1] in ".," and stem.isascii() and stem.isalpha():
            return self.encode_piece(stem.lower()) + self.encode_piece(word[-1])
        if not _PLAIN.match(word) or self.has_special(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [i for piece in _PIECES.findall(word.lower()) for i in self.encode_piece(piece)]

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; `end` is appended to each."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts = [t.encode("utf-8", "replace") for t in texts]
        buffer = b"\n".join(parts) + b"\n"
        raw = np.frombuffer(buffer, np.uint8)
        edge = np.diff(((raw != 32) & (raw != 10)).astype(np.int8), prepend=0)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
        per_text = np.diff(np.searchsorted(start, bounds))
        if self.n + len(start) > self.most:
            self.forget()
        one, two = self.hashes(raw, start, stop)
        number = self.find(one, two)
        kinds, loose = self.unknown(number, one, two, stop - start)
        ids_of = lambda at: [self.encode_word(buffer[a:b].decode()) for a, b in zip(start[at].tolist(), stop[at].tolist())]
        new = ids_of(kinds)
        self.put(one[kinds], two[kinds], np.fromiter(chain.from_iterable(new), np.uint32), np.fromiter(map(len, new), np.int64, len(new)))
        extra = ids_of(loose)
        missing = np.flatnonzero(number < 0)
        number[missing] = self.find(one[missing], two[missing])
        starts, ids = np.frombuffer(self.starts, np.int64), np.frombuffer(self.ids, np.uint32)
        known = number >= 0
        self.seen[: self.n] += np.bincount(number[known], minlength=self.n)
        first, length = starts[number], starts[number + 1] - starts[number]
        if extra:
            length[loose] = np.fromiter(map(len, extra), np.int64, len(extra))
            first[loose] = len(ids) + np.cumsum(length[loose]) - length[loose]
            ids = np.append(ids, np.fromiter(chain.from_iterable(extra), np.uint32))
        before = np.cumsum(length) - length
        take = np.repeat(first - before, length)
        take += np.arange(len(take))
        out = ids[take]
        del starts, ids  # else the arrays cannot grow
        ends = np.append(0, np.cumsum(length))[np.cumsum(per_text)]
        sizes = np.diff(ends, prepend=0)
        if end is None:
            return out, sizes
        return np.insert(out, ends, np.uint32(end)), sizes + 1

    def unknown(self, number: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where there are words to encode and keep, one of each kind, and words to encode each: long ones.

        Each of them, and none is kept, if the table can't take all kinds.
        """
        missing = np.flatnonzero(number < 0)
        short = missing[size[missing] <= self.LONGEST]
        kinds = short[np.unique(one[short] ^ (two[short] * np.uint64(3)), return_index=True)[1]]
        if self.n + len(kinds) > self.most:
            return missing[:0], missing
        return kinds, missing[size[missing] > self.LONGEST]


def encoder(path: str | None = None) -> WordEncoder:
    """This Python worker's encoder for a tokenizers file."""
    return kept("encoder", path, lambda: WordEncoder(path))
