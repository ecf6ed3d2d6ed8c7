"""Token counts: how many tokens each prefix of a text has, by dynamic programming.

A byte-pair encoding of a word is the one sequence of tokens whose neighbours
all stand when encoded together, and cutting it at a token leaves the encoding
of what is before. So for each prefix the last token, and with it the count,
follows from those of shorter prefixes:

    open(i)   = open(i - |t|) + 1     t the one token that ends at i and stands next to
                                      the last token of open(i - |t|)
    closed(i) = open(i - |t|) + 1     the same with a token that ends a word

``closed(i)`` is what the library counts for the first i letters as a text of
their own. Counts of whole words before are added. The table of a document
holds the change of the count at each code point, so that the count of any
prefix, and the longest prefix within a budget, are sums over it.

Null and empty texts have no tokens and an empty table. Repeated rows give
repeated results; other columns of the input are neither read nor returned.
What the normaliser takes for a blank parts words. Where normalising puts letters
together or apart, counts are taken over what it makes of each group of letters
that go together; prefixes that end within a group are branches of the same
table. A special token counts as one where it is whole. So the work grows with
the length of a text, whatever is in it.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from .common import keep_only, kept, slices, texts_of
from .tokens import _PIECES, _PLAIN, WordEncoder, letters, split_words

CACHED_WORDS = 900_000
CACHED_PREFIXES = 1_200_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, width int, changes binary"


def sizes_by_tail(tokens: frozenset[str]) -> dict[str, tuple[int, ...]]:
    """Which lengths tokens have that end in the same three letters, and the lengths below."""
    out: dict[str, set[int]] = {}
    for token in tokens:
        if len(token) > 2:
            out.setdefault(token[-3:], set()).add(len(token))
    return {tail: (*sorted(sizes, reverse=True), 2, 1) for tail, sizes in out.items()}


@cache
def _joining() -> frozenset[str]:
    """Characters that normalising may put together with what is before: marks, second parts of composed letters, Hangul vowels and finals."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for code in range(0x110000):
        char = chr(code)
        if unicodedata.combining(char):
            out.add(char)
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def groups_of_letters(word: str) -> list[str]:
    """The word in groups that are normalised apart from each other."""
    if word.isascii():
        return list(word)
    joining, out = _joining(), []
    starts = [i for i, c in enumerate(word) if not i or c not in joining]
    for a, b in zip(starts, [*starts[1:], len(word)]):
        out.append(word[a:b])
    return out


def spread(sizes: Iterable[int]) -> list[int]:
    """Where each piece starts."""
    return [0, *accumulate(sizes)]


class PrefixCounter(dict):
    """word -> one signed byte for each code point: the change of the count there."""

    WIDE = b"\x80"  # stands for every code point of a word with a change beyond a byte

    def __init__(self, path: str | None = None):
        super().__init__()
        own = WordEncoder(path)
        self.tokenizer, self.model, self.has_special = own.tokenizer, own.model, own.has_special
        self.vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.end = self.model.end_of_word_suffix or ""
        self.longest = max(map(len, self.vocab))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.loads(self.tokenizer.to_str())["model"]["merges"]]
        self.inner = BPE(vocab=self.vocab, merges=merges)
        added = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        cores = frozenset(t.removesuffix(self.end) for t in self.vocab if self.end and t.endswith(self.end)) if self.end else frozenset(self.vocab)
        self.tokens = frozenset(self.vocab), cores
        self.sizes = tuple(map(sizes_by_tail, self.tokens))
        self.stands: tuple[dict, dict] = {}, {}
        self.states: dict[str, tuple] = {}
        self.kinds: dict[str, tuple] = {}
        self.old: dict[str, bytes] = {}
        self.wide: dict[str, np.ndarray] = {}

    def pair(self, key: tuple[str, str], last: bool) -> bool:
        """Whether a token (that ends a word, if `last`) stands next to the one on its left ("": starts the word)."""
        left, right = key
        if len(self.stands[last]) > 2 * CACHED_PREFIXES:
            self.stands[last].clear()
        got = (self.model if last else self.inner).tokenize(left + right)
        known = [t.value for t in got] == [left] * bool(left) + [right + self.end * last]
        self.stands[last][key] = known
        return known

    def state(self, s: str, states: list[tuple]) -> tuple[str, int, int]:
        """For the prefix `s`: its last token and count within a word, and its count as a whole word."""
        n, tail, found = len(s), s[-3:], []
        for last in (False, True):
            tokens, stands = self.tokens[last], self.stands[last]
            for size in self.sizes[last].get(tail, (2, 1)):
                if size > n:
                    continue
                token = s[n - size :]
                if token in tokens:
                    before = states[n - size]
                    key = before[0], token
                    known = stands.get(key)
                    if self.pair(key, last) if known is None else known:
                        found += [token, before[1] + 1]
                        break
            else:
                raise ValueError(f"no token ends {s!r}")
        return found[0], found[1], found[3]

    def run(self, s: str, states: list[tuple] | None = None) -> list[int]:
        """closed(i) for i = 1..len(s), `s` being one pre-token in the byte alphabet; `states`, if given, gets the state of each prefix."""
        states, out, seen = [] if states is None else states, [], self.states
        states.append(("", 0, 0))
        for i in range(1, len(s) + 1):
            if i <= 32:
                part = s[:i]
                state = seen.get(part)
                if state is None:
                    state = seen[part] = self.state(part, states)
            else:
                state = self.state(s[max(0, i - self.longest) : i], states[max(0, i - self.longest) :])
            states.append(state)
            out.append(state[2])
        if len(seen) > CACHED_PREFIXES:
            seen.clear()
        return out

    def kind(self, char: str) -> tuple[str, str]:
        """What the library's normaliser and pre-tokeniser make of a character: (form, L, N, P, or ? if it differs in length)."""
        if (known := self.kinds.get(char)) is None:
            form = self.tokenizer.normalizer.normalize_str(char)
            kind = "?"
            if len(form) == 1 and form != " ":
                cut = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
                kind = "L" if cut(f"a{form}a") == 1 else "N" if cut(form * 2) == 2 else "P"
            known = self.kinds[char] = form, kind
        return known

    def counts(self, word: str) -> list[int]:
        """The count of tokens of each prefix of `word`."""
        out, start = [], 0
        for i, char in enumerate(word + " "):
            if i == len(word) or self.kind(char)[0] == " ":
                base = out[-1] if out else 0
                out += [base + c for c in self.between_blanks(word[start:i])]
                out += [out[-1] if out else 0] * (i < len(word))
                start = i + 1
        return out

    def between_blanks(self, word: str) -> list[int]:
        out, start = [], 0
        for match in self.specials.finditer(word) if self.has_special(word) else ():
            base = out[-1] if out else 0
            own = self.between_specials(word[start : match.end() - 1])
            before = match.start() - start
            out += [base + c for c in own] + [base + (own[before - 1] if before else 0) + 1]
            start = match.end()
        base = out[-1] if out else 0
        return out + [base + c for c in self.between_specials(word[start:])]

    def between_specials(self, word: str) -> list[int]:
        groups = groups_of_letters(word)
        forms = [self.form(g) for g in groups]
        form = "".join(forms)
        after, branches = spread(map(len, forms)), {}
        for group, at in zip(groups, after):
            if len(group) > 1:
                branches.setdefault(at, []).extend(self.form(group[:k]) for k in range(1, len(group)))
        known, branched = self.of_form(form, branches)
        out: list[int] = []
        for group, own, at in zip(groups, forms, after):
            out += branched.get(at, []) if len(group) > 1 else []
            out.append(known[at + len(own)])
        return out

    def form(self, group: str) -> str:
        """What the normaliser makes of letters that go together."""
        return self.kind(group)[0] if len(group) == 1 else self.tokenizer.normalizer.normalize_str(group)

    def of_form(self, form: str, branches: dict[int, list[str]]) -> tuple[list[int], dict[int, list[int]]]:
        """Of normalised text: the counts of its prefixes from the empty one on, and of those that go on otherwise at some places."""
        kinds = [self.kind(c)[1] for c in form]
        known, branched, i, quote = [0], {}, 0, False  # quote: whether all that is before i since the last pre-token is a quote
        if 0 in branches:
            branched[0] = [self.library(b) for b in branches[0]]
        while i < len(form):
            kind, j, base = kinds[i], i + 1, known[-1]
            size = next((len(c) for c in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d") if form.startswith(c, i)), 0)  # fixed values of the vocabulary's pattern
            states: list[tuple] = []
            if size:
                j = i + size
                own = [self.library(form[i : i + k]) for k in range(1, size + 1)]
            else:
                while kind != "N" and j < len(form) and kinds[j] == kind:
                    j += 1
                ends = list(accumulate(len(c.encode()) for c in form[i:j]))
                spelt = letters(form[i:j])
                run = self.run(spelt, states)
                own = [run[e - 1] for e in ends]
            known += [base + c for c in own]
            for at in range(i + 1, j + 1):
                if at in branches:
                    if at - i <= 64:
                        first = i - quote  # with what goes on otherwise it may be a contraction
                        branched[at] = [known[first] + self.library(form[first:at] + b) for b in branches[at]]
                    else:
                        end = ends[at - i - 1]
                        branched[at] = [base + self.branch(spelt[max(0, end - self.longest) : end], states[max(0, end - self.longest) : end + 1], own[at - i - 1], kind, b) for b in branches[at]]
            quote = form[i:j] == "'"
            i = j
        return known, branched

    def branch(self, spelt: str, states: list[tuple], count: int, kind: str, more: str) -> int:
        """The count of a long pre-token, of whose end `spelt` and `states` tell, that goes on with `more`."""
        same = next((k for k, c in enumerate(more) if self.kind(c)[1] != kind), len(more)) if kind != "N" else 0
        states = list(states)
        for letter in letters(more[:same]):
            spelt += letter
            states.append(self.state(spelt[-self.longest :], states[-min(len(spelt), self.longest) :]))
        return (states[-1][2] if same else count) + self.library(more[same:])

    def library(self, form: str) -> int:
        return len(self.tokenizer.encode(form, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.changes(word)
        self[word] = out
        return out

    def changes(self, word: str) -> bytes:
        if word[-1:] in ".," and word[:-1].isascii() and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1]] if len(word) <= 127 else self.packed(word, self.counts(word))
        if _PLAIN.match(word) and not self.has_special(word):
            pieces = _PIECES.findall(word.lower())
            if pieces != [word]:  # each piece starts from the count before it
                return b"".join([self[p] for p in pieces]) if len(word) <= 127 else self.packed(word, self.counts(word))
            own = letters(word)
            counts = self.run(own)
            if len(own) != len(word):
                counts = [counts[e - 1] for e in accumulate(len(c.encode()) for c in word)]
        else:
            counts = self.counts(word)
        return self.packed(word, counts)

    def packed(self, word: str, counts: list[int]) -> bytes:
        changes = [b - a for a, b in zip([0] + counts, counts)]
        if changes and max(map(abs, changes)) > 127:
            self.wide[word] = np.array(changes, "<i4")
            return self.WIDE * len(word)
        return bytes([c & 255 for c in changes])

    def table(self, text: str) -> tuple[int, bytes]:
        """Bytes for each code point (1 or 4), and the changes of the count."""
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
            self.wide = {w: c for w, c in self.wide.items() if w in self.old}
        if not text:
            return 1, b""
        words = split_words(text)
        out = b"\0".join(map(self.__getitem__, words))
        if self.WIDE not in out:
            return 1, out
        blank = np.zeros(1, "<i4")
        parts = [p for w in words for p in (self.wide.get(w, np.frombuffer(self[w], np.int8).astype("<i4")), blank)]
        return 4, np.concatenate(parts[:-1]).tobytes()


def changes_of(width: int, changes: bytes) -> np.ndarray:
    return np.frombuffer(changes, np.int8 if width == 1 else "<i4").astype(np.int64)


def count_at(width: int, changes: bytes, n_chars: int) -> int:
    """Tokens of the first `n_chars` code points as a text of their own."""
    return int(changes_of(width, changes)[:n_chars].sum())


def longest_within(width: int, changes: bytes, budget: int) -> int:
    """Code points of the longest prefix that has at most `budget` tokens."""
    fits = np.flatnonzero(np.cumsum(changes_of(width, changes)) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and the prefix table (width, changes) of each document. Nothing is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables hold no cycles
        keep_only("counter")
        counter = kept("counter", vocabulary, lambda: PrefixCounter(vocabulary))
        for batch in slices(batches, "text"):
            tables = [counter.table(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([int(np.frombuffer(c, np.int8 if w == 1 else "<i4").sum(dtype=np.int64)) for w, c in tables], pa.int64()),
                    pa.array([w for w, _ in tables], pa.int32()),
                    pa.array([c for _, c in tables], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "width", "changes"],
            )

    own = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return own.mapInArrow(count, SCHEMA)


def over_limit(n_tokens: Column, limit: int = 2048) -> Column:
    return n_tokens > limit
