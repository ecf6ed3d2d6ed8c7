"""License scan by patience alignment.

A text is read as words. Where a rare word of a template stands, the stretch
that the template would take there, and a quarter more, is aligned with it, and
where that does not agree in full, again with less and less around it:
words that both have exactly once are anchors, the longest increasing
subsequence of the anchors is kept, and the gaps between them are aligned the
same way, down to equal words at the ends of a gap. The share of the
template's words that find a partner is its coverage; from `least` on it is
found. Of those that overlap, the one stays whose words and the stretch's
agree best, of equals the template that comes first, then the earlier place.

No occurrence is missed by looking at rare words only: at most a share of
1 - `least` of a template's words may be missing, and one more than that many
of them, the longest, are looked for.

Null and empty texts hold none. Each repeated row is scanned. A template that
occurs again and again is found each time. Texts are scanned whole where they
lie, in time proportional to their length; nothing is shuffled. Only doc_id and text are
read, whatever other columns are called. An empty table has no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, slices, spans, texts_of
from .decontam import Words
from .license_texts import NOTICES


def align(a: list, b: list, pairs: list[tuple[int, int]], at_a: int = 0, at_b: int = 0) -> None:
    """Append the pairs (place in a, place in b) of a patience alignment."""
    todo = [(at_a, at_a + len(a), at_b, at_b + len(b))]
    base_a, base_b = at_a, at_b
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i - base_a] == b[k - base_b]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1 - base_a] == b[m - 1 - base_b]:
            pairs.append((j - 1, m - 1))
            j, m = j - 1, m - 1
        if i >= j or k >= m:
            continue
        of_a, of_b = Counter(a[i - base_a : j - base_a]), Counter(b[k - base_b : m - base_b])
        place_b = {w: p for p, w in enumerate(b[k - base_b : m - base_b], k) if of_b[w] == 1 and of_a[w] == 1}
        both = [(p, place_b[w]) for p, w in enumerate(a[i - base_a : j - base_a], i) if w in place_b]
        anchors = longest_rising(both)
        if not anchors:
            continue
        for (p, q), (r, s) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)]):
            todo.append((p + 1, r, q + 1, s))
        pairs += anchors


def longest_rising(both: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second members rise; the first members do already."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, q) in enumerate(both):
        pile = bisect_left(tops, q)
        before.append(ends[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [q]
        ends[pile : pile + 1] = [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(both[n])
        n = before[n]
    return out[::-1]


class Templates:
    """Words of the templates as numbers, and for each rare word where it stands in which."""

    def __init__(self, notices: dict[str, str], least: float):
        self.names, self.least = list(notices), least
        words = Words(list(notices.values()))
        self.vocabulary, first, ids = np.unique(words.hash, return_index=True, return_inverse=True)
        ends = spans(words.per_text)
        self.words = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
        size = (words.end - words.start)[first]
        self.keys: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, own in enumerate(self.words):
            missing = int((1 - least) * len(own) + 1e-9)
            left = missing + 1
            for w in sorted(set(own), key=lambda w: (-size[w], w)):
                if left <= 0:
                    break
                for place, other in enumerate(own):
                    if other == w:
                        self.keys[w].append((t, place))
                left -= 1
        self.is_key = np.zeros(len(self.vocabulary) + 1, bool)
        self.is_key[list(self.keys)] = True

    def scan(self, texts: list[str]) -> list[list[tuple]]:
        """For each text (name, first word, words, coverage) of what is found, by first word."""
        words = Words(texts)
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == words.hash, at, -1)
        first = spans(words.per_text)
        found: list[dict] = [{} for _ in texts]
        for p in np.flatnonzero(self.is_key[ids] & (ids >= 0)).tolist():
            text = int(words.text[p])
            low, high = int(first[text]), int(first[text + 1])
            for t, place in self.keys[int(ids[p])]:
                own = self.words[t]
                a = p - place
                if a >= low and a + len(own) <= high and ids[a : a + len(own)].tolist() == own:
                    found[text][(t, a, a + len(own))] = 1.0, len(own), 1.0
                    continue
                slack = len(own) // 4 + 2
                while slack >= 0:  # less and less of what stands around: of copies in a row no word is unique in the whole
                    a, b = max(low, p - place - slack), min(high, p - place + len(own) + slack)
                    slack = slack - 1 if slack <= 4 else slack // 2
                    stretch = ids[a:b].tolist()
                    if len(set(own) & set(stretch)) < self.least * len(set(own)) - (len(own) - len(set(own))):
                        break
                    pairs: list[tuple[int, int]] = []
                    align(own, stretch, pairs)
                    if len(pairs) < self.least * len(own):
                        continue
                    begin, end = min(q for _, q in pairs) + a, max(q for _, q in pairs) + a + 1
                    agree = len(pairs) / max(len(own), end - begin)
                    found[text][(t, begin, end)] = max(found[text].get((t, begin, end), (0, 0, 0)), (agree, len(pairs), len(pairs) / len(own)))
                    if agree == 1:
                        break
        out = []
        for text, own in enumerate(found):
            kept: list[tuple] = []  # by begin; none overlaps another
            for (t, begin, end), (agree, n, coverage) in sorted(own.items(), key=lambda x: (-x[1][1] * x[1][0], -x[1][0], x[0])):
                spot = bisect_left(kept, (begin,))
                if (spot == len(kept) or kept[spot][0] >= end) and (not spot or kept[spot - 1][1] <= begin):
                    kept.insert(spot, (begin, end, t, coverage))
            out.append([(self.names[t], b - int(first[text]), e - b, c) for b, e, t, c in kept])
        return out


def scan(docs: DataFrame, notices: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id and found: an array of (license, first_word, n_words, coverage), one row for each document."""
    templates = Templates(notices or NOTICES, least)
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("powers")
        for batch in slices(batches, "text", 1 << 20):
            rows = [[dict(zip(("license", "first_word", "n_words", "coverage"), f)) for f in own] for own in templates.scan(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

    schema = "doc_id long, found array<struct<license:string,first_word:long,n_words:long,coverage:double>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
