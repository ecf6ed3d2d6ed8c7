"""Tokens, token files and prefix counts against the library."""

import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowguard.llm import pfor, token_counts, tokens

ODD = [
    "", " ", "\n\n", "don't I'll we've 're ÉCOLE naïve", "<|endoftext|>x a<|startoftext|>b <|endof", "áb á", "a\x1cb \tc\xa0d\u2003e", "İstanbul ΑΣ ΣΑΣ ß ẞ", "漢字かな 한국어 ไทย",
    "12ab3 ''s ...!!'t 'll'", "a" * 300, "é" * 90, "=-" * 90, "x" * 3000 + " y", "a\0 a b\0", "😀😀 👨‍👩‍👧", "The The the THE tHe,", "€100.5%", "K ﬁ ℌ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_by_library(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    encoder = tokens.WordEncoder(most=50)  # so small that it forgets all the time
    for _ in range(2):
        ids, n = encoder.encode(ODD, end=2)
        assert ids.tolist() == [i for t in ODD for i in [*ids_by_library(library, t), 2]]
        assert n.tolist() == [len(ids_by_library(library, t)) + 1 for t in ODD]
    assert encoder.encode([])[0].tolist() == []
    one = tokens.WordEncoder()
    for t in ODD:
        assert one.encode([t])[0].tolist() == ids_by_library(library, t)


_ONE = tokens.WordEncoder(most=2000)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aZeé .,\n'x1!ßÀ|<>"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_any_text(texts):
    ids, n = _ONE.encode(texts)
    assert ids.tolist() == [i for t in texts for i in ids_by_library(_ONE.tokenizer, t)]


def test_prefix_counts_equal_the_library(library):
    counter = token_counts.PrefixCounter()
    for text in ODD:
        width, changes = counter.table(text)
        own = np.cumsum(token_counts.changes_of(width, changes)).tolist()
        step = max(1, len(text) // 60)
        assert len(own) == len(text)
        for i in range(0, len(text), step):
            assert own[i] == len(ids_by_library(library, text[: i + 1])), (text[: i + 1],)
    width, changes = counter.table("The quick brown fox, don't jump. " * 9)
    text = "The quick brown fox, don't jump. " * 9
    for budget in (0, 1, 7, 50, 10**6):
        cut = token_counts.longest_within(width, changes, budget)
        assert token_counts.count_at(width, changes, cut) <= budget
        assert all(len(ids_by_library(library, text[:k])) > budget for k in range(cut + 1, len(text) + 1))


_COUNTER = token_counts.PrefixCounter()


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("aZeéthing .,\n'sx1!ßÀ|<>漢"), max_size=40))
def test_prefix_counts_of_any_text(text):
    width, changes = _COUNTER.table(text)
    own = np.cumsum(token_counts.changes_of(width, changes)).tolist()
    assert own == [len(ids_by_library(_COUNTER.tokenizer, text[: i + 1])) for i in range(len(text))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.sampled_from([50.0, 90.0, 100.0]))
def test_blocks_come_back(values, percentile):
    v = np.array(values, np.uint32)
    chunk = pfor.pack(v, percentile)
    assert pfor.unpack(chunk).tolist() == values
    if len(v) > 256:
        assert pfor.unpack(chunk, 1, 2).tolist() == values[128:256]


def test_outliers_are_patched():
    v = np.array([7] * 2000 + [60000] * 3, np.uint32)
    assert len(pfor.pack(v)) < 600 and pfor.unpack(pfor.pack(v)).tolist() == v.tolist()
    with pytest.raises(ValueError):
        pfor.unpack(b"none" + bytes(20))


def odd_rows(spark):
    """Null, empty, very long and repeated texts, a null doc_id, and columns with the operators' own names."""
    rows = [(3, "b c"), (1, None), (2, ""), (3, "b c"), (3, "a"), (9, "word " * 60_000), (None, "x"), (5, "<|endoftext|>")]
    kind = "doc_id long, text string, part int, ids string, n_tokens string, score double, row int, length int"
    return spark.createDataFrame([(*r, 0, "i", "n", 0.5, 1, 2) for r in rows], kind)


def test_files(spark, sf_dir, library, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_rows(spark).select("doc_id", "text"))
    path = str(tmp_path / "ids")
    more = docs.unionByName(spark.createDataFrame([(0, "zero")], "doc_id long, text string"))
    pfor.write_ids(more.repartition(5), path)
    got = sorted(pfor.read_ids(spark, path).collect(), key=lambda r: r.start)
    start = 0
    docs = docs.unionByName(spark.createDataFrame([(0, "zero")], "doc_id long, text string"))
    want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
    assert [r.doc_id for r in got] == [w[0] for w in want]
    for r in got:
        assert r.start == start and r.n_tokens * 4 == len(r.ids)
        start += r.n_tokens
    texts = {}
    for i, t in want:
        texts.setdefault(i, []).append(zlib.crc32(np.array([*ids_by_library(library, t), 2], "<u4").tobytes()))
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(pfor.unsigned_crc32(r.ids))
    assert {k: sorted(v) for k, v in texts.items()} == {k: sorted(v) for k, v in found.items()}
    empty = str(tmp_path / "none")
    pfor.write_ids(docs.filter("false"), empty)
    assert pfor.read_ids(spark, empty).count() == 0


def test_counts_of_odd_rows(spark, library):
    rows = odd_rows(spark)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(rows).collect())
    assert got == sorted((r.doc_id or 0, len((r.text or "").encode()), len(ids_by_library(library, r.text or ""))) for r in rows.collect())
    assert token_counts.token_counts(rows.filter("false")).count() == 0


def test_queries_equal_the_library(spark, sf_dir, library):
    """Files, pieces and counts of all documents, against the library's ids of the whole texts."""
    from rowguard.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    ids = {i: ids_by_library(library, t) for i, t in texts.items()}
    crc = lambda own: zlib.crc32(np.array(own, "<u4").tobytes())

    start, want = 0, []
    for i in sorted(ids):
        want.append((i, start, len(ids[i]) + 1, crc([*ids[i], 2])))
        start += len(ids[i]) + 1
    assert sorted(tuple(r) for r in QUERIES["op3_token_files"](spark, sf_dir).collect()) == want

    got = QUERIES["op5_token_counts"](spark, sf_dir).collect()
    assert sorted(tuple(r) for r in got) == [(i, len(texts[i].encode()), len(ids[i]), len(ids[i]) > 2048) for i in sorted(ids)]

    pieces = QUERIES["op4_packing"](spark, sf_dir).collect()
    own = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces)
    want = [(i, k, a, len(p), crc(p)) for i in sorted(ids) for k, (a, p) in enumerate((a, [*ids[i], 0][a : a + 2048]) for a in range(0, len(ids[i]) + 1, 2048))]
    assert own == want
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    bound = -(-sum(r.length for r in pieces) // 2048)
    assert len(bins) <= bound * 1.01 + 1


@pytest.mark.parametrize("text", [
    "col\tval\t" * 30, "日本語" * 40 + "\u3000" + "日本" * 3, "e\u0301" * 40 + "z", "a" * 100 + "\u0301" + "c" * 90 + "e\u0301.", "x\u0323\u0301 \u1100\u1161\u11a8\uf900", "<|endoftext|>!<|endof<|endoftext|>a",
    "'re\u0301 it's 'r", "t\x85\x1c'ré\u200d\x1c", "İSß" * 30, "!'s..'s" * 20,
])
def test_prefixes_of_odd_words(library, text):
    """Every prefix, whatever the normaliser does with its letters."""
    width, changes = token_counts.PrefixCounter().table(text)
    got = np.cumsum(token_counts.changes_of(width, changes)).tolist()
    assert got == [len(ids_by_library(library, text[:i])) for i in range(1, len(text) + 1)]


@pytest.mark.parametrize("text", ["col\tval\t" * 25_000, "日本語中文字" * 16_000 + "\u3000", "e\u0301" * 100_000, "vie\u0323\u0302t " * 30_000, "<|endoftext|>" * 15_000])
def test_long_odd_words_are_not_counted_in_the_square_of_their_length(library, text):
    began = time.perf_counter()
    width, changes = token_counts.PrefixCounter().table(text)
    assert time.perf_counter() - began < 60
    assert token_counts.changes_of(width, changes).sum() == len(ids_by_library(library, text))
