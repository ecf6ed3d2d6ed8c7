"""Near-duplicates, components, phrase fingerprints and decontamination against plain versions."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rowguard.llm import decontam, lzprint, simhash
from rowguard.llm.components import components
from rowguard.llm.queries import QUERIES
from .test_tokens import odd_rows


def by_hand(text, size=3):
    words = text.encode().lower().split()
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in runs) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(runs))


def groups_by_hand(prints, bits):
    """doc_id -> least doc_id reachable."""
    ids, parent = list(prints), {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_fingerprints(spark):
    texts = ["", "A b", "a  B\tc\n", "é É x", "w " * 700, "the cat sat on the mat " * 90]
    assert simhash.fingerprints_of(texts, 3).tolist() == [by_hand(t) for t in texts]
    assert simhash.fingerprints_of([], 3).tolist() == []


def test_query_equals_plain(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: by_hand(t) for i, t in sorted(docs.items())}
    want = groups_by_hand(prints, 3)
    got = QUERIES["op8_simhash"](spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", want[i]) for i in docs}
    assert len(got) == len(docs) > len(set(want.values()))


def test_links_are_exact_in_crowds(spark, monkeypatch):
    """Planted distances, chains, and a crowd that shares a key and is split into parts."""
    monkeypatch.setattr(simhash, "MOST", 40)
    rng = np.random.default_rng(1)
    prints = {}
    for n, base in enumerate(rng.integers(0, 2**63, 30, dtype=np.uint64).tolist()):
        x = base
        for k in range(6):  # a chain whose steps are 3 bits, and steps of 4 that must not link
            prints[len(prints)] = x
            for b in rng.choice(64, 3 if (n + k) % 4 else 4, replace=False).tolist():
                x ^= 1 << b
    crowd = int(rng.integers(0, 2**63))
    for _ in range(150):
        x = crowd
        for b in rng.choice(20, 4, replace=False).tolist():
            x ^= 1 << b
        prints[len(prints)] = x
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >= 1 << 63 else p) for i, p in prints.items()], "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, 3).collect()}
    assert got == groups_by_hand(prints, 3)


def test_components(spark):
    n = 200
    chain = [(i, i + 1) for i in range(n)] + [(1000, 2000), (2000, 1500), (7, 7)] + [(3000, 3000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain, "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 2000: 1000, 1500: 1000, **{3000 + i: 3000 for i in range(1, 50)}}
    assert components(edges.filter("false")).count() == 0


def test_odd_rows(spark):
    rows = odd_rows(spark)
    got = simhash.near_duplicates(simhash.fingerprints(rows), 3).collect()
    assert len(got) == rows.count()
    assert {r.component_id for r in got if r.fingerprint == 0} == {1}
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns and kept.count() == rows.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert simhash.one_of_each(rows.filter("false")).count() == 0
    assert simhash.near_duplicates(simhash.fingerprints(rows.filter("false"))).count() == 0


def test_similar_texts(spark, tmp_path):
    """Copies with few words changed go, texts that share half stay."""
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [[word() for _ in range(400)] for _ in range(30)]
    rows = []
    for n, words in enumerate(base):
        near, far = list(words), list(words)
        for i in rng.choice(400, 4, replace=False):
            near[i] = word()  # J of 5-word shingles: about 0.9
        far[:200] = [word() for _ in range(200)]  # about 0.33
        rows += [(3 * n, " ".join(words)), (3 * n + 1, " ".join(near)), (3 * n + 2, " ".join(far))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = {r.doc_id for r in simhash.one_of_each(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert kept == {i for i, _ in rows if i % 3 != 1}


def kept_of(spark, path, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(path))
    return {r.doc_id for r in simhash.one_of_each(spark.read.parquet(str(path))).collect()}


def test_repeated_lines_do_not_outweigh_the_text(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = lambda n: ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]
    texts, want = [], set()
    for _ in range(20):
        body, line, shared = words(392), words(12), words(104)
        want |= {len(texts), len(texts) + 2, len(texts) + 3}
        texts += [body + line, body + line * 10]  # Jaccard 0.97
        texts += [shared * 10 + words(104), shared * 10 + words(104)]  # about 0.33
    assert kept_of(spark, tmp_path / "d", texts) == want


def test_similarity_decides_exactly(spark, tmp_path):
    """Pairs just below 0.8 stay, from 0.8 on they go; also of a handful of shingles."""
    rng = np.random.default_rng(5)
    words = lambda n: ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]
    texts, want = [], set()
    for size, common, goes in [(400, 344, False), (400, 355, False), (400, 356, True), (400, 368, True), (9, 8, None)] * 40:
        s, n = common - 4, size - 4  # 0.752, 0.796, 0.8, 0.850
        if goes is None:
            body = words(size)
            texts += [body, body[:-1]]  # 4 of 5 shingles
            want.add(len(texts) - 2)
            continue
        body = words(common)
        texts += [body + words(size - common), body + words(size - common)]
        want |= {len(texts) - 2} | (set() if s >= 0.8 * (2 * n - s) else {len(texts) - 1})
        assert (s >= 0.8 * (2 * n - s)) == goes
    assert kept_of(spark, tmp_path / "d", texts) == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_by_hand(docs, bench, window=10):
    where = defaultdict(set)
    for item, text in bench:
        own = words_of(text)
        size = min(window, len(own))
        for j in range(len(own) - size + 1 if size else 0):
            where[tuple(own[j : j + size])].add(item)
    out = []
    for doc, text in docs:
        own, hit, items = words_of(text), set(), set()
        for size in {len(k) for k in where}:
            for j in range(len(own) - size + 1):
                key = tuple(own[j : j + size])
                if key in where:
                    hit.update(range(j, j + size))
                    items |= where[key]
        out.append((doc, len(own), len(hit), sorted(items)))
    return out


def test_decontamination_equals_plain(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {(d, n, h, len(i), hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest(), h > 0) for d, n, h, i in contamination_by_hand(docs, bench)}
    got = QUERIES["op9_decontamination"](spark, sf_dir).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs) and any(r.contaminated for r in got)


def test_decontamination_of_odd_texts(spark, monkeypatch):
    """Short items, overlaps, repeats, shared windows, and a benchmark in many blocks."""
    bench = [(1, "alpha beta gamma"), (2, "one two three four five six seven eight nine ten eleven twelve"), (3, "ONE two, three four five six seven eight nine ten"), (4, ""), (5, None), (6, "héllo"), (10, "a a a a a a a a a a a a")]
    docs = [(0, "x Alpha-beta GAMMA alpha beta gamma y"), (1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, "alpha beta. beta gamma"), (5, "Héllo héllo HÉLLO"), (6, "a " * 30), (7, "seven eight nine ten eleven twelve"), (8, "a b " * 9)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    for size in (decontam.GROUP_BYTES, 20):
        monkeypatch.setattr(decontam, "GROUP_BYTES", size)
        got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontam.contamination(rows, items).orderBy("doc_id").collect()]
        assert got == contamination_by_hand(docs, bench)
    found = {tuple(r) for r in decontam.matches(rows, items).collect()}
    assert (1, 0, 2, 0, 11) in found and (1, 0, 3, 0, 10) in found and (0, 1, 1, 0, 3) in found and (0, 4, 1, 0, 3) in found
    odd = odd_rows(spark)
    assert decontam.decontaminate(odd, items).columns == odd.columns
    assert decontam.decontaminate(odd, items.filter("false")).count() == odd.count()
    assert decontam.contamination(odd.filter("false"), items).count() == 0


def test_large_benchmark_in_groups(spark, monkeypatch):
    """A benchmark of many groups: built once in a worker and pass, ids of any type, the same result as in one group."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    bench = [(f"item {i}", " ".join(rng.choice(words, 30))) for i in range(60)] + [(None, "alone in the world"), ("empty", "")]
    docs = [(i, " ".join([*rng.choice(words, 40), *bench[i % 60][1].split()[5:25], *rng.choice(words, 10), *bench[(i + 1) % 60][1].split()[:12]])) for i in range(40)] + [(99, "x alone in the world y"), (None, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    items = spark.createDataFrame(bench, "item_id string, text string")
    want = sorted((-1 if d is None else d, n, h, [i for i in own if i]) for d, n, h, own in contamination_by_hand(docs, [(i or "", t) for i, t in bench]))
    for size in (decontam.GROUP_BYTES, 2000):
        monkeypatch.setattr(decontam, "GROUP_BYTES", size)
        got = decontam.contamination(rows, items).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == want
        assert {r.doc_id for r in decontam.decontaminate(rows, items).collect()} == {None}
    assert len(list(decontam.groups_of(items, 10))) > 3
    search, built = next(decontam.groups_of(items, 10))(), []
    monkeypatch.setattr(decontam, "Benchmark", lambda *a, own=decontam.Benchmark: built.append(1) or own(*a))
    for _ in range(20):
        search.texts([t for _, t in docs if t])
    assert len(built) == 1


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        ids = rng.integers(0, 3, n)
        order = decontam.suffix_array(ids, n + 1).tolist()
        assert order == sorted(range(n), key=lambda i: ids[i:].tolist())


def phrases(text):
    seen, phrase = set(), ""
    for char in text:
        phrase += char
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


def test_phrases():
    for text in ("", "a", "aaaaaaa", "abababab", "the cat the cat", "漢字" * 9):
        own, edited = lzprint.phrase_ends(text, "xyz the cat")
        cut = [text[a:b] for a, b in zip([0, *own], own)]
        assert set(cut) == phrases(text) and len(cut) == len(set(cut))
        new = lzprint.edit(text, "xyz the cat")
        assert {new[a:b] for a, b in zip([0, *edited], edited)} == phrases(new)


def test_fingerprints_estimate_jaccard(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op10_lz_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    off = []
    for (doc, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        new, r = lzprint.edit(text, following), got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        own, edited, nxt = phrases(text), phrases(new), phrases(following)
        off += [r.near_edited - len(own & edited) / len(own | edited), r.near_next - len(own & nxt) / len(own | nxt)]
        assert r.near_edited > r.near_next or text == following or len(text) < 100
    assert np.abs(off).mean() < 0.05 and np.abs(off).max() < 0.2
    texts = defaultdict(set)
    for doc, text in docs:
        texts[text].add(got[doc].fingerprint)
    assert all(len(v) == 1 for v in texts.values()) and len(set.union(*texts.values())) == len(texts)


def test_next_of_odd_rows(spark):
    rows = odd_rows(spark)
    got = lzprint.with_next(rows).collect()
    assert len(got) == rows.count()
    pairs = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in rows.collect())
    want = sorted((k[1], hashlib.sha256(lzprint.edit(t, n).encode()).hexdigest()) for (k, t), (_, n) in zip(pairs, pairs[1:] + pairs[:1]))
    assert sorted((r.doc_id or 0, r.edited_sha256) for r in got) == want
    one = lzprint.with_next(rows.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    empty = [r for r in got if r.doc_id in (1, 2)]
    assert all(r.n_chars == 0 for r in empty) and len({r.fingerprint for r in empty}) == 1
    assert lzprint.with_next(rows.filter("false")).count() == 0
    assert lzprint.fingerprints(rows).count() == rows.count()
