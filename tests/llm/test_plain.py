"""The registered queries and the pipeline against versions in plain Python, over all documents of a small table."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowguard.llm import langid, quality
from rowguard.llm.common import new_path
from rowguard.llm.license_texts import NOTICES
from rowguard.llm.queries import QUERIES

from .test_near import contamination_by_hand, words_of


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    read = lambda t: [r.asDict() for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    return {t: read(t) for t in ("documents", "labels", "benchmark")}


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# Language.


def letters(text):
    words = re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in text.lower()))
    return "  " + "".join(w + " " for w in words) if words else ""


class PlainModel:
    """Interpolated Kneser-Ney by dictionaries: a letter given the two before it."""

    def __init__(self, rows):
        self.n = defaultdict(lambda: [Counter(), Counter(), Counter()])  # by language: of one, two, three letters
        for lang, text in rows:
            s = letters(text)
            self.n[lang][2].update(s[i - 2 : i + 1] for i in range(2, len(s)))
        for three in self.n.values():
            for gram in three[2]:
                three[1][gram[1:]] += 1
            for gram in three[1]:
                three[0][gram[1:]] += 1
        self.kinds = len({c for own in self.n.values() for c in own[0]}) + 1
        self.contexts = {lang: [None, self.before(own[1]), self.before(own[2])] for lang, own in self.n.items()}

    @staticmethod
    def before(counts):
        out = defaultdict(lambda: [0, 0])
        for gram, n in counts.items():
            out[gram[:-1]][0] += n
            out[gram[:-1]][1] += 1
        return out

    @staticmethod
    def discount(counts):
        ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
        return min(0.9, max(0.1, (ones + 0.5) / (ones + 2 * twos + 1)))

    def share(self, lang, gram):
        one = self.n[lang][0]
        d, total = self.discounts[lang][0], self.totals[lang]
        p = max(one[gram[-1]] - d, 0) / total if gram[-1] in one else 0.0
        p += d * len(one) / total / self.kinds
        for order in (1, 2):
            own = gram[-1 - order :]
            n, kinds = self.contexts[lang][order].get(own[:-1], (0, 0))
            if n:
                d = self.discounts[lang][order]
                p = max(self.n[lang][order].get(own, 0) - d, 0) / n + d * kinds / n * p
        return p

    def entropies(self, text):
        if not hasattr(self, "discounts"):
            self.discounts = {lang: [self.discount(c) for c in own] for lang, own in self.n.items()}
            self.totals = {lang: sum(own[0].values()) for lang, own in self.n.items()}
            self.known = {}
        s = letters(text)
        out = {}
        for lang in sorted(self.n):
            total = 0.0
            for i in range(2, len(s)):
                key = lang, s[i - 2 : i + 1]
                if key not in self.known:
                    self.known[key] = -math.log(self.share(*key))
                total += self.known[key]
            out[lang] = total / max(1, len(s) - 2)
        return out, max(0, len(s) - 2)


def test_language_equals_plain(spark, sf_dir, tables):
    model = PlainModel((d["lang"], d["text"]) for d in tables["documents"] if remainder(d["doc_id"], 4) != 2 and d["lang"] and d["text"])
    got = {r.doc_id: r for r in QUERIES["op2_language"](spark, sf_dir).collect()}
    assert len(got) == len(tables["documents"])
    for d in tables["documents"]:
        own, n = model.entropies(d["text"] or "")
        r = got[d["doc_id"]]
        assert r.held_out == (remainder(d["doc_id"], 4) == 2)
        if not n:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        best = min(own, key=own.get)
        assert r.lang_pred == best and r.entropy == pytest.approx(own[best], abs=1e-9)
        assert r.score == pytest.approx(1 / sum(math.exp((own[best] - h) * min(n, 100)) for h in own.values()), abs=1e-6)


# Quality.


def statistics(text):
    raw = text.encode()
    kind = {k: 0 for k in ("small", "capital", "digit", "stop", "sign", "bar", "bang", "line")}
    for b in raw:
        c = chr(b)
        if b >= 128 or "a" <= c <= "z":
            kind["small"] += 1
        elif "A" <= c <= "Z":
            kind["capital"] += 1
        elif "0" <= c <= "9":
            kind["digit"] += 1
        elif c in ".,;:'\"()-":
            kind["stop"] += 1
        elif c == "|":
            kind["bar"] += 1
        elif c in "!?":
            kind["bang"] += 1
        elif 33 <= b <= 126:
            kind["sign"] += 1
        elif c == "\n":
            kind["line"] += 1
    words = words_of(text)
    n, size = len(words), max(1, sum(v for k, v in kind.items() if k != "line"))
    letters_, per = kind["small"] + kind["capital"], max(1, n)
    root = lambda a, b: math.sqrt(a / b)
    return [
        math.log1p(n), letters_ / size, root(kind["capital"], max(1, letters_)), root(kind["digit"], size), root(kind["stop"], size), root(kind["sign"], size), root(kind["bar"], size), root(kind["bang"], size),
        math.log1p(kind["line"] / per), math.log1p(max(1, letters_) / per), math.log((len(set(words)) + 1) / (n + 1)), root(size - letters_ - kind["stop"], size),
    ]


class PlainDiscriminant:
    def __init__(self, rows, pooling=0.2, rounding=0.02):
        x = {k: np.array([s for q, s in rows if q == k]) for k in (0, 1)}
        total = sum(map(len, x.values()))
        cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
        pooled = sum(cov[k] * len(x[k]) for k in x) / total
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.scale, self.parts = scale, {}
        for k in x:
            own = ((1 - pooling) * cov[k] + pooling * pooled) / np.outer(scale, scale)
            own = (1 - rounding) * own + rounding * max(np.trace(own) / len(own), 1e-6) * np.eye(len(own))
            self.parts[k] = x[k].mean(axis=0), own, math.log(len(x[k]) / total)

    def score(self, s):
        density = {}
        for k, (mean, cov, share) in self.parts.items():
            d = (np.array(s) - mean) / self.scale
            density[k] = share - 0.5 * (d @ np.linalg.solve(cov, d) + np.linalg.slogdet(cov)[1])
        return 1 / (1 + math.exp(min(700, max(-700, density[0] - density[1]))))


def plain_quality(docs, labels):
    texts = defaultdict(list)
    for d in docs:
        texts[d["doc_id"]].append(d["text"] or "")
    return PlainDiscriminant([(r["quality"], statistics(t)) for r in labels if r["quality"] in (0, 1) for t in texts.get(r["doc_id"], [])])


def test_quality_equals_plain(spark, sf_dir, tables):
    model = plain_quality(tables["documents"], [r for r in tables["labels"] if remainder(r["doc_id"], 3) != 1])
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, sf_dir).collect()}
    assert len(got) == len(tables["documents"])
    for d in tables["documents"]:
        want, r = model.score(statistics(d["text"] or "")), got[d["doc_id"]]
        assert r.score == pytest.approx(want, abs=1e-6) and r.held_out == (remainder(d["doc_id"], 3) == 1)
        assert abs(want - 0.5) < 1e-6 or r.predicted == (want >= 0.5)


def test_statistics_of_odd_texts():
    texts = ["", " ", "é" * 10, "A b 1!", "||\n\n", "x\x00y", "word " * 5000]
    assert np.allclose(quality.statistics(texts), [statistics(t) for t in texts])


# Licences.


def common_length(a, b):
    """Of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_licenses_equal_plain(spark, sf_dir, tables, tmp_path):
    """All exact copies are found or lie in something longer; whatever is found agrees with its template by a plain alignment."""
    names = list(NOTICES)
    planted = [{"doc_id": 10**6 + k, "text": f"Before it. {NOTICES[n]} After it, {NOTICES[names[k - 1]]}"} for k, n in enumerate(names)]
    docs = [{"doc_id": d["doc_id"], "text": d["text"]} for d in tables["documents"]] + planted
    spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op6_licenses"](spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    templates = {n: words_of(t) for n, t in NOTICES.items()}
    exact = 0
    from rowguard.llm import licenses

    whole = {r.doc_id: r.found for r in licenses.scan(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    for d in docs:
        own, r, found = words_of(d["text"]), got[d["doc_id"]], whole[d["doc_id"]]
        spans = [(f.first_word, f.first_word + f.n_words) for f in found]
        assert (r.n_found, r.licenses, r.first_words) == (len(found), ",".join(f.license for f in found), ",".join(str(f.first_word) for f in found))
        assert r.n_words == sum(f.n_words for f in found) and r.coverage == max([f.coverage for f in found], default=0.0)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        for f in found:
            t = templates[f.license]
            stretch = own[f.first_word : f.first_word + f.n_words]
            assert f.coverage >= 0.8 - 1e-9 and round(f.coverage * len(t)) <= common_length(t, stretch)
        for name, t in templates.items():
            for i in range(len(own) - len(t) + 1):
                if own[i] == t[0] and own[i : i + len(t)] == t:
                    exact += 1
                    assert any(a < i + len(t) and i < b for a, b in spans), (d["doc_id"], name, i)
                    assert any(a <= i and i + len(t) <= b for a, b in spans) or any(b - a > len(t) for a, b in spans if a < i + len(t) and i < b)
    assert exact >= 2 * len(names)


# The pipeline.


def plain_pipeline(docs, labels, bench, tolerance=langid.TOLERANCE):
    """The documents that each stage leaves."""
    left = []
    model = PlainModel((d["lang"], d["text"]) for d in docs if d["lang"] and d["text"])
    scored = []
    for d in docs:
        own, n = model.entropies(d["text"] or "")
        best = min(own, key=own.get)
        scored.append((d, best if n else None, own[best]))
    limits = {}
    for lang in model.n:
        right = sorted(h for d, best, h in scored if best == lang == d["lang"])
        if right:
            middle, high = (right[math.ceil(p * len(right)) - 1] for p in (0.5, 0.99))
            limits[lang] = middle + tolerance * max(high - middle, 0.1)
    docs = [d for d, best, h in scored if best and h <= limits.get(best, math.inf)]
    left.append(docs)
    model = plain_quality(docs, labels)
    docs = [d for d in docs if model.score(statistics(d["text"])) >= 0.5]
    left.append(docs)
    sets = []
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d["text"]))
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= 0.8 * large and (both := len(sets[i] & sets[j])) >= 0.8 * (small + large - both) - 1e-9:
                parent[root(i)] = root(j)
    stays = {}
    for i, d in enumerate(docs):
        stays.setdefault(root(i), []).append((d["doc_id"], i))
    docs = [docs[i] for _, i in sorted(min(own) for own in stays.values())]
    left.append(docs)
    hit = {doc for doc, _, n_hit, _ in contamination_by_hand([(d["doc_id"], d["text"]) for d in docs], [(b["item_id"], b["text"]) for b in bench]) if n_hit}
    docs = [d for d in docs if d["doc_id"] not in hit]
    left.append(docs)
    return left


def test_pipeline_equals_plain(spark, sf_dir, tables, tmp_path):
    """Every stage, and `run`, on documents with planted copies, junk and benchmark passages."""
    rng = np.random.default_rng(9)
    docs = [dict(d) for d in tables["documents"]]
    long = sorted((d for d in docs if d["lang"] == "en" and len(d["text"]) > 1500), key=lambda d: d["doc_id"])[:20]
    for k, d in enumerate(long):
        words = d["text"].split(" ")
        for i in rng.choice(len(words), max(1, len(words) // 100), replace=False):
            words[i] = "changed"
        docs.append({**d, "doc_id": 10**6 + k, "text": " ".join(words)})
        docs.append({**d, "doc_id": 10**6 + 100 + k, "text": d["text"][:700] + " " + tables["benchmark"][k % len(tables["benchmark"])]["text"]})
        docs.append({**d, "doc_id": 10**6 + 200 + k, "text": "".join(rng.choice(list("qxzjkvwpf   "), 300))})
    docs += [{**long[0], "doc_id": 10**6 + 300, "text": None}, {**long[0], "doc_id": 10**6 + 301, "text": ""}]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    spark.createDataFrame([tuple(d[c] for c in schema.names) for d in docs], schema).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    want = plain_pipeline(docs, tables["labels"], tables["benchmark"])
    assert len(docs) > len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 0
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), left in zip(corpus_pipeline.STAGES, want):
        path = new_path(spark, name)
        stage(spark, rows, str(tmp_path)).write.parquet(path)
        rows = spark.read.parquet(path)
        assert rows.columns == schema.names
        assert sorted(r.doc_id for r in rows.select("doc_id").collect()) == sorted(d["doc_id"] for d in left), name
    assert {tuple(r) for r in rows.collect()} == {tuple(d[c] for c in schema.names) for d in want[3]}
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {d["doc_id"] for d in want[3]}
    fills = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 2048 for r in fills) and len(fills) <= -(-sum(r.n for r in fills) // 2048) + 1
