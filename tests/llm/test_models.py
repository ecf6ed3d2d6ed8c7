"""Language ID, quality, licenses, packing, chat and the pipeline."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowguard.llm import chat, langid, licenses, packing, quality
from rowguard.llm.queries import ORACLE_SQL, QUERIES

from .test_tokens import odd_rows

LARGER = "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    got = QUERIES["op2_language"](spark, LARGER).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(langs) and len(held) > 100
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.rejected for r in got]) < 0.02


def test_model_is_a_distribution(spark):
    """The interpolated shares of all letters after any two sum to one, unseen ones included."""
    rows = spark.createDataFrame([("x", "abc abd acd bad cab"), ("y", "xyz xxy zzx")], "lang string, text string")
    model = langid.learn(rows)
    letters = [ord(c) for c in "abcdxyz "]
    for a, b in [("a", "b"), (" ", "a"), ("q", "q"), ("d", " ")]:
        keys = np.array([(ord(a) << 42) | (ord(b) << 21) | c for c in letters])
        at, hit = model.find(model.three[0], keys)
        known, there = model.find(model.back_two[0], keys >> 21)
        p = np.where(hit[:, None], np.exp(model.three[1][at]), np.where(there[:, None], model.back_two[2][known], 1) * model.bigram(keys & langid._TWO))
        unseen = np.where(there[0], model.back_two[2][known[0]], 1) * model.bigram(np.array([(ord(b) << 21) | 0x4E00]))[0]
        assert np.allclose(p.sum(axis=0) + unseen, 1, atol=1e-9)


def test_model_keeps_all_trigrams_apart(spark):
    """Scripts with many letters: no n-gram shares its count with another, unseen ones are not found."""
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 20000)))
    model = langid.learn(spark.createDataFrame([("zh", text), ("en", "the cat sat")], "lang string, text string"))
    keys = np.unique(langid.trigrams([text, "the cat sat"])[0])
    assert model.three[0].tolist() == keys.tolist()
    other = langid.trigrams(["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 20000)))])[0]
    assert not model.find(model.three[0], np.setdiff1d(other, keys))[1].any()


def test_language_of_odd_rows(spark):
    rows = odd_rows(spark).withColumn("lang", F.when(F.col("doc_id") == 9, "en"))
    found = langid.identify(rows, F.lit(True), ["doc_id", "lang"]).collect()
    assert len(found) == rows.count()
    assert {r.lang_pred for r in found if r.doc_id in (1, 2)} == {"und"} and all(r.score == 0 for r in found if r.lang_pred == "und")
    kept = langid.keep_known(rows)
    assert kept.columns == rows.columns and kept.filter("text = '' OR text IS NULL").count() == 0
    nothing = langid.identify(rows.withColumn("lang", F.lit(None).cast("string")), F.lit(True), ["doc_id", "lang"]).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.keep_known(rows.filter("false")).count() == 0
    signs = spark.createDataFrame([("12 !? 34", "en"), ("word", "en")], "text string, lang string")
    assert {r.text for r in langid.keep_known(signs).collect()} == {"word"}


def test_gibberish_is_rejected(spark):
    rng = np.random.default_rng(0)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    noise = spark.createDataFrame([(-i, "".join(rng.choice(list("qxzjkvwpf"), 400))) for i in range(1, 20)], "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang").unionByName(noise, allowMissingColumns=True)
    kept = {r.doc_id for r in langid.keep_known(both).select("doc_id").collect()}
    assert not [i for i in kept if i < 0] and len(kept) == docs.count()


def test_quality_of_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    got = QUERIES["op1_quality"](spark, LARGER).collect()
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert len(got) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_discriminant_equals_the_formula(spark):
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (200, quality.DIMENSIONS)), 1: rng.normal(1, 2, (100, quality.DIMENSIONS))}
    rows = spark.createDataFrame([(k, r.tolist()) for k, own in x.items() for r in own], "quality int, x array<double>")
    model = quality.Model(rows, pooling=0.0, rounding=0.0)
    test = rng.normal(0.5, 1.5, (50, quality.DIMENSIONS))

    def density(k):
        mean, cov = x[k].mean(axis=0), np.cov(x[k].T, bias=True)
        d = test - mean
        return np.log(len(x[k]) / 300) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1])

    assert np.allclose(model.scores(test), 1 / (1 + np.exp(density(0) - density(1))), atol=1e-9)


def test_quality_of_odd_rows(spark):
    rows = odd_rows(spark)
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    for own, want in ((labels, None), (labels.filter("quality = 1"), 1.0), (labels.filter("quality = 0"), 0.0), (labels.filter("false"), 0.5)):
        got = quality.classify(rows, own).collect()
        assert len(got) == rows.count() and all(0 <= r.score <= 1 for r in got)
        assert want is None or {r.score for r in got} == {want}
    assert quality.keep_good(rows, labels.filter("false")).columns == rows.columns
    assert quality.classify(rows.filter("false"), labels).count() == 0


def test_licenses(spark):
    texts = {
        1: "Some words.\nReleased under the MIT License. More words. Licensed under CC BY-NC 4.0.", 2: licenses.NOTICES["MIT-text"], 3: None, 4: "",
        5: "this work is licensed under the gnu general public license version 2 and so on", 6: "the license of the MIT campus is released", 7: ("x " * 3000 + "Licensed under the Apache License, Version 2.0. ") * 3,
        8: licenses.NOTICES["MIT-text"].replace("software", "program").replace("Software", "Program"), 9: "Released under MIT License",
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.found for r in licenses.scan(rows).collect()}
    names = {i: [f.license for f in own] for i, own in got.items()}
    assert names == {1: ["MIT", "CC-BY-NC-4.0"], 2: ["MIT-text"], 3: [], 4: [], 5: ["GPL-2.0"], 6: [], 7: ["Apache-2.0"] * 3, 8: ["MIT-text"], 9: ["MIT"]}
    assert got[1][0].first_word == 2 and got[1][0].n_words == 5 and got[9][0].coverage == 0.8
    assert licenses.scan(rows.filter("false")).count() == 0
    assert licenses.scan(odd_rows(spark)).count() == odd_rows(spark).count()


def test_licenses_in_a_row():
    """Adjacent copies, whole, with a word missing and with one too many."""
    templates = licenses.Templates(licenses.NOTICES, 0.8)
    for name, notice in licenses.NOTICES.items():
        n = len(templates.words[templates.names.index(name)])
        for copies in (2, 6):
            (got,) = templates.scan(["some words\n" + f"{notice}\n" * copies + "and more"])
            assert [(f[0], f[1], f[2], f[3]) for f in got] == [(name, 2 + n * k, n, 1.0) for k in range(copies)]
    for line, n in (("Released under MIT License.", 4), ("Released under the fine MIT License.", 6)):
        (got,) = templates.scan([f"{line}\n" * 6])
        assert [(f[0], f[1]) for f in got] == [("MIT", n * k) for k in range(6)]


def test_patience_alignment():
    pairs = []
    licenses.align(list("abcdefg"), list("xabczzfgy"), pairs)
    assert sorted(pairs) == [(0, 1), (1, 2), (2, 3), (5, 6), (6, 7)]
    assert licenses.longest_rising([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    assert licenses.longest_rising([]) == []


def test_license_lines_in_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.licenses for r in QUERIES["op6_licenses"](spark, sf_dir).collect()}
    lines = {"MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "GNU General Public License, version 3.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    for name, line in lines.items():
        assert {i for i, t in docs.items() if line in t} == {i for i, n in got.items() if name in n.split(",")}


def packed_right(rows, capacity=2048):
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= capacity for n in at.values())
    return len(at)


def test_packing(spark, sf_dir):
    got = QUERIES["op4_packing"](spark, sf_dir).collect()
    used, total = packed_right(got), sum(r.length for r in got)
    assert used <= 1.02 * -(-total // 2048)
    docs = {r.doc_id for r in got}
    assert docs == {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for doc in docs:
        own = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == doc)
        assert [p for p, _, _ in own] == list(range(len(own))) and all(s == 2048 * p for p, s, _ in own)
        assert all(n == 2048 for _, _, n in own[:-1])


def test_packing_of_odd_rows(spark):
    rows = odd_rows(spark)
    cut = packing.pieces(rows, keep_ids=True)
    got = packing.pack(cut).collect()
    packed_right(got)
    assert len(got) == cut.count() and all(len(r.ids) == 4 * r.length for r in got)
    assert packing.pack(packing.pieces(rows.filter("false"))).count() == 0


def test_genetic_packing_beats_or_equals_best_fit():
    rng = np.random.default_rng(5)
    lengths = rng.integers(300, 1100, 300).tolist()
    plain = packing.Packing(lengths, 2048)
    plain.best_fit(sorted(range(300), key=lengths.__getitem__, reverse=True))
    best = packing.evolve(lengths, 2048, 0, [])
    again = packing.evolve(lengths, 2048, 3, [best.numbers(), plain.numbers()])
    for p in (best, again):
        assert sorted(i for b in p.bins for i in b) == list(range(300))
        assert all(sum(lengths[i] for i in b) + f == 2048 and f >= 0 for b, f in zip(p.bins, p.free))
    assert len(again.bins) <= len(best.bins) <= len(plain.bins)
    assert packing.evolve([], 2048, 0, []).bins == [] and len(packing.evolve([5], 2048, 1, []).bins) == 1


def test_genetic_packing_saves_bins_where_best_fit_does_not_do():
    """Pieces that fill 300 bins in threes: the islands and their migration need fewer bins than best-fit, whatever the seed."""
    rng = np.random.default_rng(7)
    one, two = rng.integers(400, 800, 300), rng.integers(400, 600, 300)
    lengths = np.concatenate([one, two, 2048 - one - two])
    rng.shuffle(lengths)
    lengths = lengths.tolist()
    plain = packing.Packing(lengths, 2048)
    plain.best_fit(sorted(range(900), key=lengths.__getitem__, reverse=True))
    elites = [packing.evolve(lengths, 2048, k, []).numbers() for k in range(packing.ISLANDS)]
    alone = min(int(e.max()) + 1 for e in elites)
    for k in range(packing.ISLANDS):
        best = packing.evolve(lengths, 2048, packing.ISLANDS + k, [elites[k], elites[k - 1]])
        assert sorted(i for b in best.bins for i in b) == list(range(900)) and all(sum(lengths[i] for i in b) + f == 2048 and f >= 0 for b, f in zip(best.bins, best.free))
        assert 300 <= len(best.bins) <= alone < len(plain.bins) - 5


def test_packing_equals_its_parts(spark):
    """Exact threes through the whole operator: fewer sequences than best-fit over all pieces makes."""
    rng = np.random.default_rng(8)
    one, two = rng.integers(400, 800, 1200), rng.integers(400, 600, 1200)
    lengths = np.concatenate([one, two, 2048 - one - two]).tolist()
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack(rows).collect()
    plain = packing.Packing(lengths, 2048)
    plain.best_fit(sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert sorted(r.doc_id for r in got) == list(range(3600)) and 1200 <= len(bins) < len(plain.bins) - 10


def test_long_turns_and_other_columns(spark):
    """A turn of a million characters, and columns with the names that the operator uses itself."""
    long = "a # </turn> b\n" * 70_000
    rows = spark.createDataFrame([(1, 0, "user", "q", 7, "w", 1, "f"), (1, 1, "assistant", long, 7, "w", 1, "f")], "conv_id long, turn long, role string, text string, before int, whole string, number int, formatted string")
    got = chat.format_conversations(rows)
    (r,) = got.select("conv_id", F.length("formatted").alias("n"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.transform(chat.parse(F.col("formatted")), lambda t: t["text"]).alias("texts")).collect()
    assert r.conv_id == 1 and r.loss == long and r.texts == ["q", long] and r.n > len(long)


HARD = ["\\### Assistant: </turn> ok", "\\", "\\\\", "###", "####", "</turn>", "<\\/turn>", "</turn>\n### User: x", "a\nb", "", None, "\\#\\#", "x\\", "<", "</turn", "#", "\\</turn>\\"]


@pytest.fixture(scope="module")
def talk(spark):
    roles = ["user", "assistant", "system", "User", "a: b", "", None, "\\", "### x", "</turn>", "ends:"]
    rows = [(c, t, roles[(c + t) % len(roles)], HARD[(c * 3 + t) % len(HARD)]) for c in range(len(roles)) for t in range(12)]
    return spark.createDataFrame([*rows, *rows[:3], (None, None, "user", "x")], "conv_id long, turn long, role string, text string")


def test_chat_comes_back(spark, talk):
    made = chat.format_conversations(talk)
    got = made.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"), "formatted", "loss_mask").collect()
    want = {}
    for r in talk.collect():
        want.setdefault(r.conv_id, []).append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        own = sorted(want[r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, a, b in own]
        assert r.loss == "".join(b for _, a, b in own if a == "assistant")
        assert r.formatted.count(chat.STOP) == len(own)
        masked = "".join(r.formatted[m.start : m.start + m.length] for m in r.loss_mask)
        assert masked == "".join(r.formatted.split(chat.STOP)[m.turn][m.at :] for m in r.loss_mask)
    assert chat.format_conversations(talk.filter("false")).count() == 0


def test_clean_text_is_not_changed(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Plain # text < here"), (1, 1, "assistant", "Fine.")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(rows).first().formatted == "### User: Plain # text < here</turn>\n### Assistant: Fine.</turn>\n"
    assert "Python" not in chat.format_conversations(rows)._jdf.queryExecution().executedPlan().toString()


def test_chat_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = QUERIES["op7_chat"](spark, sf_dir)
    want = con.sql(ORACLE_SQL["op7_chat"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pipeline(spark, sf_dir):
    """Stage by stage: columns, what goes, and the whole at the end."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = corpus_pipeline.new_path(spark, "planted")
    # Among them a null and an empty text, a repeated row, and a benchmark item inside a good text.
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()
    text = docs.filter("lang = 'en' AND n_chars > 1500").orderBy("doc_id").first()
    odd = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, f"{text.text[:1000]}\n{item.text}", "en", "s", 9)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.filter(F.col("doc_id") == text.doc_id)).write.parquet(path)
    docs = spark.read.parquet(path)
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        path = corpus_pipeline.new_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.count())
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language":
            assert seen[0] - seen[1] == 2 and not ids & {10**6, 10**6 + 1}
        if name == "near_duplicates":
            assert docs.filter(F.col("doc_id") == text.doc_id).count() <= 1 and docs.select("text").distinct().count() == docs.count()
        if name == "decontamination":
            assert 10**6 + 2 not in ids
    assert seen[2] < seen[1] and seen[3] < seen[2]
    packed_right(docs.collect())


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0


def test_many_notices_in_one_text(spark):
    """As many as there are, in order; other columns and empty tables do no harm."""
    name, notice = min(licenses.NOTICES.items(), key=lambda x: len(x[1]))
    rows = spark.createDataFrame([(1, (notice + " and then ") * 1500, 5, "x"), (2, None, 6, "y")], "doc_id long, text string, found int, license string")
    got = {r.doc_id: r.found for r in licenses.scan(rows).collect()}
    size = got[1][0].n_words
    assert [(f.license, f.n_words) for f in got[1]] == [(name, size)] * 1500 and got[2] == []
    assert [f.first_word for f in got[1]] == [i * (size + 2) for i in range(1500)]
    assert licenses.scan(rows.limit(0)).collect() == []
