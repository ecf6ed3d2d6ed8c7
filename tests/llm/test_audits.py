"""URL filters, Merkle manifest and filter audit: against SQL, and by hand on odd rows."""

import hashlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from rowguard.llm import audit, merkle, urls
from rowguard.llm.queries import ORACLE_SQL, QUERIES, URL_RULES
from test_queries import TABLES, plain


@pytest.mark.parametrize("name", ["op11_url_filters", "op12_merkle_manifest", "op13_filter_audit"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want) and len(got)


# Merkle manifest.


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in merkle.COLUMNS)])


def tree_of(digests, paths, arity):
    """The root; `paths`, a list for each digest, get (before, after)."""
    under = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [list(range(i, min(i + arity, len(digests)))) for i in range(0, len(digests), arity)]
        for run in runs:
            for at in run:
                step = ("".join(digests[j] for j in run if j < at), "".join(digests[j] for j in run if j > at))
                for i in under[at]:
                    paths[i].append(step)
        digests, under = [h(*[digests[j] for j in run]) for run in runs], [[i for j in run for i in under[j]] for run in runs]
    return digests[0]


def manifest_by_hand(rows, arity=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    paths = {s: [[] for _ in groups[s]] for s in names}
    subroots = [tree_of([x[2] for x in sorted(groups[s])], paths[s], arity) for s in names]
    above = [[] for _ in names]
    root = tree_of(subroots, above, arity)
    return sorted(
        (str(i if known else None), str(s), leaf, sub, root, str(own + top))
        for s, sub, top in zip(names, subroots, above)
        for (known, i, leaf), own in zip(sorted(groups[s]), paths[s])
    )


ODD = "doc_id long, source string, lang string, n_chars long, text string, key string, idx int, run string, path int"


def odd_docs():
    more = ("k", 1, "r", 2)
    rows = [(i, "many", "en", i, f"text {i}", *more) for i in range(300)]
    rows += [(7, "twice", None, 3, "Same", *more)] * 40 + [(None, "twice", "x", None, None, *more)] * 3
    rows += [(1, None, "de", 0, "", *more), (2, "", "é", -5, "ÄÖ A", *more), (3, "lone", "en", 1, "word " * 200_000, *more)]
    return rows + [(i, f"s{i}", "en", 1, "x", *more) for i in range(30)]


@pytest.mark.parametrize("arity", [16, 2])
def test_manifest_by_hand(spark, arity):
    docs = spark.createDataFrame(odd_docs(), ODD).repartition(5)
    found = merkle.manifest(docs, arity=arity, carry={"kind": F.col("key")}).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    got = sorted((str(r.doc_id), str(r.source), r.leaf, r.subroot, r.root, str([(s.before, s.after) for s in r.path])) for r in found)
    assert got == manifest_by_hand([dict(zip([p.split()[0] for p in ODD.split(",")], r)) for r in odd_docs()], arity)
    assert all(r.folded == r.root and r.kind == "k" for r in found)


def test_manifest_of_few_rows(spark):
    docs = spark.createDataFrame(odd_docs()[:1], ODD)
    one = merkle.manifest(docs).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].path == []
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_manifest_tells_what_changed(spark):
    """A path only fits the row that it was made for."""
    docs = spark.createDataFrame([(i, "s", "en", 1, f"Text {i}") for i in range(50)], "doc_id long, source string, lang string, n_chars long, text string")
    before = merkle.manifest(docs).select("doc_id", "path", "root")
    after = merkle.manifest(docs.withColumn("text", F.when(F.col("doc_id") == 9, "other").otherwise(F.col("text")))).select("doc_id", "leaf")
    bad = before.join(after, "doc_id").filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in bad.collect()] == [9]


# Filter audit.


def audit_by_hand(docs, labels):
    least = {}
    for i, _, text in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, *says in labels if says[k] == 1 and i is not None} for k in (0, 1))
    parts = defaultdict(list)
    for i, source, text in docs:
        text = text or ""
        words = [w for w in text.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= x <= "Z" for x in text) > 5 * len(text),
            "D": any(x in "#$%&*|" for x in text), "E": i is not None and least[text] < i,
        }
        parts[source or ""].append((i, {f for f in fails if fails[f]}))
    out, total = [], Counter()
    for part, own in parts.items():
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = [d for d in own if d[1] & set(order[: step - 1])]
                here = [d for d in own if f in d[1] and not d[1] & set(order[: step - 1])]
                total[part, f] += len(here)
                out.append([
                    part, "".join(order), step, len(own) - len(gone) - len(here), len(here), sum(f in d[1] for d in gone),
                    sum(d[1] == {f} for d in own), sum(d[0] in good for d in here), sum(d[0] in toxic for d in here),
                ])
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_by_hand(spark):
    many = " ".join(f"word{i}" for i in range(60))
    docs = [(i, "hot", many) for i in range(200)] + [(5, "hot", many)] * 3 + [(0, "other", many)] * 2
    docs += [(1, None, None), (2, "", ""), (300, "x", None), (None, "x", many), (None, None, "n"), (301, "x", "a b " * 40), (302, "x", "A\u00a0B\x1cC " * 60)]
    docs += [(303, "y", "LOUD " * 70), (304, "y", many + " #"), (305, "y", "é" * 10), (306, "y", "tail " * 300_000), (307, "hot", "tail " * 300_000)]
    labels = [(0, 1, 0), (3, 1, 1), (3, 0, 0), (5, 0, 1), (None, 1, 1), (303, None, 1), (303, 1, None), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, source string, text string, n int, mask string")
    for held in (audit.HELD, 100):
        got = audit.interactions(frame.repartition(6), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held)
        assert sorted(map(tuple, got.collect())) == audit_by_hand(docs, labels)
    assert audit.interactions(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_texts_of_one_hash(monkeypatch):
    """Different texts whose hashes are the same are not taken for copies."""
    monkeypatch.setattr(audit.xxhash, "xxh64_intdigest", lambda own: 1)
    rows = [(3, "p", "one"), (1, "p", "two"), (2, "p", "one"), (4, "p", "two"), (2, "q", "one")]
    got = sorted((i, p, bool(m & 16), n) for i, p, m, n in audit.compare(sorted(audit.route(rows), key=lambda r: r[0])))
    assert got == [(1, "p", False, 1), (2, "p", False, 1), (2, "q", False, 1), (3, "p", True, 1), (4, "p", True, 1)]


# URL filters.


def test_parts_of_urls(spark):
    cases = {
        "http://A.Net/x?y#z": ("a.net", "/x"), "HTTPS://É.Net": ("É.net", ""), "no-scheme/x": ("", ""), None: ("", ""), "": ("", ""), "://h": ("h", ""), "a://b://c/d": ("b:", "//c/d"),
        "http://u@h:80?q": ("u@h:80", ""), "http:///p": ("", "/p"), "http://h#/x": ("h", ""), "http://h/a\nb/c": ("h", "/a\nb/c"),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.host(F.col("u")), urls.path(F.col("u"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases


def test_list_rules(spark):
    cases = {
        "http://a.net/x": "net/", "http://net/": "net/", "http://a.net": None, "http://anet/": None, "http://x.example.net/en/1": "example.net/en/", "http://example.net/en": "net/",
        "http://notexample.com/de/": None, "http://m.example.com/de/": "example.com/de/", "http://a.org/fr/x": "org/fr/", "http://a.org/FR/x": None, "http://A.ORG/fr/": "org/fr/", "http://a.net./x": None, None: None,
    }
    rows = spark.createDataFrame([(u, "x", i) for i, u in enumerate(cases)], "url string, HOST string, row int")
    found = urls.judge(rows, urls.rule_table(spark, URL_RULES)).collect()
    assert {r.url: r.rule for r in found} == cases and len(found) == len(cases)
    assert sorted(r.row for r in found) == list(range(len(cases)))
    assert urls.judge(rows.limit(0), urls.rule_table(spark, URL_RULES)).collect() == []


def test_mined_rules(spark):
    """What labelled urls have in common decides others; a rule that adds nothing to a shorter one goes."""
    known = [(f"http://h{i}.bad.com/en/{i}", "block") for i in range(40)] + [(f"http://h{i}.fine.com/en/{i}", "allow") for i in range(40)]
    known += [(f"http://h{i}.mixed.com/{'de' if i % 2 else 'fr'}/{i}", "block" if i % 2 else "allow") for i in range(40)]
    labelled = spark.createDataFrame(known, "url string, verdict string")
    index = urls.mine(labelled.select(urls.tokens(F.col("url")).alias("tokens"), "verdict"), min_support=0.05)
    found = {(tuple(r.antecedent), r.verdict) for r in index.collect()}
    assert (("domain=bad.com",), "block") in found and (("directory=de",), "block") in found and (("domain=fine.com",), "allow") in found
    assert all(len(a) == 1 for a, _ in found)
    pages = spark.createDataFrame([(f"http://new.{d}.com/{p}/1?x=" + "y" * 50_000,) for d, p in (("bad", "en"), ("fine", "es"), ("mixed", "de"), ("unseen", "es"))] + [(None,)], "url string")
    got = urls.judge(pages, urls.rule_table(spark, [("block", "nowhere/")]), labelled, otherwise="none", min_support=0.05).collect()
    assert [(r.verdict, r.antecedent) for r in got if "bad" in (r.url or "")] == [("block", ["domain=bad.com"])]
    assert sorted(r.verdict for r in got) == ["allow", "block", "block", "none", "none"]
    nothing = urls.judge(pages, urls.rule_table(spark, URL_RULES), labelled.limit(0)).collect()
    assert {r.verdict for r in nothing} == {"allow"}
