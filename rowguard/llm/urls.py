"""URL filters: a list of rules, and for the other URLs association rules mined from labelled ones.

DataFrame functions and Spark's FPGrowth only. A rule "example.net/en/" fits its host
and all hosts below it if the path starts with "/en/"; the longest that fits decides.

Every URL has at most eight tokens: scheme, top-level domain, domain, host, first
directory, ending, the names in its query, whether it has a fragment. FP-growth
finds the token sets that at least MIN_SUPPORT of the labelled URLs have together
with a verdict; a rule says the verdict if at least MIN_CONFIDENCE of the URLs
with its tokens have it. A rule goes if one with fewer of its tokens says the same
with no less confidence. As no URL has more than 2^8 token sets, there are no
more than 2^8 / MIN_SUPPORT sets, whatever the data.

Both kinds of rules are matched by an inverted index: a list rule stands under
its host, looked up by every end of a URL's host that is not longer than the longest
rule's; a mined rule stands under its rarest token, and the URLs with that token are
then asked for the others. Only row numbers, tokens and paths are shuffled, and
Spark broadcasts an index if its size allows. Of the mined rules that fit, the
most confident decides, then the one with more support, with more tokens, one that
blocks. Where none fits, `otherwise` does.

Null urls and those without "://" have an empty host and path and tokens like
others. Repeated urls are judged each; an empty table has no rows. With no labelled
urls nothing is mined. Very long urls are read whole. Other columns pass, except
that those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, named, numbered

MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
VERDICT = "verdict="

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _end(labels: Column, n: Column | int) -> Column:
    """The last `n` labels of a host."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n, F.lit(0)) + 1, n), ".")


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    own = F.coalesce(url, F.lit(""))
    labels, at = F.split(host(own), r"\."), path(own)
    query = F.regexp_extract(own, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))))
    ending = F.regexp_extract(at, r"(?s)(/|\.[^./]*)\z", 1)
    own = [
        ("scheme", F.translate(F.regexp_extract(own, r"(?s)^(.*?)://", 1), UPPER, LOWER)),
        ("tld", _end(labels, 1)),
        ("domain", _end(labels, 2)),
        ("host", host(own)),
        ("directory", F.regexp_extract(at, r"(?s)^/([^/]+)/", 1)),
        ("ending", ending),
        ("query", F.array_join(names, "&")),
        ("fragment", F.when(own.contains("#"), "yes").otherwise("no")),
    ]
    return F.array(*[F.concat(F.lit(name + "="), value) for name, value in own])


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """rule and verdict of (verdict, rule) pairs."""
    return spark.createDataFrame([(rule, verdict) for verdict, rule in rules], "rule string, verdict string")


def listed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule, verdict) of the longest of `rules` (rule, verdict) that fits, for each of `urls` (row, host, path) that one fits.

    Of rules of one length the greater one counts.
    """
    known = rules.select("rule", "verdict", F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("end"), F.regexp_extract("rule", r"(?s)^[^/]*(.*)", 1).alias("start"))
    most = known.agg(F.max(F.size(F.split("end", r"\.")))).first()[0] or 0
    if not most:
        return known.select(F.lit(0).cast("long").alias("row"), "rule", "verdict").limit(0)
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: _end(labels, n))
    hits = urls.select("row", "path", F.explode(ends).alias("end")).join(known, "end").filter(F.col("path").startswith(F.col("start")))
    best = hits.groupBy("row").agg(F.max(F.struct(F.length("rule").alias("length"), "rule", "verdict")).alias("best"))
    return best.select("row", "best.rule", "best.verdict")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The index of mined rules, from `labelled` (tokens, verdict): token, antecedent, verdict, confidence, support (of all labelled).

    The antecedent is sorted; the token is its rarest one, then the least.
    """
    known = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"))
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=parts).fit(known)
    says = F.col("consequent")[0]
    rules = model.associationRules.filter(says.startswith(VERDICT)).select(F.array_sort("antecedent").alias("antecedent"), F.substring(says, len(VERDICT) + 1, 1 << 30).alias("verdict"), "confidence", "support")
    rules = cut(rules)
    within = F.aggregate("antecedent", F.array(F.array().cast("array<string>")), lambda sets, t: F.concat(sets, F.transform(sets, lambda s: F.array_append(s, t))))
    fewer = F.filter(within, lambda s: (F.size(s) > 0) & (F.size(s) < F.size("antecedent")))
    better = rules.select(F.col("antecedent").alias("fewer"), "verdict", F.col("confidence").alias("theirs"))
    beaten = rules.select("antecedent", "verdict", "confidence", F.explode(fewer).alias("fewer")).join(better, ["fewer", "verdict"]).filter("theirs >= confidence")
    rules = rules.join(beaten.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti")
    often = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = rules.select("antecedent", F.explode("antecedent").alias("token")).distinct().join(often, "token").groupBy("antecedent").agg(F.min(F.struct("freq", "token"))["token"].alias("token"))
    return cut(rules.join(rarest, "antecedent").select("token", "antecedent", "verdict", "confidence", "support"))


def mined(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(row, verdict, confidence, antecedent) of the mined rule that decides, for each of `urls` (row, tokens) that one fits."""
    asked = urls.select("row", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    fits = asked.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    order = F.struct("confidence", "support", F.size("antecedent").alias("size"), (F.col("verdict") == "block").alias("blocks"), "verdict", "antecedent")
    return fits.groupBy("row").agg(F.max(order).alias("best")).select("row", "best.verdict", "best.confidence", "best.antecedent")


def judge(pages: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, url: str = "url", otherwise: str = "allow", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """`pages` with host, path, rule, verdict, and confidence and antecedent where a mined rule decides.

    Association rules are mined from `labelled` (url, verdict) or, without it, from the pages that a rule of the list
    fits, with its verdicts. Select the columns that you want first: they are joined by row number.
    """
    results = ["host", "path", "rule", "verdict", "confidence", "antecedent"]
    pages = pages.drop(*[c for c in pages.columns if c.lower() in results and c != url])
    rows, row = numbered(pages)
    urls = rows.select(named(row).alias("row"), host(named(url)).alias("host"), path(named(url)).alias("path"), tokens(named(url)).alias("tokens"))
    by_list = cut(urls.join(listed(urls, rules), "row", "left"))
    known = by_list.filter("verdict IS NOT NULL").select("tokens", "verdict") if labelled is None else labelled.select(tokens(F.col("url")).alias("tokens"), "verdict")
    by_rule = mined(by_list.filter("verdict IS NULL").select("row", "tokens"), mine(known, min_support, min_confidence))
    found = by_list.drop("tokens").withColumnRenamed("verdict", "listed").join(by_rule, "row", "left")
    found = found.select(F.col("row").alias(row), "host", "path", "rule", F.coalesce("listed", "verdict", F.lit(otherwise)).alias("verdict"), "confidence", "antecedent")
    return rows.join(found, row).drop(row)
