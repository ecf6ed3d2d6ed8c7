"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontam, langid, licenses, lzprint, merkle, oracle, packing, pfor, quality, simhash, token_counts, urls
from .common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(remainder(3) != 1)
    found = quality.classify(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, remainder(4) != 2, ["doc_id", "lang"])
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    pfor.write_ids(table(spark, sf_dir, "documents"), path)
    return pfor.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_tokens", token_counts.over_limit(F.col("n_tokens")).alias("over_limit"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifiers found, as often as they are, by place; words inside them; the best coverage."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_found"),
        F.array_join(F.transform("found", lambda f: f["license"]), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda f: f["first_word"].cast("string")), ",").alias("first_words"),
        F.aggregate("found", F.lit(0).cast("long"), lambda n, f: n + f["n_words"]).alias("n_words"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["coverage"])), F.lit(0.0)).alias("coverage"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    whole = chat.format_conversations(rows.unionByName(more))
    turns = chat.parse(F.col("formatted"))
    loss = chat.under_mask(F.col("formatted"), F.col("loss_mask"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(simhash.fingerprints(table(spark, sf_dir, "documents"), shingle=3), bits=3)
    return found.select("doc_id", simhash.hex_of("fingerprint").alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lzprint.with_next(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


#: The list that pages are judged by.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = urls.judge(pages, urls.rule_table(spark, URL_RULES))
    return found.select("page_id", "host", "path", "rule", "verdict", "confidence", F.array_join("antecedent", " ").alias("mined"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    other = [F.translate("text", urls.UPPER, urls.LOWER) if c == "text" else F.col(c) for c in merkle.COLUMNS]
    changed = F.when(remainder(5) == 0, merkle.leaf(other))
    found = merkle.manifest(docs, carry={"tampered": changed})
    folded = found.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_token_files": op3_token_files,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_licenses": op6_licenses,
    "op7_chat": op7_chat,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_lz_fingerprints": op10_lz_fingerprints,
    "op11_url_filters": op11_url_filters,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op7_chat": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), turns AS (
            SELECT *, CASE WHEN contains(text, '###') OR contains(text, '</turn>') OR regexp_matches(text, '(?s)\\.')
                           THEN replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '#', '\#') ELSE text END AS body
            FROM rows
        ), conversations_ AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_text,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                   sum(length('### ' || role || ': ' || body || '</turn>' || chr(10))) AS formatted_chars
            FROM turns GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
               sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM conversations_
    """,
    "op11_url_filters": oracle.URL_FILTERS,
    "op12_merkle_manifest": oracle.merkle_manifest(),
    "op13_filter_audit": oracle.filter_audit(),
}
