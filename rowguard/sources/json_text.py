"""JSON payloads as VARIANT, with what is no JSON set apart, and quarantine tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_of, is_whole, json_array, json_value
from ..operators.frame import with_validation


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Objects that name a key twice count as JSON, the last one holds. Spark refuses them by default."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """A line each: raw, payload (VARIANT, null if it is no JSON), is_json."""
    raw = spark.read.text(path).select(F.col("value").alias("raw"), json_array(F.col("value")).alias("parts"))
    return raw.select("raw", first_of(F.col("parts")).alias("payload"), is_whole(F.col("parts")).alias("is_json"))


def with_payload(frame: DataFrame, text: str, payload: str = "payload") -> DataFrame:
    return frame.withColumn(payload, json_value(F.col(text)))


def write_split(frame: DataFrame, schema, path: str, quarantine: str, **how) -> None:
    """Valid rows to `path`, the others with their errors to `quarantine`, both as Parquet. Rows are read and checked once."""
    flag = "_is_valid"
    while flag in frame.columns:
        flag += "_"
    checked = with_validation(frame, schema, valid=flag, **how).persist()
    checked.filter(flag).drop(flag, "errors").write.parquet(path)
    checked.filter(f"NOT {flag}").drop(flag).write.parquet(quarantine)
    checked.unpersist()
