"""Store files: tolerant load (S5) and versioned save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulant.operators.store import STORE_SCHEMA, signature_digest

RAW_COLUMNS = (
    "signature", "sig_id", "verified_fix", "confidence", "llm_time_s",
    "times_retrieved", "failure_count", "verified", "metadata",
)


def clean_store(raw: DataFrame) -> DataFrame:
    """Text columns to typed ones.

    A row without a signature, with a number that does not parse or with broken
    metadata is skipped; absent values take their defaults; metadata that is
    JSON but no object counts as empty.
    """

    def number(name: str, kind: str):
        text = F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.lit("0"))
        return text.try_cast(kind)

    meta = F.coalesce(F.nullif(F.trim("metadata"), F.lit("")), F.lit("{}"))
    is_json = F.try_parse_json(meta).isNotNull()
    is_object = F.startswith(F.ltrim(meta), F.lit("{"))
    flag = F.coalesce(F.nullif(F.trim("verified"), F.lit("")), F.lit("1"))
    typed = raw.select(
        "signature",
        F.coalesce(F.nullif("sig_id", F.lit("")), signature_digest(F.col("signature"))).alias("sig_id"),
        F.coalesce("verified_fix", F.lit("")).alias("verified_fix"),
        number("confidence", "double").alias("confidence"),
        number("llm_time_s", "double").alias("llm_time_s"),
        number("times_retrieved", "bigint").alias("times_retrieved"),
        number("failure_count", "bigint").alias("failure_count"),
        (~F.lower(flag).isin("0", "false")).alias("verified"),
        F.when(is_object, F.from_json(meta, "map<string,string>"))
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("metadata"),
        is_json.alias("_json"),
    )
    numbers = ("confidence", "llm_time_s", "times_retrieved", "failure_count")
    ok = (F.coalesce("signature", F.lit("")) != "") & F.col("_json")
    for name in numbers:
        ok = ok & F.col(name).isNotNull()
    return typed.filter(ok).drop("_json")


def load_store(spark: SparkSession, path: str) -> DataFrame:
    """A store kept as CSV text with any damage, as a typed table."""
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    raw = spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").option(
        "escape", '"'
    ).csv(path)
    return clean_store(raw)


def save_version(store: DataFrame, path: str, version: int) -> None:
    """Write the whole store as one version; writing the same version again replaces it."""
    store.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """The store as of a version, None before the first one."""
    if version <= 0:
        return None
    return spark.read.schema(STORE_SCHEMA).parquet(f"{path.rstrip('/')}/version={version}")
