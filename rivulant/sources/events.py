"""Append-only JSON event log (S4) and the report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "run bigint, seq bigint, ts timestamp_ntz, event string, state string, value double"
# Times keep their microseconds; the default JSON format cuts them to milliseconds.
TIME_FORMATS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def append_events(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; each call adds files and touches no old one."""
    df.write.mode("append").options(**TIME_FORMATS).json(path)


def read_events(
    spark: SparkSession, path: str, kind: str | None = None, schema: str = EVENT_SCHEMA
) -> DataFrame:
    """The log back, broken lines skipped, one event kind if asked for."""
    rows = (
        spark.read.schema(f"{schema}, _corrupt string")
        .options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", **TIME_FORMATS)
        .json(path)
    )
    good = rows.filter("_corrupt IS NULL").drop("_corrupt")
    return good if kind is None else good.filter(F.col("event") == kind)


def count_broken(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Good and broken lines of a log."""
    options = {"columnNameOfCorruptRecord": "_corrupt", **TIME_FORMATS}
    parsed = F.from_json("value", f"{schema}, _corrupt string", options)
    broken = parsed.isNull() | parsed["_corrupt"].isNotNull()
    return spark.read.text(path).agg(
        F.count_if(~broken).alias("good"), F.count_if(broken).alias("broken")
    )


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document per row (one row per run)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
