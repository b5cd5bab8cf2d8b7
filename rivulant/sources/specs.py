"""Nested kernel specs with optional keys (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = "struct<x:bigint,y:bigint,z:bigint>"
SPEC_SCHEMA = (
    "kernel_name string, kernel_function string, description string, "
    "params array<struct<name:string,type:string,direction:string,size_expr:string,value:string>>, "
    f"launch struct<grid:{AXES},block:{AXES}>, "
    "input_setup struct<count:bigint,default_value:double>, "
    "output_readback struct<count:bigint,element_type:string,format:string>, "
    "reference_output string, dynamic_shared_mem string, port_mode string, "
    "self_contained boolean, deterministic boolean, auto_generated boolean, "
    "atol double, rtol double, tolerance struct<atol:double,rtol:double>"
)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """S3: one row per spec file or array element; absent keys are null, broken files are kept apart.

    `_corrupt` holds the text of a file that is no JSON; `good_specs` drops it.
    """
    return (
        spark.read.schema(f"{SPEC_SCHEMA}, _corrupt string")
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("pathGlobFilter", "*.json")
        .json(path)
    )


def parse_specs(df: DataFrame, column: str) -> DataFrame:
    """S3 for specs kept as text in a table."""
    keep = [c for c in df.columns if c != column]
    parsed = F.from_json(
        F.col(column),
        f"{SPEC_SCHEMA}, _corrupt string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    return df.withColumn("_spec", parsed).select(*keep, "_spec.*")


def good_specs(specs: DataFrame) -> DataFrame:
    return specs.filter("_corrupt IS NULL AND kernel_name IS NOT NULL").drop("_corrupt")


def spec_params(specs: DataFrame, *keys: str) -> DataFrame:
    """One row per parameter with its 1-based position."""
    keys = keys or ("kernel_name",)
    return specs.select(*keys, F.posexplode_outer("params").alias("_i", "p")).filter("_i IS NOT NULL").select(
        *keys, (F.col("_i") + 1).alias("position"), "p.*"
    )


def tolerances(specs: DataFrame, default_atol: float = 1e-5, default_rtol: float = 0.0) -> DataFrame:
    """Tolerance per kernel: the nested form wins over the flat one, then the defaults."""
    nested = F.col("tolerance").isNotNull()
    return specs.select(
        "kernel_name",
        F.coalesce(F.when(nested, F.col("tolerance.atol")).otherwise(F.col("atol")), F.lit(default_atol)).alias("atol"),
        F.coalesce(F.when(nested, F.col("tolerance.rtol")).otherwise(F.col("rtol")), F.lit(default_rtol)).alias("rtol"),
    )
