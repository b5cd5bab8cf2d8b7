"""Gated sink."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rivulant.plans import files
from rivulant.plans.scratch import scratch_path

Gate = tuple[str, Column, Column]


def gate_rows(df: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """Add `gate` and `reason` of the first gate a row fails, both null when it passes all.

    A gate is (name, passes, reason).  Cheap gates go first: a later one is
    evaluated for rows that passed the earlier ones only.
    """
    failed = None
    for name, passes, reason in gates:
        why = F.struct(F.lit(name).alias("gate"), reason.alias("reason"))
        fails = ~F.coalesce(passes, F.lit(False))
        failed = F.when(fails, why) if failed is None else failed.when(fails, why)
    return df.withColumn("_f", failed).select(*df.columns, "_f.gate", "_f.reason")


def gated_write(df: DataFrame, gates: Sequence[Gate], ok_path: str, reject_path: str) -> None:
    """Passing rows to one table, the rest with gate and reason to another.

    The gates run once: rows are staged in the shared folder, partitioned by
    outcome, and both tables are written from there.  Each write is committed as
    a whole or not at all.
    """
    spark = df.sparkSession
    staging = scratch_path(spark, "gated")
    judged = gate_rows(df, gates).withColumn("_passed", F.col("gate").isNull())
    judged.write.partitionBy("_passed").parquet(staging)
    staged = spark.read.schema(judged.schema).parquet(staging)
    staged.filter("_passed").drop("_passed", "gate", "reason").write.mode("overwrite").parquet(ok_path)
    staged.filter("NOT _passed").drop("_passed").write.mode("overwrite").parquet(reject_path)
    files.delete(spark, staging)


def gated_commit(df: DataFrame, gates: Sequence[Gate], path: str) -> str:
    """Passing and rejected rows of one run as a pair that becomes visible at once; returns the run id.

    Both tables are written below the run's own folder in one pass, partitioned by outcome; the
    manifest that names the run is renamed into place last.  A run that dies before that leaves
    the pair of the run before; the next commit removes what it left, and runs before the last.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    judged = gate_rows(df, gates).withColumn("passed", F.col("gate").isNull())
    judged.write.partitionBy("passed").parquet(f"{path}/runs/{run}")
    before = committed_run(spark, path)
    files.put_text(spark, f"{path}/manifest", json.dumps({"run": run, "schema": judged.schema.jsonValue()}))
    for folder in files.children(spark, f"{path}/runs"):
        if folder not in (run, before):
            files.delete(spark, f"{path}/runs/{folder}")
    return run


def committed_run(spark: SparkSession, path: str) -> str | None:
    said = files.get_text(spark, f"{path}/manifest")
    return json.loads(said)["run"] if said else None


def read_gated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The passing and the rejected rows of the last committed run."""
    said = json.loads(files.get_text(spark, f"{path}/manifest") or "{}")
    if not said:
        raise ValueError(f"no run is committed under {path}")
    # `passed` is the partition column, so each side reads its own files only
    rows = spark.read.schema(StructType.fromJson(said["schema"])).parquet(f"{path}/runs/{said['run']}")
    return rows.filter("passed").drop("passed", "gate", "reason"), rows.filter("NOT passed").drop("passed")
