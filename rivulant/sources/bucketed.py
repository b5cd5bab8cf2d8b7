"""A keyed table in hash buckets with copy-on-write versions.

A version is a short manifest that names, for each bucket, the version whose files hold it.  A
new version writes only the buckets it changes; the manifest is renamed into place last, so a
reader sees the old version or the whole new one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulant.plans import files

BUCKETS = 64


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that hold any of the rows' keys, `buckets` numbers at most."""
    return sorted(r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect())


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Bucket -> version of its files; nothing before the first version."""
    said = files.get_text(spark, f"{path}/manifest/version={version}")
    return {int(b): v for b, v in json.loads(said).items()} if said else {}


def read_version(spark: SparkSession, path: str, schema: str, version: int, only: list[int] | None = None) -> DataFrame | None:
    """The rows of a version, of the buckets `only` if given; None where there are none."""
    placed = manifest(spark, path, version)
    folders = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(placed.items()) if only is None or b in only]
    folders = [f for f in folders if files.exists(spark, f)]
    return spark.read.schema(schema).parquet(*folders) if folders else None


def write_version(rows: DataFrame, key: str, path: str, version: int, changed: list[int], buckets: int = BUCKETS) -> None:
    """Make `version` from the one before: `rows` are the whole new contents of the buckets `changed`.

    Writing a version again replaces it.
    """
    spark = rows.sparkSession
    split = rows.withColumn("bucket", bucket_of(key, buckets)).repartition(F.col("bucket"))
    split.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    placed = manifest(spark, path, version - 1) | {b: version for b in changed}
    files.put_text(spark, f"{path}/manifest/version={version}", json.dumps(placed))


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Keep the last versions; files that none of them names go."""
    numbers = sorted(int(n.split("=")[1]) for n in files.children(spark, f"{path}/manifest") if n.startswith("version="))
    used = {(v, b) for n in numbers[-keep:] for b, v in manifest(spark, path, n).items()}
    for n in numbers[:-keep]:
        files.delete(spark, f"{path}/manifest/version={n}")
    for folder in files.children(spark, f"{path}/data"):
        n = int(folder.split("=")[1])
        if numbers and n <= numbers[-1]:
            for part in files.children(spark, f"{path}/data/{folder}"):
                if part.startswith("bucket=") and (n, int(part.split("=")[1])) not in used:
                    files.delete(spark, f"{path}/data/{folder}/{part}")
