"""Corpus scan and line table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulant.functions.text import lines_of

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def list_files(spark: SparkSession, path: str | list[str], glob: str = "*", since: datetime | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the files under `path`; columns not selected are not read.

    With `since` only files changed then or later are opened; the source takes that
    condition itself.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
        .load(path)
    )
    return files if since is None else files.filter(F.col("modificationTime") >= F.lit(since))


def read_corpus(
    spark: SparkSession, path: str | list[str], glob: str = "*", require_files: bool = True, since: datetime | None = None
) -> DataFrame:
    """One row (path, source, mtime, size) per readable text file under `path`.

    Files that vanish, cannot be read or are no valid UTF-8 are dropped; an empty
    input is an error.  The listing alone decides emptiness, contents are not read.
    """
    files = list_files(spark, path, glob, since)
    if require_files and files.select("path").isEmpty():
        raise ValueError(f"no file matches {glob} under {path}")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(
        "path",
        text.alias("source"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
    ).filter("source IS NOT NULL")


def to_lines(corpus: DataFrame, text: str = "source") -> DataFrame:
    """(keys, line, text) with 1-based line numbers."""
    keep = [c for c in corpus.columns if c != text]
    return corpus.select(*keep, F.posexplode(lines_of(F.col(text))).alias("_i", "text")).select(
        *keep, (F.col("_i") + 1).alias("line"), "text"
    )
