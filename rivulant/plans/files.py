"""Small file operations through Spark's own file systems, so that any store Spark reaches will do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none if it is missing."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a short text as a whole or not at all: it is renamed into place, replacing what was there."""
    part = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    fs, there = _at(spark, part)
    out = fs.create(there, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    # a rename that replaces its target in one step, where a delete and a rename would leave a moment without either
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    kind = getattr(hadoop, "Options$Rename")
    over = gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    target = fs.makeQualified(_at(spark, path)[1])
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(there), target, over)


def get_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one short file
