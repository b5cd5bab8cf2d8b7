"""Directory watch, processed-file state and the event sink."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rivulant.operators.telemetry import pending
from rivulant.plans import files as fs
from rivulant.plans.scan import range_rank
from rivulant.plans.scratch import scratch_path, settle
from rivulant.sources.corpus import list_files, read_corpus

STATE_SCHEMA = (
    "path string, mtime timestamp, size bigint, batch bigint, processed_at timestamp, "
    "status string, result string"
)


def watch_corpus(
    spark: SparkSession, path: str, glob: str = "*", max_files: int | None = None
) -> DataFrame:
    """Files as they arrive, one row (path, source, mtime, size) each.  For files that arrive once."""
    reader = (
        spark.readStream.format("text")
        .schema("value string")
        .option("wholetext", "true")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("source"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_size").alias("size"),
    )


def _generation(spark: SparkSession, state_path: str) -> int:
    """The newest complete generation of the state; one that a compaction did not finish does not count."""
    names = [n for n in fs.children(spark, state_path) if n.startswith("gen=")]
    whole = [n for n in names if fs.exists(spark, f"{state_path}/{n}/_SUCCESS")]
    return max((int(n.split("=")[1]) for n in whole), default=0)


def current_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The latest record of each file; the log is append-only between compactions."""
    log = spark.read.schema(STATE_SCHEMA).parquet(f"{state_path}/gen={_generation(spark, state_path)}")
    rest = F.struct("mtime", "size", "batch", "processed_at", "status", "result")
    return log.groupBy("path").agg(F.max_by(rest, F.struct("processed_at", "batch")).alias("s")).select("path", "s.*")


def init_state(spark: SparkSession, state_path: str) -> None:
    """Create an empty state log if there is none."""
    if not fs.exists(spark, f"{state_path}/gen=0/_SUCCESS") and not _generation(spark, state_path):
        spark.createDataFrame([], STATE_SCHEMA).write.mode("ignore").parquet(f"{state_path}/gen=0")


def compact_state(spark: SparkSession, state_path: str) -> int:
    """One row per path in a new generation, which counts once its success marker is there; older ones go.

    Run by the process that owns the state, between passes.
    """
    now = _generation(spark, state_path)
    current_state(spark, state_path).write.mode("overwrite").parquet(f"{state_path}/gen={now + 1}")
    for name in fs.children(spark, state_path):
        if name.startswith("gen=") and int(name.split("=")[1]) <= now:
            fs.delete(spark, f"{state_path}/{name}")
    return now + 1


def process_pending(
    spark: SparkSession,
    path: str,
    state_path: str,
    fn: Callable[[DataFrame], DataFrame],
    glob: str = "*",
    batch: int = 0,
    max_files: int = 10_000,
) -> int:
    """One pass over the directory; returns how many files were processed.

    The listing is a batch read, so an edited file counts as pending again; it reads no
    contents.  The first `max_files` pending files by name are admitted (a further pass takes
    the next ones) and exactly these are opened.  `fn` maps (path, source, mtime, size) rows to
    (path, status, result).  Files that cannot be read or decoded and other failures are
    recorded as errors and not tried again until the file changes.  State is appended after
    the work, so a pass that dies is repeated, not lost.
    """
    first = _waiting(spark, path, state_path, glob).orderBy("path").limit(max_files)
    return _admit(spark, state_path, settle(first.withColumn("batch", F.lit(batch).cast("bigint"))), fn)


def process_passes(
    spark: SparkSession,
    path: str,
    state_path: str,
    fn: Callable[[DataFrame], DataFrame],
    glob: str = "*",
    batch: int = 0,
    max_files: int = 10_000,
    at_once: int = 10_000,
) -> int:
    """All files pending now, in passes of `max_files` by name; returns how many passes they made.

    The records equal those of `process_pending` called with `batch`, `batch` + 1, … on a folder that
    rests.  The directory is listed once and ranked over all tasks; whole passes that make up
    `at_once` files (one pass at least) are opened together and recorded together, so a
    death repeats these alone.  What arrives after the listing is left to the next call.
    """
    together = max(1, at_once // max_files) * max_files
    place = F.col("_place") - 1
    ranked = range_rank(_waiting(spark, path, state_path, glob), ["path"], "_place").select(
        "path", "mtime", "size",
        (F.lit(batch) + F.floor(place / F.lit(max_files))).cast("bigint").alias("batch"),
        F.floor(place / F.lit(together)).cast("bigint").alias("part"),
    )
    plan = scratch_path(spark, "passes")
    ranked.write.partitionBy("part").parquet(plan)
    schema, done = ranked.drop("part").schema, 0
    parts = [n for n in fs.children(spark, plan) if n.startswith("part=")]
    for name in sorted(parts, key=lambda n: int(n.split("=")[1])):
        done += _admit(spark, state_path, spark.read.schema(schema).parquet(f"{plan}/{name}"), fn)
    fs.delete(spark, plan)
    return -(-done // max_files)


def _waiting(spark: SparkSession, path: str, state_path: str, glob: str) -> DataFrame:
    """(path, mtime, size) of the files that are new or changed since they were recorded."""
    init_state(spark, state_path)
    listing = list_files(spark, path, glob).select(
        "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")
    )
    return pending(listing, current_state(spark, state_path))


def _admit(spark: SparkSession, state_path: str, todo: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> int:
    """Open the files of `todo`, which is written already, and append what became of them to the state."""
    names = [r.path for r in todo.select("path").collect()]  # the caller bounds them
    if not names:
        return 0
    files = read_corpus(spark, [_escaped(n) for n in names], require_files=False)
    outcome = fn(files).select("path", "status", "result")
    record = todo.join(outcome, "path", "left").select(
        "path",
        "mtime",
        "size",
        "batch",
        F.current_timestamp().alias("processed_at"),
        F.coalesce("status", F.lit("error")).alias("status"),
        "result",
    )
    record.write.mode("append").parquet(f"{state_path}/gen={_generation(spark, state_path)}")
    return len(names)


def _escaped(path: str) -> str:
    """A path in which nothing is read as a pattern."""
    return re.sub(r"([\[\]{}*?\\\\])", r"\\\1", path)


def watch_pending(
    spark: SparkSession,
    path: str,
    state_path: str,
    fn: Callable[[DataFrame], DataFrame],
    glob: str = "*",
    interval: str = "30 seconds",
    checkpoint: str | None = None,
) -> StreamingQuery:
    """T2 on a timer: a rate source ticks, every tick runs `process_pending`."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def on_tick(_: DataFrame, batch: int) -> None:
        process_pending(spark, path, state_path, fn, glob, batch)

    return (
        ticks.writeStream.foreachBatch(on_tick)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "watch"))
        .trigger(processingTime=interval)
        .start()
    )


def stream_events(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """T4: append-only JSON log; the checkpoint makes each row appear once."""
    return (
        stream.writeStream.format("json")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
