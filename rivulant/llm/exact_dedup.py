"""Exact dedup against immutable snapshots screened by static binary-fuse filters.

A snapshot is a stored set of classes (digest, size, largest id) that never changes, cut
into buckets by digest.  Each bucket has one binary-fuse filter.  An incoming batch is
grouped by digest on its own; its distinct digests pass the filter of their bucket.  What
the filter rejects is a class of its own and never meets the snapshot; only positives are
joined with the exact bucket, and those whose bytes are the same too join the stored class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulant.llm.common import ascii_lower, written
from rivulant.plans.scratch import scratch_path, settle

BUCKET_KEYS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments and a 16-bit fingerprint for each 64-bit key."""
    with np.errstate(over="ignore"):
        h = keys ^ (np.uint64(seed) * _MIX)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
        g = (h * _MIX) ^ (h >> np.uint64(29))
    first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    mask = np.uint64(segment - 1)
    places = np.stack([
        first * segment + (h & mask).astype(np.int64),
        (first + 1) * segment + (g & mask).astype(np.int64),
        (first + 2) * segment + ((g >> np.uint64(24)) & mask).astype(np.int64),
    ])
    return places, ((g >> np.uint64(48)) ^ h).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, number of start segments, fingerprints) over distinct uint64 keys.

    Slots that one key alone uses are peeled in waves; fingerprints are then set in
    reverse, so that the three slots of every key xor to its fingerprint.
    """
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    size = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(size / segment) - 2)
    for seed in range(1, 1000):
        places, prints = _slots(keys, seed, segment, segments)
        total = (segments + 2) * segment
        uses = np.bincount(places.ravel(), minlength=total)
        which = np.zeros(total, np.int64)
        for row in places:
            np.bitwise_xor.at(which, row, np.arange(n))
        waves, left = [], n
        alone = np.flatnonzero(uses == 1)
        while len(alone):
            peeled, at = np.unique(which[alone], return_index=True)
            waves.append((peeled, alone[at]))
            left -= len(peeled)
            touched = places[:, peeled]
            np.subtract.at(uses, touched.ravel(), 1)
            np.bitwise_xor.at(which, touched.ravel(), np.tile(peeled, 3))
            near = np.unique(touched)
            alone = near[uses[near] == 1]
        if left == 0:
            table = np.zeros(total, np.uint16)
            for peeled, own in reversed(waves):
                a, b, c = table[places[:, peeled]]
                table[own] = a ^ b ^ c ^ table[own] ^ prints[peeled]
            return seed, segment, segments, table.tobytes()
        if seed % 8 == 0:
            segments += 1
    raise RuntimeError("no seed gives a filter; the keys are not distinct")


def probe_filter(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    places, prints = _slots(keys, seed, segment, segments)
    a, b, c = np.frombuffer(table, np.uint16)[places]
    return (a ^ b ^ c) == prints


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[8:16] for d in digests), ">u8").astype(np.uint64)


def snapshot_filters(entries: DataFrame) -> DataFrame:
    """One filter per bucket of a snapshot's (bucket, digest) rows; buckets are even, being cut by digest."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, table = build_filter(_keys(group["digest"]))
        return pd.DataFrame(
            {"bucket": [group["bucket"].iloc[0]], "seed": [seed], "segment": [segment], "segments": [segments], "table": [table]}
        )

    schema = "bucket long, seed int, segment int, segments int, table binary"
    return entries.select("bucket", "digest").groupBy("bucket").applyInPandas(build, schema)


def screen(entries: DataFrame, filters: DataFrame) -> DataFrame:
    """The (bucket, digest) rows that the filter of their bucket lets through: all that are in the snapshot, few others."""

    def test(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return mine.iloc[:0]
        f = theirs.iloc[0]
        hit = probe_filter(_keys(mine["digest"]), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["table"])
        return mine[hit]

    left = entries.select("bucket", "digest").groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInPandas(test, "bucket long, digest binary")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def arrival(doc_id: Column) -> Column:
    """The batch a document came in with where the table has none: 0 is the stored snapshot, 1 the new batch."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(2)), F.lit(0)).cast("int")


def _bucket(buckets: int) -> Column:
    """Buckets are cut by the digest's first bytes, which are even."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(buckets))


@dataclass
class Snapshot:
    """Stored classes (bucket, digest, n, top), the filter of every bucket that has any, and the number of buckets."""

    entries: DataFrame
    filters: DataFrame
    buckets: int


def save_snapshot(groups: DataFrame, path: str, bucket_keys: int = BUCKET_KEYS) -> None:
    """Store distinct classes (digest, n, top) and their filters below `path`, which must not exist yet."""
    spark = groups.sparkSession
    size = groups.agg(F.approx_count_distinct("digest")).first()[0]
    buckets = -(-size // bucket_keys) or 1
    groups.select(_bucket(buckets).alias("bucket"), "digest", "n", "top").write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries")
    snapshot_filters(entries).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")


def load_snapshot(spark: SparkSession, path: str) -> Snapshot:
    filters = spark.read.parquet(f"{path}/filters")
    size = filters.agg(F.max("buckets")).first()[0]  # one value for the whole snapshot
    return Snapshot(spark.read.parquet(f"{path}/entries"), filters.drop("buckets"), size or 1)


def _bytes_equal(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests of `pairs` (digest, old_id, new_id) whose two texts have the same normalised bytes."""
    wanted = pairs.select("digest", F.explode(F.array("old_id", "new_id")).alias("wanted")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    found = texts.join(wanted, F.col("_id").eqNullSafe(F.col("wanted"))).filter(
        F.unhex(F.sha2("_text", 256)) == F.col("digest")
    )
    return found.groupBy("digest").agg((F.min("_text") == F.max("_text")).alias("same")).filter("same").select("digest")


def meet(groups: DataFrame, snapshot: Snapshot, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored classes that a batch's classes (digest, n, top) join: digest, n and top of both sides.

    The filter decides who reaches the exact bucket.  `docs` holds the texts of both sides.
    """
    new = groups.withColumn("bucket", _bucket(snapshot.buckets))
    positive = screen(new, snapshot.filters).select(F.col("bucket").alias("_b"), F.col("digest").alias("_d"))
    positive = positive.join(new, (F.col("_b") == F.col("bucket")) & (F.col("_d") == F.col("digest"))).drop("_b", "_d")
    old = snapshot.entries.select("bucket", "digest", F.col("n").alias("old_n"), F.col("top").alias("old_id"))
    found = positive.join(old, ["bucket", "digest"]).select(
        "digest", F.col("n").alias("new_n"), F.col("top").alias("new_id"), "old_n", "old_id"
    )
    found = settle(found)
    return found.join(_bytes_equal(docs, found, id_col, text_col), "digest", "left_semi")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch: Column | None = None,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """Group equal texts; per row: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest doc_id stays (null ids last; a group of null ids only
    has a null keep_id).  Rows that repeat id and text are returned as often as they
    occur and the first stays.  `batch` tells stored rows (0) from new ones (1): the
    stored ones are saved as a snapshot in the shared folder, the new ones meet that.
    Needs columns `id_col` and `text_col` only; other columns are not read.
    """
    spark = docs.sparkSession
    batch = arrival(F.col(id_col)) if batch is None else batch
    rows = docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"), batch.alias("batch"))
    rows = settle(rows.groupBy("digest", "doc_id", "batch").agg(F.count("*").alias("n")))

    def groups(condition: str) -> DataFrame:
        return rows.filter(condition).groupBy("digest").agg(F.sum("n").alias("n"), F.max("doc_id").alias("top"))

    path = scratch_path(spark, "snapshot")
    save_snapshot(groups("batch = 0"), path, bucket_keys)
    snapshot = load_snapshot(spark, path)
    new = written(groups("batch <> 0"), "incoming")
    joined = settle(meet(new, snapshot, docs, id_col, text_col))
    met = joined.select(
        "digest", (F.col("old_n") + F.col("new_n")).alias("both_n"), F.greatest("old_id", "new_id").alias("both_top"),
    )
    # Only the classes that a positive joined change; every other class stays as its own side has it.
    sides = snapshot.entries.select("digest", F.lit(0).alias("side"), "n", "top").unionAll(
        new.select("digest", F.lit(1).alias("side"), "n", "top")
    )
    classes = sides.join(met, "digest", "left").select(
        F.col("digest").alias("_digest"), "side", F.coalesce("both_n", "n").alias("group_size"),
        F.coalesce("both_top", "top").alias("keep_id"),
    )
    side = F.when(F.col("batch") == 0, F.lit(0)).otherwise(F.lit(1))
    out = rows.join(classes, (F.col("digest") == F.col("_digest")) & (side == F.col("side")))
    copies = out.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    first = (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return copies.select("doc_id", "keep_id", "group_size", first.alias("kept"), "digest")
