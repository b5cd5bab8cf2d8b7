"""Signature store: fingerprints, lookup, ordered merge, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.functions.text import short_digest
from rivulant.operators.findings import normal_name, normal_severity
from rivulant.plans.joins import lookup_join
from rivulant.plans.scan import running
from rivulant.rules import Rule

STORE_SCHEMA = (
    "signature string, sig_id string, verified_fix string, confidence double, "
    "llm_time_s double, times_retrieved bigint, failure_count bigint, verified boolean, "
    "metadata map<string,string>"
)


def serialize_pairs(pairs: Column) -> Column:
    """`name:SEVERITY` joined by bars from an array of sorted (name, severity) structs."""
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(p["name"], F.lit(":"), p["severity"])), "|"
    )


def signature_digest(key: Column) -> Column:
    return short_digest(key, 16)


def signature(findings: DataFrame, key: str = "path") -> DataFrame:
    """A7 from a findings table.  A group keeps distinct pairs only, at most one per rule and severity."""
    pair = F.struct(
        normal_name(F.col("rule")).alias("name"), normal_severity(F.col("severity")).alias("severity")
    )
    text = serialize_pairs(F.array_sort(F.collect_set(pair)))
    return (
        findings.groupBy(key)
        .agg(text.alias("signature"))
        .withColumn("digest", signature_digest(F.col("signature")))
    )


def signature_of_corpus(corpus: DataFrame, rules: Sequence[Rule], text: str = "source") -> DataFrame:
    """A7 straight from texts, map-only: a pair per rule that hits; empty without findings."""
    ordered = sorted(rules, key=lambda r: (r.name, r.severity))
    pairs = F.array(
        *[
            F.when(
                F.col(text).rlike(r.pattern),
                F.concat(
                    normal_name(F.lit(r.name)), F.lit(":"), normal_severity(F.lit(r.severity))
                ),
            )
            for r in ordered
        ]
    )
    keep = [c for c in corpus.columns if c != text]
    return corpus.select(*keep, F.array_join(F.array_compact(pairs), "|").alias("signature")).withColumn(
        "digest", signature_digest(F.col("signature"))
    )


def parse_signature(key: Column) -> Column:
    """array<struct<name, severity>> from the serialized key, normalised, sorted, distinct."""
    tokens = F.filter(F.split(key, r"\|"), lambda t: t != "")
    pairs = F.transform(
        tokens,
        lambda t: F.struct(
            normal_name(F.split_part(t, F.lit(":"), F.lit(1))).alias("name"),
            normal_severity(F.regexp_replace(t, r"(?s)^[^:]*:?", "")).alias("severity"),
        ),
    )
    return F.array_sort(F.array_distinct(pairs))


def servable() -> Column:
    """Only a verified entry with a fix is ever served."""
    return F.col("verified") & (F.coalesce("verified_fix", F.lit("")) != "")


def lookup(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Exact-key lookup; an empty signature is a miss.

    The store has one row per signature, requests may repeat one signature
    without bound; only rows of such signatures are repeated in the store.
    """
    served = store.filter(servable() & (F.col("signature") != "")).select(
        "signature",
        F.col("verified_fix").alias("fix"),
        F.col("confidence").alias("fix_confidence"),
    )
    return lookup_join(requests, served, ["signature"]).withColumn("hit", F.col("fix").isNotNull())


def count_retrievals(store: DataFrame, lookups: DataFrame) -> DataFrame:
    """Raise `times_retrieved` by the hits; hits are counted per key before the join."""
    hits = lookups.filter("hit").groupBy("signature").agg(F.count(F.lit(1)).alias("_hits"))
    return store.join(hits, "signature", "left").withColumn(
        "times_retrieved", F.col("times_retrieved") + F.coalesce("_hits", F.lit(0))
    ).select(*store.columns)


BATCH_COLUMNS = (
    "signature", "seq", "negative", "fix", "confidence", "llm_time_s", "verified", "metadata", "error",
)


def _as_batch(store: DataFrame) -> DataFrame:
    """Existing entries as the earliest row of their key (`_seq` below every batch row)."""
    return store.select(
        "signature",
        F.lit(0).alias("_gen"),
        F.lit(0).cast("bigint").alias("seq"),
        F.lit(False).alias("negative"),
        F.col("verified_fix").alias("fix"),
        "confidence",
        "llm_time_s",
        "verified",
        "metadata",
        F.lit(None).cast("string").alias("error"),
        "times_retrieved",
        "failure_count",
    )


def merge_store(store: DataFrame | None, batch: DataFrame, seq_per_chunk: int = 1_000_000) -> DataFrame:
    """Fold an ordered batch into the store.

    `batch` has BATCH_COLUMNS with `seq` unique per signature; a `negative` row
    reports a failed attempt.  A row is accepted when (verified, confidence) is
    not below the running maximum of earlier rows, so the surviving fix is the
    maximum of (verified, confidence, order): a plain aggregate.  Only merged
    metadata needs to know which rows were accepted; that running maximum is
    chunked by `seq`, and map entries are reduced per (signature, entry key).
    """
    rows = batch.select(
        "signature", F.lit(1).alias("_gen"), "seq", "negative", "fix",
        F.bround(F.col("confidence").cast("double"), 4).alias("confidence"),
        F.bround(F.col("llm_time_s").cast("double"), 3).alias("llm_time_s"),
        "verified", "metadata", "error",
        F.lit(0).cast("bigint").alias("times_retrieved"),
        F.col("negative").cast("bigint").alias("failure_count"),
    ).filter(F.col("signature").isNotNull() & (F.col("signature") != ""))
    if store is not None:
        rows = _as_batch(store).unionByName(rows)

    order = F.struct("_gen", "seq")
    standing = F.struct("verified", "confidence", order.alias("ord"))
    offered = ~F.col("negative")
    # A negative row that opens its key leaves a placeholder (unverified, confidence 0).
    placeholder = F.struct(F.lit(False).alias("verified"), F.lit(0.0).alias("confidence"))
    last = F.max_by(F.struct("fix", "confidence", "llm_time_s", "verified"), F.when(offered, standing))
    heads = rows.groupBy("signature").agg(
        last.alias("top"),
        F.min_by("negative", order).alias("opened_negative"),
        F.sum("failure_count").cast("bigint").alias("failure_count"),
        F.max("times_retrieved").cast("bigint").alias("times_retrieved"),
    )
    # The placeholder outranks nothing but a row of lower standing, which stays rejected.
    lost = F.col("top").isNull() | (
        F.col("opened_negative")
        & (F.struct("top.verified", "top.confidence") < placeholder)
    )
    zero = F.lit(0.0)
    heads = heads.select(
        "signature",
        F.when(lost, F.lit("")).otherwise(F.coalesce("top.fix", F.lit(""))).alias("verified_fix"),
        F.when(lost, zero).otherwise(F.col("top.confidence")).alias("confidence"),
        F.when(lost, zero).otherwise(F.coalesce("top.llm_time_s", zero)).alias("llm_time_s"),
        "times_retrieved",
        "failure_count",
        F.when(lost, F.lit(False)).otherwise(F.col("top.verified")).alias("verified"),
    )

    meta = _merged_metadata(rows, seq_per_chunk)
    empty_map = F.create_map().cast("map<string,string>")
    return heads.join(meta, "signature", "left").select(
        "signature",
        signature_digest(F.col("signature")).alias("sig_id"),
        "verified_fix", "confidence", "llm_time_s", "times_retrieved", "failure_count", "verified",
        F.coalesce("metadata", empty_map).alias("metadata"),
    )


def _merged_metadata(rows: DataFrame, seq_per_chunk: int) -> DataFrame:
    """Last value per (signature, entry key) over accepted rows, plus the last error of negatives."""
    slim = rows.select(
        "signature", "_gen", "seq", "negative", "verified", "confidence", "metadata", "error"
    )
    standing = F.struct("verified", "confidence")
    slim = slim.withColumn("_standing", F.when(~F.col("negative"), standing))
    # The greatest (-order, negative) of the rows before is the opening row of the key.
    opening = F.struct((-F.col("_gen")).alias("g"), (-F.col("seq")).alias("s"), "negative")
    chunk = F.struct("_gen", F.floor(F.col("seq") / F.lit(seq_per_chunk)).alias("c"))
    ranked = running(
        slim, ["signature"], ["_gen", "seq"], chunk,
        maxes={"_best": F.col("_standing"), "_opening": opening}, exclusive=True,
    )
    placeholder = F.struct(F.lit(False).alias("verified"), F.lit(0.0).alias("confidence"))
    opened_negative = F.coalesce("_opening.negative", F.lit(False))
    accepted = (
        ~F.col("negative")
        & (F.col("_best").isNull() | (F.col("_standing") >= F.col("_best")))
        & (~opened_negative | (F.col("_standing") >= placeholder))
    )
    said = F.when(accepted, F.map_entries("metadata")).when(
        F.col("negative") & (F.coalesce("error", F.lit("")) != ""),
        F.array(F.struct(F.lit("last_error").alias("key"), F.col("error").alias("value"))),
    )
    entries = ranked.select("signature", "_gen", "seq", F.inline(said).alias("key", "value"))
    return (
        entries.groupBy("signature", "key")
        .agg(F.max_by("value", F.struct("_gen", "seq")).alias("value"))
        .groupBy("signature")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    )


def store_stats(store: DataFrame, lookups: DataFrame) -> DataFrame:
    """One row; average confidence covers every entry, served or not."""
    left = store.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(servable()).alias("served_entries"),
        F.coalesce(F.sum("times_retrieved"), F.lit(0)).cast("bigint").alias("retrievals"),
        F.coalesce(F.bround(F.avg("confidence"), 4), F.lit(0.0)).alias("avg_confidence"),
    )
    hits, misses = F.count_if(F.col("hit")), F.count_if(~F.col("hit"))
    right = lookups.agg(
        hits.alias("hits"),
        misses.alias("misses"),
        F.coalesce(F.bround(F.try_divide(hits, hits + misses), 3), F.lit(0.0)).alias("hit_rate"),
    )
    return left.join(right, F.lit(True), "inner")
