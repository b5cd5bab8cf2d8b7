"""Joins that survive hot keys.

The only broadcast hints are on tables whose size a parameter bounds; AQE broadcasts others on measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1024


def hot_keys(facts: DataFrame, on: Sequence[str], share: int = SHARE) -> DataFrame:
    """(_code, _copies): the keys that hold over one in `share` of all rows, so fewer than `share` of them.

    A key is given by its hash; one that collides with a hot key is dealt like it.  Its rows are
    to be cut in `_copies` parts, each of one in `share` of all rows; these add up to twice
    `share` at most.  Reads the key columns once, with counts per key added up before the shuffle.
    """
    counts = facts.groupBy(F.xxhash64(*on).alias("_code")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))  # one row against the counts
    hot = counts.join(F.broadcast(total), F.col("_n") * share > F.col("_total"))
    return hot.select("_code", F.ceil(F.col("_n") * share / F.col("_total")).cast("int").alias("_copies"))


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    share: int = SHARE,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join many fact rows to at most one `dim` row per key.

    Facts of a hot key are dealt to several partitions by a hash of the row, and the
    `dim` row of that key alone is repeated, so a key with a third of the facts is shared by
    many tasks and `dim` grows by twice `share` rows at most, whatever its size.  Facts equal in all
    columns stay together.  `hot` takes the `hot_keys` of the same key columns where `facts` is costly to read twice.
    """
    on = list(on)
    hot = F.broadcast(hot_keys(facts, on, share) if hot is None else hot)  # fewer than `share` rows of two numbers
    plain = [c for c, kind in facts.dtypes if "map<" not in kind]
    code = F.xxhash64(*on)
    left = facts.withColumn("_code", code).join(hot, "_code", "left")
    left = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(F.lit(1), *plain), F.col("_copies")), F.lit(0)).cast("int"))
    kinds = dict(facts.dtypes)  # equal numbers of two types have two hashes
    same = F.xxhash64(*[F.col(k).try_cast(kinds[k]) for k in on])
    right = dim.withColumn("_code", same).join(hot, "_code", "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)))
    return left.drop("_code", "_copies").join(right.drop("_code", "_copies"), [*on, "_salt"], how).drop("_salt")


def bucket_range_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    position: str,
    start: str,
    end: str,
    width: int,
    how: str = "left",
) -> DataFrame:
    """Join points to the intervals [start, end] that hold them, on equal `on` columns.

    Both sides meet on (on, floor(position / width)): a point has one bucket,
    an interval one per bucket it touches, so no pair is found twice and a large
    group is split over its buckets.
    """
    on = list(on)
    left = points.withColumn("_bucket", F.floor(F.col(position) / F.lit(width)).cast("bigint"))
    right = intervals.select(
        *[F.col(k).alias(f"_i_{k}") for k in on],
        *[c for c in intervals.columns if c not in on],
        F.explode(
            F.sequence(
                F.floor(F.col(start) / F.lit(width)).cast("bigint"),
                F.floor(F.col(end) / F.lit(width)).cast("bigint"),
            )
        ).alias("_i_bucket"),
    )
    cond: Column = F.col("_bucket") == F.col("_i_bucket")
    for k in on:
        cond = cond & (left[k] == right[f"_i_{k}"])
    cond = cond & F.col(position).between(F.col(start), F.col(end))
    return left.join(right, cond, how).drop("_i_bucket", *[f"_i_{k}" for k in on])


def _cover(start: Column, end: Column, levels: int) -> Column:
    """array<struct<level, slot>>: the dyadic slots that make up [start, end], two a level at most."""

    def at(k: Column) -> Column:
        low = -F.call_function("shiftright", -start, k)  # rounded up
        high = F.call_function("shiftright", end + 1, k) - 1
        left = F.when((low <= high) & (low % 2 != 0), F.struct(k.alias("level"), low.alias("slot")))
        right = F.when((low <= high) & (high % 2 == 0), F.struct(k.alias("level"), high.alias("slot")))
        return F.array(left, right)

    slots = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at))
    return F.filter(slots, lambda s: s.isNotNull())


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    position: str,
    start: str,
    end: str,
    how: str = "left",
    levels: int = 48,
) -> DataFrame:
    """Join points to the intervals [start, end] that hold them, on equal `on` columns; positions are integers.

    An interval is cut into dyadic slots, two a level at most, so one of a million positions has
    about forty keys; a point has one slot per level that any interval uses.  Slots of an interval
    do not overlap, so no pair is found twice, and a group is spread over its slots.  With `left`
    a point comes once per used level without a match, nulls on the right; group them again.
    Covers intervals of up to 2 ** `levels` positions.
    """
    on = list(on)
    right = intervals.select(
        *[F.col(k).alias(f"_i_{k}") for k in on], *[c for c in intervals.columns if c not in on],
        F.explode(_cover(F.col(start).cast("bigint"), F.col(end).cast("bigint"), levels)).alias("_i_slot"),
    )
    used = intervals.select(F.explode(_cover(F.col(start).cast("bigint"), F.col(end).cast("bigint"), levels)).alias("s"))
    used = sorted(r[0] for r in used.select("s.level").distinct().collect()) or [0]  # `levels` numbers at most
    slots = F.array(*[
        F.struct(F.lit(k).alias("level"), F.shiftright(F.col(position).cast("bigint"), k).alias("slot")) for k in used
    ])
    left = points.withColumn("_slot", F.explode(slots))
    cond = (F.col("_slot.level") == F.col("_i_slot.level")) & (F.col("_slot.slot") == F.col("_i_slot.slot"))
    for k in on:
        cond = cond & (left[k] == right[f"_i_{k}"])
    return left.join(right, cond, how).drop("_slot", "_i_slot", *[f"_i_{k}" for k in on])
