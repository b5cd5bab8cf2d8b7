"""Numeric table jobs over (idx, v) vectors and (c, y, x, v) grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulant.plans.scan import CHUNK, running, with_halo

RANGE_SIZE = 1_000_000


def vector_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise sum of two vectors on idx."""
    other = b.select("idx", F.col("v").alias("_w"))
    return a.join(other, "idx").select("idx", (F.col("v") + F.col("_w")).alias("v"))


def block_reduce(vec: DataFrame, block: int = 64, take: int | None = None) -> DataFrame:
    """Sum of each block; `take` keeps the first positions of a block only."""
    rows = vec if take is None else vec.filter(F.col("idx") % block < take)
    return rows.groupBy(F.floor(F.col("idx") / block).cast("bigint").alias("block")).agg(
        F.sum("v").alias("total")
    )


def prefix_sum(vec: DataFrame, range_size: int = RANGE_SIZE, held: bool = False) -> DataFrame:
    """Inclusive prefix sum of a whole vector.

    Each index range is summed by its own task; only one total per range meets
    in the ordered step.  `held`: see `running`.
    """
    return running(
        vec, [], ["idx"], F.floor(F.col("idx") / range_size).cast("bigint"),
        sums={"prefix": F.col("v")}, held=held,
    )


def block_scan(vec: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(scan inside each block, total of each block)."""
    blocked = vec.withColumn("block", F.floor(F.col("idx") / block).cast("bigint"))
    w = Window.partitionBy("block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    scanned = blocked.withColumn("scan", F.sum("v").over(w))
    totals = blocked.groupBy("block").agg(F.sum("v").alias("total"))
    return scanned, totals


def uniform_add(scanned: DataFrame, totals: DataFrame, blocks_per_range: int = RANGE_SIZE) -> DataFrame:
    """Add to each block the totals of all blocks before it."""
    offsets = running(
        totals, [], ["block"], F.floor(F.col("block") / blocks_per_range).cast("bigint"),
        sums={"offset": F.col("total")}, exclusive=True,
    ).drop("total")
    return scanned.join(offsets, "block").select(
        "idx", "block", (F.col("scan") + F.col("offset")).alias("prefix")
    )


def integral_image(grid: DataFrame, tile: int = RANGE_SIZE, held: bool = False) -> DataFrame:
    """Sum of all cells above and to the left, cell included; row scan, then column scan.  `held`: see `running`."""
    rows = running(
        grid, ["y"], ["x"], F.floor(F.col("x") / tile).cast("bigint"), sums={"row_sum": F.col("v")}, held=held
    )
    return running(
        rows, ["x"], ["y"], F.floor(F.col("y") / tile).cast("bigint"), sums={"area": F.col("row_sum")}
    )


def histogram(vec: DataFrame, bins: int, value: str = "v") -> DataFrame:
    """bin = v * bins truncated and clamped to the bins; empty bins have a row."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(float(bins - 1)), F.col(value) * F.lit(bins)))
    counts = vec.groupBy(F.floor(scaled).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = vec.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def softmax(vec: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """exp(v - max) / sum per group, stable.

    Maximum and sum are aggregates that combine before they are shuffled, so the
    vector itself stays where it is when the group table is small enough for AQE to
    broadcast; without keys that table is one row.
    """
    keys = list(keys)
    tops = vec.groupBy(*keys).agg(F.max(value).alias("_m"))

    def met(table: DataFrame) -> DataFrame:
        return vec.join(table, keys) if keys else vec.join(table, F.lit(True))

    sums = met(tops).groupBy(*keys).agg(F.first("_m").alias("_m"), F.sum(F.exp(F.col(value) - F.col("_m"))).alias("_s"))
    return met(sums).select(*vec.columns, (F.exp(F.col(value) - F.col("_m")) / F.col("_s")).alias("softmax"))


def transpose(grid: DataFrame, width: int, height: int, batch: str | None = None) -> DataFrame:
    """Swap the coordinates; `idx` is the flat position in the transposed layout."""
    offset = F.col(batch) * F.lit(width * height) if batch else F.lit(0)
    extra = [batch] if batch else []
    return grid.select(
        *extra,
        F.col("x").alias("y"),
        F.col("y").alias("x"),
        "v",
        (offset + F.col("x") * F.lit(height) + F.col("y")).cast("bigint").alias("idx"),
    )


def densify(grid: DataFrame, width: int, height: int, channels: int = 1) -> DataFrame:
    """Every cell of the grid once, absent cells as zero; built from one id range, no cross join."""
    i = F.col("id")
    base = grid.sparkSession.range(channels * width * height).select(
        F.floor(i / (width * height)).cast("bigint").alias("c"),
        F.floor(i % (width * height) / width).cast("bigint").alias("y"),
        (i % width).alias("x"),
        F.lit(0).alias("v"),
    )
    return base.unionByName(grid.select("c", "y", "x", "v")).groupBy("c", "y", "x").agg(F.sum("v").alias("v"))


def box_filter(
    grid: DataFrame, width: int, height: int, radius: int = 3, channels: int = 1, tile: int = 4096
) -> DataFrame:
    """Sum over the (2 * radius + 1)-square around each cell, zero outside, per channel.

    Separable: along x, then along y.  Rows and columns are cut into tiles with
    a halo of `radius` cells, so that a long row is shared by tasks.
    """
    out = densify(grid, width, height, channels)
    for axis, other in (("x", "y"), ("y", "x")):
        tiled = with_halo(out, F.col(axis), max(tile, radius), radius, radius)
        w = Window.partitionBy("c", other, CHUNK).orderBy(axis).rangeBetween(-radius, radius)
        out = tiled.withColumn("v", F.sum("v").over(w)).filter("_own").select("c", "y", "x", "v")
    return out


def initialised_reduce(vec: DataFrame, order: Column, init: Mapping[str, int] | None = None) -> DataFrame:
    """Order-free reductions that start from given values; `last` needs the explicit order.

    fixed start values: all zero, but 255 for the second and / xor.
    """
    start = {
        "count": 0, "minus": 0, "last": 0, "min": 0, "max": 0, "and": 0, "or": 0, "xor": 0,
        "and2": 0xFF, "or2": 0, "xor2": 0xFF, **(init or {}),
    }
    s = {k: F.lit(x).cast("bigint") for k, x in start.items()}
    v = F.col("v").cast("bigint")
    agg = vec.agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(v, order).alias("last"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.bit_and(v).alias("ba"),
        F.bit_or(v).alias("bo"),
        F.bit_xor(v).alias("bx"),
    )
    return agg.select(
        (s["count"] + F.col("n")).alias("count"),
        (s["minus"] - F.col("n")).alias("minus_count"),
        F.coalesce("last", s["last"]).alias("last"),
        F.least(s["min"], F.col("lo")).alias("min"),
        F.greatest(s["max"], F.col("hi")).alias("max"),
        s["and"].bitwiseAND(F.coalesce("ba", F.lit(-1))).alias("and"),
        s["or"].bitwiseOR(F.coalesce("bo", F.lit(0))).alias("or"),
        s["xor"].bitwiseXOR(F.coalesce("bx", F.lit(0))).alias("xor"),
        s["and2"].bitwiseAND(F.coalesce("ba", F.lit(-1))).alias("and2"),
        s["or2"].bitwiseOR(F.coalesce("bo", F.lit(0))).alias("or2"),
        s["xor2"].bitwiseXOR(F.coalesce("bx", F.lit(0))).alias("xor2"),
    )
