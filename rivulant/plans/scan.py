"""Running values over ordered groups without putting a group into one task.

A plain window sorts a whole group inside one task, so one key holding a third
of the rows stalls the job.  Here a group is cut into chunks by a column that
never decreases along the order.  Windows run per (key, chunk); only one
summary row per chunk is carried along the group and joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulant.plans.scratch import settle

CHUNK = "_chunk"


def _join_carry(local: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of one carry row per (keys, chunk); null keys match each other."""
    on = [*keys, CHUNK]
    renamed = carry.select(
        *[F.col(k).alias(f"_c_{k}") for k in on],
        *[c for c in carry.columns if c not in on],
    )
    cond = [local[k].eqNullSafe(renamed[f"_c_{k}"]) for k in on]
    return local.join(renamed, cond, "left").drop(*[f"_c_{k}" for k in on])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    exclusive: bool = False,
    held: bool = False,
) -> DataFrame:
    """Add running sums, running maxima and previous-row values.

    `chunk` must not decrease along `order` inside a group; (keys, order) must
    be unique for a reproducible result.  With `exclusive` the running values
    cover the rows before the current one only.  Rows and chunk sums are both read from the
    input, which is therefore written once to the checkpoint folder.  An input that is `held` (columns and
    filters over files, or over a frame already written) is read twice instead, for the sums without
    the columns they do not need; it must give the same rows each time.
    """
    sums, maxes, previous = dict(sums or {}), dict(maxes or {}), dict(previous or {})
    keys, order = list(keys), list(order)
    base = df.withColumn(CHUNK, chunk)
    if not held:
        base = settle(base)
    part = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = part.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)

    local_cols, totals, carries, final = {}, [], [], {}
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    for name, expr in sums.items():
        local_cols[f"_l_{name}"] = F.sum(expr).over(upto)
        totals.append(F.sum(expr).alias(f"_t_{name}"))
        carries.append(F.sum(f"_t_{name}").over(before).alias(f"_p_{name}"))
        final[name] = F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.coalesce(
            F.col(f"_p_{name}"), F.lit(0)
        )
    for name, expr in maxes.items():
        local_cols[f"_l_{name}"] = F.max(expr).over(upto)
        totals.append(F.max(expr).alias(f"_t_{name}"))
        carries.append(F.max(f"_t_{name}").over(before).alias(f"_p_{name}"))
        final[name] = (
            F.when(F.col(f"_l_{name}").isNull(), F.col(f"_p_{name}"))
            .when(F.col(f"_p_{name}").isNull(), F.col(f"_l_{name}"))
            .otherwise(F.greatest(F.col(f"_l_{name}"), F.col(f"_p_{name}")))
        )
    for name, expr in previous.items():
        local_cols[f"_l_{name}"] = F.lag(F.struct(expr.alias("v"))).over(part)
        totals.append(
            F.max_by(F.struct(expr.alias("v")), F.struct(*order)).alias(f"_t_{name}")
        )
        carries.append(F.lag(f"_t_{name}").over(along).alias(f"_p_{name}"))
        final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_p_{name}"))["v"]

    local = base.withColumns(local_cols)
    carry = base.groupBy(*keys, CHUNK).agg(*totals).select(*keys, CHUNK, *carries)
    joined = _join_carry(local, carry, keys)
    return joined.select(*df.columns, *[e.alias(n) for n, e in final.items()])


def segmented_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    counters: Mapping[str, tuple[Column, Column]],
) -> DataFrame:
    """Counters that add `inc` on every row and fall back to zero before a `reset` row adds.

    `counters` maps a name to (inc, reset).  Inside a chunk the value is the
    running sum less its value just before the last reset; a chunk without a
    reset so far adds the value carried from the chunks before it.
    """
    keys, order = list(keys), list(order)
    marks = {}
    for name, (inc, reset) in counters.items():
        marks[f"_i_{name}"] = inc.cast("bigint")
        marks[f"_r_{name}"] = reset
    base = settle(df.withColumn(CHUNK, chunk).withColumns(marks))
    part = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = part.rowsBetween(Window.unboundedPreceding, 0)

    local = base.withColumns(
        {f"_s_{n}": F.sum(f"_i_{n}").over(upto) for n in counters}
    )
    local = local.withColumns(
        {
            f"_b_{n}": F.max(
                F.when(F.col(f"_r_{n}"), F.col(f"_s_{n}") - F.col(f"_i_{n}"))
            ).over(upto)
            for n in counters
        }
    )
    # Sums never decrease, so a maximum over resets is the value at the last reset.
    summary = local.groupBy(*keys, CHUNK).agg(
        *[F.sum(f"_i_{n}").alias(f"_t_{n}") for n in counters],
        *[F.max(f"_b_{n}").alias(f"_u_{n}") for n in counters],
    )
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    incl = along.rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumns({f"_g_{n}": F.sum(f"_t_{n}").over(incl) for n in counters})
    summary = summary.withColumns(
        {
            # global sum just before the last reset seen up to this chunk
            f"_h_{n}": F.max(
                F.when(
                    F.col(f"_u_{n}").isNotNull(),
                    F.col(f"_g_{n}") - F.col(f"_t_{n}") + F.col(f"_u_{n}"),
                )
            ).over(incl)
            for n in counters
        }
    )
    carry = summary.select(
        *keys,
        CHUNK,
        *[
            F.lag(F.col(f"_g_{n}") - F.coalesce(F.col(f"_h_{n}"), F.lit(0)))
            .over(along)
            .alias(f"_p_{n}")
            for n in counters
        ],
    )
    joined = _join_carry(local, carry, keys)
    final = [
        F.when(F.col(f"_b_{n}").isNotNull(), F.col(f"_s_{n}") - F.col(f"_b_{n}"))
        .otherwise(F.col(f"_s_{n}") + F.coalesce(F.col(f"_p_{n}"), F.lit(0)))
        .alias(n)
        for n in counters
    ]
    return joined.select(*df.columns, *final)


def with_halo(df: DataFrame, position: Column, width: int, before: int, after: int = 0) -> DataFrame:
    """Cut a line of integer positions into chunks that also hold their neighbours' edge rows.

    Adds `_chunk` and `_own`.  A row goes to its own chunk and, near an edge, as
    a guest to the chunk next door, so that a window reaching `before` positions
    back and `after` ahead is complete for own rows.  Needs width >= before, after.
    """
    if width < max(before, after, 1):
        raise ValueError("chunk width must not be smaller than the reach of the window")
    own = F.floor(position / F.lit(width)).cast("bigint")
    targets = F.array_distinct(
        F.array(
            own,
            F.floor((position + F.lit(before)) / F.lit(width)).cast("bigint"),
            F.floor((position - F.lit(after)) / F.lit(width)).cast("bigint"),
        )
    )
    return (
        df.withColumn("_home", own)
        .withColumn(CHUNK, F.explode(targets))
        .withColumn("_own", F.col("_home") == F.col(CHUNK))
        .drop("_home")
    )


def range_rank(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """Adds the 1-based place of each row in the order of all rows (ties in any order).

    Rows are dealt to sorted ranges; a range's offset comes from the counts of the ranges
    before it, so the only unkeyed window runs over one row per range.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = settle(placed.withColumns({"_pid": F.spark_partition_id(), "_row": row}))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(F.col("_pid").alias("_p")).agg(F.count("*").alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    joined = placed.join(offsets, F.col("_pid") == F.col("_p"))
    return joined.select(*df.columns, (F.col("_offset") + F.col("_row") + 1).cast("bigint").alias(name))
