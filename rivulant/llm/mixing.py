"""Mixing sources to target weights along a curriculum.

Targets share a budget of words by weight, none above a cap (water filling).  Every
source has a weight schedule over training time; its integral is the source's
cumulative demand, and the documents of the source, laid out in a fixed pseudo-random
order, get the time at which demand reaches them.  Sorting by time gives the stream.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulant.llm.common import WORD, text_hash
from rivulant.plans.scratch import settle

#: (time, weight) knots of each schedule, dealt to the sources in turn; linear in between.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)
CHUNK_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Water filling over one row per source (source, source_size): adds rank and target.

    Sources in code point order, null last, take the weights in turn.  With the
    sources sorted by the level at which each is full, the first k are full and the
    others share what is left by weight; the smallest k that leaves nobody above the
    cap is the answer.  The window without keys holds one short row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    choices = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(choices, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = ranked.withColumns({
        "budget": F.sum("source_size").over(whole) * F.lit(float(share)),
        "spent": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(after),
    })
    rate = (F.col("budget") - F.col("spent")) / F.col("open")
    # with too many sources taken as full the rate falls, so the first that fits is the highest; none fits when all are full
    filled = filled.withColumn("rate", F.max(F.when(rate * F.col("weight") <= F.col("limit"), rate)).over(whole))
    target = F.least(F.coalesce(F.col("rate") * F.col("weight"), F.col("limit")), F.col("limit"))
    return filled.select("source", "source_size", "rank", target.alias("target"))


def time_of(demand: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a schedule, scaled to one, reaches `demand`."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, done, out = math.fsum(areas), 0.0, None
    for area, (t0, w0), (t1, w1) in zip(areas, knots, knots[1:]):
        slope = (w1 - w0) / (t1 - t0)
        rest = F.greatest(demand * total - done, F.lit(0.0))
        # w0 * x + slope * x^2 / 2 = rest, in the form that also holds for a flat piece
        x = 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
        here = F.lit(t0) + F.least(x, F.lit(t1 - t0))
        out = here if out is None else F.when(demand * total <= done, out).otherwise(here)
        done += area
    return out


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    seed: str = "mix",
) -> DataFrame:
    """Per row: doc_id, text_hash, source, size, source_size, target, taken, positions.

    `taken` is the number of words the mix takes of the row, repeats counted, and
    `positions` has one struct (pass, words, position) per time the row is taken;
    position is a time in [0, 1].  Demand runs through the source's documents from the
    start and again from the start, so the words taken of a source are its target
    rounded, and the document at the end gives its first words only.  Null texts have
    size zero, are never taken and have no positions; a null source is a source.
    Order inside a source: MD5 of seed and id, then id, then text hash; rows equal in
    all these are interchangeable.  Reruns agree.

    The order key's first hex digits cut a source into chunks; running sums are taken
    within a chunk and carried over one summary row per chunk, so that a source
    with a third of all rows is not sorted in one task.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        text_hash(F.col(text_col)).alias("text_hash"),
        word_count(F.col(text_col)).alias("size"),
    )
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    base = settle(base.withColumn("key", key).withColumn("chunk", F.substring("key", 1, CHUNK_DIGITS)))
    chunks = settle(base.groupBy("source", "chunk").agg(F.sum("size").alias("words")))
    goals = targets(chunks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    along = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        F.col("source").alias("c_source"), F.col("chunk").alias("c_chunk"),
        F.coalesce(F.sum("words").over(along), F.lit(0)).alias("carried"),
    )
    goals = goals.select(F.col("source").alias("g_source"), "source_size", "rank", "target")
    carried = carried.join(goals, F.col("c_source").eqNullSafe(F.col("g_source"))).drop("g_source")

    inside = Window.partitionBy("source", "chunk").orderBy("key", "doc_id", "text_hash")
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = base.withColumn("until", F.sum("size").over(inside))
    placed = placed.join(
        carried, placed["source"].eqNullSafe(F.col("c_source")) & (placed["chunk"] == F.col("c_chunk"))
    )
    begins = F.col("carried") + F.col("until") - F.col("size")
    wanted = F.round("target").cast("long")
    takes = []
    for turn in range(math.ceil(cap)):
        at = begins + F.col("source_size") * turn
        words = F.greatest(F.least(wanted - at, F.col("size")), F.lit(0)).cast("long")
        demand = F.try_divide(at.cast("double"), F.col("target"))
        time = time_of(demand, schedules[-1])
        for i, knots in enumerate(schedules[:-1]):
            time = F.when(F.col("rank") % len(schedules) == i, time_of(demand, knots)).otherwise(time)
        takes.append(F.struct(F.lit(turn + 1).alias("pass"), words.alias("words"), time.alias("position")))
    placed = placed.withColumn("positions", F.filter(F.array(*takes), lambda p: p["words"] > 0))
    taken = F.aggregate("positions", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    return placed.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.alias("taken"), "positions")


def stream(mixed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed documents in training order: the columns of `docs`, a row per pass.

    A document taken in part keeps its first words with the blanks before and between
    them.  Rows that repeat id and text have as many sets of positions as they are.
    The order is by position, over range partitions.
    """
    key = F.struct(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"))
    takes = mixed.select(F.struct("doc_id", "text_hash").alias("_row"), F.col("size").alias("_size"), F.explode("positions").alias("_p"))
    left = docs.withColumn("_key", key).dropDuplicates(["_key"])
    met = left.join(takes, F.col("_key") == F.col("_row"))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_p.words").cast("int")), "")
    text = F.when(F.col("_p.words") < F.col("_size"), cut).otherwise(F.col(text_col))
    met = met.withColumn(text_col, text)
    order = ["_p.position", "_key", "_p.pass"]
    return met.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
