"""Running counters, store merge and stagnation over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rivulant.operators.diagnostics import ITERATIONS_PER_CHUNK, iteration_trend, trend_state
from rivulant.operators.store import STORE_SCHEMA, merge_store
from rivulant.plans import files
from rivulant.plans.scratch import settle
from rivulant.rules import Rule
from rivulant.rules.diagnostics import CYCLE_REACH, PLATEAU_LIMIT, STAGNATION_LIMIT
from rivulant.sources import bucketed


def stream_rule_counts(stream: DataFrame, rules: Sequence[Rule], text: str = "source") -> DataFrame:
    """Matches per rule over all arrivals so far, zeros included, and texts scanned.

    Each text yields one small row per rule; the state is one counter per rule.
    """
    counted = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.regexp_count(F.col(text), F.lit(r.pattern)).cast("bigint").alias("n"),
            )
            for r in rules
        ]
    )
    return stream.select(F.inline(counted)).groupBy("rule").agg(
        F.sum("n").alias("n_matches"), F.count(F.lit(1)).alias("scanned")
    )


def reset_rule_counts(stream: DataFrame, resets: DataFrame, rules: Sequence[Rule], seq: str, text: str = "source") -> DataFrame:
    """Counters that start anew at every reset: (epoch, rule, n_matches, scanned) of every epoch.

    `resets` is the control table with a column `seq`: the first arrival that the new epoch
    counts.  It is read again for each batch and must have a reset before that arrival does.
    The epoch is part of the state's key, so a counter restarts without touching the old one;
    `current_counts` takes the last epoch.  The resets are few and meet each batch as one row.
    """
    marks = resets.agg(F.array_sort(F.collect_set("seq")).alias("_marks"))
    dated = stream.join(F.broadcast(marks), F.lit(True)).withColumn(  # one row against the stream
        "epoch", F.size(F.filter("_marks", lambda m: m <= F.col(seq)))
    )
    counted = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.regexp_count(F.col(text), F.lit(r.pattern)).cast("bigint").alias("n"))
            for r in rules
        ]
    )
    return dated.select("epoch", F.inline(counted)).groupBy("epoch", "rule").agg(
        F.sum("n").alias("n_matches"), F.count(F.lit(1)).alias("scanned")
    )


def current_counts(counts: DataFrame) -> DataFrame:
    """The counters of the last epoch that counted anything."""
    last = counts.agg(F.max("epoch").alias("epoch"))
    return counts.join(last, "epoch", "left_semi").drop("epoch")


def to_versions(stream: DataFrame, path: str, checkpoint: str, keep: int = 3, **trigger) -> StreamingQuery:
    """Write the complete result of each batch as its own version; a repeated batch replaces it.

    The last `keep` versions stay.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        for name in files.children(batch.sparkSession, path):
            if name.startswith("batch=") and int(name.split("=")[1]) <= number - keep:
                files.delete(batch.sparkSession, f"{path}/{name}")

    return (
        stream.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last batch `to_versions` wrote."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(last, "batch", "left_semi").drop("batch")


def stream_merge_store(
    stream: DataFrame, store_path: str, checkpoint: str, buckets: int = bucketed.BUCKETS, keep: int = 2, **trigger
) -> StreamingQuery:
    """T5: fold each micro-batch into the store; version k + 1 is version k merged with batch k.

    The store is kept in buckets by signature: a batch reads and writes the buckets its keys
    are in and leaves the files of all others.  A batch that is run again reads the same
    version and writes the same one; the last `keep` versions stay.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = settle(batch)  # the merge reads its batch more than once
        changed = bucketed.touched(held, "signature", buckets)
        current = bucketed.read_version(spark, store_path, STORE_SCHEMA, number, changed)
        bucketed.write_version(merge_store(current, held), "signature", store_path, number + 1, changed, buckets)
        bucketed.expire(spark, store_path, keep)

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_store(spark: SparkSession, store_path: str, version: int) -> DataFrame | None:
    """The store as of a version `stream_merge_store` wrote."""
    return bucketed.read_version(spark, store_path, STORE_SCHEMA, version)


STATE_SCHEMA = "run bigint, iteration bigint, n_errors bigint, error_set string, seed_stagnation bigint, seed_plateau bigint"


def stream_trend(
    stream: DataFrame, path: str, state_path: str, checkpoint: str, buckets: int = bucketed.BUCKETS,
    rows_per_chunk: int = ITERATIONS_PER_CHUNK, **trigger
) -> StreamingQuery:
    """The trend of each run as its iterations arrive in order, equal to the batch trend; batch k goes to `path`/batch=k.

    Between batches a run is four rows and two counters, kept in buckets by run, of which a batch
    reads and writes those it needs.  Inside a batch a run is cut into chunks like in the batch
    trend, so a run with any number of new iterations is shared by many tasks.
    """

    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = settle(batch.select("run", "iteration", F.col("n_errors").cast("bigint").alias("n_errors"), "error_set"))
        changed = bucketed.touched(fresh, "run", buckets)
        before = bucketed.read_version(spark, state_path, STATE_SCHEMA, number, changed)
        rows = fresh.withColumns({c: F.lit(None).cast("bigint") for c in ("seed_stagnation", "seed_plateau")})
        rows = settle(rows if before is None else before.unionByName(rows))
        trend = settle(iteration_trend(rows, rows_per_chunk, held=True))
        trend.write.mode("overwrite").parquet(f"{path}/batch={number}")
        bucketed.write_version(trend_state(rows, trend), "run", state_path, number + 1, changed, buckets)
        bucketed.expire(spark, state_path)

    return (
        stream.writeStream.foreachBatch(advance)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


TREND_SCHEMA = (
    "run bigint, iteration bigint, n_errors bigint, error_set string, delta bigint, cycle boolean, "
    "stagnation bigint, plateau bigint, state string"
)


def _trend(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Advance one run by its new iterations; the state is five small values."""
    if state.hasTimedOut:
        state.remove()
        return
    if state.exists:
        count, history, stagnation, plateau = json.loads(state.get[0])
    else:
        count, history, stagnation, plateau = 0, [], 0, 0
    rows = pd.concat(list(frames)).sort_values("iteration")
    out = []
    for row in rows.itertuples():
        if row.iteration == 0:
            count, history, stagnation, plateau = int(row.n_errors), [], 0, 0
            continue
        if not row.n_errors:
            continue
        delta = count - int(row.n_errors)
        cycle = row.error_set in history[-CYCLE_REACH:]
        again = bool(history) and history[-1] == row.error_set
        stagnation = (stagnation + 1 if delta <= 0 else 0) + (2 if cycle else 0)
        plateau = plateau + 1 if again else 0
        count = int(row.n_errors)
        history = [*history[-CYCLE_REACH + 1 :], row.error_set]
        label = (
            "stagnant" if stagnation >= STAGNATION_LIMIT
            else "plateau" if plateau >= PLATEAU_LIMIT
            else "improving" if delta > 0
            else "slow"
        )
        out.append(
            (key[0], row.iteration, row.n_errors, row.error_set, delta, cycle, stagnation, plateau, label)
        )
    state.update((json.dumps([count, history, stagnation, plateau]),))
    columns = [c.split()[0] for c in TREND_SCHEMA.split(", ")]
    yield pd.DataFrame(out, columns=columns)


def stream_stagnation(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """T6 in keyed state, for short runs: a run's rows of a batch are sorted in one frame; `stream_trend` has no such limit.

    `stream` has (run, iteration, n_errors, error_set).  With `idle_ms`, the
    state of a run without news for that long is dropped; such a query keeps
    ticking, so start it with a processing-time trigger, not with availableNow.
    """

    def advance(key, frames, state):
        yield from _trend(key, frames, state)
        if idle_ms is not None and state.exists:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("run").applyInPandasWithState(
        advance, TREND_SCHEMA, "memo string", "append", timeout
    )
