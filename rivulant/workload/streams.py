"""Streaming queries: T1-T6.  Each runs to the end of its input and returns what it wrote."""

from pyspark.sql import functions as F

from rivulant.plans import files as fs
from rivulant.plans.scratch import scratch_path
from rivulant.rules.portable import TEXT_RULES
from rivulant.sources.events import read_events
from rivulant.streaming import monitors, watch
from rivulant.workload import views as v
from rivulant.workload.files import stage_texts
from rivulant.workload.logs import _TREND
from rivulant.workload.registry import query


def _stream(spark, sf, name):
    """A table as a stream of its rows, be it one file or a folder of files."""
    path = f"{sf}/{name}.parquet"
    reader = spark.readStream.schema(v.table(spark, sf, name).schema)
    if fs.is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)  # a stream starts at a folder


def _in_pieces(df, column, pieces, start):
    """Write `df` in ranges of `column`, lowest first, and after each run a stream over the folder to its end."""
    spark = df.sparkSession
    whole, path = scratch_path(spark, "whole"), scratch_path(spark, "pieces")
    df.write.parquet(whole)
    staged = spark.read.schema(df.schema).parquet(whole)
    span = staged.agg(F.max(column)).first()[0] + 1
    piece = F.floor(F.col(column) * pieces / span)
    for i in range(pieces):
        staged.filter(piece == i).write.mode("append").parquet(path)
        run = start(spark.readStream.schema(df.schema).parquet(path))
        run.awaitTermination()
    return run


@query(
    "T1_watch_corpus",
    """SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY 1""",
)
def watch_corpus(spark, sf):
    arriving = watch.watch_corpus(spark, stage_texts(spark, sf), "*.txt", max_files=64)
    sizes = arriving.select(
        F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), F.length("source").cast("bigint").alias("chars")
    )
    out = scratch_path(spark, "watched")
    sizes.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "cp")).trigger(
        availableNow=True
    ).start(out).awaitTermination()
    return spark.read.schema(sizes.schema).parquet(out).groupBy("source").agg(F.sum("chars").alias("chars"))


@query(
    "T2_process_pending",
    """WITH d AS (SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY 1)
    SELECT source, chars, CAST(1 AS BIGINT) AS passes FROM d""",
)
def process_pending(spark, sf):
    folder, state = stage_texts(spark, sf), scratch_path(spark, "state")

    def measure(files):
        return files.select("path", F.lit("ok").alias("status"), F.length("source").cast("string").alias("result"))

    for batch in range(2):  # the second pass finds nothing to do
        watch.process_pending(spark, folder, state, measure, "*.txt", batch)
    done = watch.current_state(spark, state)
    return done.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(
        F.sum(F.col("result").cast("bigint")).alias("chars"),
        (F.max("batch") + 1).alias("passes"),
    )


@query(
    "T3_stream_rule_counts",
    f"""WITH {v.RULES}, {v.HITS} SELECT r.rule, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS n_matches,
      (SELECT count(*) FROM documents) AS scanned FROM rules r LEFT JOIN hits h ON h.rule = r.rule GROUP BY 1""",
)
def stream_rule_counts(spark, sf):
    docs = _stream(spark, sf, "documents").select(F.col("text").alias("source"))
    out = scratch_path(spark, "counts")
    monitors.to_versions(
        monitors.stream_rule_counts(docs, TEXT_RULES), out, scratch_path(spark, "cp")
    ).awaitTermination()
    return monitors.latest_version(spark, out)


@query("T4_stream_events", "SELECT event_id AS seq, user_id AS run, event_type AS event, value FROM events")
def stream_events(spark, sf):
    events = _stream(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("event"), "value"
    )
    out = scratch_path(spark, "events")
    watch.stream_events(events, out, scratch_path(spark, "cp")).awaitTermination()
    return read_events(spark, out).select("seq", "run", "event", "value")


@query("T4_stream_times", "SELECT event_id AS seq, CAST(ts AS DATE) AS day, hour(ts) AS hour, minute(ts) AS minute FROM events")
def stream_times(spark, sf):
    """Times survive the way through the JSON log."""
    events = _stream(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("event"), "value"
    )
    out = scratch_path(spark, "events")
    watch.stream_events(events, out, scratch_path(spark, "cp")).awaitTermination()
    hours = [F.hour("ts").cast("bigint").alias("hour"), F.minute("ts").cast("bigint").alias("minute")]
    return read_events(spark, out).select("seq", F.to_date("ts").alias("day"), *hours)


@query(
    "T5_stream_merge_store",
    f"WITH {v.STORE} SELECT signature, verified_fix, confidence, failure_count, verified FROM store",
)
def stream_merge_store(spark, sf):
    batch = v.store_batch(spark, sf, v.staged_signatures(spark, sf))
    target, cp = scratch_path(spark, "store"), scratch_path(spark, "cp")
    q = _in_pieces(batch, "seq", 3, lambda arriving: monitors.stream_merge_store(arriving, target, cp))
    last = q.lastProgress.batchId + 1
    return monitors.read_store(spark, target, last).select(
        "signature", "verified_fix", "confidence", "failure_count", "verified"
    )


@query(
    "T6_stream_stagnation",
    f"""WITH {_TREND} SELECT *, CASE WHEN stagnation >= 4 THEN 'stagnant' WHEN plateau >= 2 THEN 'plateau'
      WHEN delta > 0 THEN 'improving' ELSE 'slow' END AS state FROM trend""",
)
def stream_stagnation(spark, sf):
    rows = v.iterations(spark, sf)
    out, state, cp = scratch_path(spark, "trend"), scratch_path(spark, "runs"), scratch_path(spark, "cp")
    _in_pieces(rows, "iteration", 3, lambda arriving: monitors.stream_trend(arriving, out, state, cp, rows_per_chunk=8))
    return spark.read.schema(monitors.TREND_SCHEMA).parquet(out).drop("batch")


@query(
    "T1_name_order",
    """WITH d AS (SELECT doc_id // 50 AS folder, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY 1),
    n AS (SELECT *, row_number() OVER (ORDER BY folder) - 1 AS place FROM d)
    SELECT folder, chars, CAST(place // 7 AS BIGINT) AS arrival FROM n""",
)
def name_order(spark, sf):
    """Files are admitted seven a pass by name, whenever they were written."""
    folder, state = scratch_path(spark, "named"), scratch_path(spark, "state")
    docs = v.table(spark, sf, "documents").select(
        F.lpad(F.floor(F.col("doc_id") / 50).cast("string"), 12, "0").alias("d"), F.col("text").alias("value")
    )
    docs.repartition("d").write.partitionBy("d").text(folder)

    def measure(found):
        return found.select("path", F.lit("ok").alias("status"), F.length("source").cast("string").alias("result"))

    batch = 0
    while passes := watch.process_passes(spark, folder, state, measure, "*.txt", batch, max_files=7):
        batch += passes
        watch.compact_state(spark, state)
    done = watch.current_state(spark, state)
    number = F.regexp_extract("path", r"d(?:=|%3D)(\d+)/", 1).cast("bigint")
    return done.select(number.alias("folder"), F.col("result").cast("bigint").alias("chars"), F.col("batch").alias("arrival"))


@query(
    "T3_reset_rule_counts",
    f"""WITH {v.RULES}, half AS (SELECT max(doc_id) // 2 AS h FROM documents), late AS (SELECT * FROM documents, half WHERE doc_id >= h),
    {v.hits_cte(source='late')}
    SELECT r.rule, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS n_matches, (SELECT count(*) FROM late) AS scanned
    FROM rules r LEFT JOIN hits h ON h.rule = r.rule GROUP BY 1""",
)
def reset_rule_counts(spark, sf):
    docs = v.table(spark, sf, "documents")
    control, out, cp = scratch_path(spark, "control"), scratch_path(spark, "counts"), scratch_path(spark, "cp")
    docs.agg(F.floor(F.max("doc_id") / 2).cast("bigint").alias("seq")).write.parquet(control)

    def count(arriving):
        texts = arriving.select("doc_id", F.col("text").alias("source"))
        counts = monitors.reset_rule_counts(texts, spark.read.parquet(control), TEXT_RULES, "doc_id")
        return monitors.to_versions(counts, out, cp)

    _in_pieces(docs, "doc_id", 3, count)
    return monitors.current_counts(monitors.latest_version(spark, out))
