"""Telemetry, sources, sinks and streams."""

import json
import os
import time

from pyspark.sql import functions as F

from rivulant.operators import telemetry as ops
from rivulant.operators.findings import rule_counts
from rivulant.plans.scratch import scratch_path
from rivulant.rules.device import KEYWORD_ITEMS
from rivulant.rules.portable import TEXT_RULES
from rivulant.sources import corpus, gated, specs
from rivulant.streaming import monitors, watch


def test_pack_stops_at_the_first_that_does_not_fit(spark):
    items = spark.createDataFrame([("g", i, n) for i, n in enumerate([10, 5, 30, 1, 1])], "g string, pos bigint, n bigint")
    got = {r.pos: r.kept for r in ops.pack(items, 20, ["g"], "pos", "n", rows_per_chunk=2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False}


def test_evolve(spark):
    checklist = spark.createDataFrame([("v1", c, i) for i, c in enumerate("abcde")], "version string, item string, position bigint")
    scores = spark.createDataFrame([("a", -3), ("b", 2), ("d", -1), ("e", 1)], "item string, score bigint")
    hits = spark.createDataFrame([("v1", "new", 4), ("v1", "b", 1)], "version string, item string, keyword_no int")
    out = ops.evolve_items(checklist, scores, hits).orderBy("place").collect()
    assert [r.item for r in out] == ["b", "e", "c", "new"]
    assert spark.range(1).select(ops.next_version(F.lit("v12_seed")).alias("v")).first().v == "v13"


def test_keyword_expansion(spark):
    errors = spark.createDataFrame([("r", "use of cudaMallocHost"), ("r", "cudaEvent_t"), ("s", "nothing")], "run string, raw string")
    present = spark.createDataFrame([("r", KEYWORD_ITEMS[1][1])], "run string, item string")
    out = ops.expand_items(errors, KEYWORD_ITEMS, present)
    assert {(r.run, r.keyword_no) for r in out.collect()} == {("r", 0), ("r", 3)}


def test_provider_order(spark):
    attempts = spark.createDataFrame(
        [("a", "api_timeout", 5, False), ("a", None, 5, True), ("b", None, 1, True), ("c", "http_error", 1, False)],
        "provider string, failure string, latency_ms bigint, extraction_ok boolean",
    )
    health = ops.provider_health(attempts)
    listed = spark.createDataFrame([("c", 0), ("a", 1), ("b", 2)], "provider string, position int")
    ranked = ops.rank_providers(health.join(listed, "provider")).orderBy("place")
    assert [(r.provider, r.failure_rate) for r in ranked.collect()] == [("c", 0.0), ("b", 0.0), ("a", 0.5)]


def test_corpus_files(spark, tmp_path):
    (tmp_path / "a.cu").write_text("one\ntwo\r\nthree\n")
    (tmp_path / "b.cu").write_bytes(b"\xff\xfe bad \xff")
    (tmp_path / "c.txt").write_text("skip")
    docs = corpus.read_corpus(spark, str(tmp_path), "*.cu")
    assert [r.path.split("/")[-1] for r in docs.collect()] == ["a.cu"]
    assert [(r.line, r.text) for r in corpus.to_lines(docs.select("path", "source")).orderBy("line").collect()] == [
        (1, "one"), (2, "two"), (3, "three"),
    ]
    try:
        corpus.read_corpus(spark, str(tmp_path), "*.hip")
        raise AssertionError("an empty corpus must be an error")
    except ValueError:
        pass


def test_spec_files(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({
        "kernel_name": "k", "params": [{"name": "in", "type": "float*", "direction": "in"}, {"name": "n", "type": "int", "value": "4"}],
        "launch": {"grid": {"x": 4, "y": 1, "z": 1}}, "tolerance": {"rtol": 0.5},
    }, indent=2))
    (tmp_path / "bad.json").write_text('{"kernel_name": ')
    found = specs.read_specs(spark, str(tmp_path)).cache()
    assert found.count() == 2
    good = specs.good_specs(found)
    assert [(r.position, r.name, r.value) for r in specs.spec_params(good).collect()] == [(1, "in", None), (2, "n", "4")]
    assert good.first().launch.grid.x == 4 and good.first().launch.block is None
    t = specs.tolerances(good).first()
    assert (t.atol, t.rtol) == (1e-5, 0.5)


def test_gates_in_order(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok text"), (2, ""), (3, "bad")], "id int, t string")
    gates = [
        ("length", F.length("t") > 0, F.lit("empty")),
        ("word", ~F.contains("t", F.lit("bad")), F.concat(F.lit("holds "), F.col("t"))),
    ]
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    gated.gated_write(df, gates, good, bad)
    assert [r.id for r in spark.read.parquet(good).collect()] == [1]
    assert {(r.id, r.gate, r.reason) for r in spark.read.parquet(bad).collect()} == {(2, "length", "empty"), (3, "word", "holds bad")}


def _judge(files):
    return files.select(
        "path",
        F.when(F.contains("source", F.lit("boom")), F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.length("source").cast("string").alias("result"),
    )


def test_edited_files_are_processed_again(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.cu").write_text("int a;")
    (folder / "b.cu").write_text("boom")
    run = lambda n: watch.process_pending(spark, str(folder), state, _judge, "*.cu", n)
    assert run(0) == 2 and run(1) == 0  # the failed file is not tried again
    (folder / "b.cu").write_text("fixed now")
    (folder / "c.cu").write_text("new")
    assert run(2) == 2
    now = {r.path.split("/")[-1]: (r.status, r.result, r.batch) for r in watch.current_state(spark, state).collect()}
    assert now == {"a.cu": ("ok", "6", 0), "b.cu": ("ok", "9", 2), "c.cu": ("ok", "3", 2)}


def test_undecodable_files_are_errors_once(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.cu").write_text("int a;")
    (folder / "bad.cu").write_bytes(b"\xff\xfe\x00")
    run = lambda n: watch.process_pending(spark, str(folder), state, _judge, "*.cu", n)
    assert run(0) == 2 and run(1) == 0
    now = {r.path.split("/")[-1]: r.status for r in watch.current_state(spark, state).collect()}
    assert now == {"a.cu": "ok", "bad.cu": "error"}


def test_watch_on_a_timer(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.cu").write_text("int a;")
    watch.init_state(spark, state)
    query = watch.watch_pending(spark, str(folder), state, _judge, "*.cu", interval="1 second")
    try:
        for _ in range(60):
            if watch.current_state(spark, state).count() == 1:
                break
            time.sleep(0.5)
        assert query.exception() is None
        assert watch.current_state(spark, state).first().status == "ok"
    finally:
        query.stop()


def test_stream_counts_equal_batch_over_arrivals(spark, tmp_path):
    folder = str(tmp_path / "docs")
    first = spark.createDataFrame([("token = \"ab12\" and a@b.c",), ("SHOUTING!!",)], "source string")
    first.write.mode("append").parquet(folder)
    out, cp = scratch_path(spark, "counts"), scratch_path(spark, "cp")

    def run():
        stream = spark.readStream.schema("source string").parquet(folder)
        monitors.to_versions(monitors.stream_rule_counts(stream, TEXT_RULES), out, cp).awaitTermination()
        return {r.rule: r.n_matches for r in monitors.latest_version(spark, out).collect()}

    assert run()["email"] == 1
    spark.createDataFrame([("x@y.z x@y.z",)], "source string").write.mode("append").parquet(folder)
    batch = {r.rule: r.n_matches for r in rule_counts(spark.read.parquet(folder), TEXT_RULES).collect()}
    assert run() == batch and batch["email"] == 3


def test_idle_runs_leave_the_state(spark, tmp_path):
    folder = str(tmp_path / "it")
    spark.createDataFrame(
        [(1, 0, 5, "a"), (1, 1, 5, "a"), (1, 2, 5, "a"), (1, 3, 4, "b")], monitors_schema()
    ).write.parquet(folder)
    stream = spark.readStream.schema(monitors_schema()).parquet(folder)
    out = str(tmp_path / "out")
    trend = monitors.stream_stagnation(stream, idle_ms=60_000)
    query = (
        trend.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(processingTime="1 second").start(out)
    )
    try:
        rows = []
        for _ in range(60):
            if os.path.isdir(f"{out}/_spark_metadata"):
                rows = spark.read.schema(trend.schema).parquet(out).orderBy("iteration").collect()
            if len(rows) == 3:
                break
            time.sleep(0.5)
        assert query.exception() is None
    finally:
        query.stop()
    assert [(r.delta, r.cycle, r.stagnation, r.plateau) for r in rows] == [(0, False, 1, 0), (0, True, 4, 1), (1, False, 0, 0)]


def monitors_schema():
    return "run bigint, iteration bigint, n_errors bigint, error_set string"


def test_scratch_is_one_shared_folder(spark):
    assert os.path.dirname(scratch_path(spark, "a")) == os.path.dirname(scratch_path(spark, "b"))
