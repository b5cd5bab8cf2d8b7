"""Copy-on-write store, paired commits, name order, compaction, resets, streamed trends, digests and ranks."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from rivulant.operators.diagnostics import attempt_signature, iteration_trend
from rivulant.operators.store import STORE_SCHEMA, merge_store
from rivulant.plans.digest import ordered_digest
from rivulant.plans.scan import range_rank
from rivulant.rules.portable import TEXT_RULES
from rivulant.sources import bucketed, gated
from rivulant.streaming import monitors, watch

BATCH = "signature string, seq long, negative boolean, fix string, confidence double, llm_time_s double, verified boolean, metadata map<string,string>, error string"


def store_rows(n, keys, seed):
    rng = random.Random(seed)
    return [(f"sig{rng.randrange(keys)}", i, rng.random() < 0.2, f"fix{i}", rng.randrange(100) / 100, 0.5, rng.random() < 0.5, {f"k{i % 3}": f"v{i}"}, f"err{i}") for i in range(n)]


def fed(spark, tmp_path, rows, schema, cuts, start):
    """Run a stream over a folder to its end after each part of the rows arrives."""
    folder = str(tmp_path / "in")
    for part in cuts:
        spark.createDataFrame(rows[part], schema).write.mode("append").parquet(folder)
        start(spark.readStream.schema(schema).parquet(folder)).awaitTermination()
    return len(cuts)


@pytest.mark.parametrize("at", [(10, 20), (1, 59), (30, 31)])
def test_streamed_merge_equals_one_merge(spark, tmp_path, at):
    rows = store_rows(60, 9, 4)
    cuts = [slice(0, at[0]), slice(at[0], at[1]), slice(at[1], 60)]
    path = str(tmp_path / "store")
    n = fed(spark, tmp_path, rows, BATCH, cuts, lambda s: monitors.stream_merge_store(s, path, str(tmp_path / "cp"), buckets=4))
    got = {r.signature: r.asDict() for r in monitors.read_store(spark, path, n).drop("bucket").collect()}
    want = {r.signature: r.asDict() for r in merge_store(None, spark.createDataFrame(rows, BATCH)).collect()}
    assert got == want


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path, rows = str(tmp_path / "s"), store_rows(80, 40, 6)
    whole = merge_store(None, spark.createDataFrame(rows, BATCH))
    every = bucketed.touched(whole, "signature", 8)
    bucketed.write_version(whole, "signature", path, 1, every, 8)
    before = files_of(path)
    late = spark.createDataFrame([("sig1", 900, False, "new", 1.0, 0.1, True, {}, None)], BATCH)
    changed = bucketed.touched(late, "signature", 8)
    assert len(changed) == 1
    current = bucketed.read_version(spark, path, STORE_SCHEMA, 1, changed)
    bucketed.write_version(merge_store(current, late), "signature", path, 2, changed, 8)
    assert before < files_of(path) and len(files_of(path) - before) <= 2
    assert bucketed.read_version(spark, path, STORE_SCHEMA, 2).count() == whole.count()
    assert bucketed.read_version(spark, path, STORE_SCHEMA, 1).filter("verified_fix = 'new'").count() == 0
    assert bucketed.read_version(spark, path, STORE_SCHEMA, 2).filter("verified_fix = 'new'").count() == 1
    bucketed.expire(spark, path, keep=1)
    assert not bucketed.manifest(spark, path, 1)
    assert files_of(path) < before | files_of(path) and len(before - files_of(path)) >= 1
    assert bucketed.read_version(spark, path, STORE_SCHEMA, 2).count() == whole.count()


def test_a_failed_run_leaves_the_old_pair(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "pair"), spark.createDataFrame([(1, "ok"), (2, "")], "id int, t string")
    with pytest.raises(ValueError):
        gated.read_gated(spark, path)
    gated.gated_commit(df, [("length", F.length("t") > 0, F.lit("empty"))], path)
    read = lambda: tuple({r.id for r in side.collect()} for side in gated.read_gated(spark, path))
    assert read() == ({1}, {2})
    real = gated.files.put_text
    monkeypatch.setattr(gated.files, "put_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        gated.gated_commit(df, [("none", F.lit(False), F.lit("all"))], path)
    assert read() == ({1}, {2})
    monkeypatch.setattr(gated.files, "put_text", real)
    gated.gated_commit(df, [("none", F.lit(False), F.lit("all"))], path)
    assert read() == (set(), {1, 2})
    assert len(os.listdir(f"{path}/runs")) == 2  # the last two committed runs; what the failed one left is gone


def test_names_decide_the_order_and_only_pending_files_are_opened(spark, tmp_path, monkeypatch):
    folder, state, opened = tmp_path / "in", str(tmp_path / "state"), []
    folder.mkdir()
    for name in ("d", "b", "e", "a", "c{1}", "odd[x]"):
        (folder / f"{name}.txt").write_text(name)
    real = watch.read_corpus
    monkeypatch.setattr(watch, "read_corpus", lambda s, p, **k: opened.append(p) or real(s, p, **k))

    def judge(found):
        return found.select("path", F.lit("ok").alias("status"), F.col("source").alias("result"))

    run = lambda n: watch.process_pending(spark, str(folder), state, judge, "*.txt", n, max_files=2)
    assert [run(i) for i in range(4)] == [2, 2, 2, 0]
    done = lambda: {r.result: (r.batch, r.status) for r in watch.current_state(spark, state).collect()}
    assert done() == {"a": (0, "ok"), "b": (0, "ok"), "c{1}": (1, "ok"), "d": (1, "ok"), "e": (2, "ok"), "odd[x]": (2, "ok")}
    assert [len(p) for p in opened] == [2, 2, 2]
    (folder / "d.txt").write_text("changed")
    (folder / "a0.txt").write_text("a0")
    assert watch.compact_state(spark, state) == 1 and len(done()) == 6
    assert run(7) == 2 and len(opened[-1]) == 2
    assert done()["changed"] == (7, "ok") and done()["a0"] == (7, "ok") and run(8) == 0
    assert watch.compact_state(spark, state) == 2 and len(done()) == 7
    assert sorted(n for n in os.listdir(state) if n.startswith("gen=")) == ["gen=2"]


def test_passes_that_share_a_job_equal_single_passes(spark, tmp_path, monkeypatch):
    folder, opened, listed = tmp_path / "in", [], []
    folder.mkdir()
    for i in range(23):
        (folder / f"{i * 7 % 23:02d}.txt").write_text(f"t{i}")
    (folder / "odd[x].txt").write_bytes(b"\xff\xfe\x00")
    read, listing = watch.read_corpus, watch.list_files
    monkeypatch.setattr(watch, "read_corpus", lambda s, p, **k: opened.append(len(p)) or read(s, p, **k))
    monkeypatch.setattr(watch, "list_files", lambda *a, **k: listed.append(1) or listing(*a, **k))

    def judge(found):
        return found.select("path", F.lit("ok").alias("status"), F.col("source").alias("result"))

    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    done = lambda state: {(r.path, r.batch, r.status, r.result) for r in watch.current_state(spark, state).collect()}
    n = 0
    while watch.process_pending(spark, str(folder), one, judge, "*.txt", n, max_files=5):
        n += 1
    opened.clear(), listed.clear()
    run = lambda batch: watch.process_passes(spark, str(folder), many, judge, "*.txt", batch, max_files=5, at_once=12)
    assert run(0) == n == 5 and opened == [10, 10, 4] and len(listed) == 1  # two whole passes at a time
    assert done(many) == done(one) and len(done(many)) == 24
    assert run(5) == 0 and opened == [10, 10, 4]
    (folder / "03.txt").write_text("changed")
    (folder / "02a.txt").write_text("new")
    assert run(5) == 1 and {r[3] for r in done(many) if r[1] == 5} == {"changed", "new"}


def test_an_unfinished_compaction_does_not_count(spark, tmp_path):
    state = str(tmp_path / "state")
    watch.init_state(spark, state)
    os.makedirs(f"{state}/gen=1")
    assert watch.current_state(spark, state).count() == 0 and watch._generation(spark, state) == 0


def test_counters_restart(spark, tmp_path):
    rows = [(i, f"a{i}@b.org " * (i % 3)) for i in range(30)]
    control, out, cp = str(tmp_path / "control"), str(tmp_path / "out"), str(tmp_path / "cp")
    spark.createDataFrame([(12,)], "seq long").write.parquet(control)

    def start(stream):
        counts = monitors.reset_rule_counts(stream.withColumnRenamed("t", "source"), spark.read.parquet(control), TEXT_RULES, "i")
        return monitors.to_versions(counts, out, cp, keep=2)

    fed(spark, tmp_path, rows, "i long, t string", [slice(0, 10), slice(10, 14), slice(14, 30), slice(0, 0)], start)
    got = {r.rule: (r.n_matches, r.scanned) for r in monitors.current_counts(monitors.latest_version(spark, out)).collect()}
    assert got["email"] == (sum(i % 3 for i in range(12, 30)), 18) and len(got) == len(TEXT_RULES)
    assert len([n for n in os.listdir(out) if n.startswith("batch=")]) <= 2


def trends(n, seed):
    rng = random.Random(seed)
    return [(run, i, rng.randrange(4), f"set{rng.randrange(3)}") for run in range(3) for i in range(n)]


@pytest.mark.parametrize("cut", [(1, 2), (5, 9), (11, 30)])
def test_streamed_trend_equals_the_batch(spark, tmp_path, cut):
    rows, schema = trends(40, 7), "run long, iteration long, n_errors long, error_set string"
    parts = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((0, cut[0]), (cut[0], cut[1]), (cut[1], 40))]
    order = [r for part in parts for r in part]
    sizes = [0, len(parts[0]), len(parts[0]) + len(parts[1]), len(order)]
    out = str(tmp_path / "out")
    fed(spark, tmp_path, order, schema, [slice(a, b) for a, b in zip(sizes, sizes[1:])],
        lambda s: monitors.stream_trend(s, out, str(tmp_path / "state"), str(tmp_path / "cp"), buckets=2, rows_per_chunk=8))
    got = {tuple(r) for r in spark.read.schema(monitors.TREND_SCHEMA).parquet(out).drop("batch").collect()}
    want = {tuple(r[c.split()[0]] for c in monitors.TREND_SCHEMA.split(", ")) for r in iteration_trend(spark.createDataFrame(rows, schema), 8).collect()}
    assert got == want and len(got) > 60


def test_digest_streams_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if i % 5 == 0 else f"g{i % 5}", f"é{i * 37 % 101:03d}", i % 3) for i in range(100)]
        df = spark.createDataFrame(rows, "k string, t string, n long")
        got = {r.k: r.digest for r in ordered_digest(df, ["k"], ["t"], "t", F.col("n"), separator="\n", length=64).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in {r[0] for r in rows}:
        items = sorted(t for k, t, n in rows if k == key for _ in range(n))
        assert got[key] == hashlib.sha256("\n".join(items).encode()).hexdigest()
    assert ordered_digest(df.limit(0), ["k"], ["t"], "t").count() == 0


def test_attempt_signatures(spark):
    rows = [("a", 0, None), ("b", 1, "x.cpp:3:4: error: use of undeclared identifier 'q'"), ("b", 2, "x.o:1:1: lost"),
            ("c", 3, "x.o:7:2: undefined symbol z"), ("c", 4, "y.o:9:9: undefined symbol a")]
    df = spark.createDataFrame(rows, "run string, seq int, raw string")
    got = {r.run: r.failure_signature for r in attempt_signature(df, ["run"], "seq").collect()}
    short = lambda s: "compile:" + hashlib.sha256(s.encode()).hexdigest()[:12]
    assert got == {"a": "", "b": short("undeclared:q:"), "c": short("undefined symbol a|undefined symbol z")}


def test_range_rank(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(500)]
    got = {(r.a, r.b): r.place for r in range_rank(spark.createDataFrame(rows, "a int, b int"), ["a", "b"]).collect()}
    assert got == {r: i + 1 for i, r in enumerate(sorted(rows))}
    assert range_rank(spark.createDataFrame([], "a int, b int"), ["a", "b"]).count() == 0
