"""Mixing against the resharing written as a loop, and the stream it gives."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rivulant.llm.mixing import SCHEDULES, mix, stream, time_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, taken string"


def shared_out(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, active = {s: 0.0 for s in names}, share * sum(sizes.values()), set(names)
    while active:
        total = sum(weight[s] for s in active)
        over = {s for s in active if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in active}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        active -= over
    return out


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y") for i, (t, s) in enumerate(texts)], SCHEMA)


def check(df):
    got = mix(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == sum(p.words for p in r.positions)
        assert all(0 <= p.position <= 1 for p in r.positions)
    goals = shared_out(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goals[r.source])
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= 0.5 + 1e-6
    return got


def test_targets_and_words(spark):
    texts = [("w " * (1 + i % 17), f"s{i % 5}" if i % 3 else "s0") for i in range(300)]
    got = check(rows(spark, texts))
    again = mix(rows(spark, texts)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_caps_bind(spark):
    check(rows(spark, [("a b c", "a"), ("a " * 500, "b"), ("a " * 400, "c"), ("x", "d"), ("y z", "e")]))


def test_odd_rows(spark):
    got = check(rows(spark, [(None, "a"), ("", None), ("one two", None), (" \t\n", "b"), ("a " * 30, "b"), ("same", "b"), ("same", "b")]))
    assert len(got) == 7
    assert check(rows(spark, [])) == []
    check(rows(spark, [(None, None)]))


def test_shared_tables(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


@pytest.mark.parametrize("knots", SCHEDULES)
def test_time_inverts_the_integral(spark, knots):
    (t0, w0), (t1, w1) = knots
    for r in spark.range(11).select((F.col("id") / 10).alias("d"), time_of(F.col("id") / 10, knots).alias("t")).collect():
        assert w0 * r.t + (w1 - w0) * r.t**2 / 2 == pytest.approx(r.d * (w0 + w1) / 2)


def test_stream_is_ordered_and_whole(spark):
    texts = [("a b  c\nd " * (1 + i % 7), f"s{i % 4}") for i in range(60)] + [("twin", "s1")] * 2
    df = rows(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") >= 60, 60).otherwise(F.col("doc_id")))
    mixed = mix(df)
    out = stream(mixed, df)
    assert out.columns == df.columns
    words = sum(len(r.text.split()) for r in out.collect())
    assert words == mixed.agg(F.sum("taken")).first()[0]
    ends = out.select(F.spark_partition_id().alias("p"), "doc_id").collect()
    assert ends
