"""Numeric jobs against plain loops, and chunked scans against plain windows."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulant.operators import compare, numeric
from rivulant.plans.joins import bucket_range_join, hot_keys, lookup_join
from rivulant.plans.scan import running, segmented_sums


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_prefix_sum(spark, size):
    df = spark.range(500).select(F.col("id").alias("idx"), (F.col("id") * 7 % 13).alias("v"))
    got = {r.idx: r.prefix for r in numeric.prefix_sum(df, size).collect()}
    total = 0
    for i in range(500):
        total += i * 7 % 13
        assert got[i] == total


def test_scan_parts_give_the_prefix(spark):
    df = spark.range(300).select(F.col("id").alias("idx"), (F.col("id") % 11).alias("v"))
    scanned, totals = numeric.block_scan(df, 32)
    a = {r.idx: r.prefix for r in numeric.uniform_add(scanned, totals, blocks_per_range=3).collect()}
    b = {r.idx: r.prefix for r in numeric.prefix_sum(df).collect()}
    assert a == b


def test_running_equals_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "cold", None]), i, rng.randrange(100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    w = Window.partitionBy("k").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "o", F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"), F.lag("v").over(w).alias("p"))
    got = running(
        df, ["k"], ["o"], F.floor(F.col("o") / 37),
        sums={"s": F.col("v")}, maxes={"m": F.col("v")}, previous={"p": F.col("v")},
    ).select("k", "o", "s", "m", "p")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_segmented_sums_equal_a_loop(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("ab"), i, rng.randrange(4), rng.random() < 0.1) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, o bigint, inc bigint, reset boolean")
    out = segmented_sums(df, ["k"], ["o"], F.floor(F.col("o") / width), {"n": (F.col("inc"), F.col("reset"))})
    got = {(r.k, r.o): r.n for r in out.collect()}
    now = {"a": 0, "b": 0}
    for k, o, inc, reset in rows:
        now[k] = inc if reset else now[k] + inc
        assert got[(k, o)] == now[k]


def test_box_filter_and_integral_image(spark):
    w, h, c = 23, 17, 2
    rng = random.Random(1)
    cell = {(k, y, x): rng.randrange(9) for k in range(c) for y in range(h) for x in range(w) if rng.random() < 0.8}
    df = spark.createDataFrame([(k, y, x, v) for (k, y, x), v in cell.items()], "c bigint, y bigint, x bigint, v bigint")
    got = {(r.c, r.y, r.x): r.v for r in numeric.box_filter(df, w, h, 3, c, tile=5).collect()}
    assert len(got) == w * h * c
    for (k, y, x), v in got.items():
        assert v == sum(cell.get((k, y + dy, x + dx), 0) for dy in range(-3, 4) for dx in range(-3, 4))
    one = numeric.densify(df.filter("c = 0"), w, h)
    area = {(r.y, r.x): (r.row_sum, r.area) for r in numeric.integral_image(one, tile=4).collect()}
    assert area[(h - 1, w - 1)][1] == sum(v for (k, _, _), v in cell.items() if k == 0)
    assert area[(2, w - 1)][0] == sum(v for (k, y, _), v in cell.items() if k == 0 and y == 2)


def test_transpose_twice_is_identity(spark):
    df = spark.range(35).select((F.col("id") % 7).alias("x"), F.floor(F.col("id") / 7).alias("y"), F.col("id").alias("v"))
    once = numeric.transpose(df, 7, 5)
    assert {r.idx: r.v for r in once.collect()} == {x * 5 + y: y * 7 + x for y in range(5) for x in range(7)}
    twice = numeric.transpose(once.drop("idx"), 5, 7)
    assert {(r.x, r.y, r.v) for r in twice.collect()} == {(r.x, r.y, r.v) for r in df.collect()}


def test_softmax_is_stable(spark):
    df = spark.createDataFrame([(0, 1000.0), (1, 1001.0), (2, -1000.0)], "i int, v double")
    got = {r.i: r.softmax for r in numeric.softmax(df, []).collect()}
    assert math.isclose(got[0] + got[1] + got[2], 1.0) and math.isclose(got[1] / got[0], math.e)


def test_histogram_clamps(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.49, 0.5, 1.0, 7.0)], "v double")
    assert [r.n for r in numeric.histogram(df, 4).orderBy("bin").collect()] == [2, 1, 1, 2]


def test_initialised_reduce(spark):
    df = spark.range(16384).select(F.col("id").alias("v"))
    r = numeric.initialised_reduce(df, F.col("v")).first().asDict()
    xor = 0
    for i in range(16384):
        xor ^= i
    assert (r["count"], r["minus_count"], r["last"], r["min"], r["max"]) == (16384, -16384, 16383, 0, 16383)
    assert (r["and"], r["or"], r["xor"], r["and2"], r["xor2"]) == (0, 16383, xor, 0, 255 ^ xor)


def test_numeric_diff_verdicts(spark):
    a = [("same", 0, "x"), ("tol", 0, "1.0"), ("tol", 1, "2.0"), ("bad", 0, "1.0"), ("bad", 1, "5.0"),
         ("short", 0, "1"), ("text", 0, "a"), ("nan", 0, "NaN"), ("zero", 0, "0.5")]
    e = [("same", 0, "x"), ("tol", 0, "1.000001"), ("tol", 1, "2.0"), ("bad", 0, "1.5"), ("bad", 1, "4.5"),
         ("short", 0, "1"), ("short", 1, "2"), ("text", 0, "b"), ("nan", 0, "1.0"), ("zero", 0, "0.0")]
    schema = "key string, idx bigint, value string"
    out = compare.numeric_diff(spark.createDataFrame(a, schema), spark.createDataFrame(e, schema))
    got = {r.key: r for r in out.collect()}
    assert {k for k, r in got.items() if r.passed} == {"same", "tol"}
    assert got["bad"].worst_idx == 0 and got["bad"].worst_abs == 0.5
    assert got["zero"].worst_rel == math.inf and got["short"].n_missing == 1 and got["text"].n_unparsed == 1


def test_verdicts(spark):
    runs = spark.createDataFrame([(r,) for r in "abcde"], "run string")
    v = spark.createDataFrame(
        [("b", False, False), ("c", False, True), ("d", True, True), ("e", True, True), ("e", False, True)],
        "run string, passed boolean, testable boolean",
    )
    got = {r.run: (r.verdict, r.exit_fail) for r in compare.verdict(runs, v).collect()}
    assert got == {
        "a": ("NO PORTS NEEDED", False), "b": ("UNVERIFIED (no GPU)", False), "c": ("FAILED", True),
        "d": ("PASSED", False), "e": ("PARTIAL (1/2 verified)", False),
    }


def test_joins_keep_every_row(spark):
    facts = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, d int")
    out = lookup_join(facts, dim, ["k"])
    assert out.count() == 1000 and out.filter("d = 1").count() == 334 and out.filter("d = 2").count() == 0 + (5 % 3 != 0)
    points = spark.range(100).select(F.lit("p").alias("g"), F.col("id").alias("at"))
    spans = spark.createDataFrame([("p", 3, 40), ("p", 40, 41), ("q", 0, 99)], "g string, s bigint, e bigint")
    pairs = bucket_range_join(points, spans, ["g"], "at", "s", "e", 7)
    assert pairs.filter("s IS NOT NULL").count() == 38 + 2 and pairs.count() == 100 + 1


def test_only_hot_keys_are_repeated(spark):
    """A third of the rows in one key, a null key, keys of another integer type: few copies, every row once."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).cast("int")
    facts = spark.range(3000).select("id", key.alias("k"))
    dim = spark.range(-1, 3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))  # k is a bigint here
    hot = hot_keys(facts, ["k"], share=8)
    assert sorted(r._copies for r in hot.collect()) == [3, 3]  # -1 and null
    for given in (None, hot):
        out = lookup_join(facts, dim, ["k"], share=8, hot=given)
        assert out.columns == ["k", "id", "d"]
        got = {r.id: (r.k, r.d) for r in out.collect()}
        assert out.count() == len(got) == 3000
        assert all(d == (None if k is None else k * 2) for k, d in got.values())
    assert lookup_join(facts.limit(0), dim, ["k"]).count() == 0
    assert lookup_join(facts, dim.limit(0), ["k"]).filter("d IS NULL").count() == 3000
