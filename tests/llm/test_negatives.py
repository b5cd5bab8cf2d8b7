"""Packed products and hard negatives against plain loops."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulant.llm.hard_negatives import components, field_bits, hard_negatives, pack, products, unpack

SCHEMA = "vec_id long, label int, embedding array<{}>, _row string, rank int, score double"


def slow(rows, every=50, positives=5, negatives=3, scale=256):
    good = []
    for at, (vec_id, label, vector) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            good.append((at, vec_id, label, [math.floor(scale * x) for x in vector]))
    order = lambda s, c: (-s, c[1] is None, c[1] or 0, c[0])
    out = []
    for a in good:
        if a[1] is None or a[1] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[3], c[3])), c) for c in good if c[0] != a[0]]
        scored.sort(key=lambda x: order(*x))
        for p, c in [x for x in scored if x[1][2] == a[2]][:positives]:
            fits = [x for x in scored if x[1][2] != a[2] and 50 * p <= 100 * x[0] <= 95 * p][:negatives]
            out += [(a[1], c[1], rank + 1, d[1], p, s) for rank, (s, d) in enumerate(fits)]
    return Counter(out)


def fast(spark, rows, kind="float", **more):
    df = spark.createDataFrame([(*r, "x", 0, 0.0) for r in rows], SCHEMA.format(kind)).coalesce(1)
    out = hard_negatives(df.repartition(1), F.col("vec_id") % 50 == 0, **more)
    return Counter(tuple(r) for r in out.collect())


def test_fields_hold_the_largest_sum():
    for low, high, dims in ((-3, 3, 4), (-128, 127, 64), (0, 1, 1), (-(2**40), 2**40, 100)):
        assert dims * (high - low) ** 2 < 1 << field_bits(low, high, dims)


def test_pack_and_unpack():
    rng = np.random.default_rng(3)
    for kind in (np.int64, object):
        rows = rng.integers(-50, 50, (7, 5)).astype(kind)
        words = pack(rows, 50, 9, 3)
        assert words.shape == (5, 3)
        assert (unpack(words, 9, 3, 7).astype(np.int64) == (rows + 50).T.astype(np.int64)).all()


@pytest.mark.parametrize("top", [1, 150, 60_000, 2**20, 2**70])
def test_products_are_exact(top):
    rng = np.random.default_rng(top % 1000)
    draw = lambda n: np.array([[int(rng.integers(-99, 100)) * top // 99 for _ in range(13)] for _ in range(n)], object)
    a, b = draw(6), draw(11)
    want = a @ b.T
    if top < 2**31:
        a, b = a.astype(np.int64), b.astype(np.int64)
    assert (products(a, b).astype(object) == want).all()


def vectors(rng, n, dims=16):
    centre = rng.normal(0, 0.3, (4, dims))
    label = rng.integers(0, 4, n)
    return [(int(i), int(label[i]), [float(np.float32(x)) for x in centre[label[i]] * 0.4 + rng.normal(0.1, 0.15, dims)]) for i in range(n)]


def test_against_loops(spark):
    rows = vectors(np.random.default_rng(5), 400)
    want = slow(rows)
    assert len(want) > 40 and fast(spark, rows) == want
    assert fast(spark, rows, block_bytes=1000) == want


def test_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 3)), [float(x) / 256 for x in rng.integers(0, 3, 3)]) for i in range(300)]
    rows += [(50, 1, [1 / 64, 1 / 64, 1 / 64])] * 4 + [(7, 2, [1 / 64, 0.0, 1 / 64])] * 9
    assert fast(spark, rows) == slow(rows)


def test_odd_rows(spark):
    rows = vectors(np.random.default_rng(9), 200, 6)
    rows += [(50, None, [1.0] * 6), (100, 1, None), (150, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (200, 1, [float("nan")] * 6)]
    rows += [(250, 2, [float("inf")] * 6), (None, 2, [0.2] * 6), (None, 1, [0.2] * 6), (300, 1, []), (350, 2, [0.3, 0.3])]
    rows += [(400, 2, [0.2] * 40)]
    assert fast(spark, rows) == slow(rows)


def test_scores_beyond_a_word(spark):
    rows = [(i, l, [x * 2.0**24 for x in v]) for i, l, v in vectors(np.random.default_rng(10), 220, 5)]
    assert fast(spark, rows, "double") == slow(rows)


def test_empty_tables(spark):
    assert not fast(spark, []) and not fast(spark, [(3, 1, [1.0])]) and not fast(spark, [(50, 1, [1.0])])


def test_components_of_ragged_vectors():
    import pyarrow as pa

    got = components(pa.array([[0.5, -0.001], [], [1.0]], pa.list_(pa.float32())), 256)
    assert got.tolist() == [[128, -1], [0, 0], [256, 0]]
