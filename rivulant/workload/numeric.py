"""Numeric table queries: N1-N10."""

from pyspark.sql import functions as F

from rivulant.operators import numeric as ops
from rivulant.workload import views as v
from rivulant.workload.registry import query

WIDTH, HEIGHT = 64, 50

_GRID = f"""
cells AS (SELECT l_partkey % {WIDTH} AS x, l_suppkey % {HEIGHT} AS y, count(*) AS n FROM lineitem GROUP BY 1, 2),
grid AS (
  SELECT gy.y, gx.x, coalesce(c.n, 0) AS v FROM range({HEIGHT}) gy(y) CROSS JOIN range({WIDTH}) gx(x)
  LEFT JOIN cells c ON c.x = gx.x AND c.y = gy.y)"""
_VEC = "vec AS (SELECT event_id AS idx, CAST(value AS DECIMAL(18, 2)) AS v FROM events)"


def grid(spark, sf):
    """All cells of the fixture grid, absent ones as zero."""
    cells = v.table(spark, sf, "lineitem").groupBy(
        (F.col("l_partkey") % WIDTH).alias("x"), (F.col("l_suppkey") % HEIGHT).alias("y")
    ).agg(F.count(F.lit(1)).alias("v"))
    return ops.densify(cells.withColumn("c", F.lit(0).cast("bigint")), WIDTH, HEIGHT)


def vec(spark, sf):
    return v.table(spark, sf, "events").select(
        F.col("event_id").alias("idx"), F.col("value").cast("decimal(18,2)").alias("v")
    )


@query(
    "N1_vector_add",
    """SELECT e.event_id AS idx, CAST(CAST(e.value AS DECIMAL(18, 2)) + CAST(o.o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS v
      FROM events e JOIN orders o ON o.o_orderkey = e.event_id""",
)
def vector_add(spark, sf):
    b = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("idx"), F.col("o_totalprice").cast("decimal(18,2)").alias("v")
    )
    return ops.vector_add(vec(spark, sf), b).withColumn("v", F.col("v").cast("double"))


@query("N2_block_reduce", f"WITH {_VEC} SELECT idx // 64 AS block, CAST(sum(v) AS DOUBLE) AS total FROM vec GROUP BY 1")
def block_reduce(spark, sf):
    return ops.block_reduce(vec(spark, sf)).withColumn("total", F.col("total").cast("double"))


@query(
    "N2_block_reduce_half",
    f"WITH {_VEC} SELECT idx // 64 AS block, CAST(sum(v) FILTER (WHERE idx % 64 < 32) AS DOUBLE) AS total FROM vec GROUP BY 1",
)
def block_reduce_half(spark, sf):
    return ops.block_reduce(vec(spark, sf), take=32).withColumn("total", F.col("total").cast("double"))


_PREFIX = f"WITH {_VEC} SELECT idx, CAST(sum(v) OVER (ORDER BY idx) AS DOUBLE) AS prefix FROM vec"


@query("N3_prefix_sum", _PREFIX)
def prefix_sum(spark, sf):
    out = ops.prefix_sum(vec(spark, sf), range_size=1024, held=True)
    return out.select("idx", F.col("prefix").cast("double").alias("prefix"))


@query(
    "N4_block_scan",
    f"WITH {_VEC} SELECT idx, idx // 256 AS block, CAST(sum(v) OVER (PARTITION BY idx // 256 ORDER BY idx) AS DOUBLE) AS scan FROM vec",
)
def block_scan(spark, sf):
    scanned, _ = ops.block_scan(vec(spark, sf), 256)
    return scanned.select("idx", "block", F.col("scan").cast("double").alias("scan"))


@query("N4_uniform_add", _PREFIX)
def uniform_add(spark, sf):
    scanned, totals = ops.block_scan(vec(spark, sf), 256)
    return ops.uniform_add(scanned, totals).select("idx", F.col("prefix").cast("double").alias("prefix"))


@query(
    "N5_integral_image",
    f"""WITH {_GRID}, r AS (SELECT x, y, sum(v) OVER (PARTITION BY y ORDER BY x) AS row_sum FROM grid)
    SELECT x, y, CAST(row_sum AS BIGINT) AS row_sum, CAST(sum(row_sum) OVER (PARTITION BY x ORDER BY y) AS BIGINT) AS area FROM r""",
)
def integral_image(spark, sf):
    return ops.integral_image(grid(spark, sf), tile=16).select("x", "y", "row_sum", "area")


@query(
    "N6_histogram",
    """WITH h AS (SELECT CAST(floor(greatest(0.0, least(15.0, l_discount * 16))) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT b.bin, coalesce(h.n, 0) AS n FROM range(16) b(bin) LEFT JOIN h ON h.bin = b.bin""",
)
def histogram(spark, sf):
    return ops.histogram(v.table(spark, sf, "lineitem"), 16, "l_discount")


@query(
    "N7_softmax",
    """SELECT event_id, user_id, round(exp(value - max(value) OVER w) / sum(exp(value - m)) OVER w, 6) AS softmax
      FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) WINDOW w AS (PARTITION BY user_id)""",
)
def softmax(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", "user_id", "value")
    return ops.softmax(e, ["user_id"], "value").select("event_id", "user_id", F.round("softmax", 6).alias("softmax"))


@query(
    "N7_softmax_global",
    """WITH m AS (SELECT max(value) AS m FROM events), s AS (SELECT sum(exp(value - m)) AS s FROM events, m)
    SELECT event_id, round(exp(value - m) / s, 6) AS softmax FROM events, m, s""",
)
def softmax_global(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", "value")
    return ops.softmax(e, [], "value").select("event_id", F.round("softmax", 6).alias("softmax"))


@query("N8_transpose", f"WITH {_GRID} SELECT x AS y, y AS x, v, x * {HEIGHT} + y AS idx FROM grid")
def transpose(spark, sf):
    return ops.transpose(grid(spark, sf), WIDTH, HEIGHT)


@query(
    "N8_transpose_batched",
    f"""SELECT l_linenumber % 4 AS b, l_partkey % {WIDTH} AS y, l_suppkey % {HEIGHT} AS x, count(*) AS v,
      l_linenumber % 4 * {WIDTH * HEIGHT} + l_partkey % {WIDTH} * {HEIGHT} + l_suppkey % {HEIGHT} AS idx
      FROM lineitem GROUP BY ALL""",
)
def transpose_batched(spark, sf):
    cells = v.table(spark, sf, "lineitem").groupBy(
        (F.col("l_linenumber") % 4).alias("b"),
        (F.col("l_partkey") % WIDTH).alias("x"),
        (F.col("l_suppkey") % HEIGHT).alias("y"),
    ).agg(F.count(F.lit(1)).alias("v"))
    return ops.transpose(cells, WIDTH, HEIGHT, batch="b")


@query(
    "N9_box_filter",
    f"""WITH {_GRID} SELECT CAST(0 AS BIGINT) AS c, a.y, a.x, CAST(sum(b.v) AS BIGINT) AS v
      FROM grid a JOIN grid b ON b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 GROUP BY ALL""",
)
def box_filter(spark, sf):
    cells = v.table(spark, sf, "lineitem").groupBy(
        (F.col("l_partkey") % WIDTH).alias("x"), (F.col("l_suppkey") % HEIGHT).alias("y")
    ).agg(F.count(F.lit(1)).alias("v"))
    return ops.box_filter(cells.withColumn("c", F.lit(0).cast("bigint")), WIDTH, HEIGHT, tile=16)


@query(
    "N10_initialised_reduce",
    """SELECT count(*) AS count, -count(*) AS minus_count, arg_max(o_custkey, o_orderkey) AS last,
      least(0, min(o_custkey)) AS min, greatest(0, max(o_custkey)) AS max,
      0 & bit_and(o_custkey) AS "and", 0 | bit_or(o_custkey) AS "or", xor(0, bit_xor(o_custkey)) AS "xor",
      255 & bit_and(o_custkey) AS and2, 0 | bit_or(o_custkey) AS or2, xor(255, bit_xor(o_custkey)) AS xor2 FROM orders""",
)
def initialised_reduce(spark, sf):
    o = v.table(spark, sf, "orders").withColumn("v", F.col("o_custkey"))
    return ops.initialised_reduce(o, F.col("o_orderkey"))
