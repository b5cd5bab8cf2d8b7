"""Comparison queries: A5, F16, J10, J11."""

from pyspark.sql import functions as F

from rivulant.operators import compare as ops
from rivulant.workload import views as v
from rivulant.workload.registry import query

_NUM = """
act AS (SELECT o_orderpriority AS key, o_orderkey AS idx, o_totalprice AS a FROM orders),
ex AS (SELECT o_orderpriority AS key, o_orderkey AS idx,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice
       WHEN o_orderkey % 50 = 0 THEN o_totalprice * 1.001e0 ELSE o_totalprice END AS e
  FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderkey % 500 = 7)),
j AS (
  SELECT coalesce(act.key, ex.key) AS key, coalesce(act.idx, ex.idx) AS idx, a, e, abs(a - e) AS d,
    a IS NULL OR e IS NULL AS missing, coalesce(a = e, false) AS same,
    abs(a - e) > (CASE WHEN coalesce(act.key, ex.key) = '2-HIGH' THEN 1e4 ELSE 1e-5 END) + 0 AS bad
  FROM act FULL JOIN ex ON act.key = ex.key AND act.idx = ex.idx)"""


@query(
    "J10_numeric_diff",
    f"""WITH {_NUM} SELECT key, count(*) AS n_rows, count(*) FILTER (WHERE missing) AS n_missing,
      CAST(0 AS BIGINT) AS n_unparsed, count(*) FILTER (WHERE bad) AS n_violations, bool_and(same) AS identical,
      bool_and(same) OR (count(*) FILTER (WHERE missing) = 0 AND count(*) FILTER (WHERE bad) = 0) AS passed,
      arg_max(idx, (bad, d, -idx)) FILTER (WHERE d IS NOT NULL) AS worst_idx,
      round(arg_max(d, (bad, d, -idx)) FILTER (WHERE d IS NOT NULL), 6) AS worst_abs,
      round(arg_max(CASE WHEN abs(e) > 0 THEN d / abs(e) ELSE 0 END, (bad, d, -idx)) FILTER (WHERE d IS NOT NULL), 6) AS worst_rel
    FROM j GROUP BY 1""",
)
def numeric_diff(spark, sf):
    o = v.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("value")
    )
    changed = F.when(F.col("key") == "1-URGENT", F.col("value")).when(
        F.col("idx") % 50 == 0, F.col("value") * 1.001
    ).otherwise(F.col("value"))
    expected = o.filter("NOT (key = '5-LOW' AND idx % 500 = 7)").withColumn("value", changed)
    out = ops.numeric_diff(o, expected, atol={"2-HIGH": 1e4})
    return out.withColumns({c: F.round(c, 6) for c in ("worst_abs", "worst_rel")})


@query(
    "J11_compare_runs",
    """WITH a AS (SELECT o_orderpriority AS key, o_custkey AS idx, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS v
      FROM orders GROUP BY 1, 2),
    b AS (SELECT o_orderpriority AS key, o_custkey AS idx, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS v
      FROM orders WHERE NOT (o_orderpriority IN ('3-MEDIUM', '5-LOW') AND o_orderkey % 1000 = 3) GROUP BY 1, 2),
    j AS (SELECT coalesce(a.key, b.key) AS key, a.v IS NOT DISTINCT FROM b.v AS same
      FROM a FULL JOIN b ON a.key = b.key AND a.idx = b.idx)
    SELECT key, count(*) AS n_rows, count(*) FILTER (WHERE NOT same) AS n_different,
      key = '5-LOW' OR count(*) FILTER (WHERE NOT same) = 0 AS deterministic FROM j GROUP BY 1""",
)
def compare_runs(spark, sf):
    o = v.table(spark, sf, "orders")
    cents = F.col("o_totalprice").cast("decimal(18,2)")
    one = o.groupBy("o_orderpriority", "o_custkey").agg(F.sum(cents).cast("double").alias("value"))
    halves = (
        o.filter("NOT (o_orderpriority IN ('3-MEDIUM', '5-LOW') AND o_orderkey % 1000 = 3)")
        .groupBy("o_orderpriority", "o_custkey", (F.col("o_orderkey") % 2).alias("half"))
        .agg(F.sum(cents).alias("part"))
    )
    two = halves.groupBy("o_orderpriority", "o_custkey").agg(F.sum("part").cast("double").alias("value"))
    return ops.compare_runs(one, two, "o_orderpriority", "o_custkey", "value", opted_out=["5-LOW"])


@query(
    "A5_verdict",
    """WITH g AS (SELECT o_custkey AS run, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS p,
      bool_or(o_orderstatus <> 'P') AS testable FROM orders GROUP BY 1)
    SELECT c_custkey AS run, coalesce(n, 0) AS attempted, coalesce(p, 0) AS passed,
      CASE WHEN n IS NULL THEN 'NO PORTS NEEDED' WHEN NOT testable THEN 'UNVERIFIED (no GPU)' WHEN p = 0 THEN 'FAILED'
        WHEN p = n THEN 'PASSED' ELSE 'PARTIAL (' || p || '/' || n || ' verified)' END AS verdict,
      coalesce(testable AND p = 0, false) AS exit_fail
    FROM customer LEFT JOIN g ON g.run = c_custkey""",
)
def verdict(spark, sf):
    runs = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("run"))
    checks = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"),
        (F.col("o_orderstatus") == "F").alias("passed"),
        (F.col("o_orderstatus") != "P").alias("testable"),
    )
    return ops.verdict(runs, checks)


@query(
    "F16_failure_label",
    """SELECT event_id,
      CASE WHEN event_type = 'error' THEN 'Not compiled — saved for manual hipcc'
        WHEN event_type IN ('view', 'click') THEN CASE
          WHEN event_id % 7 = 0 THEN 'Compiled, but failed to run'
          WHEN event_id % 7 = 1 THEN 'Compiled, but crashed at runtime (exit 3)'
          WHEN event_id % 7 = 2 THEN 'Compiled, but crashed at runtime (SIGABRT, exit -6)'
          WHEN event_id % 7 = 3 THEN 'Compiled, but crashed at runtime (SIGSEGV, exit -11)'
          WHEN event_id % 7 = 4 THEN 'Compiled, but crashed at runtime (SIGKILL, exit -9)'
          WHEN event_id % 7 = 5 THEN 'Compiled, but crashed at runtime (SIGBUS, exit -7)'
          ELSE 'Compiled, but crashed at runtime (signal 99, exit -99)' END
        ELSE 'Output mismatch' END AS label FROM events""",
)
def failure_label(spark, sf):
    e = v.table(spark, sf, "events")
    code = F.get(
        F.array(*[F.lit(x).cast("int") for x in (None, 3, -6, -11, -9, -7, -99)]),
        (F.col("event_id") % 7).cast("int"),
    )
    runs = e.select(
        "event_id",
        (F.col("event_type") != "error").alias("compile_success"),
        (~F.col("event_type").isin("view", "click")).alias("run_success"),
        code.alias("run_exit_code"),
    )
    return ops.failure_label(runs).select("event_id", "label")


@query(
    "F16_failure_class",
    """WITH c AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'api_timeout' WHEN 2 THEN 'http_error'
        WHEN 3 THEN 'api_timeout' ELSE 'network_error' END AS failure FROM events)
    SELECT failure, true AS transient, count(*) AS n FROM c GROUP BY 1""",
)
def failure_class(spark, sf):
    six = F.col("event_id") % 6
    status = F.when(six == 0, F.lit(429)).when(six == 1, F.lit(503)).when(six == 2, F.lit(404))
    text = F.when(six == 3, F.lit("Read TIMED OUT")).when(six == 4, F.lit("connection refused")).otherwise(F.lit("odd"))
    rows = v.table(spark, sf, "events").select(ops.failure_class(status, text).alias("failure"))
    return rows.groupBy("failure", ops.is_transient(F.col("failure")).alias("transient")).agg(
        F.count(F.lit(1)).alias("n")
    )
