"""Source and sink queries: S1-S7.  Intermediate files go to the shared scratch folder."""

from pyspark.sql import functions as F

from rivulant.operators import findings as scans
from rivulant.plans.scratch import scratch_path
from rivulant.rules.portable import TEXT_RULES
from rivulant.sources import corpus as files
from rivulant.sources import events as logs
from rivulant.sources import gated, specs
from rivulant.sources import store as stores
from rivulant.workload import views as v
from rivulant.workload.registry import query


def stage_texts(spark, sf) -> str:
    """Documents as text files below one folder per source."""
    path = scratch_path(spark, "texts")
    docs = v.table(spark, sf, "documents").select("source", F.col("text").alias("value"))
    docs.write.partitionBy("source").text(path)
    return path


@query(
    "S1_read_corpus",
    """SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS chars, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1""",
)
def read_corpus(spark, sf):
    found = files.read_corpus(spark, stage_texts(spark, sf), "*.txt")
    return found.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(
        F.sum(F.length("source")).cast("bigint").alias("chars"), F.sum("size").alias("bytes")
    )


@query(
    "S2_to_lines",
    """WITH l AS (SELECT doc_id AS path, CASE WHEN text[-1] = chr(10) THEN string_split(text[1:-2], chr(10)) ELSE string_split(text, chr(10)) END AS ls FROM documents)
    SELECT path, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line, unnest(ls) AS text FROM l""",
)
def to_lines(spark, sf):
    return files.to_lines(v.corpus(spark, sf))


def _specs(spark, sf):
    """Kernel specs as text, derived from parts; every 7th is cut off."""
    params = F.array(
        F.struct(F.lit("in").alias("name"), F.lit("const float*").alias("type"), F.lit("in").alias("direction")),
        F.struct(F.lit("n").alias("name"), F.lit("int").alias("type"), F.lit("scalar").alias("direction")),
    )
    text = F.to_json(
        F.struct(
            F.col("p_name").alias("kernel_name"),
            params.alias("params"),
            F.struct(F.struct(F.col("p_size").alias("x")).alias("grid")).alias("launch"),
            F.when(F.col("p_partkey") % 3 == 0, F.struct(F.lit(0.5).alias("atol"))).alias("tolerance"),
            F.when(F.col("p_partkey") % 2 == 0, F.lit(0.25)).alias("rtol"),
        )
    )
    cut = F.when(F.col("p_partkey") % 7 == 0, F.substring(text, 1, 30)).otherwise(text)
    raw = v.table(spark, sf, "part").select("p_partkey", cut.alias("spec"))
    return specs.good_specs(specs.parse_specs(raw, "spec"))


@query(
    "S3_spec_params",
    """SELECT p_partkey, p_name AS kernel_name, p_size::BIGINT AS grid_x, p.position, p.name, p.type, p.direction
      FROM part CROSS JOIN (VALUES (1::INTEGER, 'in', 'const float*', 'in'), (2::INTEGER, 'n', 'int', 'scalar')) p(position, name, type, direction) WHERE p_partkey % 7 <> 0""",
)
def spec_params(spark, sf):
    rows = _specs(spark, sf).withColumn("grid_x", F.col("launch.grid.x"))
    return specs.spec_params(rows, "p_partkey", "kernel_name", "grid_x").drop("size_expr", "value")


@query(
    "S3_tolerances",
    """SELECT p_name AS kernel_name, CASE WHEN p_partkey % 3 = 0 THEN 0.5::DOUBLE ELSE 0.00001::DOUBLE END AS atol,
      CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE WHEN p_partkey % 2 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS rtol FROM part WHERE p_partkey % 7 <> 0""",
)
def tolerances(spark, sf):
    return specs.tolerances(_specs(spark, sf))


@query(
    "S4_event_log",
    """SELECT event_id AS seq, user_id AS run, ts, event_type AS event, value FROM events WHERE event_type = 'error'""",
)
def event_log(spark, sf):
    e = v.table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("event"), "value"
    )
    path = scratch_path(spark, "log")
    logs.append_events(e.filter("seq % 2 = 0"), path)
    logs.append_events(e.filter("seq % 2 = 1"), path)
    # lines a crash left half-written
    torn = e.filter("seq % 100 = 0").select(F.substring(F.to_json(F.struct("*")), 1, 20).alias("value"))
    torn.write.mode("append").text(path)
    return logs.read_events(spark, path, "error").select("seq", "run", "ts", "event", "value")


@query(
    "S4_count_broken",
    """SELECT count(*) AS good, count(*) FILTER (WHERE event_id % 100 = 0) AS broken FROM events""",
)
def count_broken(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"))
    path = scratch_path(spark, "log")
    logs.append_events(e, path)
    e.filter("seq % 100 = 0").select(F.lit('{"run": 1, "se').alias("value")).write.mode("append").text(path)
    return logs.count_broken(spark, path)


@query(
    "S5_load_store",
    """SELECT 's' || doc_id AS signature, 'fix-' || doc_id AS verified_fix, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 100 / 100.0 END AS DOUBLE) AS confidence,
      CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE toxic END AS BIGINT) AS failure_count, quality = 1 OR doc_id % 3 = 0 AS verified,
      CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'q' || quality END AS q
    FROM labels WHERE doc_id % 5 <> 0 AND doc_id % 9 <> 0 AND doc_id % 13 <> 0""",
)
def load_store(spark, sf):
    d = F.col("doc_id")
    raw = v.table(spark, sf, "labels").select(
        F.when(d % 5 != 0, F.concat(F.lit("s"), d)).alias("signature"),
        F.lit(None).cast("string").alias("sig_id"),
        F.concat(F.lit("fix-"), d).alias("verified_fix"),
        F.when(d % 9 == 0, F.lit("n/a")).when(d % 4 != 0, (d % 100 / 100).cast("string")).alias("confidence"),
        F.lit("").alias("llm_time_s"),
        F.lit("3").alias("times_retrieved"),
        F.when(d % 2 == 1, F.col("toxic").cast("string")).alias("failure_count"),
        F.when(d % 3 != 0, F.col("quality").cast("string")).alias("verified"),
        F.when(d % 13 == 0, F.lit('{"q": '))
        .when(d % 11 == 0, F.lit("[1, 2]"))
        .otherwise(F.to_json(F.struct(F.concat(F.lit("q"), F.col("quality")).alias("q"))))
        .alias("metadata"),
    )
    path = scratch_path(spark, "store")
    raw.write.option("header", "true").option("escape", '"').csv(path)
    return stores.load_store(spark, path).select(
        "signature", "verified_fix", "confidence", "failure_count", "verified",
        F.coalesce(F.try_element_at("metadata", F.lit("q")), F.lit("")).alias("q"),
    )


@query(
    "S6_gated_write",
    """WITH g AS (SELECT doc_id AS path, CASE WHEN NOT n_chars > 50 THEN 'length' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'noise'
        WHEN regexp_matches(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') THEN 'mail' END AS gate, n_chars FROM documents)
    SELECT path, coalesce(gate, 'passed') AS outcome, CASE WHEN gate = 'length' THEN n_chars || ' characters' WHEN gate IS NOT NULL THEN gate || ' found' END AS reason FROM g""",
)
def gated_write(spark, sf):
    docs = v.corpus(spark, sf)
    n, src = F.length("source"), F.col("source")
    gates = [
        ("length", n > 50, F.concat(n, F.lit(" characters"))),
        ("noise", ~src.rlike("[#$%&*]{3}"), F.lit("noise found")),
        ("mail", ~src.rlike("[A-Za-z0-9.]+@[A-Za-z0-9.]+"), F.lit("mail found")),
    ]
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    gated.gated_write(docs, gates, good, bad)
    passed = spark.read.parquet(good).select("path", F.lit("passed").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    return passed.unionByName(spark.read.parquet(bad).select("path", F.col("gate").alias("outcome"), "reason"))


@query(
    "S6_gated_commit",
    """SELECT doc_id AS path, CASE WHEN n_chars > 50 THEN 'passed' ELSE 'length' END AS outcome, CASE WHEN n_chars > 50 THEN NULL ELSE n_chars || ' characters' END AS reason,
      text AS source FROM documents""",
)
def gated_commit(spark, sf):
    """The second run's pair is what a reader sees; the first run judged by another gate."""
    docs, path, n = v.corpus(spark, sf), scratch_path(spark, "pair"), F.length("source")
    gated.gated_commit(docs, [("length", n > 9, F.lit("short"))], path)
    gated.gated_commit(docs, [("length", n > 50, F.concat(n, F.lit(" characters")))], path)
    good, bad = gated.read_gated(spark, path)
    passed = good.select("path", F.lit("passed").alias("outcome"), F.lit(None).cast("string").alias("reason"), "source")
    return passed.unionByName(bad.select("path", F.col("gate").alias("outcome"), "reason", "source"))


@query(
    "S7_write_report",
    f"WITH {v.RISK} SELECT risk_level, count(*) AS n_docs FROM risk GROUP BY 1",
)
def write_report(spark, sf):
    path = scratch_path(spark, "report")
    logs.write_report(scans.risk_breakdown(scans.risk(v.corpus(spark, sf), TEXT_RULES)), path)
    return spark.read.schema("risk_level string, n_docs bigint").json(path)
