"""Views over the shared tables, once as Spark expressions and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulant.operators.store import signature_of_corpus
from rivulant.plans.scratch import settle
from rivulant.rules.portable import TEXT_RULES


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("path"), F.col("text").alias("source"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "pages")
    return df.select(F.col("page_id").alias("path"), F.col("html").alias("source"))


def page_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Each page and, as its new version, the next page; the last page stands for itself."""
    old = pages(spark, sf)
    new = old.select((F.col("path") - 1).alias("path"), F.col("source").alias("_next"))
    return old.join(new, "path", "left").select("path", "source", F.coalesce("_next", "source").alias("ported"))


PAGE_VERSIONS = """
pg AS (SELECT a.page_id AS path, a.html AS source, coalesce(b.html, a.html) AS ported
  FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1)"""


def err_log(spark: SparkSession, sf: str) -> DataFrame:
    """Error events as log lines: run (user), day, event, line text."""
    e = table(spark, sf, "events").filter("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("bigint")
    message = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("use of undeclared identifier 's"), k % 7, F.lit("'")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("unknown type name 't"), k % 7, F.lit("'")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("'h"), k % 7, F.lit(".h' file not found")))
        .otherwise(F.concat(F.lit("something odd "), k % 3))
    )
    return e.select(
        F.col("user_id").alias("run"),
        F.to_date("ts").alias("day"),
        "event_id",
        F.concat(
            F.lit("u"), F.col("user_id"), F.lit(".cpp:"), F.col("event_id") % 90 + 1, F.lit(":"),
            F.col("event_id") % 40 + 1, F.lit(": error: "), message,
        ).alias("raw"),
    )


ERR_LOG = """
err_log AS (
  SELECT user_id AS run, CAST(ts AS DATE) AS day, event_id,
    'u' || user_id || '.cpp:' || (event_id % 90 + 1) || ':' || (event_id % 40 + 1) || ': error: ' ||
    CASE event_id % 4
      WHEN 0 THEN 'use of undeclared identifier ''s' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 7) || ''''
      WHEN 1 THEN 'unknown type name ''t' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 7) || ''''
      WHEN 2 THEN '''h' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 7) || '.h'' file not found'
      ELSE 'something odd ' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) END AS raw
  FROM events WHERE event_type = 'error')"""


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rules_cte(rules=TEXT_RULES) -> str:
    rows = ", ".join(
        f"({i}, {sql_text(r.name)}, {sql_text(r.pattern)}, {sql_text(r.severity)})"
        for i, r in enumerate(rules)
    )
    return f"rules(rule_no, rule, pattern, severity) AS (VALUES {rows})"


RULES = rules_cte()


def hits_cte(rules=TEXT_RULES, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """(path, rule, severity, n) of rules that hit; patterns stay literals for the engine's regex."""
    parts = " UNION ALL ".join(
        f"SELECT {key} AS path, {sql_text(r.name)} AS rule, {sql_text(r.severity)} AS severity, "
        f"len(regexp_extract_all({text}, {sql_text(r.pattern)})) AS n FROM {source}"
        for r in rules
    )
    return f"hits AS (SELECT * FROM ({parts}) WHERE n > 0)"


HITS = hits_cte()

RISK = f"""{HITS},
risk AS (
  SELECT d.doc_id AS path,
    CASE WHEN max(CASE WHEN h.severity = 'high' THEN 1 ELSE 0 END) = 1 THEN 'red'
         WHEN max(CASE WHEN h.severity = 'medium' THEN 1 ELSE 0 END) = 1 THEN 'yellow'
         ELSE 'green' END AS risk_level,
    CAST(coalesce(sum(h.n), 0) AS BIGINT) AS n_findings,
    count(DISTINCT h.rule) AS matched_rules,
    CAST({len(TEXT_RULES)} AS BIGINT) AS rules_checked
  FROM documents d LEFT JOIN hits h ON h.path = d.doc_id GROUP BY 1)"""

SIGS = f"""{HITS},
sigs AS (
  SELECT d.doc_id AS path,
    coalesce(string_agg(h.rule || ':' || upper(h.severity), '|' ORDER BY h.rule), '') AS signature
  FROM documents d LEFT JOIN hits h ON h.path = d.doc_id GROUP BY 1)"""


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    return signature_of_corpus(corpus(spark, sf), TEXT_RULES)


def staged_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures materialised once: the texts are read and matched a single time, later steps read short keys."""
    return settle(signatures(spark, sf).select("path", "signature"))


def store_batch(spark: SparkSession, sf: str, sigs: DataFrame) -> DataFrame:
    """Labelled documents as ordered store writes; toxic ones report a failed attempt."""
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "path")
    return sigs.join(labels, "path").select(
        "signature",
        F.col("path").alias("seq"),
        (F.col("toxic") == 1).alias("negative"),
        F.concat(F.lit("fix-"), F.col("path")).alias("fix"),
        (F.col("path") % 100 / 100).alias("confidence"),
        F.lit(0.0).alias("llm_time_s"),
        (F.col("quality") == 1).alias("verified"),
        F.create_map(
            F.concat(F.lit("k"), F.col("path") % 3), F.concat(F.lit("v"), F.col("path"))
        ).alias("metadata"),
        F.concat(F.lit("err-"), F.col("path")).alias("error"),
    )


def store_requests(spark: SparkSession, sf: str, sigs: DataFrame) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("path"))
    return sigs.join(labels, "path", "left_anti").select("path", "signature")


# The ordered merge as an inclusive fold: row k is accepted when (verified, confidence) is not
# below every earlier accepted or offered row of its key.
STORE = f"""{SIGS},
batch AS (
  SELECT s.signature, l.doc_id AS seq, l.toxic = 1 AS negative, 'fix-' || l.doc_id AS fix,
    l.doc_id % 100 / 100.0 AS confidence, l.quality = 1 AS verified
  FROM sigs s JOIN labels l ON l.doc_id = s.path WHERE s.signature <> ''),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY signature ORDER BY seq) = 1 AND negative AS opens FROM batch),
scored AS (
  SELECT *, CASE WHEN NOT negative THEN (CASE WHEN verified THEN 1000000 ELSE 0 END) + round(confidence * 10000)
                 WHEN opens THEN 0 END AS standing FROM marked),
folded AS (
  SELECT *, max(standing) OVER (PARTITION BY signature ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM scored),
accepted AS (SELECT *, NOT negative AND (best IS NULL OR standing >= best) AS ok FROM folded),
store AS (
  SELECT signature,
    coalesce(max_by(fix, seq) FILTER (WHERE ok), '') AS verified_fix,
    CAST(coalesce(max_by(confidence, seq) FILTER (WHERE ok), 0) AS DOUBLE) AS confidence,
    count(*) FILTER (WHERE negative) AS failure_count,
    coalesce(max_by(verified, seq) FILTER (WHERE ok), false) AS verified
  FROM accepted GROUP BY 1)"""


def iteration_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Error lines with the number of the day among the run's active days, from 0."""
    from rivulant.plans.scan import running

    days = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.to_date("ts").alias("day")
    ).distinct()
    numbered = running(
        days, ["run"], ["day"], F.date_trunc("year", "day"),
        sums={"iteration": F.lit(1).cast("bigint")}, exclusive=True,
    )
    logged = err_log(spark, sf)
    return numbered.join(logged, ["run", "day"], "left").select("run", "iteration", "event_id", "raw")


ITERATIONS = f"""{ERR_LOG},
days AS (SELECT DISTINCT user_id AS run, CAST(ts AS DATE) AS day FROM events),
numbered AS (SELECT run, day, row_number() OVER (PARTITION BY run ORDER BY day) - 1 AS iteration FROM days),
iter_err AS (
  SELECT n.run, n.iteration, e.event_id, e.raw, regexp_replace(e.raw, '^[A-Za-z0-9_./-]+:[0-9]+:[0-9]+:\\s*', '') AS err
  FROM numbered n LEFT JOIN err_log e ON e.run = n.run AND e.day = n.day),
iters AS (
  SELECT run, iteration, count(raw) AS n_errors,
    CASE WHEN count(raw) > 0 THEN substring(sha256(string_agg(DISTINCT err, chr(10) ORDER BY err)), 1, 16) END AS error_set
  FROM iter_err GROUP BY 1, 2)"""


def iterations(spark: SparkSession, sf: str) -> DataFrame:
    """(run, iteration, n_errors, error_set) per active day of a user, materialised once."""
    from rivulant.operators.diagnostics import iteration_sets

    rows = iteration_errors(spark, sf)
    failed = iteration_sets(rows.filter("raw IS NOT NULL"))
    out = rows.select("run", "iteration").distinct().join(failed, ["run", "iteration"], "left").select(
        "run", "iteration", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "error_set"
    )
    return settle(out)


DIAGS = f"""{ERR_LOG},
typed AS (
  SELECT run, event_id AS seq, raw, regexp_extract(raw, '^([^ :]+):([0-9]+):([0-9]+):', 1) AS file,
    CAST(event_id % 90 + 1 AS INTEGER) AS line, CAST(event_id % 40 + 1 AS INTEGER) AS col,
    CASE event_id % 4 WHEN 0 THEN 'undeclared' WHEN 1 THEN 'unknown-type' WHEN 2 THEN 'missing-include' ELSE 'unknown' END AS kind,
    CASE WHEN event_id % 4 < 3 THEN regexp_extract(raw, '''([a-z0-9.]+)''', 1) ELSE '' END AS symbol, '' AS owner
  FROM err_log),
diags AS (
  SELECT run, kind, symbol, owner, line, min(seq) AS seq, arg_min(raw, seq) AS raw, arg_min(file, seq) AS file, arg_min(col, seq) AS col
  FROM typed GROUP BY 1, 2, 3, 4, 5)"""


def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    from rivulant.operators.diagnostics import parse_diagnostics

    return parse_diagnostics(err_log(spark, sf), ["run"], "event_id")
