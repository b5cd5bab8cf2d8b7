"""Rule scan queries: F1-F5, F14, F19, F21, A1-A4, A6, A19, K1."""

from pyspark.sql import functions as F

from rivulant.functions.text import lines_of
from rivulant.operators import findings as ops
from rivulant.rules import Rule
from rivulant.rules.portable import TEXT_RULES
from rivulant.workload import views as v
from rivulant.workload.registry import query

_PLACED = " UNION ALL ".join(
    f"""SELECT doc_id AS path, text, {v.sql_text(r.name)} AS rule, {v.sql_text(r.severity)} AS severity,
      regexp_extract_all(text, {v.sql_text(r.pattern)}) AS m,
      regexp_split_to_array(text, {v.sql_text(r.pattern)}) AS pieces FROM documents"""
    for r in TEXT_RULES
)
FINDINGS = f"""
placed AS ({_PLACED}),
each_hit AS (SELECT path, text, rule, severity, m, pieces, unnest(range(1, len(m) + 1)) AS k FROM placed),
findings AS (
  SELECT path, text, rule, severity, k, m[k] AS matched_text,
    CAST(1 + len(array_to_string(pieces[1:k], '') || array_to_string(m[1:k-1], ''))
      - len(replace(array_to_string(pieces[1:k], '') || array_to_string(m[1:k-1], ''), chr(10), '')) AS INTEGER) AS line
  FROM each_hit)"""


@query("F1_scan_rules", f"WITH {FINDINGS} SELECT path, rule, severity, line, matched_text FROM findings")
def scan_rules(spark, sf):
    return ops.scan_rules(v.corpus(spark, sf), TEXT_RULES).drop("description")


@query(
    "F2_with_context",
    f"""WITH {FINDINGS}, kept AS (
      SELECT path, rule, line,
        CASE WHEN text[-1] = chr(10) THEN string_split(text[1:-2], chr(10)) ELSE string_split(text, chr(10)) END AS ls
      FROM findings)
    SELECT path, rule, line,
      array_to_string(ls[greatest(1, line - 2):least(len(ls), line + 2)], chr(10)) AS context
    FROM kept""",
)
def with_context(spark, sf):
    found = ops.scan_rules(v.corpus(spark, sf), TEXT_RULES, context=(2, 2))
    return found.select("path", "rule", "line", "context")


@query(
    "F3_severity_lookup",
    f"""WITH {v.HITS} SELECT rule,
      CASE rule WHEN 'secret_token' THEN 'high' WHEN 'email' THEN 'high'
        WHEN 'long_number' THEN 'medium' WHEN 'license_line' THEN 'medium' ELSE 'low' END AS severity,
      CAST(sum(n) AS BIGINT) AS n FROM hits GROUP BY 1, 2""",
)
def severity_lookup(spark, sf):
    named = ops.scan_rules(v.corpus(spark, sf), TEXT_RULES).select("rule")
    known = [r for r in TEXT_RULES if r.severity != "low"]
    return ops.with_severity(named, known).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "F4_normalize_findings",
    """WITH dirty AS (
      SELECT event_id,
        CASE event_id % 5 WHEN 0 THEN ' ' || upper(event_type) || ' ' WHEN 1 THEN '  ' ELSE event_type END AS rule,
        CASE event_id % 9 WHEN 0 THEN ' High' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'med ' WHEN 3 THEN 'moderate'
          WHEN 4 THEN 'Low' WHEN 5 THEN 'informational' WHEN 6 THEN 'fatal' WHEN 7 THEN NULL ELSE '' END AS severity
      FROM events)
    SELECT CASE WHEN trim(rule) = '' THEN 'unknown_pattern' ELSE lower(trim(rule)) END AS rule,
      CASE lower(trim(severity)) WHEN 'high' THEN 'HIGH' WHEN 'critical' THEN 'HIGH' WHEN 'med' THEN 'MEDIUM'
        WHEN 'moderate' THEN 'MEDIUM' WHEN 'low' THEN 'LOW' WHEN 'informational' THEN 'LOW' ELSE 'UNKNOWN' END AS severity,
      count(*) AS n FROM dirty GROUP BY 1, 2""",
)
def normalize_findings(spark, sf):
    e = v.table(spark, sf, "events")
    five, nine = F.col("event_id") % 5, F.col("event_id") % 9
    rule = (
        F.when(five == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")))
        .when(five == 1, F.lit("  "))
        .otherwise(F.col("event_type"))
    )
    spellings = (" High", "CRITICAL", "med ", "moderate", "Low", "informational", "fatal", None)
    severity = F.lit("")
    for i, s in reversed(list(enumerate(spellings))):
        severity = F.when(nine == i, F.lit(s).cast("string")).otherwise(severity)
    dirty = e.select(rule.alias("rule"), severity.alias("severity"))
    return ops.normalize_findings(dirty).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "F5_needs_review",
    f"""SELECT doc_id AS path, regexp_matches(text, 'idiot|clown')
      OR regexp_matches(text, {v.sql_text(TEXT_RULES[0].pattern)}) AS needs_review FROM documents""",
)
def needs_review(spark, sf):
    return ops.needs_review(v.corpus(spark, sf), TEXT_RULES, "idiot|clown", ["token", "credential"])


@query(
    "F5_residual_symbols",
    """SELECT doc_id AS path, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z]{3,}'))), ',') AS symbols
      FROM documents""",
)
def residual_symbols(spark, sf):
    found = ops.residual_symbols(v.corpus(spark, sf), "[A-Z]{3,}")
    return found.withColumn("symbols", F.array_join("symbols", ","))


@query(
    "F14_token_budget",
    """SELECT doc_id AS path,
      CAST(greatest(2048, least(16384, CAST(floor(n_chars / 4.0 * 2) AS BIGINT) + 512)) AS BIGINT) AS budget FROM documents""",
)
def token_budget(spark, sf):
    docs = v.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("path"), ops.token_budget(F.col("n_chars"), 16384).alias("budget"))


@query("A1_risk", f"WITH {v.RISK} SELECT * FROM risk")
def risk(spark, sf):
    return ops.risk(v.corpus(spark, sf), TEXT_RULES)


@query("A1_risk_of_findings", f"WITH {v.RISK} SELECT * FROM risk")
def risk_of_findings(spark, sf):
    docs = v.corpus(spark, sf)
    return ops.risk_of_findings(docs, ops.scan_rules(docs, TEXT_RULES), TEXT_RULES)


@query(
    "A1_risk_breakdown",
    f"""WITH {v.RISK}, levels(risk_level) AS (VALUES ('green'), ('yellow'), ('red'))
    SELECT l.risk_level, count(r.path) AS n_docs FROM levels l LEFT JOIN risk r ON r.risk_level = l.risk_level GROUP BY 1""",
)
def risk_breakdown(spark, sf):
    return ops.risk_breakdown(ops.risk(v.corpus(spark, sf), TEXT_RULES))


@query(
    "A2_rule_counts",
    f"""WITH {v.RULES}, {v.HITS} SELECT r.rule, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS n_matches
      FROM rules r LEFT JOIN hits h ON h.rule = r.rule GROUP BY 1""",
)
def rule_counts(spark, sf):
    return ops.rule_counts(v.corpus(spark, sf), TEXT_RULES)


@query(
    "A3_severity_counts",
    f"""WITH {v.HITS} SELECT CAST(coalesce(sum(n) FILTER (WHERE severity = 'high'), 0) AS BIGINT) AS high,
      CAST(coalesce(sum(n) FILTER (WHERE severity = 'medium'), 0) AS BIGINT) AS medium,
      CAST(coalesce(sum(n) FILTER (WHERE severity = 'low'), 0) AS BIGINT) AS low,
      CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM hits""",
)
def severity_counts(spark, sf):
    return ops.severity_counts(ops.scan_rules(v.corpus(spark, sf), TEXT_RULES), ("high", "medium", "low"))


@query(
    "A4_report",
    f"""WITH {v.RISK}, a AS (
      SELECT count(*) AS total_files, count(*) FILTER (WHERE risk_level = 'green') AS green,
        count(*) FILTER (WHERE risk_level = 'yellow') AS yellow, count(*) FILTER (WHERE risk_level = 'red') AS red,
        CAST(sum(n_findings) AS BIGINT) AS findings FROM risk),
    b AS (
      SELECT count(*) FILTER (WHERE quality = 1) AS passed, count(*) AS verified_total,
        CAST(round_even(avg(CASE WHEN quality = 1 THEN doc_id % 100 ELSE 0 END), 1) AS DOUBLE) AS avg_confidence,
        CAST(round_even(count(*) FILTER (WHERE quality = 1) * 4.0, 1) AS DOUBLE) AS hours_saved,
        CAST(4.0 AS DOUBLE) AS hours_per_fix FROM labels)
    SELECT *, printf('files: %d red, %d yellow, %d green; passed: %d of %d, about %.1f hours saved at %.1f each',
      red, yellow, green, passed, verified_total, hours_saved, hours_per_fix) AS summary FROM a, b""",
)
def report(spark, sf):
    runs = v.table(spark, sf, "labels").select(
        (F.col("quality") == 1).alias("passed"), (F.col("doc_id") % 100).alias("confidence")
    )
    return ops.report(ops.risk(v.corpus(spark, sf), TEXT_RULES), runs)


@query(
    "A6_coverage_flags",
    """WITH s AS (SELECT (n_chars - len(regexp_extract_all(text, '[#$%&*]'))) * 100.0 / greatest(n_chars, 1) AS pct FROM documents)
    SELECT count(*) FILTER (WHERE pct > 80) AS covered, count(*) FILTER (WHERE NOT pct > 80) AS uncovered,
      count(*) AS total FROM s""",
)
def coverage_flags(spark, sf):
    docs = v.table(spark, sf, "documents")
    odd = F.regexp_count("text", F.lit("[#$%&*]"))
    pct = (F.col("n_chars") - odd) * F.lit(100.0) / F.greatest(F.col("n_chars"), F.lit(1))
    return ops.coverage_flags(docs.select(pct.alias("coverage_pct")))


_GROUPS = {"articles": ("the ", "der ", "les "), "pair": ("an",), "licence": ("license", "copyright"), "noise": ("###", "%%%")}
_GROUP_SQL = ", ".join(
    f"({i}, '{name}', "
    + " + ".join(f"(len(t) - len(replace(t, '{w}', ''))) // {len(w)}" for w in words)
    + ")"
    for i, (name, words) in enumerate(_GROUPS.items())
)


@query(
    "A19_keyword_profile",
    f"""WITH d AS (SELECT doc_id AS path, lower(text) AS t FROM documents),
    c AS (SELECT path, u.* FROM d, LATERAL (VALUES {_GROUP_SQL}) u(pos, keyword, n)),
    r AS (SELECT path, keyword, CAST(n AS BIGINT) AS n, row_number() OVER (PARTITION BY path ORDER BY n DESC, pos) AS rank
      FROM c WHERE n > 0)
    SELECT path, rank, keyword, n FROM r WHERE rank <= 3""",
)
def keyword_profile(spark, sf):
    return ops.keyword_profile(v.corpus(spark, sf), _GROUPS)


_ORDERED = f"""WITH {FINDINGS}, n AS (
      SELECT path, line, severity, rule, matched_text,
        row_number() OVER (PARTITION BY path ORDER BY line,
          CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, rule, matched_text, k) AS position FROM findings)
    SELECT path, position, line, severity, rule, matched_text FROM n"""


@query("K1_order_findings", _ORDERED)
def order_findings(spark, sf):
    found = ops.scan_rules(v.corpus(spark, sf), TEXT_RULES, ordered=True)
    return found.select(
        "path", F.col("position").cast("bigint").alias("position"), "line", "severity", "rule", "matched_text"
    )


@query("K1_order_findings_table", _ORDERED)
def order_findings_table(spark, sf):
    found = ops.scan_rules(v.corpus(spark, sf), TEXT_RULES).drop("description")
    ordered = ops.order_findings(found, order=("line", "severity", "rule", "matched_text"))
    return ordered.select("path", "position", "line", "severity", "rule", "matched_text")
