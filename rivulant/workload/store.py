"""Signature store queries: A7, A8, J1, J2."""

from pyspark.sql import functions as F

from rivulant.operators import store as ops
from rivulant.operators.findings import scan_rules
from rivulant.plans.scratch import settle
from rivulant.rules.portable import TEXT_RULES
from rivulant.workload import views as v
from rivulant.workload.registry import query


@query(
    "A7_signature",
    f"WITH {v.SIGS} SELECT path, signature, substring(sha256(signature), 1, 16) AS digest FROM sigs",
)
def signature(spark, sf):
    return v.signatures(spark, sf)


@query(
    "A7_signature_of_findings",
    f"""WITH {v.SIGS} SELECT path, signature, substring(sha256(signature), 1, 16) AS digest
      FROM sigs WHERE signature <> ''""",
)
def signature_of_findings(spark, sf):
    return ops.signature(scan_rules(v.corpus(spark, sf), TEXT_RULES))


@query(
    "A7_parse_signature",
    f"""WITH {v.SIGS}, t AS (SELECT path, unnest(string_split(signature, '|')) AS tok FROM sigs WHERE signature <> '')
    SELECT path, split_part(tok, ':', 1) AS name, split_part(tok, ':', 2) AS severity FROM t""",
)
def parse_signature(spark, sf):
    return v.signatures(spark, sf).select("path", F.inline(ops.parse_signature(F.col("signature"))))


@query(
    "J2_merge_store",
    f"""WITH {v.STORE} SELECT signature, substring(sha256(signature), 1, 16) AS sig_id, verified_fix,
      confidence, failure_count, verified FROM store""",
)
def merge_store(spark, sf):
    merged = ops.merge_store(None, v.store_batch(spark, sf, v.staged_signatures(spark, sf)))
    return merged.select("signature", "sig_id", "verified_fix", "confidence", "failure_count", "verified")


@query(
    "J2_merge_store_times",
    f"""WITH {v.STORE} SELECT signature, CAST(0 AS BIGINT) AS times_retrieved,
      CAST(coalesce(max_by(seq % 7 / 4.0, seq) FILTER (WHERE ok), 0) AS DOUBLE) AS llm_time_s FROM accepted GROUP BY 1""",
)
def merge_store_times(spark, sf):
    """The time kept is that of the surviving fix."""
    batch = v.store_batch(spark, sf, v.staged_signatures(spark, sf)).withColumn("llm_time_s", F.col("seq") % 7 / 4)
    return ops.merge_store(None, batch).select("signature", "times_retrieved", "llm_time_s")


@query(
    "J2_merge_store_metadata",
    f"""WITH {v.STORE},
    said AS (
      SELECT signature, seq, 'k' || (seq % 3) AS key, 'v' || seq AS value FROM accepted WHERE ok
      UNION ALL SELECT signature, seq, 'last_error', 'err-' || seq FROM accepted WHERE negative)
    SELECT signature, key, max_by(value, seq) AS value FROM said GROUP BY 1, 2""",
)
def merge_store_metadata(spark, sf):
    merged = ops.merge_store(None, v.store_batch(spark, sf, v.staged_signatures(spark, sf)), seq_per_chunk=64)
    return merged.select("signature", F.explode("metadata"))


_LOOKUP = f"""{v.STORE},
reqs AS (SELECT path, signature FROM sigs WHERE path NOT IN (SELECT doc_id FROM labels)),
looked AS (
  SELECT r.path, r.signature, s.verified_fix AS fix, s.confidence AS fix_confidence, s.signature IS NOT NULL AS hit
  FROM reqs r LEFT JOIN (SELECT * FROM store WHERE verified AND verified_fix <> '') s ON s.signature = r.signature)"""


@query("J1_lookup", f"WITH {_LOOKUP} SELECT path, signature, hit, fix, fix_confidence FROM looked")
def lookup(spark, sf):
    sigs = v.staged_signatures(spark, sf)
    store = ops.merge_store(None, v.store_batch(spark, sf, sigs))
    return ops.lookup(v.store_requests(spark, sf, sigs), store)


@query(
    "J1_count_retrievals",
    f"""WITH {_LOOKUP} SELECT s.signature, count(l.path) AS times_retrieved
      FROM store s LEFT JOIN (SELECT * FROM looked WHERE hit) l ON l.signature = s.signature GROUP BY 1""",
)
def count_retrievals(spark, sf):
    sigs = v.staged_signatures(spark, sf)
    store = settle(ops.merge_store(None, v.store_batch(spark, sf, sigs)))  # looked up in and raised
    found = ops.lookup(v.store_requests(spark, sf, sigs), store)
    return ops.count_retrievals(store, found).select("signature", "times_retrieved")


@query(
    "A8_store_stats",
    f"""WITH {_LOOKUP}, a AS (
      SELECT count(*) AS entries, count(*) FILTER (WHERE verified AND verified_fix <> '') AS served_entries,
        CAST(0 AS BIGINT) AS retrievals, round_even(avg(confidence), 4) AS avg_confidence FROM store),
    b AS (
      SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
        round_even(count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE), 3) AS hit_rate FROM looked)
    SELECT * FROM a, b""",
)
def store_stats(spark, sf):
    sigs = v.staged_signatures(spark, sf)
    store = settle(ops.merge_store(None, v.store_batch(spark, sf, sigs)))  # looked up in and counted
    return ops.store_stats(store, ops.lookup(v.store_requests(spark, sf, sigs), store))
