"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulant.llm.common import documents, labels
from rivulant.llm.exact_dedup import exact_dedup
from rivulant.llm.hard_negatives import hard_negatives
from rivulant.llm.language_id import language_id
from rivulant.llm.license_scan import license_scan
from rivulant.llm.line_dedup import line_dedup
from rivulant.llm.merkle_manifest import merkle_manifest, proof_digest
from rivulant.llm.mixing import mix
from rivulant.llm.quality_classifier import quality_classifier
from rivulant.llm.quality_rules import quality_rules
from rivulant.llm.sentencepiece_codec import round_trip
from rivulant.llm.simhash import simhash_groups
from rivulant.llm.substring_dedup import substring_dedup
from rivulant.llm.toxicity import toxicity

QUERIES = {}
ORACLES = {}
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


EXACT_SQL = f"""
WITH n AS (SELECT doc_id, sha256({LOWER_SQL.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)"""


@query("op3_exact_dedup", EXACT_SQL)
def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


LINE_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line,
    {LOWER_SQL.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common ON k.key = common.key GROUP BY k.doc_id"""


@query("op6_line_dedup", LINE_SQL)
def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup(documents(spark, sf))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    out = simhash_groups(documents(spark, sf))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    out = quality_rules(documents(spark, sf))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior",
    )


MIX_SQL = r"""
WITH b AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('mix:' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM b GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
r AS (SELECT *, max(CASE WHEN (budget - spent) / open * weight <= cap THEN (budget - spent) / open END) OVER () AS rate FROM f),
t AS (SELECT source, rank, CAST(source_size AS BIGINT) AS source_size, least(coalesce(rate * weight, cap), cap) AS target FROM r),
p AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, t.rank,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id) - b.size AS start
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(round(target) AS BIGINT) AS wanted, start / target AS d FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(greatest(least(wanted - start, size), 0) + greatest(least(wanted - start - source_size, size), 0) AS BIGINT) AS taken,
  CASE WHEN size > 0 AND start < wanted THEN round(CASE rank % 3
      WHEN 0 THEN least(2 * d / (1.5 + sqrt(greatest(2.25 - 2 * d, 0))), 1)
      WHEN 1 THEN least(d, 1)
      ELSE least(2 * d / (0.5 + sqrt(0.25 + 2 * d)), 1) END, 6) END AS position
FROM q"""


@query("op2_mixing", MIX_SQL)
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    out = mix(documents(spark, sf))
    first = F.round(F.get(F.col("positions.position"), F.lit(0)), 6)
    out = out.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return round_trip(documents(spark, sf), ["doc_id"]).withColumnRenamed("same", "round_trip")


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM s JOIN r USING (k)),
cov AS (SELECT DISTINCT doc_id, i + o AS p, true AS gone FROM hit CROSS JOIN range(35) t(o)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN cov ON cov.doc_id = words.doc_id AND cov.p = words.p
GROUP BY d.doc_id, d.w"""


@query("op4_substring_dedup", SUBSTRING_SQL)
def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(documents(spark, sf), labels(spark, sf))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_classifier(documents(spark, sf), labels(spark, sf))


# Every licence whose rule is one sentence; this table has no longer notices.
LICENSE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, CASE trim(line)
    WHEN 'Licensed under CC BY-NC 4.0.' THEN 'CC-BY-NC-4.0' WHEN 'Released under the MIT License.' THEN 'MIT'
    WHEN 'Licensed under the Apache License, Version 2.0.' THEN 'Apache-2.0'
    WHEN 'This work is licensed under the GNU General Public License, version 3.' THEN 'GPL-3.0-only' END AS licence FROM l)
SELECT doc_id, count(licence) AS n_sentences, coalesce(string_agg(licence, ',' ORDER BY pos) FILTER (WHERE licence IS NOT NULL), '') AS licences
FROM k GROUP BY doc_id"""


@query("op5_license_scan", LICENSE_SQL)
def op5_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = license_scan(documents(spark, sf))
    return out.select("doc_id", "n_sentences", F.array_join("licences.licence", ",").alias("licences"))


# CRC-32 of the decimal doc_id, bit by bit.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"""
MERKLE_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT *, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
      || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
    CASE WHEN {CRC_SQL} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS shown FROM documents),
leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    sha256(head || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(octet_length(encode(CAST(shown AS VARCHAR))) || ':' || shown, '-') || tail) AS presented FROM d),
tree AS (
  SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2
  FROM tree WHERE n > 1 GROUP BY lang, lvl, pos // 2),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS lvl, pos, h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2
  FROM crown WHERE n > 1 GROUP BY lvl, pos // 2),
way AS (
  SELECT doc_id, lang, 0 AS lvl, pos, n, presented AS acc, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.lvl + 1, w.pos // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.acc ELSE w.acc || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
  FROM way w LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl
    AND s.pos = w.pos + 1 - 2 * (w.pos % 2) WHERE w.n > 1),
climb AS (
  SELECT w.doc_id, 0 AS lvl, r.pos, r.n, w.acc, w.proof FROM way w JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT c.doc_id, c.lvl + 1, c.pos // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.acc ELSE c.acc || coalesce(s.h, '') END), c.proof || coalesce(s.h, '')
  FROM climb c LEFT JOIN crown s ON s.lvl = c.lvl AND s.pos = c.pos + 1 - 2 * (c.pos % 2) WHERE c.n > 1)
SELECT l.doc_id, l.leaf, r.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.acc AS folded_root, c.acc = t.h AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN climb c ON c.doc_id = l.doc_id AND c.n = 1, crown t
WHERE t.n = 1"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = merkle_manifest(documents(spark, sf), presented={"n_chars": changed})
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id(documents(spark, sf))
