"""Line dedup in DataFrame functions only: lines that many documents share are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.llm.common import BLANKS, ascii_lower, text_hash, written


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
) -> DataFrame:
    """Drop every line whose key at least `min_docs` documents hold; per row: doc_id, text, n_lines, n_dropped.

    A text is split at \\n; null and empty texts are one empty line.  The key is the
    line without blanks at both ends, A-Z lower-cased; keys under `min_chars` code
    points are never dropped.  A key counts once per document id (null ids are one
    document).  Repeated rows give the same result each.  Needs `id_col` and
    `text_col` only.

    The lines' 128-bit key hashes, ids and positions are written once and shuffled to
    count and flag lines; the texts move once, when the flags meet them.  Counting distinct ids per hash
    pre-aggregates per (hash, id), so a line of a third of the documents is shared out.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumn("_h", text_hash(F.col("_text")))
    lines = base.select("doc_id", "_h", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    key = line_key(F.col("_line"))
    lines = lines.select("doc_id", "_h", "_pos", key.alias("_key")).select(
        "doc_id", "_h", "_pos",
        F.when(F.char_length("_key") >= min_chars, F.xxhash64("_key")).alias("_a"),
        F.when(F.char_length("_key") >= min_chars, F.xxhash64(F.lit("second"), "_key")).alias("_b"),
    )
    lines = written(lines, "lines")
    common = (
        lines.filter(F.col("_a").isNotNull())
        .groupBy("_a", "_b")
        .agg(F.count_distinct(F.struct("doc_id")).alias("_docs"))
        .filter(F.col("_docs") >= min_docs)
        .select("_a", "_b")
    )
    # a table of its own: AQE broadcasts it by its size or splits the join's hot keys
    common = written(common, "common_lines")
    flags = (
        lines.join(common, ["_a", "_b"], "left_semi")
        .groupBy("doc_id", "_h")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_at"))
        .select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hh"), "_at")
    )
    met = base.join(flags, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hh")), "left")
    parts = F.split("_text", "\n", -1)
    # one boolean per line: a kept line's position is not among the flagged ones
    marked = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_at"))
    kept = F.when(F.col("_at").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(marked, lambda i: F.element_at(parts, i + 1)), "\n")
    )
    return met.select(
        "doc_id",
        kept.alias("text"),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("_at"), F.lit(0)).cast("long").alias("n_dropped"),
    )
