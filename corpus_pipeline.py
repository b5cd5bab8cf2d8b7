"""From raw documents to a tokenised training stream: five stages, each over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.  Between stages the rows are written as Parquet.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulant.llm.common import documents, restrict, text_hash
from rivulant.llm.exact_dedup import digest_of, exact_dedup
from rivulant.llm.mixing import mix, stream
from rivulant.llm.quality_rules import quality_filter
from rivulant.llm.sentencepiece_codec import round_trip
from rivulant.llm.simhash import representatives, simhash_groups
from rivulant.plans import files
from rivulant.plans.scratch import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; rows equal in id and text count as one."""
    kept = exact_dedup(docs).filter("kept").select("doc_id", "digest")
    return restrict(docs, kept, {"doc_id": F.col("doc_id"), "digest": digest_of(F.col("text"))})


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the least doc_id stays."""
    kept = representatives(simhash_groups(docs))
    return restrict(docs, kept, {"doc_id": F.col("doc_id"), "text_hash": text_hash(F.col("text"))})


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, a row per time taken, in training order; n_chars follows a cut text.

    Files are written in that order and rows inside a file too; `tokens` reads it back from there.
    """
    return stream(mix(docs), docs).withColumn("n_chars", F.char_length("text").cast("long"))


def in_file_order(docs: DataFrame) -> DataFrame:
    """Adds `position`, the 1-based place of each row in the order of the files it was read from, and `pass`, how
    often the document came up to there.  Rows not read from Parquet files have neither.

    Writers number files in the order of the partitions.  The place is the row's number in its file plus the rows of
    the files before, one short row per file.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # the frame is not a table of files
        return docs.withColumns({"position": F.lit(None).cast("long"), "pass": F.lit(None).cast("long")})
    files = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select(F.col("_file").alias("_f"), "_n").select("_f", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = placed.join(offsets, F.col("_file") == F.col("_f"))
    placed = placed.withColumn("position", (F.col("_offset") + F.col("_row") + 1).cast("long"))
    # rows without an id are told apart by their text
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), text_hash(F.col("text")))).orderBy("position")
    return placed.withColumn("pass", F.row_number().over(same).cast("long")).select(*docs.columns, "position", "pass")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, position and pass of the training order, n_tokens, token_ids, decoded_sha256, round_trip of every row."""
    return round_trip(in_file_order(docs), ["doc_id", "source", "position", "pass"]).withColumnRenamed("same", "round_trip")


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mixing),
    ("sentencepiece", tokens),
]

#: Expectation-maximisation, classes of linked fingerprints and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what the stage read is not needed again
            files.delete(spark, before)
        before = path
    return docs
