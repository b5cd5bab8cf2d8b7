"""Text conventions and plan helpers the operators of this subpackage share.

Words are `[^\\x20\\x09-\\x0D]+`; lower-casing touches A-Z only.  Python code works
on UTF-8 bytes: `bytes.split()` and `bytes.lower()` follow the same two rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulant.plans.scratch import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in blocks of about `size` bytes, so that a very long text needs little memory."""
    start = 0
    while start < len(data):
        cut = _GAP.search(data, start + size)
        end = cut.start() if cut else len(data)
        yield data[start:end].split()
        start = end


def word_spans(words: Sequence[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each starts and ends in it."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def map_texts(
    docs: DataFrame,
    keep: Sequence[str],
    text: str,
    fn: Callable[[list[bytes]], Sequence],
    schema: str,
) -> DataFrame:
    """One output row per input row: the columns `keep` and what `fn` makes of a batch of texts.

    `fn` gets UTF-8 bytes (null counts as empty) and returns Arrow arrays, one per
    further column of `schema`, which `;` separates.  Spark bounds the batches by bytes.
    """
    kinds = dict(docs.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(len(keep)).cast(pa.binary()).to_pylist()
                made = fn([t or b"" for t in texts])
                columns = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=names)

    made = schema.replace(";", ",")
    full = f"{head}, {made}" if head else made
    names = [*keep, *(part.split()[0] for part in schema.split(";"))]
    return docs.select(*keep, F.col(text)).mapInArrow(run, full)


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder; the shuffle files it took are removed when it is complete.

    Later steps read the table, so they do not depend on those files; a lost executor
    costs at most the step that runs.
    """
    conf, path = df.sparkSession.conf, scratch_path(df.sparkSession, name)
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEAN_UP)
        else:
            conf.set(CLEAN_UP, before)
    return df.sparkSession.read.parquet(path)


def text_hash(text: Column) -> Column:
    """Tells rows apart that repeat an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def restrict(docs: DataFrame, keep: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of `docs` whose key values are in `keep`; rows of equal keys count as one.

    `keys` names the columns of `keep` and gives their expressions over `docs`.  They
    are compared as structs, in which nulls are equal; dropping repeats groups by the
    join's own key and needs no further shuffle.
    """
    left = docs.withColumn("_key", F.struct(*[expr.alias(name) for name, expr in keys.items()]))
    right = keep.select(F.struct(*[F.col(name) for name in keys]).alias("_kept"))
    kept = left.join(right, F.col("_key") == F.col("_kept"), "left_semi")
    return kept.dropDuplicates(["_key"]).select(*docs.columns)
