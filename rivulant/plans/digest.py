"""Digests over the sorted items of a group, in constant memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_digest(items: DataFrame, keys: Sequence[str], order: Sequence[str | Column], text: str, repeat: Column | None = None,
                   separator: str = "|", length: int = 12, prefix: str = "") -> DataFrame:
    """(keys, digest): the first `length` hex digits of SHA-256 over a group's texts, sorted and joined by `separator`.

    Rows are sorted inside partitions and stream through one running hash per group, which goes
    on from batch to batch; no group is gathered, however many items or repeats it has.  Texts
    are hashed as UTF-8; a row counts `repeat` times.
    """
    keys = list(keys)
    times = F.lit(1).cast("long") if repeat is None else repeat.cast("long")
    rows = items.select(*keys, *[c.alias(f"_o{i}") if isinstance(c, Column) else F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                        F.col(text).alias("_text"), times.alias("_times"))
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *[f"_o{i}" for i in range(len(order))])
    placed = placed.select(*keys, F.col("_text").cast("binary").alias("_text"), "_times")
    kinds = dict(placed.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "digest string"])
    glue = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, done, digests = None, None, [], []

        def flush():
            columns = list(zip(*done)) or [()] * len(keys)
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, types)]
            out = pa.RecordBatch.from_arrays([*arrays, pa.array(digests, pa.string())], names=[*keys, "digest"])
            done.clear()
            digests.clear()
            return out

        types = []
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(keys))]
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *key, value, n in zip(*columns):
                if state is None or key != group:
                    if state is not None:
                        done.append(group)
                        digests.append(prefix + state.hexdigest()[:length])
                    group, state, first = key, hashlib.sha256(), True
                for _ in range(n):
                    if not first:
                        state.update(glue)
                    state.update(value or b"")
                    first = False
            if len(done) >= 10_000:
                yield flush()
        if state is not None:
            done.append(group)
            digests.append(prefix + state.hexdigest()[:length])
            yield flush()

    return placed.mapInArrow(run, schema)
