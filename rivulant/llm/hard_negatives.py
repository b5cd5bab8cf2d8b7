"""Hard negatives by exact inner products of integer vectors, several candidates to a multiplication.

Kronecker packing: components are made non-negative by a bias, and those of several candidates
are laid into separated fields of one wide integer.  One multiplication per anchor component
then serves every candidate of the word; the fields of the sum, wide enough for the largest
biased product, are cut apart and the bias is taken off, which gives the exact scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulant.llm.common import written

CHUNK = 1024
SLICE = 256
NO_ID = (1 << 63) - 1


def field_bits(low: int, high: int, dims: int) -> int:
    """Bits that hold the sum of `dims` products of values biased from [low, high] to start at zero."""
    return max(1, (dims * (high - low) ** 2).bit_length())


def pack(candidates: np.ndarray, bias: int, bits: int, lanes: int) -> np.ndarray:
    """(dims, words): the components of `lanes` consecutive candidates of (n, dims) in fields of `bits` bits."""
    n, dims = candidates.shape
    biased = candidates + bias if candidates.dtype == object else (candidates + bias).astype(np.uint64)
    words = -(-n // lanes)
    if words * lanes > n:
        biased = np.concatenate([biased, np.zeros((words * lanes - n, dims), biased.dtype)])
    biased = biased.reshape(words, lanes, dims)
    shift = (lambda j: 1 << (bits * j)) if biased.dtype == object else (lambda j: np.uint64(1 << (bits * j)))
    total = biased[:, 0] * shift(0)
    for j in range(1, lanes):
        total = total + biased[:, j] * shift(j)
    return np.ascontiguousarray(total.T)


def unpack(words: np.ndarray, bits: int, lanes: int, n: int) -> np.ndarray:
    """(rows, n): the fields of (rows, words) sums."""
    if words.dtype == object:
        fields = [(words >> (bits * j)) & ((1 << bits) - 1) for j in range(lanes)]
    else:
        fields = [(words >> np.uint64(bits * j)) & np.uint64((1 << bits) - 1) for j in range(lanes)]
    return np.stack(fields, axis=2).reshape(len(words), -1)[:, :n]


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products of (a, dims) and (n, dims) integers, int64 where they fit and Python integers elsewhere.

    Two fields share a 64-bit word while they fit; wider fields go four to an unbounded integer.
    """
    dims = anchors.shape[1]
    if not len(anchors) or not len(candidates) or not dims:
        return np.zeros((len(anchors), len(candidates)), np.int64)
    low = min(0, int(anchors.min()), int(candidates.min()))
    high = max(0, int(anchors.max()), int(candidates.max()))
    bias, bits = -low, field_bits(low, high, dims)
    wide = bits > 32
    lanes = 4 if wide else 64 // bits
    if wide:
        anchors, candidates = anchors.astype(object), candidates.astype(object)
    packed = pack(candidates, bias, bits, lanes)
    if wide:
        sums = (anchors + bias) @ packed
    else:
        sums = np.einsum("ad,dw->aw", (anchors + bias).astype(np.uint64), packed)
    fields = unpack(sums, bits, lanes, len(candidates))
    if not wide:
        fields = fields.astype(np.int64)
    # (x + b)(y + b) summed is xy + b(sum of x) + b(sum of y) + dims b b
    left, right = anchors.sum(axis=1)[:, None], candidates.sum(axis=1)[None, :]
    return fields - bias * (left + right) - dims * bias * bias


def components(vectors: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of list-typed vectors as integers; shorter vectors are filled up with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(vectors.offsets.to_numpy())
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        table = flat.reshape(len(sizes), width)
    else:
        table = np.zeros((len(sizes), width))
        table[np.arange(width)[None, :] < sizes[:, None]] = flat
    whole = np.floor(table * scale)
    if whole.size and np.abs(whole).max() >= 2.0**31:
        return np.array([[int(v) for v in row] for row in whole], dtype=object).reshape(whole.shape)
    return whole.astype(np.int64)


def _align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    fill = lambda x: np.concatenate([x, np.zeros((len(x), width - x.shape[1]), x.dtype)], axis=1)
    return fill(a), fill(b)


def _ordered(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores as int64 that keep their order: themselves, or ranks among the distinct ones for wide integers."""
    if scores.dtype != object:
        return scores, None
    values, place = np.unique(scores, return_inverse=True)
    return place.reshape(scores.shape).astype(np.int64), values


class Best:
    """The first `keep` hits per (anchor, positive) by falling score, rising id and row; hits come in parts."""

    def __init__(self, keep: int):
        self.keep, self.parts, self.held = keep, [], 0

    def add(self, anchor: np.ndarray, positive: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if len(anchor):
            self.parts.append((anchor, positive, score, vec_id, row))
            self.held += len(anchor)
            if self.held > 4_000_000:
                self.squeeze()

    def squeeze(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        anchor, positive, score, vec_id, row = (np.concatenate(c) for c in zip(*self.parts))
        falling = _ordered(score)[0]
        order = np.lexsort((row, vec_id, -falling, positive, anchor))
        a, p = anchor[order], positive[order]
        first = np.append(True, (a[1:] != a[:-1]) | (p[1:] != p[:-1]))
        start = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
        order = order[np.arange(len(a)) - start < self.keep]
        best = anchor[order], positive[order], score[order], vec_id[order], row[order]
        self.parts, self.held = [best], len(order)
        return best


def _columns(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, vec_id (null as the largest long), label and components of a batch, in order of vec_id and row."""
    row = batch.column(0).to_numpy(zero_copy_only=False)
    ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    label = batch.column(2).to_numpy(zero_copy_only=False)
    order = np.lexsort((row, ids))
    return row[order], ids[order], label[order], components(batch.column(3).take(pa.array(order)), scale)


def _hits(values: np.ndarray, allowed: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, candidate) places of the `keep` largest allowed values per row; of equal values the earlier place."""
    n = values.shape[1]
    key = np.where(allowed, values * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
    if n > keep:
        key = np.partition(key, n - keep, axis=1)[:, n - keep :]
    anchor, at = np.nonzero(key > np.iinfo(np.int64).min)
    return anchor, n - 1 - key[anchor, at] % n


def _bounds(positive: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score s with low[0] p <= low[1] s and high[1] s <= high[0] p, exact for any size."""
    exact = positive.astype(object)
    return -((-low[0] * exact) // low[1]), (high[0] * exact) // high[1]


def _scan(block: dict, keep: int, scale: float, choose: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams candidates past a block of anchors and yields the task's best hits once, at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, best = block.value, Best(keep)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                row, ids, label, vectors = _columns(batch.slice(lo, CHUNK), scale)
                for at in range(0, len(anchors["row"]), SLICE):
                    part = {k: v[at : at + SLICE] for k, v in anchors.items()}
                    mine, theirs = _align(part["vectors"], vectors)
                    scores = products(mine, theirs)
                    for anchor, positive, place in choose(part, scores, row, label):
                        best.add(part["row"][anchor], positive, scores[anchor, place], ids[place], row[place])
        anchor, positive, score, vec_id, row = best.squeeze()
        top = NO_ID
        score = np.array([max(-top - 1, min(top, int(s))) for s in score], np.int64) if score.dtype == object else score
        names = ["anchor_row", "positive", "score", "vec_id", "row"]
        columns = [pa.array(anchor), pa.array(positive.astype(np.int32)), pa.array(score), pa.array(vec_id), pa.array(row)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


HITS = "anchor_row long, positive int, score long, vec_id long, row long"


def _first(hits: DataFrame, keep: int) -> DataFrame:
    """Each task's best hits brought together: at most `keep` per anchor, positive and task meet in a window."""
    order = Window.partitionBy("anchor_row", "positive").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _same_label(part: dict, scores: np.ndarray, row: np.ndarray, label: np.ndarray, keep: int):
    allowed = (part["label"][:, None] == label[None, :]) & (part["row"][:, None] != row[None, :])
    anchor, place = _hits(_ordered(scores)[0], allowed, keep)
    yield anchor, np.zeros(len(anchor), np.int64), place


def _other_label(part: dict, scores: np.ndarray, row: np.ndarray, label: np.ndarray, keep: int):
    """Hits per positive: one sort of a slice's values serves all its windows."""
    values, distinct = _ordered(scores)
    n = values.shape[1]
    least = np.iinfo(np.int64).min
    key = np.sort(
        np.where(part["label"][:, None] != label[None, :], values * n + (n - 1 - np.arange(n)), least), axis=1
    )
    for q in range(part["low"].shape[1]):
        low, high = part["low"][:, q], part["high"][:, q]
        if distinct is not None:
            low, high = np.searchsorted(distinct, low), np.searchsorted(distinct, high, "right") - 1
        else:
            limit = (1 << 62) // n  # beyond every score of this width
            low, high = (np.array([max(-limit, min(limit, int(v))) for v in b], np.int64) for b in (low, high))
        upto = (key < ((high + 1) * n)[:, None]).sum(axis=1)
        for back in range(1, keep + 1):
            at = upto - back
            found = key[np.arange(len(key)), np.maximum(at, 0)]
            good = np.flatnonzero((at >= 0) & (found >= low * n) & (found > least) & part["has"][:, q])
            yield good, np.full(len(good), q), n - 1 - found[good] % n


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: tuple[int, int] = (50, 100),
    high: tuple[int, int] = (95, 100),
    scale: float = 256.0,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """Per anchor and positive the first `negatives` rows of another label whose score lies in the window:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the exact inner product of floor(scale * component); higher scores come first,
    ties by smaller id.  An anchor's positives are its first `positives` other rows of its
    label.  The window is low[0] * positive <= low[1] * negative and
    high[1] * negative <= high[0] * positive (the default: half to 95 % of the positive's score).

    `anchors` says which rows are anchors.  They go out in blocks of about `block_bytes`; for
    each block all rows stream past once for the positives and once for the negatives, and a
    task hands on at most `negatives` hits per anchor and positive, whatever it has read.

    Rows with a null label, a null vector or a null or non-finite component (before or after
    scaling) take no part.  Shorter vectors count as filled up with zeros, so an empty one scores
    zero.  Repeated rows are rows of their own.  Null ids come last in ties and are null in the
    result; the id 2 ** 63 - 1 is not told from null.  Scores past a long are compared exactly
    inside a task and returned as the nearest long.  Labels are integers.  An empty table gives no rows.
    """
    session = vectors.sparkSession
    finite = ~F.exists(F.col("_vector"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(scale)) == F.lit(float("inf"))))
    kind = dict(vectors.select(F.col(vector_col)).dtypes)[vector_col]
    rows = vectors.select(
        F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"),
        F.col(vector_col).cast("array<double>" if "double" in kind else "array<float>").alias("_vector"),
        F.coalesce(anchors, F.lit(False)).alias("_anchor"),
    )
    rows = rows.filter(F.col("_label").isNotNull() & F.col("_vector").isNotNull()).filter(
        finite if "double" in kind else ~F.exists(
            F.col("_vector"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    )
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "negatives-rows")
    chosen = rows.filter("_anchor")
    size = chosen.agg(F.sum(F.size("_vector") * 8 + 200)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    scanned = rows.select("_row", "_id", "_label", "_vector")
    out = None
    for block in range(blocks):
        mine = chosen.filter(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == block).select("_row", "_id", "_label", "_vector")
        table = mine.toArrow().combine_chunks()
        batch = table.to_batches()[0] if table.num_rows else None
        if batch is None:
            continue
        row, ids, label, matrix = _columns(batch, scale)
        data = {"row": row, "label": label, "vectors": matrix}
        shared = session.sparkContext.broadcast(data)
        same = lambda *a: _same_label(*a, positives)
        found = _first(scanned.mapInArrow(_scan(shared, positives, scale, same), HITS), positives)
        found = written(found, "negatives-positives")
        best = found.select("anchor_row", "rank", "score", "vec_id").toPandas()  # `positives` rows per anchor of the block
        order = np.argsort(row)
        at = order[np.searchsorted(row[order], best["anchor_row"].to_numpy(np.int64))]
        score, has = np.zeros((len(row), positives), np.int64), np.zeros((len(row), positives), bool)
        score[at, best["rank"].to_numpy(np.int64) - 1] = best["score"].to_numpy(np.int64)
        has[at, best["rank"].to_numpy(np.int64) - 1] = True
        least, most = _bounds(score, low, high)
        wider = session.sparkContext.broadcast(data | {"low": least, "high": most, "has": has})
        other = lambda *a: _other_label(*a, negatives)
        hits = _first(scanned.mapInArrow(_scan(wider, negatives, scale, other), HITS), negatives)
        known = found.select(
            F.col("anchor_row").alias("_a"), (F.col("rank") - 1).alias("_q"), F.col("vec_id").alias("_pid"), F.col("score").alias("_ps")
        )
        named = mine.select(F.col("_row").alias("_r"), F.col("_id").alias("anchor_id"))
        hits = hits.join(known, (F.col("anchor_row") == F.col("_a")) & (F.col("positive") == F.col("_q")))
        hits = hits.join(named, F.col("anchor_row") == F.col("_r"))
        part = hits.select(
            "anchor_id", F.nullif("_pid", F.lit(NO_ID)).alias("positive_id"), "rank",
            F.nullif("vec_id", F.lit(NO_ID)).alias("negative_id"),
            F.col("_ps").alias("positive_score"), F.col("score").alias("negative_score"),
        )
        if blocks > 1:  # a broadcast lives no longer than its block
            part = written(part, "negatives-block")
            shared.unpersist()
            wider.unpersist()
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = session.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    return out
