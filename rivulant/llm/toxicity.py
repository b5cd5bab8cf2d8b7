"""Toxicity score: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.llm.common import map_texts
from rivulant.plans.scratch import settle

BITS = 20
SIZES = (4, 5, 6)
FEATURES = 2048
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _characters(text: bytes, block: int, reach: int) -> Iterator[np.ndarray]:
    """Code points of UTF-8 text in blocks of about `block` bytes, each with the last `reach` - 1 of the one before."""
    lo, last = 0, np.zeros(0, np.uint32)
    while lo < len(text):
        hi = min(len(text), lo + block)
        while hi < len(text) and text[hi] & 0xC0 == 0x80:  # never inside a character
            hi += 1
        here = np.frombuffer(text[lo:hi].decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        whole = np.concatenate([last, here])
        yield whole
        lo, last = hi, whole[max(0, len(whole) - reach + 1) :]


def grams(
    data: bytes,
    sizes: Sequence[int] = SIZES,
    bits: int = BITS,
    wanted: np.ndarray | None = None,
    block: int = 1 << 20,
) -> np.ndarray:
    """Distinct buckets of the text's character n-grams, only those marked in `wanted` if given.

    Characters are code points, A-Z lower-cased, with every blank as one sign and a blank
    at both ends.  Different n-grams may share one of the 2 ** bits buckets.  Overlapping
    blocks bound the memory a long text needs.
    """
    text = b" " + data.lower().translate(_BLANKS) + b" "
    reach, parts = max(sizes), []
    for part in _characters(text, block, reach):
        value = np.zeros(len(part), np.uint32)
        found = []
        for size in range(1, reach + 1):
            if len(part) < size:
                break
            value = value[: len(part) - size + 1] * np.uint32(0x01000193) ^ part[size - 1 :] + np.uint32(size)
            if size in sizes:
                mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                bucket = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)
                found.append(bucket if wanted is None else bucket[wanted[bucket]])
        if found:
            parts.append(np.unique(np.concatenate(found)))
    if not parts:
        return np.zeros(0, np.uint32)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


@dataclass
class Model:
    """The buckets with evidence, their weights and the constant."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = SIZES
    bits: int = BITS

    def __post_init__(self):
        self.wanted = None

    def score(self, data: bytes) -> float:
        if self.wanted is None:
            self.wanted = np.zeros(1 << self.bits, bool)
            self.wanted[self.buckets] = True
        held = grams(data, self.sizes, self.bits, self.wanted)
        total = self.bias + float(self.weights[np.searchsorted(self.buckets, held)].sum())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


@dataclass
class Evidence:
    """The chosen buckets, ascending, with their log-count ratios, and the counts they come from."""

    kept: np.ndarray
    ratio: np.ndarray


def evidence(seen: np.ndarray, toxic: np.ndarray, texts: int, positives: int, features: int, alpha: float) -> Evidence:
    """The `features` buckets whose counts stand out most from the share of toxic texts, of those seen more than once.

    The ratio is the log of a bucket's smoothed shares in toxic and other texts.
    """
    p, q = alpha + toxic, alpha + seen - toxic
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    share = positives / texts
    stands = np.abs(toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 1)
    kept = np.sort(np.argsort(-stands, kind="stable")[:features])
    kept = kept[seen[kept] > 1]
    return Evidence(kept, ratio[kept])


def constant(target: np.ndarray, sizes: tuple[int, ...], bits: int) -> Model:
    """Without both classes every score is the share of the one there is."""
    none = np.zeros(0, np.int64)
    share = float(target.mean()) if len(target) else 0.0
    return Model(none, none.astype(float), math.log((share + 0.01) / (1.01 - share)), sizes, bits)


def train(
    held: list[np.ndarray], target: np.ndarray, importance: np.ndarray, found: Evidence, sizes: tuple[int, ...], bits: int,
    decay: float = 1e-3, rounds: int = 200,
) -> Model:
    """Logistic loss with an L2 penalty over the features scaled by their ratios, in full-batch Adam steps.

    `held` has, for each text, the buckets of `found` that are in it.
    """
    kept, scale = found.kept, found.ratio
    column = np.searchsorted(kept, np.concatenate(held))
    per_row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    w = np.zeros(len(kept) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = importance.sum()
    for step in range(1, rounds + 1):
        z = np.bincount(per_row, weights=(w[:-1] * scale)[column], minlength=len(held)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) * importance / total
        g = np.append(np.bincount(column, weights=error[per_row], minlength=len(kept)) * scale + decay * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 / (1 + step / 50) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(kept, w[:-1] * scale, float(w[-1]), sizes, bits)


def fit(
    rows: list[np.ndarray],
    target: np.ndarray,
    importance: np.ndarray,
    sizes: tuple[int, ...] = SIZES,
    bits: int = BITS,
    features: int = FEATURES,
    alpha: float = 1.0,
) -> Model:
    """A model from the distinct buckets of each text, its label and its weight, all at hand."""
    if not len(rows) or not 0 < target.sum() < len(target):
        return constant(target, sizes, bits)
    seen, toxic = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for row, label in zip(rows, target):
        seen[row] += 1
        if label:
            toxic[row] += 1
    found = evidence(seen, toxic, len(target), int(target.sum()), features, alpha)
    wanted = np.zeros(1 << bits, bool)
    wanted[found.kept] = True
    return train([row[wanted[row]] for row in rows], target, importance, found, sizes, bits)


def bucket_counts(sample: DataFrame, sizes: Sequence[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """How many texts, and how many toxic ones, hold each bucket: 2 ** bits numbers, counted in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for target, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = grams(text or b"", sizes, bits)
                tables[0][found] += 1
                if target:
                    tables[1][found] += 1
        there = np.flatnonzero(tables[0])
        columns = [pa.array(there), *(pa.array(t[there]) for t in tables)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "seen", "toxic"])

    parts = sample.select("target", "text").repartition(4).mapInArrow(count, "bucket long, seen long, toxic long")
    table = parts.groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toArrow()
    seen, toxic = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    where = table["bucket"].to_numpy()
    seen[where], toxic[where] = table["seen"].to_numpy(), table["toxic"].to_numpy()
    return seen, toxic


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into the part that is never learned from (null ids never do)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def training_rows(
    docs: DataFrame, marks: DataFrame, label: str, id_col: str, text_col: str, parts: int, part: int, per_class: int
) -> DataFrame:
    """(text, target): at most `per_class` labelled texts of each class outside the held-out part.

    Chosen by the least hash of the id, so reruns agree.  The ids, at most
    2 * per_class of them, are what is broadcast; an id with two labels has the larger.
    """
    known = marks.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("target"))
    known = known.filter("target IN (0, 1)").filter(~held_out(F.col("_id"), parts, part)).filter("_id IS NOT NULL")
    known = known.groupBy("_id").agg(F.max("target").alias("target"))
    order = [F.xxhash64(F.lit("sample"), "_id"), F.col("_id")]
    chosen = known.filter("target = 1").orderBy(*order).limit(per_class).unionAll(
        known.filter("target = 0").orderBy(*order).limit(per_class)
    )
    return docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
        F.broadcast(chosen), F.col("_doc") == F.col("_id")
    ).select("text", "target")


def class_shares(marks: DataFrame, label: str, parts: int, part: int) -> dict[int, int]:
    """How many labelled ids each class has outside the held-out part."""
    known = marks.filter(F.col(label).isin(0, 1)).filter(~held_out(F.col("doc_id"), parts, part))
    return {int(r[0]): r[1] for r in known.groupBy(F.col(label).cast("int")).count().collect()}


def importances(target: np.ndarray, shares: dict[int, int]) -> np.ndarray:
    """Weights that give the sampled classes their shares among all labelled rows."""
    out = np.ones(len(target))
    for c in (0, 1):
        if (target == c).any():
            out[target == c] = shares.get(c, 0) / (target == c).sum()
    return out


def toxicity(
    docs: DataFrame,
    marks: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    threshold: float = 0.3,
    per_class: int = 1500,
    parts: int = 4,
    part: int = 2,
    sizes: tuple[int, ...] = SIZES,
    bits: int = BITS,
    features: int = FEATURES,
) -> DataFrame:
    """Score every row: doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    `marks` has doc_id and the label column; only rows whose crc32(doc_id as text)
    modulo `parts` is not `part` are learned from.  The model is fitted on at most
    `per_class` texts of each class.  Character n-grams of `sizes` fall into 2 ** `bits`
    buckets, which may hold several n-grams; the `features` buckets that tell the classes
    apart best carry weights.  What reaches the driver is bounded whatever the texts'
    length: two counts per bucket, and of each text at most `features` buckets.
    Scores come from the text alone.  A null text scores as an empty one; without
    labels of both classes every score is the same.
    """
    sample = settle(training_rows(docs, marks, label, id_col, text_col, parts, part, per_class))
    target = np.array([r[0] for r in sample.select("target").collect()], np.int64)
    if not 0 < target.sum() < len(target):
        model = constant(target, sizes, bits)
    else:
        seen, toxic = bucket_counts(sample, sizes, bits)
        found = evidence(seen, toxic, len(target), int(target.sum()), features, 1.0)
        wanted = np.zeros(1 << bits, bool)
        wanted[found.kept] = True
        kept = map_texts(
            sample, ["target"], "text",
            lambda texts: [pa.array([grams(t, sizes, bits, wanted).astype("<u4").tobytes() for t in texts], pa.binary())], "grams binary",
        ).collect()
        held = [np.frombuffer(bytes(r["grams"]), "<u4") for r in kept]
        target = np.array([r["target"] for r in kept], np.int64)
        model = train(held, target, importances(target, class_shares(marks, label, parts, part)), found, sizes, bits)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumn("held_out", held_out(F.col("doc_id"), parts, part))
    scored = map_texts(
        base, ["doc_id", "held_out"], "text",
        lambda texts: [pa.array([shared.value.score(t) for t in texts], pa.float64())], "score double",
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
