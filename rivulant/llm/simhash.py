"""SimHash near-duplicates with pigeonring filtering.

The 64 bits of a fingerprint are cut into `segments` pieces on a ring.  If two
fingerprints differ in at most `distance` bits, there is a piece from which every
chain of l consecutive pieces differs in at most floor(l * distance / segments) bits.
With more pieces than `distance` the first piece of that chain is equal and the second
differs in at most one bit.  So fingerprints meet on (first piece, second piece with
one bit masked); within such a group the longer chains are tested and only survivors
get the full Hamming test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulant.llm.common import map_texts, text_hash, word_blocks, word_spans
from rivulant.llm.components import components
from rivulant.plans.scratch import settle

GROUP_ROWS = 1 << 22


def simhash(data: bytes, shingle: int = 4) -> int:
    """Signed 64-bit fingerprint of a text's word shingles, repeats included; no words give zero."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(words: list[bytes], size: int) -> None:
        nonlocal n, counts
        joined, starts, ends = word_spans(words)
        spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), "<u8", len(words) - size + 1)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)

    for block in word_blocks(data.lower()):
        words = tail + block
        if len(words) < shingle:
            tail = words
            continue
        add(words, shingle)
        tail = words[len(words) - shingle + 1:]
    if not n and tail:
        add(tail, len(tail))
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 4) -> DataFrame:
    """The columns `keep` and `fp` (long) for every row; a null text counts as empty."""
    return map_texts(
        docs, keep, text_col,
        lambda texts: [pa.array([simhash(t, shingle) for t in texts], pa.int64())],
        "fp long",
    )


def _bounds(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment; widths differ by one at most."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _piece(column: str, lo: int, width: int):
    return F.shiftrightunsigned(F.col(column), lo).bitwiseAND(F.lit((1 << width) - 1))


def chain_keys(fps: DataFrame, segments: int, distance: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, fp): the groups in which a fingerprint can meet another one.

    Fingerprints that share their first piece are counted; where more than
    `group_rows` do, they are cut into blocks, and a group is one pair of blocks, so
    that no task holds more than two blocks however many fingerprints share a key.
    The table of such pieces has segments * 2^ceil(64 / segments) rows at most, which
    is what makes its broadcast safe.
    """
    if not distance < segments <= 32 or 2 * distance // segments > 1:
        raise ValueError("needs more segments than differing bits")
    bounds = _bounds(segments)
    starts = [
        F.struct(
            F.lit(i).cast("long").alias("i"),
            _piece("fp", *bounds[i]).alias("first"),
            _piece("fp", *bounds[(i + 1) % segments]).alias("second"),
        )
        for i in range(segments)
    ]
    rows = fps.select("fp", F.explode(F.array(*starts)).alias("s")).select("fp", "s.*")
    heavy = (
        rows.groupBy("i", "first").count().filter(F.col("count") > group_rows)
        .select("i", "first", F.ceil(F.col("count") / group_rows).cast("long").alias("blocks"))
    )
    rows = rows.join(F.broadcast(heavy), ["i", "first"], "left")
    # masks: bit j of the second piece is taken out; one key when its budget is no difference at all
    widest = max(w for _, w in bounds)
    masks = [F.lit(~(1 << j)).cast("long") for j in range(widest)] if 2 * distance >= segments else [F.lit(-1).cast("long")]
    variants = F.array(*[F.struct(F.lit(j).cast("long").alias("j"), m.alias("mask")) for j, m in enumerate(masks)])
    rows = rows.select("*", F.explode(variants).alias("m"))
    code = F.shiftleft(F.col("i"), 58).bitwiseOR(F.shiftleft(F.col("m.j"), 52)).bitwiseOR(
        F.shiftleft(F.col("first"), 26)).bitwiseOR(F.col("second").bitwiseAND(F.col("m.mask")))
    rows = rows.select(code.alias("key"), "fp", "blocks")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
            lambda other: F.least(own, other) * F.lit(1 << 31) + F.greatest(own, other),
        )
    )
    return rows.select("key", F.explode(pairs).alias("pair"), "fp")


def _linked(one: np.uint64, many: np.ndarray, start: int, bounds: list, distance: int) -> np.ndarray:
    """Which of `many` link with `one`: chains from `start` within budget, then the full distance."""
    differs = many ^ one
    alive = np.arange(len(many))
    total = np.zeros(len(many), np.int64)
    for length in range(1, len(bounds) + 1):
        lo, width = bounds[(start + length - 1) % len(bounds)]
        piece = (differs[alive] >> np.uint64(lo)) & np.uint64((1 << width) - 1)
        total = total[: len(alive)] + np.bitwise_count(piece)
        within = total <= length * distance // len(bounds)
        alive, total = alive[within], total[within]
        if not len(alive):
            break
    linked = np.zeros(len(many), bool)
    linked[alive] = np.bitwise_count(differs[alive]) <= distance
    return linked


def _forest(values: np.ndarray, start: int, bounds: list, distance: int) -> list[tuple[int, int]]:
    """Edges that span the classes of one group: at most one fewer than its members, not all pairs."""
    left, edges = np.unique(values), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = _linked(one, left, start, bounds, distance)
            if near.any():
                found = left[near]
                edges += [(one, other) for other in found]
                queue += list(found)
                left = left[~near]
    return edges


def links(fps: DataFrame, distance: int = 4, segments: int = 5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that keep exactly the classes of all links within `distance`."""
    bounds = _bounds(segments)
    keyed = chain_keys(fps, segments, distance, group_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)

        def close(rows: np.ndarray):
            """Edges of the whole groups in `rows` (sorted by key and pair)."""
            if rows.shape[1] < 2:
                return None
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            begin, end = np.append(0, new), np.append(new, rows.shape[1])
            many = end - begin > 1
            a, b = [], []
            for lo, hi in zip(begin[many].tolist(), end[many].tolist()):
                start = int(rows[0, lo] >> 58) & 31
                for x, y in _forest(rows[2, lo:hi].view(np.uint64), start, bounds, distance):
                    a.append(x)
                    b.append(y)
            if not a:
                return None
            columns = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (a, b)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        waiting: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)) for i in range(3)])
            if not rows.shape[1]:
                continue
            same = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            waiting.append(rows[:, :cut] if cut else rows)
            if cut:
                out = close(np.concatenate(waiting, axis=1))
                if out is not None:
                    yield out
                waiting = [rows[:, cut:]]
        if waiting:
            out = close(np.concatenate([held, *waiting], axis=1))
            if out is not None:
                yield out

    order = ["key", "pair"]
    spread = keyed.repartition(*order).sortWithinPartitions(*order)
    return spread.mapInArrow(run, "a long, b long").distinct()


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    distance: int = 4,
    segments: int = 5,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Class of every row under links of at most `distance` differing bits: doc_id, text_hash, fp, component_id, root.

    component_id is the smallest doc_id reachable, itself included (null where all
    ids of the class are null).  Rows without words have fingerprint zero and link
    like any other.  Equal fingerprints are one node, so copies never become pairs;
    `root` is the least fingerprint of the class.
    `text_hash` tells rows apart that repeat an id.  Other columns are not read.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    marked = settle(fingerprints(base, ["doc_id", "text_hash"], "text", shingle))
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), distance, segments, group_rows)).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def representatives(groups: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of the row that stays of each class: the least id, null ids last, then the least text hash."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    return groups.groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_hash")
