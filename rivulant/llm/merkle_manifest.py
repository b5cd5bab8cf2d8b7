"""Merkle manifest of a table: a root that commits to every row, and each row's proof against it.

Nodes are labelled by the interval of leaf ranks they cover.  An ancestor of a leaf is a node
whose interval holds the leaf's rank; a sibling on the way up is a child of such an ancestor
that covers the rest of it, the difference between the parent's interval and the own one.

The tree is built in tiers of `bits` levels.  A tier's block has at most 2 ** bits nodes, so a
group of any size is many small rows, and the tiers above shrink by that factor.  Proofs are put
together from the top: blocks meet the block above by (group, rank bucket), leaves meet theirs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulant.llm.common import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 6


def row_hash(values: Sequence[Column]) -> Column:
    """Hex SHA-256 of the values in order: `-` for null, else UTF-8 byte count, `:` and the value."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds `g` (index of the group in ascending order, null first), `rank` inside it and its size `n`.

    Rows are sorted by range; counts per (partition, group) give the offsets, so no group
    passes through one task.  The sorted table is written, since row numbers are read twice.
    """
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = placed.withColumns({
        "_pid": F.spark_partition_id(),
        "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    })
    placed = written(placed, "merkle-leaves")
    runs = placed.groupBy("_pid", group).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_pid").alias("_p"), F.col(group).alias("_group"), "_first", F.sum("_n").over(whole).alias("n"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.min("_pid").over(whole).alias("_start"),
    )
    # A group starts in one partition; groups before it are those of earlier partitions and of earlier order in its own.
    starts = runs.filter("_p = _start").withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("_group")))
    per_part = starts.groupBy("_p").agg(F.count("*").alias("_c"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition, no more
    per_part = per_part.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_base"))
    index = starts.join(per_part, F.col("_p") == F.col("_q")).select(
        F.col("_group").alias("_g2"), (F.col("_base") + F.col("_i") - 1).cast("long").alias("g")
    )
    runs = runs.join(index, F.col("_group").eqNullSafe(F.col("_g2")))
    joined = placed.join(runs, (F.col("_pid") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    rank = (F.col("_before") + F.col("_row") - F.col("_first")).cast("long")
    return joined.select(*rows.columns, "g", rank.alias("rank"), F.col("n").cast("long").alias("n"))


def _height(n: Column) -> Column:
    """Levels above a leaf until one node remains."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))


def _parents(nodes: Column) -> Column:
    """The next level of an array of (lo, hi, hash) nodes: two consecutive ones in a node."""

    def joined(i: Column) -> Column:
        first, second = F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)
        both = F.concat(first["hash"], F.coalesce(second["hash"], F.lit("")))
        return F.struct(
            first["lo"].alias("lo"), F.coalesce(second["hi"], first["hi"]).alias("hi"), F.sha2(both, 256).alias("hash")
        )

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), joined)


def _tier(nodes: DataFrame, tier: int, bits: int) -> DataFrame:
    """Blocks of one tier: (g, block, lo, n, levels, tree, hash); `tree` has every node but the block's root,
    each with its interval, its parent's interval and its level."""
    levels = F.greatest(F.least(_height(F.col("n")) - bits * tier, F.lit(bits)), F.lit(0))
    block = F.shiftright("lo", bits * (tier + 1))
    blocks = nodes.groupBy("g", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "hash"))).alias("l0"), F.max("n").alias("n")
    ).withColumn("levels", levels)
    for k in range(bits):
        above = F.when(F.col("levels") > k, _parents(F.col(f"l{k}"))).otherwise(F.col(f"l{k}"))
        blocks = blocks.withColumn(f"l{k + 1}", above)

    def labelled(k: int) -> Column:
        above = F.col(f"l{k + 1}")

        def child(node: Column, i: Column) -> Column:
            over = F.get(above, F.floor(i / 2).cast("int"))
            return F.struct(
                F.lit(k).alias("level"), node["lo"].alias("lo"), node["hi"].alias("hi"),
                over["lo"].alias("plo"), over["hi"].alias("phi"), node["hash"].alias("hash"),
            )

        return F.when(F.col("levels") > k, F.transform(f"l{k}", child)).otherwise(
            F.array().cast("array<struct<level:int,lo:bigint,hi:bigint,plo:bigint,phi:bigint,hash:string>>")
        )

    top = F.get(F.col(f"l{bits}"), 0)
    return blocks.select(
        "g", "block", "n", "levels", top["lo"].alias("lo"), top["hi"].alias("hi"), top["hash"].alias("hash"),
        F.flatten(F.array(*[labelled(k) for k in range(bits)])).alias("tree"),
    )


def _steps(rank: Column, tree: Column, levels: Column, bits: int) -> Column:
    """Per level of a block, the hashes left and right of the node that holds `rank`; empty where there is none."""

    def beside(node: Column) -> Column:
        in_parent = (node["plo"] <= rank) & (rank < node["phi"])
        return in_parent & ~((node["lo"] <= rank) & (rank < node["hi"]))

    def step(k: Column, siblings: Column) -> Column:
        here = F.filter(siblings, lambda s: s["level"] == k)
        left = F.transform(F.filter(here, lambda s: s["lo"] < rank), lambda s: s["hash"])
        right = F.transform(F.filter(here, lambda s: s["lo"] > rank), lambda s: s["hash"])
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    ladder = F.slice(F.array(*[F.lit(k) for k in range(bits)]), F.lit(1), levels)
    per_tree = F.transform(
        F.array(F.filter(tree, beside)), lambda siblings: F.transform(ladder, lambda k: step(k, siblings))
    )
    return F.get(per_tree, 0)


def _build(leaves: DataFrame, bits: int) -> list[DataFrame]:
    """Blocks of every tier of (g, rank, n, hash) leaves, lowest first; each is written."""
    largest = leaves.agg(F.max("n")).first()[0] or 1
    tiers = max(1, -(-((largest - 1).bit_length()) // bits))
    nodes = leaves.select("g", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "n", "hash")
    out = []
    for tier in range(tiers):
        out.append(written(_tier(nodes, tier, bits), f"merkle-tier{tier}"))
        nodes = out[-1].select("g", "lo", "hi", "n", "hash")
    return out


def _attach(nodes: DataFrame, shift: int, blocks: DataFrame, bits: int, keep: Sequence[str]) -> DataFrame:
    """Containment join: every node of (g, lo) gets the way up through the block that holds it, and on to the root."""
    above = blocks.select(
        F.col("g").alias("_g"), F.col("block").alias("_block"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
        F.col("tree").alias("_tree"), F.col("levels").alias("_levels"), F.col("steps").alias("_up"), "subroot", "root",
    )
    inside = (F.col("_lo") <= F.col("lo")) & (F.col("lo") < F.col("_hi"))
    on = (F.col("g") == F.col("_g")) & (F.shiftright("lo", shift) == F.col("_block")) & inside
    own = _steps(F.col("lo"), F.col("_tree"), F.col("_levels"), bits)
    return nodes.join(above, on).select(*keep, F.concat(own, "_up").alias("steps"), "subroot", "root")


def _descend(tiers: list[DataFrame], crown: DataFrame | None, bits: int) -> DataFrame:
    """The lowest blocks with the steps from each block's root to the root of all, `subroot` and `root`.

    `crown` has the steps above each group's own root (g, steps, root); without it that root is the root.
    """
    none = F.array().cast("array<struct<left:string,right:string>>")
    if crown is None:
        blocks = tiers[-1].withColumns({"steps": none, "subroot": F.col("hash"), "root": F.col("hash")})
    else:
        above = crown.select(F.col("lo").alias("_c"), "steps", "root")
        blocks = tiers[-1].join(above, F.col("g") == F.col("_c")).drop("_c").withColumn("subroot", F.col("hash"))
    for tier in range(len(tiers) - 2, -1, -1):
        kept = tiers[tier].columns
        blocks = _attach(tiers[tier], bits * (tier + 2), blocks, bits, kept)
    return blocks


def merkle_manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    group: str = "lang",
    id_col: str = "doc_id",
    presented: Mapping[str, Column] | None = None,
    bits: int = BITS,
) -> DataFrame:
    """Per row: the id, leaf, subroot, root, steps, presented (leaf hash as presented), folded_root, verified.

    A leaf is `row_hash` of `columns`.  Inside a group leaves ascend by id, then by hash; two
    consecutive nodes (the last may be alone) are hashed into their parent until one is left.
    The groups' roots, in ascending order of the group, null first, are folded the same way.
    `steps` is the proof: per level the hash to the left and to the right, empty where there
    is none.  `presented` gives changed expressions for columns; the row as changed is folded
    along the untouched proof and is verified if that gives the root.

    A null value is hashed as `-`, an empty text as `0:`.  Null ids come first in their group;
    repeated rows are leaves of their own with equal hashes.  A lone leaf is its group's root,
    a lone group's root is the root.  An empty table gives no rows.  Other columns are not read.
    """
    presented = dict(presented or {})
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(group).alias("_lang"),
        row_hash([F.col(c) for c in columns]).alias("leaf"),
        (row_hash([presented.get(c, F.col(c)) for c in columns]) if presented else F.lit(None).cast("string")).alias("_shown"),
    )
    leaves = written(ranked(rows, "_lang", ["doc_id", "leaf"]), "merkle-ranks")
    tiers = _build(leaves.select("g", "rank", "n", F.col("leaf").alias("hash")), bits)
    tops = tiers[-1].select("g", "hash")
    groups = tops.agg(F.count("*").alias("_groups"))
    tops = tops.crossJoin(groups).select(  # one row against the count
        F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), F.col("_groups").alias("n"), "hash"
    )
    crown_tiers = _build(tops, bits)
    crown_leaves = tops.select("g", F.col("rank").alias("lo"))
    crown = _attach(crown_leaves, bits, _descend(crown_tiers, None, bits), bits, ["lo"])
    blocks = _descend(tiers, crown, bits)
    out = _attach(
        leaves.withColumn("lo", F.col("rank")), bits, blocks, bits, ["doc_id", "leaf", F.coalesce("_shown", "leaf").alias("presented")]
    )
    folded = F.aggregate("steps", F.col("presented"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    out = out.withColumn("folded_root", folded)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(steps: Column) -> Column:
    """Hex SHA-256 of a proof's hashes, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)
