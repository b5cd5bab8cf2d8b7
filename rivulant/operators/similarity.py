"""Near names: candidate pairs by shared tokens, then the exact ratio, then one-to-one pairing."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.functions.text import fold_name, let
from rivulant.plans.scratch import settle


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def matcher_ratio(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio, which no built-in function computes.

    Declared non-deterministic so that a filter on the ratio does not make the
    optimizer compute it a second time.
    """
    return F.pandas_udf(_ratios, "double").asNondeterministic()(left, right)


def _codes(folded: Column) -> Column:
    """Code points of a text as an array of long integers."""
    return F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))


def _numbered(codes: Column) -> Column:
    """The elements, each numbered among its repeats, so that sets compare like bags."""
    return let(
        F.array_sort(codes), lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("c"), (i - F.array_position(cs, c)).alias("k")))
    )


def letters(folded: Column) -> Column:
    """The letters of a text as a bag."""
    return _numbered(_codes(folded))


def letter_pairs(folded: Column) -> Column:
    """The pairs of neighbouring letters of a text as a bag; told from letters by their size."""
    return _numbered(
        let(
            _codes(folded),
            lambda cs: F.zip_with(
                F.slice(cs, F.lit(1), F.greatest(F.size(cs) - 1, F.lit(0))),
                F.slice(cs, F.lit(2), F.greatest(F.size(cs) - 1, F.lit(0))),
                lambda x, y: (x + 1) * F.lit(1 << 32) + y,
            ),
        )
    )


def similar_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], threshold: float) -> DataFrame:
    """(on, name, match, similarity) of all pairs at or above the threshold.

    Exact, without comparing all names of a group.  A ratio r over total length s means
    r*s/2 letters in common, in at most 1 + (1-r)*s runs, so at least (1.5*r - 1)*s - 1
    letter pairs in common; lengths agree within r / (2 - r).  From its own length a name
    knows the least number of tokens it shares with any match and puts out only as many of its
    rarest tokens (by their number over all names) as must hit one of these: letter pairs,
    or letters where a short name may be a partner.  Names alone pass the join on tokens;
    lengths and the numbers of common letters and pairs are checked before the exact ratio.
    Needs a threshold above 2/3; both inputs hold distinct names.
    """
    if not threshold > 2 / 3:
        raise ValueError("blocking on shared letter pairs needs a threshold above 2/3")
    on, tiny = list(on), 1e-9
    band, gain = threshold / (2 - threshold), 1.5 * threshold - 1
    long_from = (2 - tiny) / (gain * (1 + band))  # from this length on a match shares at least two pairs less one
    n = F.length("_f")

    def tokens(df: DataFrame) -> DataFrame:
        base = df.select(*on, "name", fold_name(F.col("name")).alias("_f"))
        bag = F.concat(
            F.when(n >= long_from, letter_pairs(F.col("_f"))).otherwise(F.array().cast("array<struct<c:bigint,k:bigint>>")),
            F.when(band * n < long_from + 1, letters(F.col("_f"))).otherwise(F.array().cast("array<struct<c:bigint,k:bigint>>")),
            F.when(n == 0, F.array(F.struct(F.lit(-1).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("k")))).otherwise(
                F.array().cast("array<struct<c:bigint,k:bigint>>")
            ),
        )
        return base.select(*on, "name", n.alias("_n"), F.explode(bag).alias("_tok")).filter("name IS NOT NULL")

    sides = [settle(tokens(left)), settle(tokens(right))]
    rarity = sides[0].select("_tok").unionAll(sides[1].select("_tok")).groupBy("_tok").agg(F.count("*").alias("_uses"))
    rarity = settle(rarity)

    def prefix(side: DataFrame) -> DataFrame:
        is_pair = F.col("_tok.c") >= F.lit(1 << 32)
        known = side.join(rarity, "_tok").withColumn("_pairs", is_pair)
        per_name = known.groupBy(*on, "name", "_n", "_pairs").agg(
            F.array_sort(F.collect_list(F.struct("_uses", "_tok"))).alias("_by")  # as many as the name has letters
        )
        shared = F.when(F.col("_pairs"), F.ceil(gain * (1 + band) * F.col("_n") - 1 - tiny)).otherwise(
            F.ceil(threshold / (2 - threshold) * F.col("_n") - tiny)
        )
        size = F.least(F.size("_by"), (F.size("_by") - F.greatest(shared, F.lit(1)) + 1).cast("int"))
        return per_name.select(*on, "name", F.explode(F.slice("_by", F.lit(1), F.greatest(size, F.lit(1)))["_tok"]).alias("_tok"))

    a, b = prefix(sides[0]), prefix(sides[1]).withColumnRenamed("name", "match")
    met = a.join(b, [*on, "_tok"]).select(*on, "name", "match").distinct()
    met = met.withColumns({"_fa": fold_name(F.col("name")), "_fb": fold_name(F.col("match"))})
    la, lb = F.length("_fa"), F.length("_fb")
    total = la + lb
    near_length = F.least(la, lb) >= F.lit(band) * F.greatest(la, lb) - F.lit(tiny)
    in_common = lambda bag: F.size(F.array_intersect(bag(F.col("_fa")), bag(F.col("_fb"))))
    return (
        met.filter(near_length)
        .filter(in_common(letter_pairs) >= F.lit(gain) * total - F.lit(1 + tiny))
        .filter(2 * in_common(letters) >= F.lit(threshold) * total - F.lit(tiny))
        .withColumn("similarity", matcher_ratio(F.col("_fa"), F.col("_fb")))
        .filter(F.col("similarity") >= threshold)
        .select(*on, "name", "match", "similarity")
    )


def best_match(left: DataFrame, right: DataFrame, on: Sequence[str], threshold: float) -> DataFrame:
    """(on, name, match, similarity): the most similar name, the first in sort order on ties."""
    order = F.struct((-F.col("similarity")).alias("s"), F.col("match").alias("m"))
    return (
        similar_pairs(left, right, on, threshold)
        .groupBy(*on, "name")
        .agg(F.min(order).alias("o"))
        .select(*on, "name", F.col("o.m").alias("match"), (-F.col("o.s")).alias("similarity"))
    )


UNIONS = 16


def greedy_pairs(pairs: DataFrame, on: Sequence[str]) -> DataFrame:
    """One-to-one pairing that equals serving the names in sorted order, each taking its best free match.

    Each round looks at undecided pairs only.  A name is served when no smaller undecided name lists its
    best match; its other pairs and those of its match go, as do pairs of a larger name with a match
    that is the best of a smaller one.  The smallest name of every group of names tied by matches is
    served in each round, so rounds follow the longest chain of contested matches while only
    such chains are still read; all other names are done in the first ones.
    """
    on = list(on)
    choice = F.struct((-F.col("similarity")).alias("s"), F.col("match").alias("m"))
    left, served = settle(pairs.select(*on, "name", "match", "similarity")), []
    columns = left.columns
    while True:
        best = left.groupBy(*on, "name").agg(F.min(choice)["m"].alias("_best"))
        seen = left.join(best, [*on, "name"])
        wants = F.col("match") == F.col("_best")
        # per match: the smallest name that lists it, whether it wants it, and the smallest name that wants it
        claims = seen.groupBy(*on, "match").agg(
            F.min(F.struct("name", wants.alias("wants"))).alias("_first"), F.min(F.when(wants, F.col("name"))).alias("_holder")
        )
        won = claims.filter("_first.wants").select(*on, F.col("_first.name").alias("name"), F.col("match").alias("_won"))
        marked = seen.join(claims, [*on, "match"]).join(won, [*on, "name"], "left")
        is_won = F.col("_won").isNotNull() & (F.col("match") == F.col("_won"))
        gone = ~is_won & (F.col("_won").isNotNull() | F.col("_first.wants") | (F.col("name") > F.coalesce("_holder", F.col("name"))))
        kept = settle(marked.filter(~gone).select(*columns, is_won.alias("_served")))
        served.append(kept.filter("_served").select(*columns))
        left = kept.filter("NOT _served").select(*columns)
        if len(served) > UNIONS:
            served = [settle(reduce(DataFrame.unionAll, served))]
        if left.isEmpty():
            return reduce(DataFrame.unionAll, served)


def rename_candidates(
    removed: DataFrame, added: DataFrame, on: Sequence[str], threshold: float = 0.72
) -> DataFrame:
    """Removed names paired with added ones, (on, old, new, similarity to 4 places)."""
    paired = greedy_pairs(
        similar_pairs(removed.select(*on, "name").distinct(), added.select(*on, "name").distinct(), on, threshold),
        on,
    )
    return paired.select(
        *on,
        F.col("name").alias("old"),
        F.col("match").alias("new"),
        F.bround("similarity", 4).alias("similarity"),
    )
