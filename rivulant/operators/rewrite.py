"""Bulk rewriting and rubric scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.functions.text import let
from rivulant.rules import Insertion, Rename, Term


def _apply(state: Column, rule: Rename | Insertion) -> Column:
    """One rule on struct<t: text, n: counts so far>."""
    if isinstance(rule, Insertion):
        return let(state, lambda s: _insert(s, rule))

    def body(s: Column) -> Column:
        hit = F.struct(
            F.regexp_replace(s["t"], rule.pattern, rule.replacement).alias("t"),
            F.concat(
                s["n"], F.array(F.regexp_count(s["t"], F.lit(rule.pattern)).cast("bigint"))
            ).alias("n"),
        )
        miss = F.struct(
            s["t"].alias("t"), F.concat(s["n"], F.array(F.lit(0).cast("bigint"))).alias("n")
        )
        return F.when(s["t"].rlike(rule.pattern), hit).otherwise(miss)

    return let(state, body)


def _insert(s: Column, rule: Insertion) -> Column:
    """The greedy prefix of the pattern ends at the anchor's last match."""
    line = rule.line.replace("\\", "\\\\").replace("$", "\\$")
    after = F.regexp_replace(s["t"], rf"\A([\s\S]*{rule.anchor})", f"$1{line}")
    text = F.when(s["t"].rlike(rule.anchor), after).otherwise(F.concat(F.lit(rule.line), s["t"]))
    due = ~s["t"].rlike(rule.unless)
    return F.struct(
        F.when(due, text).otherwise(s["t"]).alias("t"),
        F.concat(s["n"], F.array(due.cast("bigint"))).alias("n"),
    )


def rewrite(corpus: DataFrame, renames: Sequence[Rename | Insertion], text: str = "source") -> DataFrame:
    """apply an ordered rename table; `changes` lists the rules that fired with their counts.

    Each rule sees the text the rules before it left.  The steps are nested
    bindings in one expression: its size grows with the number of rules, and a
    filter on the result that the optimizer moves down repeats it once, where a
    chain of projections would multiply with every step.
    """
    state = F.struct(F.col(text).alias("t"), F.array().cast("array<bigint>").alias("n"))
    for rule in renames:
        state = _apply(state, rule)
    labels = F.array(*[F.lit(r.label) for r in renames])
    log = F.filter(
        F.zip_with(labels, F.col("_s.n"), lambda label, n: F.struct(label.alias("label"), n.alias("n"))),
        lambda c: c["n"] > 0,
    )
    keep = [c for c in corpus.columns if c != text]
    return corpus.select(*keep, state.alias("_s")).select(
        *keep, F.col("_s.t").alias("new_source"), log.alias("changes")
    )


def change_counts(rewritten: DataFrame) -> DataFrame:
    """Replacements and changed texts per rule."""
    # The outer form keeps the optimizer from testing `changes` once more below.
    each = rewritten.select(F.inline_outer("changes")).filter("label IS NOT NULL")
    return each.groupBy("label").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")
    )


def rubric_score(
    df: DataFrame, terms: Sequence[Term], cap: float = 100.0, group_caps: dict[str, float] | None = None
) -> DataFrame:
    """a capped sum over groups; in a group the first holding term counts.

    A group named in `group_caps` adds up all its holding terms instead, up to
    its cap.  Conditions are SQL over the columns of `df`.
    """
    caps = group_caps or {}
    groups: dict[str, list[Term]] = {}
    for term in terms:
        groups.setdefault(term.group, []).append(term)
    total = F.lit(0.0)
    for name, members in groups.items():
        if name in caps:
            part = F.lit(0.0)
            for t in members:
                part = part + F.when(F.expr(t.condition), F.lit(float(t.points))).otherwise(F.lit(0.0))
            part = F.least(F.lit(float(caps[name])), part)
        else:
            part = None
            for t in members:
                hit, points = F.expr(t.condition), F.lit(float(t.points))
                part = F.when(hit, points) if part is None else part.when(hit, points)
            part = part.otherwise(F.lit(0.0))
        total = total + part
    return df.withColumn("score", F.least(F.lit(float(cap)), total))
