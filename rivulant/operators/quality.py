"""Text quality: line kinds, code-likeness, gates, depth."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.functions.text import count_of, is_blank, let, lines_of, running_total, strip
from rivulant.operators.diagnostics import first_n
from rivulant.operators.masking import PROSE_LITERAL, mask_text
from rivulant.operators.symbols import function_names
from rivulant.rules import device
from rivulant.rules import lines as kinds


def any_of(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in words)


CODE_LINE = (
    rf"^(?:{any_of(kinds.CODE_ANCHORS)}|\*)|{any_of(kinds.CODE_MARKS)}"
    r"|^(?:\{|\}|\};|\}\)|\}\);|\(\))$|^[A-Za-z_]\w*\s*:$"
)
SHAPE_CODE = (
    rf"^(?:{any_of(kinds.SHAPE_STARTS)})|{any_of(kinds.SHAPE_QUALIFIERS)}"
    rf"|[;{{}}]$|{any_of(kinds.SHAPE_MARKS)}"
)


@dataclass(frozen=True)
class GateRules:
    """Parameters of the lexical gate: all of them patterns and names."""

    code: str
    prose: Sequence[tuple[str, str, bool]]
    rejects: Sequence[tuple[str, str]] = ()
    single_hit: Sequence[str] = ()
    listed: Sequence[str] = ()
    strong: str | None = None
    max_prose_ratio: float = 0.15
    mask: dict | None = None


SOURCE_GATE = GateRules(
    code=CODE_LINE,
    prose=kinds.PROSE_KINDS,
    rejects=kinds.WHOLE_TEXT_REJECTS,
    single_hit=("reasoning", "section-heading"),
    listed=("bullet-list", "numbered-list"),
    strong=r"#include|__(?:global|device|host)__",
    mask={"literal": PROSE_LITERAL},
)


def prose_kind(
    line: Column, prose: Sequence[tuple[str, str, bool]], bare: Column | None = None
) -> Column:
    """Name of the first kind that fits the line, null if none; flagged kinds look at the stripped line."""
    bare = strip(line) if bare is None else bare
    out = None
    for name, pattern, stripped in prose:
        hit = (bare if stripped else line).rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def classify_lines(lines: DataFrame, rules: GateRules, text: str = "text") -> DataFrame:
    """kind of each line: blank, code, a prose kind, or other; first match wins."""
    line = F.col(text)
    kind = (
        F.when(is_blank(line), F.lit("blank"))
        .when(strip(line).rlike(rules.code), F.lit("code"))
        .otherwise(F.coalesce(prose_kind(line, rules.prose), F.lit("other")))
    )
    return lines.withColumn("kind", kind)


def code_score_of(
    text: Column,
    code: str = SHAPE_CODE,
    lead: str = kinds.SHAPE_LEADS,
    bullet: str = kinds.BULLET,
    sentence: str = kinds.SHAPE_SENTENCE,
    bonus: str = any_of(kinds.SHAPE_BONUS),
) -> Column:
    """F8 as a column: code lines over code and prose lines, a bonus for a strong marker."""

    def line_mark(x: Column) -> Column:
        """1 for code, 2 for prose, 0 for neither."""
        return let(
            strip(x),
            lambda bare: F.when(bare.rlike(code), F.lit(1))
            .when(bare.rlike(lead) | x.rlike(bullet) | bare.rlike(sentence), F.lit(2))
            .otherwise(F.lit(0)),
        )

    def score(marks: Column) -> Column:
        n_code = F.size(F.filter(marks, lambda m: m == 1))
        n_prose = F.size(F.filter(marks, lambda m: m == 2))
        base = n_code / (n_code + n_prose)
        lifted = F.when(text.rlike(bonus), F.least(F.lit(1.0), base + 0.15)).otherwise(base)
        return F.when(n_code + n_prose > 0, lifted).otherwise(F.lit(0.0))

    said = F.filter(lines_of(text), lambda x: ~is_blank(x))
    return let(F.transform(said, line_mark), score)


def code_score(df: DataFrame, text: str = "source", **patterns) -> DataFrame:
    return df.withColumn("code_score", code_score_of(F.col(text), **patterns))


def lexical_gate(
    corpus: DataFrame, rules: GateRules = SOURCE_GATE, text: str = "source", samples: int | None = None
) -> DataFrame:
    """Is the text source rather than prose?  One row per text, map-only.

    Whole-text patterns reject first, in order.  Then lines decide: a raw line
    that looks like code is code; the masked line (the raw one if masking left
    it blank) tells prose.  `samples` limits the prose lines that are shown; by
    default all are.
    """
    src = F.col(text)
    masked = mask_text(src, **rules.mask) if rules.mask is not None else src

    def line_rows(raw: Column) -> Column:
        def one(pair: Column, i: Column) -> Column:
            seen = F.when(is_blank(pair["m"]), pair["r"]).otherwise(pair["m"])
            return let(
                F.struct(strip(pair["r"]).alias("r"), seen.alias("m"), strip(seen).alias("b")),
                lambda t: F.struct(
                    (i + 1).alias("line"),
                    t["r"].alias("text"),
                    (t["r"] == "").alias("blank"),
                    F.when(t["r"] == "", F.lit(None).cast("string"))
                    .when(t["r"].rlike(rules.code), F.lit("code"))
                    .otherwise(prose_kind(t["m"], rules.prose, t["b"]))
                    .alias("kind"),
                ),
            )

        masked_lines = raw if rules.mask is None else lines_of(F.col("_masked"))
        pairs = F.zip_with(raw, masked_lines, lambda r, m: F.struct(r.alias("r"), m.alias("m")))
        return F.filter(F.transform(pairs, one), lambda row: ~row["blank"])

    keep = [c for c in corpus.columns if c != text]
    staged = corpus.withColumn("_masked", masked).withColumn("_lines", let(lines_of(src), line_rows))
    staged = staged.withColumn("_prose", F.filter("_lines", lambda r: r["kind"] != "code"))

    def n_of(names: Sequence[str]) -> Column:
        return F.size(F.filter("_prose", lambda r: r["kind"].isin(list(names)))) if names else F.lit(0)

    non_empty = F.size("_lines")
    n_code = F.size(F.filter("_lines", lambda r: r["kind"] == "code"))
    n_prose = F.size("_prose")
    reason = F.when(is_blank(src), F.lit("empty extraction"))
    for name, pattern in rules.rejects:
        reason = reason.when(src.rlike(pattern), F.lit(name))
    by_lines = F.when(F.lit(False), F.lit(""))
    for name in rules.single_hit:
        by_lines = by_lines.when(n_of([name]) >= 1, F.lit(name))
    by_lines = (
        by_lines.when(n_of(rules.listed) >= 1, F.lit("list"))
        .when((non_empty > 0) & (n_code == 0), F.lit("no code lines"))
        .when((non_empty > 0) & (n_prose / non_empty > rules.max_prose_ratio), F.lit("prose ratio"))
    )
    out = staged.select(
        *keep,
        F.coalesce(reason, by_lines).alias("reason"),
        non_empty.cast("bigint").alias("non_empty_lines"),
        n_code.cast("bigint").alias("code_lines"),
        n_prose.cast("bigint").alias("prose_lines"),
        F.transform(
            F.col("_prose") if samples is None else F.slice("_prose", 1, samples),
            lambda r: F.concat(F.lit("L"), r["line"], F.lit(" ["), r["kind"], F.lit("]: "), r["text"]),
        ).alias("samples"),
        (F.lit(False) if rules.strong is None else ~src.rlike(rules.strong)).alias("_weak"),
    )
    ok = F.col("reason").isNull()
    return out.select(
        *keep, ok.alias("ok"), "reason", "non_empty_lines", "code_lines", "prose_lines", "samples",
        (ok & F.col("_weak")).alias("warning"),
    )


# ---- depth -----------------------------------------------------------------------------


def balance(text: Column, opener: str, closer: str) -> Column:
    """Depth after the text; it stops at the first closer without an opener, hence -1."""
    only = F.regexp_replace(text, rf"[^\{opener}\{closer}]", "")
    return F.aggregate(
        F.filter(F.split(only, ""), lambda c: c != ""),
        F.lit(0),
        lambda depth, c: F.when(depth < 0, depth)
        .when(c == opener, depth + 1)
        .otherwise(depth - 1),
    )


def bracket_depth(
    corpus: DataFrame, opener: str = "{", closer: str = "}", text: str = "source"
) -> DataFrame:
    """(keys, line, depth, low): depth after each line and the lowest depth reached in it."""

    def line_stats(line: Column) -> Column:
        only = F.regexp_replace(line, rf"[^\{opener}\{closer}]", "")
        start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("low"))

        def step(acc: Column, c: Column) -> Column:
            d = acc["d"] + F.when(c == opener, F.lit(1)).when(c == closer, F.lit(-1)).otherwise(F.lit(0))
            return F.struct(d.alias("d"), F.least(acc["low"], d).alias("low"))

        return F.aggregate(F.split(only, ""), start, step)

    def rows(stats: Column) -> Column:
        deltas = F.transform(stats, lambda s: s["d"].cast("bigint"))
        return F.zip_with(
            stats,
            running_total(deltas),
            lambda s, total: F.struct(
                total.alias("depth"), (total - s["d"] + s["low"]).cast("bigint").alias("low")
            ),
        )

    keep = [c for c in corpus.columns if c != text]
    per_line = let(F.transform(lines_of(F.col(text)), line_stats), rows)
    return corpus.select(*keep, F.posexplode(per_line).alias("_i", "r")).select(
        *keep, (F.col("_i") + 1).alias("line"), "r.depth", "r.low"
    )


def depth_summary(depths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final depth, lowest depth and the first line that falls below zero."""
    return depths.groupBy(*keys).agg(
        F.max_by("depth", "line").alias("final_depth"),
        F.least(F.lit(0), F.min("low")).cast("bigint").alias("min_depth"),
        F.min(F.when(F.col("low") < 0, F.col("line"))).alias("first_unbalanced_line"),
    )


def region_bounds(lines: Column, start_pattern: str, opener: str = "{", closer: str = "}") -> Column:
    """array<struct<start, end>> (1-based): from a start line until its brackets close again.

    A region whose opener is on a later line is not closed early.  The fold keeps
    a few numbers and the bounds found so far; a region still open at the end
    runs to the last line.
    """
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("depth"),
        F.lit(False).alias("seen"), F.array().cast(kind).alias("out"),
    )

    flags = F.transform(
        lines,
        lambda line: F.struct(
            line.rlike(start_pattern).alias("hit"),
            count_of(line, opener).alias("opens"),
            count_of(line, closer).alias("closes"),
        ),
    )

    def step(acc: Column, line: Column) -> Column:
        i = acc["i"] + 1
        begins = (acc["start"] == 0) & line["hit"]
        inside = begins | (acc["start"] > 0)
        start = F.when(begins, i).otherwise(acc["start"])
        depth = F.when(begins, F.lit(0)).otherwise(acc["depth"]) + line["opens"] - line["closes"]
        seen = (~begins & acc["seen"]) | (line["opens"] > 0)
        closes = inside & seen & (depth <= 0)
        bound = F.array(F.struct(start.alias("start"), i.alias("end"))).cast(kind)
        return F.struct(
            i.alias("i"),
            F.when(closes | ~inside, F.lit(0)).otherwise(start).alias("start"),
            F.when(closes | ~inside, F.lit(0)).otherwise(depth).alias("depth"),
            (inside & ~closes & seen).alias("seen"),
            F.when(closes, F.concat(acc["out"], bound)).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        tail = F.array(F.struct(acc["start"].alias("start"), acc["i"].alias("end"))).cast(kind)
        return F.when(acc["start"] > 0, F.concat(acc["out"], tail)).otherwise(acc["out"])

    return F.aggregate(flags, zero, step, finish)


def region_lines(
    corpus: DataFrame, start_pattern: str = device.DEVICE_REGION_START, text: str = "source"
) -> DataFrame:
    """(keys, start, end) of each region."""
    keep = [c for c in corpus.columns if c != text]
    return corpus.select(*keep, F.inline(region_bounds(lines_of(F.col(text)), start_pattern)))


def region_text(text: Column, start_pattern: str) -> Column:
    """Only the region lines of a text, joined by newlines."""
    return let(
        lines_of(text),
        lambda lines: F.array_join(
            F.flatten(
                F.transform(
                    region_bounds(lines, start_pattern),
                    lambda b: F.slice(lines, b["start"], b["end"] - b["start"] + 1),
                )
            ),
            "\n",
        ),
    )


# ---- pairs of texts --------------------------------------------------------------------


def shape_flags(
    pairs: DataFrame,
    source: str = "source",
    ported: str = "ported",
    reject_ratio: float = 0.25,
    warn_ratio: float = 0.5,
    region: str | None = None,
    marker: str = kinds.TRUNCATION_MARK,
) -> DataFrame:
    """truncation marker and size of a new text against its source.

    With `region`, a row whose `port_mode` is DEVICE_SUBSET is measured against
    the matching regions of its source, if there are any.
    """
    said = lambda c: F.size(F.filter(lines_of(c), lambda x: ~is_blank(x))).cast("bigint")
    baseline = F.col(source)
    if region is not None:
        part = region_text(F.col(source), region)
        baseline = F.when(
            (F.col("port_mode") == "DEVICE_SUBSET") & ~is_blank(part), part
        ).otherwise(F.col(source))
    n_src, n_new = F.col("source_lines"), F.col("ported_lines")
    return (
        pairs.withColumn("source_lines", said(baseline))
        .withColumn("ported_lines", said(F.col(ported)))
        .withColumn("truncation_mark", F.col(ported).rlike(marker))
        .withColumn("too_short", (n_src > 0) & (n_new < n_src * reject_ratio))
        .withColumn("rather_short", (n_src > 0) & (n_new < n_src * warn_ratio))
    )


def structural_gate(
    pairs: DataFrame,
    names=function_names,
    mask=mask_text,
    region: str | None = device.DEVICE_REGION_START,
    marker: str = kinds.TRUNCATION_MARK,
) -> DataFrame:
    """A10: may the new text go to the compiler?  Needs source, ported, port_mode; map-only.

    Rejects on unbalanced brackets, a truncation marker, a size below a quarter
    of the source, or a name defined twice.  Dropped names and a size below one
    half only warn.
    """
    flagged = shape_flags(pairs, region=region, marker=marker)
    baseline = F.col("source")
    if region is not None:
        part = region_text(F.col("source"), region)
        baseline = F.when(
            (F.col("port_mode") == "DEVICE_SUBSET") & ~is_blank(part), part
        ).otherwise(F.col("source"))
    staged = (
        flagged.withColumn("_masked", mask(F.col("ported")))
        .withColumn("_old", names(mask(baseline)))
        .withColumn("_new", names(F.col("_masked")))
        .withColumn("brace_depth", balance(F.col("_masked"), "{", "}"))
        .withColumn("paren_depth", balance(F.col("_masked"), "(", ")"))
        .withColumn("missing_symbols", F.array_sort(F.array_except("_old", "_new")))
        .withColumn("_sorted", F.array_sort("_new"))
    )
    # in sorted order a repeated name equals its left neighbour
    twice = F.array_distinct(
        F.filter("_sorted", lambda x, i: (i > 0) & (x == F.get(F.col("_sorted"), i - 1)))
    )
    empty = is_blank(F.col("ported"))
    checks = (
        (~empty & (F.col("brace_depth") != 0), "braces"),
        (~empty & (F.col("paren_depth") != 0), "parentheses"),
        (~empty & F.col("truncation_mark"), "truncation marker"),
        (~empty & F.col("too_short"), "size"),
        (~empty & (F.size("duplicates") > 0), "duplicate definitions"),
        (empty, "empty"),
    )
    soft = (
        (~empty & (F.size("missing_symbols") > 0), "symbols dropped"),
        (~empty & F.col("rather_short"), "short"),
    )
    listed = lambda cs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in cs]))
    keep = [c for c in pairs.columns if c not in ("source", "ported", "port_mode")]
    out = staged.withColumn("duplicates", twice).select(
        *keep,
        listed(checks).alias("errors"),
        listed(soft).alias("warnings"),
        F.when(empty, F.array().cast("array<string>")).otherwise(F.col("missing_symbols")).alias("missing_symbols"),
    )
    ok = F.size("errors") == 0
    score = F.when(ok, F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.1) * F.size("warnings"))).otherwise(F.lit(0.0))
    return out.withColumn("ok", ok).withColumn("score", F.round(score, 4))


def duplicates(symbols: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Names that occur more than once per group, anchored at the second occurrence.

    `symbols` has (keys, name, line).  At most two rows per name and task are
    shuffled for the anchor; counts are summed before theirs.
    """
    group = [*keys, "name"]
    second = first_n(symbols.select(*group, "line"), group, ["line"], 2).filter("rn = 2").drop("rn")
    counts = symbols.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return second.join(counts, group)


# ---- neighbouring lines ----------------------------------------------------------------

JUMP = r"^(?:return\b[^;]*|break|continue)\s*;$"
JUMP_GUARD = r"\b(?:if|else|for|while|case|default)\b"
AFTER_JUMP_FINE = r"^\}|^(?:case\b|default\s*:|\w+\s*:(?!:))"


def unreachable_lines(
    corpus: DataFrame,
    jump: str = JUMP,
    guard: str = JUMP_GUARD,
    fine: str = AFTER_JUMP_FINE,
    text: str = "source",
    masked: Column | None = None,
) -> DataFrame:
    """(keys, line, jump_line, evidence): a statement right after an unconditional jump."""
    seen = masked if masked is not None else mask_text(F.col(text))
    keep = [c for c in corpus.columns if c != text]

    def pairs(said: Column) -> Column:
        n = F.greatest(F.size(said) - 1, F.lit(0))
        return F.zip_with(
            F.slice(said, F.lit(1), n), F.slice(said, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        )

    numbered = F.transform(lines_of(seen), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    said = F.filter(numbered, lambda r: ~is_blank(r["text"]))
    hits = F.filter(
        let(said, pairs),
        lambda p: strip(p["a"]["text"]).rlike(jump)
        & ~p["a"]["text"].rlike(guard)
        & ~strip(p["b"]["text"]).rlike(fine),
    )
    raw = lines_of(F.col(text))
    found = let(
        raw,
        lambda lines: F.transform(
            hits,
            lambda p: F.struct(
                p["b"]["line"].alias("line"),
                p["a"]["line"].alias("jump_line"),
                strip(F.get(lines, p["b"]["line"] - 1)).alias("evidence"),
            ),
        ),
    )
    return corpus.select(*keep, F.inline(found))


DECLARATION_GOES_ON = r"(?:;|\{|\}|,|\\|\(|&&|\|\||\+|-|=)$"


def malformed_declarations(
    corpus: DataFrame,
    start: str = device.DECLARATION_START,
    goes_on: str = DECLARATION_GOES_ON,
    body: str = r"^\{",
    text: str = "source",
) -> DataFrame:
    """(keys, line, evidence): a declaration that ends in nothing and whose next line opens no body."""
    keep = [c for c in corpus.columns if c != text]

    def rows(lines: Column) -> Column:
        pairs = F.transform(
            lines,
            lambda x, i: F.struct(
                (i + 1).alias("line"), x.alias("text"),
                F.coalesce(F.get(lines, i + 1), F.lit("")).alias("next"),
            ),
        )
        bad = F.filter(
            pairs,
            lambda p: p["text"].rlike(start)
            & ~strip(p["text"]).rlike(goes_on)
            & (count_of(p["text"], "(") <= count_of(p["text"], ")"))
            & ~strip(p["next"]).rlike(body),
        )
        return F.transform(
            bad,
            lambda p: F.struct(
                p["line"].alias("line"), strip(p["text"]).alias("evidence")
            ),
        )

    return corpus.select(*keep, F.inline(let(lines_of(F.col(text)), rows)))


