"""Rule-based static checks over masked source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.functions.text import let, lines_of, newlines, strip
from rivulant.operators.findings import match_lines
from rivulant.operators.masking import mask_text
from rivulant.operators.quality import duplicates, malformed_declarations, unreachable_lines
from rivulant.operators.symbols import CONTROL_WORDS, FUNCTION_NAMES
from rivulant.rules import Rule, device


def source_rules() -> list[tuple[Rule, str]]:
    """The device pack as (rule, view): `masked` has comments and literals blanked, `directives` comments only."""
    out = [
        (Rule("invalid-hip-construct", rf"\b{name}\b", "error", f"'{name}': {why}"), "masked")
        for name, why in sorted(device.INVALID_CONSTRUCTS.items())
    ]
    out.append(
        (
            Rule("cuda-header", device.FOREIGN_HEADER, "error", "foreign header left; include <hip/hip_runtime.h> instead"),
            "directives",
        )
    )
    # one pattern for all leftover symbols: the message takes the symbol from the match
    names = "|".join(device.RESIDUAL_SYMBOLS)
    out.append(
        (Rule("residual-cuda-symbol", rf"\b(?:{names})\b", "error", "'{}' is not defined on the target"), "masked")
    )
    out += [
        (Rule("global-non-void", device.GLOBAL_NON_VOID, "error", "a __global__ function must return void"), "masked"),
        (Rule("warp-mask-32", device.LANE_MASK_32, "warning", "32-bit lane mask reaches half of 64 lanes"), "masked"),
        (Rule("warp-size-32", device.LANE_LITERAL_32, "warning", "lane count fixed at 32"), "masked"),
    ]
    return out


def static_findings(
    corpus: DataFrame,
    rules: Sequence[tuple[Rule, str]] | None = None,
    masks: dict | None = None,
    text: str = "source",
) -> DataFrame:
    """(keys, rule, severity, line, message, evidence), one row per match, map-only.

    `{}` in a description stands for the matched text.
    """
    rules = source_rules() if rules is None else rules
    keep = [c for c in corpus.columns if c != text]
    staged = corpus.select(
        *keep,
        lines_of(F.col(text)).alias("_lines"),
        mask_text(F.col(text), **(masks or {})).alias("masked"),
        mask_text(F.col(text), keep_literals=True, **(masks or {})).alias("directives"),
    )

    def tagged(rule: Rule, view: str) -> Column:
        return F.transform(
            match_lines(F.col(view), rule.pattern),
            lambda m: F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(rule.severity).alias("severity"),
                m["line"].alias("line"),
                F.replace(F.lit(rule.description), F.lit("{}"), m["hit"]).alias("message"),
            ),
        )

    hits = F.concat(*[tagged(r, view) for r, view in rules])
    with_text = let(
        F.col("_lines"),
        lambda lines: F.transform(
            hits,
            lambda h: h.withField(
                "evidence", strip(F.coalesce(F.get(lines, h["line"] - 1), F.lit("")))
            ),
        ),
    )
    return staged.select(*keep, F.inline(with_text))


def all_source_findings(corpus: DataFrame, key: str = "path") -> DataFrame:
    """F21 with the neighbouring-line rules and duplicate definitions, as one findings table."""
    columns = [key, "rule", "severity", "line", "message", "evidence"]
    unreachable = unreachable_lines(corpus).select(
        key, F.lit("unreachable-code").alias("rule"), F.lit("warning").alias("severity"), "line",
        F.concat(F.lit("statement follows an unconditional jump on line "), "jump_line").alias("message"), "evidence",
    )
    malformed = malformed_declarations(corpus).select(
        key, F.lit("malformed-declaration").alias("rule"), F.lit("warning").alias("severity"), "line",
        F.lit("declaration ends without a terminator or a body").alias("message"), "evidence",
    )
    masked = mask_text(F.col("source"))
    # the definition counts where its name stands, which may be below the start of the match
    head = lambda hit: F.regexp_replace(hit, r"\s*\([^;{]*\)\s*(?:const\s*)?\{$", "")
    named = F.zip_with(
        match_lines(masked, FUNCTION_NAMES),
        F.regexp_extract_all(masked, F.lit(FUNCTION_NAMES), F.lit(1)),
        lambda m, name: F.struct(
            name.alias("name"), (m["line"] + newlines(head(m["hit"]))).alias("line")
        ),
    )
    symbols = corpus.select(key, F.inline(named)).filter(~F.col("name").isin(*CONTROL_WORDS))
    twice = duplicates(symbols, [key]).select(
        key, F.lit("duplicate-definition").alias("rule"), F.lit("error").alias("severity"), "line",
        F.concat(F.lit("'"), "name", F.lit("' is defined "), "n", F.lit(" times")).alias("message"),
        F.col("name").alias("evidence"),
    )
    out = static_findings(corpus).select(*columns)
    for part in (unreachable, malformed, twice):
        out = out.unionByName(part)
    return out
