"""Rule scans over a corpus and their roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.functions.text import any_contains, let, lines_of, newlines, running_total
from rivulant.operators.compare import gate_confidence
from rivulant.plans.scan import running
from rivulant.rules import SEVERITY_RANK, Rule, rule_table


def match_lines(text: Column, pattern: str) -> Column:
    """array<struct<line, hit>>: each match of the pattern with the line it starts on.

    `split` with a negative limit keeps the text around the matches, so the text
    before match k is pieces 1..k plus matches 1..k-1; only newline counts of
    those are summed, never the texts.
    """
    p = F.lit(pattern)

    def place(hits: Column, pieces: Column) -> Column:
        steps = F.transform(
            F.slice(pieces, F.lit(1), F.size(hits)),
            lambda piece, k: (
                newlines(piece) + F.coalesce(newlines(F.get(hits, k - 1)), F.lit(0))
            ).cast("bigint"),
        )
        return F.zip_with(
            hits,
            running_total(steps),
            lambda hit, before: F.struct((before + 1).cast("int").alias("line"), hit.alias("hit")),
        )

    found = let(
        F.regexp_extract_all(text, p, F.lit(0)),
        lambda hits: let(F.split(text, pattern, -1), lambda pieces: place(hits, pieces)),
    )
    empty = F.array().cast("array<struct<line:int,hit:string>>")
    return F.when(text.rlike(pattern), found).otherwise(empty)


def snippet(lines: Column, line: Column, before: int, after: int) -> Column:
    """Lines around a 1-based line, clamped at both ends, joined by newlines."""
    first = F.greatest(F.lit(1), line - before)
    last = F.least(F.size(lines), line + after)
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def scan_rules(
    corpus: DataFrame,
    rules: Sequence[Rule],
    *,
    context: tuple[int, int] | None = None,
    text: str = "source",
    ordered: bool = False,
) -> DataFrame:
    """one row per match of every rule.

    One projection holds an array per rule and is exploded once: the corpus is
    read once and nothing is shuffled.  Patterns are literals and are compiled
    once per task.  With `ordered`, `position` numbers the findings of a text
    by (line, severity rank, rule) inside the same projection.
    """
    src = F.col(text)

    def tagged(rule: Rule) -> Column:
        rank = SEVERITY_RANK.get(rule.severity, 9)
        return F.transform(
            match_lines(src, rule.pattern),
            lambda m: F.struct(
                m["line"].alias("line"),
                F.lit(rank).alias("rank"),
                F.lit(rule.name).alias("rule"),
                m["hit"].alias("matched_text"),
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.description).alias("description"),
            ),
        )

    hits = F.concat(*[tagged(r) for r in rules])
    if ordered:
        hits = F.array_sort(hits)
    if context is not None:
        before, after = context
        hits = let(
            lines_of(src),
            lambda lines: F.transform(
                hits,
                lambda h: h.withField("context", snippet(lines, h["line"], before, after)),
            ),
        )
    keep = [c for c in corpus.columns if c != text]
    out = corpus.select(*keep, F.posexplode(hits).alias("_pos", "f")).select(
        *keep, (F.col("_pos") + 1).alias("position"), "f.*"
    )
    return out.drop("rank") if ordered else out.drop("rank", "position")


def with_context(
    findings: DataFrame, corpus: DataFrame, before: int, after: int, key: str = "path"
) -> DataFrame:
    """F2 for findings that come from elsewhere: one join on the path."""
    lines = corpus.select(key, lines_of(F.col("source")).alias("_lines"))
    return (
        findings.join(lines, key, "left")
        .withColumn("context", snippet(F.col("_lines"), F.col("line"), before, after))
        .drop("_lines")
    )


def with_severity(findings: DataFrame, rules: Sequence[Rule], default: str = "low") -> DataFrame:
    """severity by rule name; names outside the table are low."""
    known = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.severity)])
    return findings.withColumn("severity", F.coalesce(F.try_element_at(known, F.col("rule")), F.lit(default)))


# --- fixed values: severity spellings ---------------------------------------------------
SEVERITY_ALIASES = {
    "high": "HIGH", "critical": "HIGH",
    "medium": "MEDIUM", "med": "MEDIUM", "moderate": "MEDIUM",
    "low": "LOW", "info": "LOW", "informational": "LOW",
}


def normal_severity(col: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for kv in SEVERITY_ALIASES.items() for x in kv])
    key = F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.coalesce(F.try_element_at(aliases, key), F.lit("UNKNOWN"))


def normal_name(col: Column) -> Column:
    cleaned = F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unknown_pattern"))


def normalize_findings(df: DataFrame, name: str = "rule", severity: str = "severity") -> DataFrame:
    """canonical names and severities; never fails on dirty spellings."""
    return df.withColumns({name: normal_name(F.col(name)), severity: normal_severity(F.col(severity))})


def needs_review(
    corpus: DataFrame,
    rules: Sequence[Rule],
    sensitive: str,
    words: Sequence[str],
    text: str = "source",
) -> DataFrame:
    """a text needs a person when the pattern hits it or a rule named with one of the words does."""
    flag = F.col(text).rlike(sensitive)
    for rule in rules:
        if any(w in rule.name.lower() for w in words):
            flag = flag | F.col(text).rlike(rule.pattern)
    return corpus.select(*[c for c in corpus.columns if c != text], flag.alias("needs_review"))


def flag_reviewed(findings: DataFrame, words: Sequence[str], key: str = "path") -> DataFrame:
    """F5 on a findings table: the per-path half of the predicate."""
    hit = any_contains(F.lower(F.col("rule")), words)
    return findings.groupBy(key).agg(F.bool_or(hit).alias("needs_review"))


def residual_symbols(corpus: DataFrame, pattern: str, text: str = "source") -> DataFrame:
    """sorted distinct matches left in each text."""
    hits = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))))
    return corpus.select(*[c for c in corpus.columns if c != text], hits.alias("symbols"))


def hit_counts(corpus: DataFrame, rules: Sequence[Rule], text: str = "source") -> DataFrame:
    """Matches of each rule per text as an array in rule order: a projection, no shuffle."""
    counts = F.array(*[F.regexp_count(F.col(text), F.lit(r.pattern)).cast("bigint") for r in rules])
    return corpus.select(*[c for c in corpus.columns if c != text], counts.alias("hits"))


def _level(high: Column, medium: Column) -> Column:
    return F.when(high, F.lit("red")).when(medium, F.lit("yellow")).otherwise(F.lit("green"))


def risk(corpus: DataFrame, rules: Sequence[Rule], text: str = "source") -> DataFrame:
    """A1 straight from the texts: one row per text from a map-only projection."""
    counted = hit_counts(corpus, rules, text)
    keep = [c for c in corpus.columns if c != text]

    def some(severity: str) -> Column:
        out = F.lit(False)
        for i, r in enumerate(rules):
            if r.severity == severity:
                out = out | (F.col("hits")[i] > 0)
        return out

    return counted.select(
        *keep,
        _level(some("high"), some("medium")).alias("risk_level"),
        F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_findings"),
        F.size(F.filter("hits", lambda x: x > 0)).cast("bigint").alias("matched_rules"),
        F.lit(len(rules)).cast("bigint").alias("rules_checked"),
    )


def risk_of_findings(
    corpus: DataFrame, findings: DataFrame, rules: Sequence[Rule], key: str = "path"
) -> DataFrame:
    """A1 from a findings table: grouped per path, texts without findings are green."""
    grouped = findings.groupBy(key).agg(
        F.bool_or(F.col("severity") == "high").alias("_high"),
        F.bool_or(F.col("severity") == "medium").alias("_medium"),
        F.count(F.lit(1)).alias("n_findings"),
        F.count_distinct("rule").alias("matched_rules"),
    )
    none = F.lit(False)
    return corpus.select(key).join(grouped, key, "left").select(
        key,
        _level(F.coalesce("_high", none), F.coalesce("_medium", none)).alias("risk_level"),
        F.coalesce("n_findings", F.lit(0)).cast("bigint").alias("n_findings"),
        F.coalesce("matched_rules", F.lit(0)).cast("bigint").alias("matched_rules"),
        F.lit(len(rules)).cast("bigint").alias("rules_checked"),
    )


RISK_LEVELS = ("green", "yellow", "red")


def risk_breakdown(risks: DataFrame) -> DataFrame:
    """Texts per risk level; every level has a row."""
    row = risks.agg(
        *[F.count_if(F.col("risk_level") == lv).alias(lv) for lv in RISK_LEVELS]
    )
    pairs = F.array(
        *[F.struct(F.lit(lv).alias("risk_level"), F.col(lv).alias("n_docs")) for lv in RISK_LEVELS]
    )
    return row.select(F.inline(pairs))


def rule_counts(corpus: DataFrame, rules: Sequence[Rule], text: str = "source") -> DataFrame:
    """A2: matches per rule over the corpus, zeros included; one row leaves each task."""
    totals = corpus.agg(
        *[
            F.coalesce(F.sum(F.regexp_count(F.col(text), F.lit(r.pattern))), F.lit(0))
            .cast("bigint")
            .alias(f"c{i}")
            for i, r in enumerate(rules)
        ]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.col(f"c{i}").alias("n_matches"))
            for i, r in enumerate(rules)
        ]
    )
    return totals.select(F.inline(pairs))


def rule_counts_of_findings(findings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A2 from a findings table; the rule table is a literal of known size."""
    counts = findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    table = rule_table(findings.sparkSession, rules).select("rule")
    return table.join(counts, "rule", "left").select(
        "rule", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matches")
    )


def severity_counts(findings: DataFrame, severities: Sequence[str] = ("error", "warning", "info")) -> DataFrame:
    """A3: findings per severity and in total."""
    return findings.agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in severities],
        F.count(F.lit(1)).alias("total"),
    )


def order_findings(
    findings: DataFrame,
    key: str = "path",
    order: Sequence[str] = ("line", "severity", "rule", "message"),
    lines_per_chunk: int = 4096,
) -> DataFrame:
    """K1: `position` of each finding in (line, severity rank, rule, message) order per path.

    Chunked by line, so that one path with very many findings is shared by tasks.
    """
    rank_map = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    ranked = findings.withColumn(
        "_rank", F.coalesce(F.try_element_at(rank_map, F.col("severity")), F.lit(9))
    )
    by = ["_rank" if c == "severity" else c for c in order]
    return running(
        ranked,
        [key],
        by,
        F.floor(F.col("line") / F.lit(lines_per_chunk)),
        sums={"position": F.lit(1).cast("bigint")},
    ).drop("_rank")


def report(risks: DataFrame, verifications: DataFrame, store: DataFrame | None = None, hours_per_fix: float = 4.0) -> DataFrame:
    """A4: one row about a corpus, with a summary to read.

    Confidence is averaged over every verification that states one; a failed one
    counts zero, whatever it claimed.  `store` is the one-row A8 statistics.
    """
    left = risks.agg(
        F.count(F.lit(1)).alias("total_files"),
        *[F.count_if(F.col("risk_level") == lv).alias(lv) for lv in RISK_LEVELS],
        F.coalesce(F.sum("n_findings"), F.lit(0)).cast("bigint").alias("findings"),
    )
    stated = F.when(F.col("confidence").isNotNull(), gate_confidence(F.col("confidence").cast("double"), F.col("passed")))
    right = verifications.agg(
        F.count_if(F.col("passed")).alias("passed"),
        F.count(F.lit(1)).alias("verified_total"),
        F.coalesce(F.bround(F.avg(stated), 1), F.lit(0.0)).alias("avg_confidence"),
        F.bround(F.count_if(F.col("passed")) * F.lit(float(hours_per_fix)), 1).alias("hours_saved"),
        F.lit(float(hours_per_fix)).alias("hours_per_fix"),
    )
    # one row each side
    out = left.join(right, F.lit(True), "inner")
    c = F.col
    parts = [
        F.format_string("files: %d red, %d yellow, %d green", c("red"), c("yellow"), c("green")),
        F.when(
            c("passed") > 0,
            F.format_string("passed: %d of %d, about %.1f hours saved at %.1f each", "passed", "verified_total", "hours_saved", "hours_per_fix"),
        ),
    ]
    if store is not None:
        stats = store.select(c("entries").alias("store_entries"), c("avg_confidence").alias("store_confidence"), c("retrievals").alias("store_retrievals"))
        out = out.join(stats, F.lit(True), "inner")
        parts.append(
            F.format_string("store: %d verified patterns, confidence %.2f, %d retrievals", "store_entries", "store_confidence", "store_retrievals")
        )
    return out.withColumn("summary", F.concat_ws("; ", *parts))


def coverage_flags(scans: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Files above the coverage threshold and totals."""
    good = F.col("coverage_pct") > threshold
    return scans.agg(
        F.count_if(good).alias("covered"),
        F.count_if(~good).alias("uncovered"),
        F.count(F.lit(1)).alias("total"),
    )


def keyword_profile(
    corpus: DataFrame, groups: Mapping[str, Sequence[str]], top: int = 3, text: str = "source"
) -> DataFrame:
    """Occurrences of each keyword group, the first `top` groups per text.

    Counted and ranked inside one projection; ties keep the listed order.
    """
    src = F.lower(F.col(text))
    entries = []
    for i, (name, words) in enumerate(groups.items()):
        n = F.lit(0).cast("bigint")
        for word in words:
            w = word.lower()
            n = n + ((F.length(src) - F.length(F.replace(src, F.lit(w), F.lit("")))) / len(w)).cast("bigint")
        entries.append(
            F.struct((-n).alias("neg"), F.lit(i).alias("pos"), F.lit(name).alias("keyword"))
        )
    ranked = F.slice(F.array_sort(F.filter(F.array(*entries), lambda e: e["neg"] < 0)), 1, top)
    keep = [c for c in corpus.columns if c != text]
    return corpus.select(*keep, F.posexplode(ranked).alias("_p", "e")).select(
        *keep,
        (F.col("_p") + 1).cast("bigint").alias("rank"),
        F.col("e.keyword").alias("keyword"),
        (-F.col("e.neg")).alias("n"),
    )


def token_budget(length: Column, ceiling: int, floor: int = 2048, extra: int = 512) -> Column:
    """output budget for a text of `length` characters, clamped."""
    estimate = F.floor(length / F.lit(4) * F.lit(2)).cast("bigint") + F.lit(extra)
    return F.greatest(F.lit(floor), F.least(F.lit(ceiling), estimate)).cast("bigint")
