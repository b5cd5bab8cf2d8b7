"""Rule tables.  Operators take rules as parameters; these packs are ready-made values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2, "high": 0, "medium": 1, "low": 2}


@dataclass(frozen=True)
class Rule:
    """One regex rule.  The pattern must not match the empty string."""

    name: str
    pattern: str
    severity: str = "low"
    description: str = ""


@dataclass(frozen=True)
class Rename:
    """One step of an ordered rewrite; `replacement` uses `$1` for groups."""

    pattern: str
    replacement: str
    label: str


@dataclass(frozen=True)
class Insertion:
    """A step that adds `line` after the last match of `anchor`, or at the top without one, unless the text has `unless`."""

    anchor: str
    line: str
    unless: str
    label: str


@dataclass(frozen=True)
class Term:
    """One row of a rubric: `points` when the SQL condition over the input columns holds.

    Inside one `group` only the first holding term counts; groups add up.
    """

    group: str
    condition: str
    points: float


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """The pack as a DataFrame, for joins that need every rule."""
    return spark.createDataFrame(
        [(i, r.name, r.pattern, r.severity, r.description) for i, r in enumerate(rules)],
        "rule_no int, rule string, pattern string, severity string, description string",
    )
