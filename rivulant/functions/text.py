"""Text expressions: white space, lines, running totals over arrays, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE = "\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it many times inside `body`.

    A column used inside a lambda is inlined by the optimizer and would be
    evaluated again for every element; a lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Drop leading and trailing white space of every kind (`trim` drops spaces only)."""
    return F.btrim(col, F.lit(" \t\n\x0b\f\r"))


def is_blank(col: Column) -> Column:
    return col.isNull() | ~col.rlike(r"\S")


def lines_of(col: Column) -> Column:
    """Array of lines: a carriage return before the break goes, a final empty piece goes."""

    def drop_tail(parts: Column) -> Column:
        body = F.slice(parts, F.lit(1), F.size(parts) - 1)
        return F.when(F.element_at(parts, -1) == "", body).otherwise(parts)

    return let(F.split(col, r"\r?\n", -1), drop_tail)


def newlines(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(NEWLINE), F.lit("")))


def count_of(col: Column, piece: str) -> Column:
    """Occurrences of a one-character string."""
    return F.length(col) - F.length(F.replace(col, F.lit(piece), F.lit("")))


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def running_total(arr: Column, block: int = 128) -> Column:
    """Inclusive prefix sums of an array of integers.

    Two levels (inside a block, then over block totals), so that the cost is
    n * sqrt(n)-like and not n * n for a text with very many matches.
    """

    def over_blocks(blocks: Column) -> Column:
        return let(
            F.transform(blocks, array_sum),
            lambda totals: F.flatten(
                F.transform(
                    blocks,
                    lambda blk, b: let(
                        array_sum(F.slice(totals, F.lit(1), b)),
                        lambda base: F.transform(
                            blk, lambda _, i: base + array_sum(F.slice(blk, F.lit(1), i + 1))
                        ),
                    ),
                )
            ),
        )

    def split_blocks(a: Column) -> Column:
        def cut(size: Column) -> Column:
            last = F.floor((F.size(a) - 1) / size).cast("int")
            starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), last)).otherwise(
                F.array().cast("array<int>")
            )
            return F.transform(starts, lambda b: F.slice(a, b * size + 1, size))

        # a short array is cut at its root, a long one at `block`
        return let(F.least(F.lit(block), F.ceil(F.sqrt(F.greatest(F.size(a), F.lit(1))))).cast("int"), cut)

    return let(arr, lambda a: let(split_blocks(a), over_blocks))


def any_contains(col: Column, words) -> Column:
    """True when the text holds at least one of the words (literal, case-sensitive)."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(col, F.lit(word))
    return out


def count_contains(col: Column, words) -> Column:
    """How many of the words occur in the text."""
    out = F.lit(0)
    for word in words:
        out = out + F.contains(col, F.lit(word)).cast("int")
    return out


def slug(col: Column, limit: int | None = None) -> Column:
    """File-name-safe form of a text; an empty result becomes `unnamed`."""
    cleaned = F.regexp_replace(
        F.regexp_replace(col, r"[^A-Za-z0-9_.\-]+", "_"), r"^_+|_+$", ""
    )
    return F.coalesce(F.nullif(cleaned if limit is None else F.substring(cleaned, 1, limit), F.lit("")), F.lit("unnamed"))


def duration_text(ms: Column) -> Column:
    """Milliseconds as text in the unit a reader can act on."""

    def fixed(value: Column, digits: int) -> Column:
        return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))

    return (
        F.when(ms < 1, F.concat(fixed(ms * 1000, 0), F.lit("µs")))
        .when(ms < 1000, F.concat(fixed(ms, 1), F.lit("ms")))
        .otherwise(F.concat(fixed(ms / 1000, 2), F.lit("s")))
    )


def normalize_error(col: Column) -> Column:
    """A log message without its volatile parts: temp folder, position prefix, extra spaces."""
    out = strip(col)
    out = F.regexp_replace(out, r"/tmp/\S+/(\S+)", "$1")
    out = F.regexp_replace(out, r"^[A-Za-z0-9_./\-]+:\d+:\d+:\s*", "")
    out = F.regexp_replace(out, r"^[A-Za-z0-9_./\-]+:\d+:\s*", "")
    return strip(F.regexp_replace(out, r"\s+", " "))


def normalize_unknown(col: Column) -> Column:
    """Identity of a message no typed pattern claimed: position and severity tag dropped."""
    out = F.regexp_replace(
        col, r"(?i)([^\s:]+:)?\d+:\d+:\s*(?:fatal\s+)?(?:error|warning):\s*", ""
    )
    return F.regexp_replace(strip(out), r"\s+", " ")


def strip_build_dir(col: Column, build_dir: Column) -> Column:
    """Drop the build folder from the front of a log line."""
    prefix = F.concat(build_dir, F.lit("/"))
    return F.when(
        F.startswith(col, prefix), F.substring(col, F.length(prefix) + 1, F.length(col))
    ).otherwise(col)


def fold_name(col: Column) -> Column:
    """Comparable spelling of a symbol across the two device dialects."""
    out = F.replace(F.lower(col), F.lit("_"), F.lit(""))
    for old, new in (("warp", "wave"), ("wavefront", "wave"), ("cuda", "hip")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def short_digest(col: Column, length: int) -> Column:
    return F.substring(F.sha2(col.cast("binary"), 256), 1, length)
