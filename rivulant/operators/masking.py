"""Comment and literal masking that keeps length and line breaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.functions.text import let

# Possessive loops keep the matcher flat on very long literals and unterminated comments.
SOURCE_COMMENT = r"//[^\n]*|/\*(?:[\s\S]*?\*/|[\s\S]*+)"
SOURCE_LITERAL = (
    r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?' r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'?"
)
CLOSED_LITERAL = (
    r'^"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"$' r"|^'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'$"
)
# In prose an apostrophe is no literal: a character literal holds at most four characters.
PROSE_LITERAL = (
    r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?' r"|'(?:\\[^\n]|[^'\\\n]){0,4}'"
)
MARKUP_COMMENT = r"<!--(?:[\s\S]*?-->|[\s\S]*+)"
MARKUP_LITERAL = r'"[^"]*+"?'


def rewrite_matches(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace each match by fn(match); the text between matches stays."""

    def join(pieces: Column) -> Column:
        return F.array_join(
            F.zip_with(
                pieces,
                F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                lambda piece, hit: F.concat(piece, F.coalesce(fn(hit), F.lit(""))),
            ),
            "",
        )

    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), join)).otherwise(text)


def _blank(col: Column, signs: str = r"[^\n]") -> Column:
    return F.regexp_replace(col, signs, " ")


def mask_text(
    text: Column,
    keep_literals: bool = False,
    comment: str = SOURCE_COMMENT,
    literal: str = SOURCE_LITERAL,
    closed: str = CLOSED_LITERAL,
    blank: str = r"[^\n]",
) -> Column:
    """Comments blanked; literal content blanked, its quotes kept.  `blank` says which signs of a comment go.

    One pass over comments and literals together, so that a comment mark inside
    a literal, or a quote inside a comment, is not taken for the other.
    """

    def masked(hit: Column) -> Column:
        n = F.length(hit)
        inner = F.when(hit.rlike(closed), n - 2).otherwise(n - 1)
        blanked = F.concat(
            F.substring(hit, 1, 1),
            _blank(F.substr(hit, F.lit(2), F.greatest(inner, F.lit(0)))),
            F.when(hit.rlike(closed), F.substr(hit, n, F.lit(1))).otherwise(F.lit("")),
        )
        is_comment = hit.rlike(f"^(?:{comment})")
        return F.when(is_comment, _blank(hit, blank)).otherwise(hit if keep_literals else blanked)

    return rewrite_matches(text, f"{comment}|{literal}", masked)


def mask(corpus: DataFrame, keep_literals: bool = False, text: str = "source", **patterns) -> DataFrame:
    """the corpus with `masked` added."""
    return corpus.withColumn("masked", mask_text(F.col(text), keep_literals, **patterns))


MARKUP = {"comment": MARKUP_COMMENT, "literal": MARKUP_LITERAL, "closed": r'^"[^"]*+"$'}
