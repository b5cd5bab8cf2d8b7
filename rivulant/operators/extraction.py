"""Source text out of free-form responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.functions.text import is_blank, let, lines_of, strip
from rivulant.operators.quality import any_of, code_score_of
from rivulant.rules import lines as kinds

WINDOW_LENIENT = (
    rf"^(?:#|//|/\*|\*)|{any_of(kinds.WINDOW_QUALIFIERS)}|template|namespace |{any_of(kinds.WINDOW_MARKS)}"
)
FENCE_LINE = r"^[ \t]*```"


def _head_test(bare: Column) -> Column:
    """Strict test: the qualifier must lie within the first 20 characters of the line."""
    head = F.substring(bare, 1, 20)
    return (
        bare.rlike(r"^(?:#|//|/\*|\*)|^(?:template|namespace)|[;{}]$")
        | head.rlike(any_of(kinds.WINDOW_QUALIFIERS))
    )


def window_bounds(
    lines: Column,
    anchor: str = kinds.WINDOW_ANCHOR,
    strict=_head_test,
    lenient: str = WINDOW_LENIENT,
    fence: str = FENCE_LINE,
    patience: int = 3,
) -> Column:
    """struct<first, last> (1-based lines) of the code window, null if there is none.

    Lines before the first anchor and from the first fence after it are out.
    The window starts at the first strict code line and ends at the last lenient
    one before `patience` non-code lines in a row; blank lines count for neither.
    One fold with a handful of numbers as state.
    """
    # Each pattern is tried once per line; the fold then works on flags.
    flags = F.transform(
        lines,
        lambda line: let(
            strip(line),
            lambda bare: F.struct(
                line.rlike(anchor).alias("anchor"),
                line.rlike(fence).alias("fence"),
                (bare == "").alias("blank"),
                ((bare == "") | strict(bare)).alias("opens"),
                bare.rlike(lenient).alias("code"),
            ),
        ),
    )
    zero = F.struct(
        F.lit(0).alias("i"), F.lit(False).alias("anchored"), F.lit(False).alias("done"),
        F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("prose"),
    )

    def step(acc: Column, line: Column) -> Column:
        i = acc["i"] + 1
        anchored = acc["anchored"] | line["anchor"]
        # the fence is looked for in the text from the anchor line on
        done = acc["done"] | (anchored & line["fence"])
        live = anchored & ~done
        first = F.when(live & (acc["first"] == 0) & line["opens"], i).otherwise(acc["first"])
        inside = live & (first > 0) & ~line["blank"]
        prose = (
            F.when(~inside, acc["prose"]).when(line["code"], F.lit(0)).otherwise(acc["prose"] + 1)
        )
        last = F.when(inside & line["code"], i).otherwise(acc["last"])
        return F.struct(
            i.alias("i"), anchored.alias("anchored"),
            (done | ((prose >= patience) & (last > 0))).alias("done"),
            first.alias("first"), last.alias("last"), prose.alias("prose"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["last"] > 0, F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return F.aggregate(flags, zero, step, finish)


def code_window(df: DataFrame, text: str = "text", **tests) -> DataFrame:
    """Adds `first_line`, `last_line` and the window text `window`."""
    lines = lines_of(F.col(text))
    found = let(
        lines,
        lambda ls: let(
            window_bounds(ls, **tests),
            lambda b: F.struct(
                b["first"].alias("first"),
                b["last"].alias("last"),
                F.concat(
                    strip(F.array_join(F.slice(ls, b["first"], b["last"] - b["first"] + 1), "\n")),
                    F.lit("\n"),
                ).alias("window"),
            ),
        ),
    )
    return df.withColumn("_w", found).select(
        *df.columns,
        F.col("_w.first").alias("first_line"),
        F.col("_w.last").alias("last_line"),
        F.col("_w.window").alias("window"),
    )


def _string_field(doc: Column, fields: Sequence[str]) -> Column:
    """First listed field of a JSON object text that holds a non-blank string."""

    def pick(v: Column) -> Column:
        out = []
        for name in fields:
            item = F.try_variant_get(v, f"$.{name}", "variant")
            value = F.try_variant_get(v, f"$.{name}", "string")
            out.append(F.when((F.schema_of_variant(item) == "STRING") & ~is_blank(value), value))
        return F.coalesce(*out)

    return let(F.try_parse_json(doc), pick)


BODY = r'"((?:[^"\\]|\\[\s\S])*+)'


def _loose_field(text: Column, fields: Sequence[str]) -> Column:
    """Body of `"field": "…` even where the rest of the object is cut off."""
    out = []
    for name in fields:
        pattern = rf'"{name}"\s*:\s*{BODY}'
        body = F.regexp_extract(text, pattern, 1)
        decoded = F.get_json_object(F.concat(F.lit('{"v":"'), body, F.lit('"}')), "$.v")
        out.append(F.when(text.rlike(pattern) & ~is_blank(body), F.coalesce(decoded, body)))
    return F.coalesce(*out)


def extract_code(
    responses: DataFrame,
    text: str = "response",
    fields: Sequence[str] = kinds.CODE_FIELDS,
    tags: Sequence[str] = kinds.CODE_TAGS,
    threshold: float = 0.5,
    score=code_score_of,
    window: dict | None = None,
) -> DataFrame:
    """adds strategy, code, response_length, code_length, discarded_length, candidates.

    Tried in order: a JSON field (whole text, a json block, then a loose match),
    the best-scoring fenced block (a tag that is no code tag halves its score,
    ties go to the longer block), the code window.  Everything happens inside
    the row: blocks are scored and ranked as an array.
    """
    src = F.col(text)
    blocks = F.transform(
        F.regexp_extract_all(src, F.lit(kinds.JSON_FENCE), F.lit(1)), lambda b: _string_field(b, fields)
    )
    first_block = F.get(F.filter(blocks, lambda b: b.isNotNull()), F.lit(0))
    json_code = F.coalesce(_string_field(strip(src), fields), first_block, _loose_field(src, fields))

    tagged = F.zip_with(
        F.regexp_extract_all(src, F.lit(kinds.FENCE), F.lit(1)),
        F.regexp_extract_all(src, F.lit(kinds.FENCE), F.lit(2)),
        lambda tag, body: F.struct(F.lower(tag).alias("tag"), body.alias("body")),
    )
    scored = F.transform(
        tagged,
        lambda b, i: F.struct(
            (score(b["body"]) * F.when(b["tag"].isin(*tags), F.lit(1.0)).otherwise(F.lit(0.5))).alias("score"),
            F.length(b["body"]).alias("length"),
            (-i).alias("place"),
            b["body"].alias("body"),
        ),
    )
    staged = responses.withColumn("_json", json_code).withColumn("_blocks", scored)
    staged = staged.withColumn("_best", F.array_max("_blocks"))
    staged = code_window(staged, text, **(window or {}))
    good_window = (score(F.col("window")) >= threshold) & F.col("window").isNotNull()
    n_blocks = F.size("_blocks")
    def chosen(strategy: Column, code: Column, candidates: Column) -> Column:
        return F.struct(
            strategy.alias("strategy"), code.alias("code"), candidates.alias("candidates")
        )

    nothing = F.when(src.isNull(), F.lit("empty")).otherwise(F.lit("rejected"))
    pick = (
        F.when(
            F.col("_json").isNotNull(), chosen(F.lit("json-field"), strip(F.col("_json")), F.lit(1))
        )
        .when(
            F.coalesce(F.col("_best.score") >= threshold, F.lit(False)),
            chosen(F.lit("markdown-fence"), F.concat(strip(F.col("_best.body")), F.lit("\n")), n_blocks),
        )
        .when(good_window, chosen(F.lit("raw-window"), F.col("window"), n_blocks + 1))
        .otherwise(
            chosen(
                nothing,
                F.lit(None).cast("string"),
                n_blocks + F.col("window").isNotNull().cast("int"),
            )
        )
    )
    n_src, n_code = F.coalesce(F.length(src), F.lit(0)), F.coalesce(F.length("code"), F.lit(0))
    return (
        staged.withColumn("_p", pick)
        .select(*responses.columns, "_p.*")
        .withColumns(
            {
                "response_length": n_src,
                "code_length": n_code,
                "discarded_length": F.greatest(n_src - n_code, F.lit(0)),
            }
        )
    )


OMITTED = "\n<<< extracted code omitted >>>\n"


def discarded_text(raw: Column, code: Column) -> Column:
    """What extraction did not keep; a code text that is no part of the response is placed by its end lines."""
    at = F.position(code, raw)
    prefix = F.substr(raw, F.lit(1), at - 1)
    suffix = F.substr(raw, at + F.length(code), F.length(raw))
    cut = F.when(is_blank(prefix) & is_blank(suffix), F.lit("")).otherwise(
        strip(F.concat(prefix, F.lit(OMITTED), suffix))
    )

    def by_ends(said: Column) -> Column:
        first, last = F.element_at(said, 1), F.element_at(said, -1)
        start = F.position(first, raw)
        back = F.position(F.reverse(last), F.reverse(raw))
        end = F.length(raw) - back - F.length(last) + 2
        joined = F.concat(
            F.substr(raw, F.lit(1), start - 1), F.lit(OMITTED),
            F.substr(raw, end + F.length(last), F.length(raw)),
        )
        return F.when((start > 0) & (back > 0) & (end > start), strip(joined)).otherwise(raw)

    said = F.filter(lines_of(code), lambda x: ~is_blank(x))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit(""))
        .when(is_blank(code), raw)
        .when(at > 0, cut)
        .otherwise(let(said, by_ends))
    )


def extraction_report(extracted: DataFrame, text: str = "response") -> DataFrame:
    """discarded text and the confidence 0 without code, else min(1, 0.5 + 0.5 * kept share)."""
    share = F.when(
        F.col("response_length") > 0, F.col("code_length") / F.col("response_length")
    ).otherwise(F.lit(0.0))
    confidence = F.when(is_blank(F.col("code")), F.lit(0.0)).otherwise(
        F.bround(F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.5) * share), 4)
    )
    return extracted.withColumns(
        {
            "discarded": discarded_text(F.col(text), F.col("code")),
            "confidence": confidence,
            "markdown_removed": F.contains("strategy", F.lit("fence")),
            "extraction_failed": is_blank(F.col("code")),
        }
    )
