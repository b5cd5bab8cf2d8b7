"""Index of the definitions and function bodies of source texts, and joins against it.

Everything about one text is computed inside its row: matches and braces become arrays of
positions, bodies are found by sorting braces by (level, position), in which a closing brace
follows the one it closes.  Only the resulting spans are exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.functions.text import let, newlines, running_total
from rivulant.operators.masking import mask_text
from rivulant.plans.joins import interval_join
from rivulant.rules import definitions as shapes

#: sign around a match and its name while a text is cut at its matches
MARK = "\x01"
#: blanks a comment but for a backslash that continues its line
BUT_CONTINUATIONS = r"[^\n\\]|\\(?!\r?(?:\n|\z))"


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    """array<struct<at, size, line, name>> of the matches of a pattern: offset from 0, length, 1-based line, group."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(found: Column) -> Column:
        sizes = F.transform(found, lambda f: F.length(f["piece"]) + F.length(f["hit"]))
        breaks = F.transform(found, lambda f: newlines(f["piece"]) + newlines(f["hit"]))
        return F.zip_with(
            F.arrays_zip(found.alias("f"), running_total(sizes).alias("after")), running_total(breaks),
            lambda x, lines: F.struct(
                (x["after"] - F.length(x["f"]["hit"])).alias("at"), F.length(x["f"]["hit"]).alias("size"),
                (lines - newlines(x["f"]["hit"]) + 1).alias("line"), x["f"]["name"].alias("name"),
            ),
        )

    pieces = F.split(text, pattern, -1)
    found = F.zip_with(
        F.arrays_zip(hits.alias("hit"), names.alias("name")), F.slice(pieces, F.lit(1), F.size(hits)),
        lambda h, piece: F.struct(piece.alias("piece"), h["hit"].alias("hit"), h["name"].alias("name")),
    )
    # one pass instead of one each for hits, names and pieces, where the text has no sign like the one that marks them
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}${group}{MARK}$0{MARK}"))

    def cut(parts: Column) -> Column:
        every = lambda k: F.filter(parts, lambda _, i: (i % 3 == k) & (i < F.size(parts) - 1))
        return F.zip_with(
            F.arrays_zip(every(2).alias("hit"), every(1).alias("name")), every(0),
            lambda h, piece: F.struct(piece.alias("piece"), h["hit"].alias("hit"), h["name"].alias("name")),
        )

    empty = F.array().cast("array<struct<at:bigint,size:int,line:bigint,name:string>>")
    quick = let(let(F.split(marked, MARK, -1), cut), placed)
    return F.when(~F.contains(text, F.lit(MARK)), quick).when(text.rlike(pattern), let(found, placed)).otherwise(empty)


def brace_pairs(masked: Column) -> Column:
    """array<struct<open, close>> of matching braces: offset of the opening one, end of the body.

    A blank-separated semicolon after the closing brace belongs to the body.
    """

    def events(pieces: Column) -> Column:
        signs = F.transform(F.regexp_extract_all(masked, F.lit(r"[{}]"), F.lit(0)), lambda b: F.when(b == "{", 1).otherwise(-1))
        sizes = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p) + 1)
        tails = F.transform(
            F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.length(F.regexp_extract(p, r"^[ \t]*;", 0))
        )
        return let(
            signs,
            lambda s: F.zip_with(
                F.arrays_zip(s.alias("sign"), running_total(s).alias("depth")),
                F.arrays_zip(running_total(sizes).alias("after"), tails.alias("tail")),
                lambda x, y: F.struct(
                    (x["depth"] + F.when(x["sign"] < 0, 1).otherwise(0)).alias("level"),
                    (y["after"] - 1).alias("pos"), x["sign"].alias("sign"), (y["after"] + y["tail"]).alias("end"),
                ),
            ),
        )

    def paired(ordered: Column) -> Column:
        joined = F.zip_with(
            ordered, F.slice(ordered, F.lit(2), F.size(ordered)),
            lambda a, b: F.when(
                (a["sign"] > 0) & (b["sign"] < 0) & (a["level"] == b["level"]),
                F.struct(a["pos"].alias("open"), b["end"].alias("close")),
            ),
        )
        return F.filter(joined, lambda p: p.isNotNull())

    empty = F.array().cast("array<struct<open:bigint,close:bigint>>")
    return F.when(masked.rlike(r"[{}]"), let(F.array_sort(let(F.split(masked, r"[{}]", -1), events)), paired)).otherwise(empty)


def bodies(headers: Column, pairs: Column) -> Column:
    """array<struct<at, brace, line, name, end>>: headers, which end at their opening brace, with the end of their body.

    Headers and pairs are sorted together by the brace; a header whose body never ends has no pair after it.
    """
    blank = F.lit(None)
    items = F.concat(
        F.transform(
            headers,
            lambda h: F.struct(
                (h["at"] + h["size"] - 1).alias("brace"), F.lit(0).alias("tag"), h["at"].alias("at"),
                h["line"].alias("line"), h["name"].alias("name"), blank.cast("bigint").alias("end"),
            ),
        ),
        F.transform(
            pairs,
            lambda p: F.struct(
                p["open"].alias("brace"), F.lit(1).alias("tag"), blank.cast("bigint").alias("at"),
                blank.cast("bigint").alias("line"), blank.cast("string").alias("name"), p["close"].alias("end"),
            ),
        ),
    )

    def met(ordered: Column) -> Column:
        joined = F.zip_with(
            ordered, F.slice(ordered, F.lit(2), F.size(ordered)),
            lambda a, b: F.when(
                (a["tag"] == 0) & (b["tag"] == 1) & (a["brace"] == b["brace"]),
                F.struct(a["at"].alias("at"), a["brace"].alias("brace"), a["line"].alias("line"), a["name"].alias("name"), b["end"].alias("end")),
            ),
        )
        return F.filter(joined, lambda s: s.isNotNull())

    return let(F.array_sort(items), met)


def _cut(source: Column, start: Column, end: Column) -> Column:
    return F.substr(source, (start + 1).cast("int"), (end - start).cast("int"))


def _header(source: Column, span: Column) -> Column:
    """What stands before the body's brace, comments included."""
    return F.substring_index(_cut(source, span["at"], span["brace"] + 1), "{", 1)


def _says(header: Column, marks: Sequence[str]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(header, F.lit(mark))
    return out


def _functions(code: Column, pairs: Column) -> Column:
    return F.filter(bodies(matches(code, shapes.FUNCTION), pairs), lambda f: ~f["name"].isin(*shapes.NOT_FUNCTIONS))


def definitions(corpus: DataFrame, text: str = "source") -> DataFrame:
    """(keys, name, kind, text, start, end) of every name a text defines.

    Kinds: type (records, typedefs, using aliases), kernel, helper, macro, variable.  The text
    is cut from the source as it stands, continuation lines and the semicolon after a body
    included.  A name has one definition: records come before functions, macros, typedefs,
    using aliases and variables, and the first in the text wins within each.
    """
    keep = [c for c in corpus.columns if c != text]
    source = F.col("_source")
    staged = corpus.select(*keep, F.col(text).alias("_source"), mask_text(F.col(text)).alias("_code"))
    staged = staged.withColumn("_dirs", mask_text(source, keep_literals=True, blank=BUT_CONTINUATIONS))
    staged = staged.withColumn("_pairs", brace_pairs(F.col("_code")))
    staged = staged.withColumns({
        "_records": bodies(matches(F.col("_code"), shapes.RECORD), F.col("_pairs")),
        "_functions": _functions(F.col("_code"), F.col("_pairs")),
    })

    def entry(phase: int, kind: Column, at: Column, end: Column, name: Column) -> Column:
        return F.struct(
            name.alias("name"), F.lit(phase).alias("phase"), at.cast("bigint").alias("start"), kind.alias("kind"),
            end.cast("bigint").alias("end"),
        )

    def plain(phase: int, kind: str, column: str, pattern: str) -> Column:
        return F.transform(
            matches(F.col(column), pattern),
            lambda m: entry(phase, F.lit(kind), m["at"], m["at"] + m["size"], m["name"]),
        )

    kernel = lambda f: F.when(_says(_header(source, f), [shapes.KERNEL_MARK]), F.lit("kernel")).otherwise(F.lit("helper"))
    found = F.concat(
        F.transform("_records", lambda r: entry(0, F.lit("type"), r["at"], r["end"], r["name"])),
        F.transform("_functions", lambda f: entry(1, kernel(f), f["at"], f["end"], f["name"])),
        plain(2, "macro", "_dirs", shapes.MACRO),
        plain(3, "type", "_code", shapes.TYPEDEF),
        plain(4, "type", "_code", shapes.USING),
        plain(5, "variable", "_code", shapes.CONSTANT),
    )
    staged = staged.select(*keep, "_source", F.array_sort(found).alias("_all"))
    # sorted by name first, a name's winner is the one whose predecessor has another name
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform("_all", lambda d: d["name"]))
    first = F.filter(
        F.zip_with(F.col("_all"), F.slice(before, F.lit(1), F.size("_all")), lambda d, b: F.when(~d["name"].eqNullSafe(b), d)),
        lambda d: d.isNotNull(),
    )
    rows = F.transform(
        first,
        lambda d: F.struct(
            d["name"].alias("name"), d["kind"].alias("kind"),
            F.regexp_replace(_cut(source, d["start"], d["end"]), r"\r+$", "").alias("text"),
            d["start"].alias("start"), d["end"].alias("end"),
        ),
    )
    return staged.select(*keep, F.inline(rows))


def regions(corpus: DataFrame, text: str = "source") -> DataFrame:
    """(keys, name, is_device, start, end, first_line, last_line) of every function body; `end` is exclusive."""
    keep = [c for c in corpus.columns if c != text]
    staged = corpus.select(*keep, F.col(text).alias("_source"), mask_text(F.col(text)).alias("_code"))
    staged = staged.withColumn("_functions", _functions(F.col("_code"), brace_pairs(F.col("_code"))))
    source = F.col("_source")
    rows = F.transform(
        "_functions",
        lambda f: F.struct(
            f["name"].alias("name"), _says(_header(source, f), shapes.DEVICE_MARKS).alias("is_device"),
            f["at"].alias("start"), f["end"].alias("end"), f["line"].alias("first_line"),
            (f["line"] + newlines(_cut(source, f["at"], f["end"]))).cast("bigint").alias("last_line"),
        ),
    )
    return staged.select(*keep, F.inline(rows))


def enclosing_region(points: DataFrame, spans: DataFrame, on: Sequence[str], offset: str = "offset") -> DataFrame:
    """Points with `region` (struct of the span) that holds their offset, the one that starts first; null outside."""
    on = list(on)
    last = F.struct("start", "end", "name", "is_device")
    held = interval_join(
        points, spans.select(*on, F.col("start").alias("_s"), (F.col("end") - 1).alias("_e"), last.alias("_r")), on, offset, "_s", "_e"
    )
    return held.groupBy(*points.columns).agg(F.min("_r").alias("region"))


def device_words_outside(corpus: DataFrame, keys: Sequence[str], words: Sequence[str] = shapes.DEVICE_WORDS, text: str = "source") -> DataFrame:
    """(keys, word, line) of device words in no function or in a host function, each line once."""
    keys = list(keys)
    pattern = r"\b(" + "|".join(words) + r")\b"
    staged = corpus.select(*keys, mask_text(F.col(text)).alias("_code"))
    found = staged.select(*keys, F.inline(matches(F.col("_code"), pattern))).select(
        *keys, F.col("name").alias("word"), "line", F.col("at").alias("offset")
    )
    placed = enclosing_region(found, regions(corpus.select(*keys, text), text), keys)
    outside = F.col("region").isNull() | ~F.col("region.is_device")
    return placed.filter(outside).select(*keys, "word", "line").distinct()
