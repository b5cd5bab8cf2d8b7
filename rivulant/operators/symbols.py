"""Symbol inventories and their differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.functions.text import is_blank, let, strip
from rivulant.operators.masking import mask_text
from rivulant.rules import device

# fixed value: a top-level definition with its name
FUNCTION_NAMES = (
    r"(?m)^[ \t]*(?:(?:__global__|__device__|__host__|static|inline|extern|template\s*<[^>]*>)\s+)*"
    r"(?:[A-Za-z_]\w*(?:\s*[*&])?\s+)+([A-Za-z_]\w*)\s*\([^;{]*\)\s*(?:const\s*)?\{"
)
# fixed value: words that look like a definition and are none
CONTROL_WORDS = ("if", "for", "while", "switch", "catch", "return", "else")


def function_names(masked: Column) -> Column:
    """Names of top-level definitions in order, repeats kept."""
    hits = F.regexp_extract_all(masked, F.lit(FUNCTION_NAMES), F.lit(1))
    return F.filter(hits, lambda n: ~n.isin(*CONTROL_WORDS))


def extract_symbols(
    corpus: DataFrame,
    symbol_rules: Sequence[tuple[str, str]] = device.SYMBOL_RULES,
    not_names: Sequence[str] = device.NOT_FUNCTIONS,
    macro: str | None = device.MACRO_PATTERN,
    include: str | None = device.INCLUDE_PATTERN,
    text: str = "source",
    mask=mask_text,
) -> DataFrame:
    """long table (keys, kind, name, body) of each text's symbols.

    Rules come most specific kind first; a name belongs to the first kind that
    claims it.  Definitions are read with comments and literals masked,
    directives with literals kept.  All arrays of a text are built and compared
    inside one projection, so nothing is shuffled.
    """
    keep = [c for c in corpus.columns if c != text]
    staged = corpus.select(
        *keep,
        mask(F.col(text)).alias("_code"),
        mask(F.col(text), keep_literals=True).alias("_dirs"),
    )
    names = staged.select(
        *keep,
        "_dirs",
        *[
            F.array_distinct(F.regexp_extract_all("_code", F.lit(pattern), F.lit(1))).alias(f"_k{i}")
            for i, (_, pattern) in enumerate(symbol_rules)
        ],
    )
    entries = []
    claimed = F.array().cast("array<string>")
    for i, (kind, _) in enumerate(symbol_rules):
        own = F.array_except(F.array_except(F.col(f"_k{i}"), claimed), F.array(*[F.lit(w) for w in not_names]))
        entries.append(_rows(own, kind))
        claimed = F.concat(claimed, F.col(f"_k{i}"))
    if macro is not None:
        found = F.regexp_extract_all("_dirs", F.lit(macro), F.lit(1))
        bodies = F.regexp_extract_all("_dirs", F.lit(macro), F.lit(2))
        # a macro defined twice keeps its last body
        entries.append(
            let(
                F.zip_with(found, bodies, lambda n, b: F.struct(n.alias("n"), strip(b).alias("b"))),
                lambda defs: F.transform(
                    F.array_distinct(F.transform(defs, lambda d: d["n"])),
                    lambda n: F.struct(
                        F.lit("macro").alias("kind"),
                        n.alias("name"),
                        F.element_at(F.filter(defs, lambda d: d["n"] == n), -1)["b"].alias("body"),
                    ),
                ),
            )
        )
    if include is not None:
        entries.append(
            _rows(F.array_distinct(F.regexp_extract_all("_dirs", F.lit(include), F.lit(1))), "include")
        )
    return names.select(*keep, F.inline(F.concat(*entries)))


def _rows(names: Column, kind: str) -> Column:
    return F.transform(
        names,
        lambda n: F.struct(
            F.lit(kind).alias("kind"), n.alias("name"), F.lit(None).cast("string").alias("body")
        ),
    )


# fixed values: host functions that a port of the device part never has
HOST_ONLY = r"^(?:main|shuffle_.*_test)$"


def diff_inventory(old: DataFrame, new: DataFrame, key: str = "path", modes: DataFrame | None = None) -> DataFrame:
    """(key, kind, name, status): missing, added, changed (other body) or preserved.

    `modes` (key, port_mode) tells which ports hold the device part only: of those, host-only
    functions of the old version do not count as missing and have no row.
    The join key holds the name, so one large inventory is spread by its names.
    """
    if modes is not None:
        subset = modes.filter("port_mode = 'DEVICE_SUBSET'").select(key).distinct().withColumn("_subset", F.lit(True))
        driver = (F.col("kind") == "function") & F.col("name").rlike(HOST_ONLY)
        known = new.select(key, "kind", "name", F.lit(True).alias("_new")).distinct()
        old = old.join(subset, key, "left").join(known, [key, "kind", "name"], "left")
        old = old.filter(~F.coalesce(driver & F.col("_subset") & F.col("_new").isNull(), F.lit(False))).drop("_subset", "_new")
    a = old.select(key, "kind", "name", F.struct("body").alias("_a"))
    b = new.select(key, "kind", "name", F.struct("body").alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), F.lit("missing"))
        .when(F.col("_a").isNull(), F.lit("added"))
        .when(~F.col("_a").eqNullSafe(F.col("_b")), F.lit("changed"))
        .otherwise(F.lit("preserved"))
    )
    return a.join(b, [key, "kind", "name"], "full").select(
        key, "kind", "name", status.alias("status"),
        F.col("_a.body").alias("old_body"), F.col("_b.body").alias("new_body"),
    )


STATUSES = ("missing", "added", "changed", "preserved")


def diff_summary(diff: DataFrame, key: str = "path") -> DataFrame:
    """Counts per key and kind."""
    return diff.groupBy(key, "kind").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    )


def name_set_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, name, status) with missing, added or preserved; the first two are the symmetric difference."""
    on = [*keys, "name"]
    a = old.select(*on).distinct().withColumn("_a", F.lit(True))
    b = new.select(*on).distinct().withColumn("_b", F.lit(True))
    return a.join(b, on, "full").select(
        *on,
        F.when(F.col("_b").isNull(), F.lit("missing"))
        .when(F.col("_a").isNull(), F.lit("added"))
        .otherwise(F.lit("preserved"))
        .alias("status"),
    )


def namespaces(text: Column) -> Column:
    """struct<declared, using>: namespaces a text opens and those it imports."""
    return F.struct(
        F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(device.NAMESPACE_PATTERN), F.lit(1)))).alias("declared"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(device.USING_PATTERN), F.lit(1)))).alias("using"),
    )


def namespace_report(pairs: DataFrame) -> DataFrame:
    """Sets dropped and added between `old_names` and `new_names` (arrays), and `old_using`, `new_using`."""
    return pairs.withColumns(
        {
            "dropped_declarations": F.array_sort(F.array_except("old_names", "new_names")),
            "added_declarations": F.array_sort(F.array_except("new_names", "old_names")),
            "dropped_using": F.array_sort(F.array_except("old_using", "new_using")),
            "preserved": F.size(F.array_except("old_names", "new_names")) == 0,
        }
    ).drop("old_names", "new_names", "old_using", "new_using")


def changed_values(old: DataFrame, new: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """Keys on both sides whose value differs (null is a value)."""
    b = new.select(*on, F.col(value).alias("new_value"))
    return (
        old.select(*on, F.col(value).alias("old_value"))
        .join(b, list(on))
        .filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    )


def unresolved_includes(includes: DataFrame, files: DataFrame, name: str = "name", file: str = "file") -> DataFrame:
    """Includes whose base name no vendored file carries."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    known = files.select(base(F.col(file)).alias("_base")).distinct()
    return includes.withColumn("_base", base(F.col(name))).join(known, "_base", "left_anti").drop("_base")


def unsatisfied_calls(calls: DataFrame, defs_old: DataFrame, defs_new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Called names the old version defines and the new one does not."""
    on = list(on)
    return (
        calls.select(*on).distinct()
        .join(defs_old.select(*on), on, "left_semi")
        .join(defs_new.select(*on), on, "left_anti")
    )


# fixed values: words before `<<<` that name no kernel
LAUNCH_KEYWORDS = (
    "if", "for", "while", "switch", "template", "sizeof", "const", "constexpr", "static", "extern", "void",
    "int", "float", "double", "char", "bool", "class", "struct", "enum", "union", "auto", "return",
    "namespace", "using", "typedef", "typename", "public", "private", "protected", "virtual",
    "override", "final", "export", "import", "include", "alignas", "alignof", "decltype", "noexcept",
    "static_cast", "dynamic_cast", "const_cast", "reinterpret_cast",
    "hipLaunchKernelGGL", "hipLaunchCooperativeKernel",
)


def undefined_launches(
    calls: DataFrame, defs: DataFrame, on: Sequence[str], name: str = "name", keywords: Sequence[str] = LAUNCH_KEYWORDS
) -> DataFrame:
    """Launched names without a definition, keywords left out."""
    on = list(on)
    return (
        calls.filter(~F.col(name).isin(list(keywords))).select(*on).distinct()
        .join(defs.select(*on), on, "left_anti")
    )


def file_scope_lines(lines: DataFrame, depths: DataFrame, on: Sequence[str], pattern: str, text: str = "text") -> DataFrame:
    """Lines at depth 0 (before and after the line) that match the pattern."""
    flat = depths.filter("depth = 0 AND low = 0").select(*on)
    return lines.filter(F.col(text).rlike(pattern)).join(flat, list(on), "left_semi")


def port_mode(
    files: DataFrame, unresolved: DataFrame, sdk: DataFrame, key: str = "path"
) -> DataFrame:
    """WHOLE_PROGRAM or DEVICE_SUBSET per file.

    `files` has (key, has_main, main_extractable); `unresolved` and `sdk` list
    the keys with an include that is not vendored or comes from an SDK.
    """
    blocked = unresolved.select(key).union(sdk.select(key)).distinct().withColumn("_blocked", F.lit(True))
    mode = (
        F.when(~F.col("has_main"), F.lit("WHOLE_PROGRAM"))
        .when(F.col("_blocked") | ~F.col("main_extractable"), F.lit("DEVICE_SUBSET"))
        .otherwise(F.lit("WHOLE_PROGRAM"))
    )
    return files.join(blocked, key, "left").select(key, mode.alias("port_mode"))


# ---- signatures ------------------------------------------------------------------------

# fixed value: the head of a device function
SIGNATURE = r"__global__\s+void\s+(\w+)\s*\(([^)]*)\)"


def signature_params(
    corpus: DataFrame,
    pattern: str = SIGNATURE,
    output_names: Sequence[str] = device.OUTPUT_NAMES,
    text: str = "source",
) -> DataFrame:
    """(keys, function, position, name, type, direction) of each parameter.

    Defaults are dropped; a star next to the name belongs to the type.  A
    pointer is `in` when const, `out` when its name is one letter or an output
    name, else `in`; anything else is a scalar.
    """
    keep = [c for c in corpus.columns if c != text]
    src = F.regexp_replace(F.col(text), r"/\*[\s\S]*?\*/", "")
    src = F.regexp_replace(F.regexp_replace(src, r"//[^\n]*", ""), r"#[^\n]*", "")
    names = F.regexp_extract_all(src, F.lit(pattern), F.lit(1))
    lists = F.regexp_extract_all(src, F.lit(pattern), F.lit(2))
    functions = corpus.select(*keep, F.arrays_zip(names.alias("function"), lists.alias("params")).alias("_f"))
    functions = functions.select(*keep, F.posexplode_outer("_f").alias("function_no", "_f")).filter("function_no IS NOT NULL").select(
        *keep, "function_no", F.col("_f.function").alias("function"), F.col("_f.params").alias("_ps")
    )
    said = F.filter(F.split("_ps", ","), lambda p: ~is_blank(p))
    params = functions.select(*keep, "function_no", "function", F.posexplode(said).alias("_i", "_p"))
    bare = strip(F.regexp_replace("_p", r"\s*=\s*[^,]+$", ""))
    words = params.withColumn("_w", F.split(bare, r"\s+"))
    last = F.element_at("_w", -1)
    single = F.size("_w") == 1
    head = F.array_join(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))), " ")
    starred = F.startswith(last, F.lit("*"))
    typed = words.select(
        *keep,
        "function_no",
        "function",
        (F.col("_i") + 1).alias("position"),
        F.when(single, F.concat(F.lit("arg"), F.col("_i")))
        .when(starred, F.regexp_replace(last, r"^\*+", ""))
        .otherwise(F.regexp_replace(F.replace(last, F.lit("*"), F.lit("")), "^&+", ""))
        .alias("name"),
        F.when(single, F.element_at("_w", 1))
        .otherwise(F.concat(head, F.when(starred, F.lit("*")).otherwise(F.lit(""))))
        .alias("type"),
    )
    pointer = F.contains("type", F.lit("*")) | F.contains("type", F.lit("]"))
    lowered = F.lower(F.replace("name", F.lit("*"), F.lit("")))
    direction = (
        F.when(~pointer, F.lit("scalar"))
        .when(F.contains("type", F.lit("const")), F.lit("in"))
        .when((F.length(lowered) <= 1) | lowered.isin(*output_names), F.lit("out"))
        .otherwise(F.lit("in"))
    )
    return typed.withColumn("direction", direction)


def element_type(type_: Column) -> Column:
    """Base type behind pointers and const."""
    return strip(F.replace(F.replace(type_, F.lit("*"), F.lit("")), F.lit("const "), F.lit("")))


def output_elements(params: DataFrame, keys: Sequence[str]) -> DataFrame:
    """element type of the first out parameter, else of the first pointer, else float."""
    pointer = F.contains("type", F.lit("*"))
    pick = F.min(
        F.when(F.col("direction") == "out", F.struct(F.lit(0).alias("r"), "position", "type")).when(
            pointer, F.struct(F.lit(1).alias("r"), "position", "type")
        )
    )
    return params.groupBy(*keys).agg(pick.alias("_t")).select(
        *keys, F.coalesce(element_type(F.col("_t.type")), F.lit("float")).alias("element_type")
    )
