"""Build-log analytics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulant.functions.text import normalize_error, normalize_unknown, short_digest, strip
from rivulant.operators.similarity import best_match
from rivulant.plans.digest import ordered_digest
from rivulant.plans.joins import hot_keys, interval_join, lookup_join
from rivulant.plans.scratch import settle
from rivulant.plans.scan import CHUNK, running, segmented_sums, with_halo
from rivulant.rules import diagnostics as shapes

ITERATIONS_PER_CHUNK = 4096


def parse_diagnostics(log: DataFrame, keys: Sequence[str], seq: str, raw: str = "raw") -> DataFrame:
    """error lines as typed diagnostics; per key one row per (kind, symbol, owner, line).

    Notes, carets and warnings are dropped; a bare line is kept when it holds
    the word "error".  The row that comes first by `seq` supplies the rest.
    """
    keys = list(keys)
    text = strip(F.col(raw))

    def part(group: int) -> Column:
        return F.regexp_extract("_t", shapes.DIAGNOSTIC_LINE, group)

    rows = (
        log.select(*keys, F.col(seq).alias("_seq"), text.alias("_t"))
        .withColumn("_shaped", F.col("_t").rlike(shapes.DIAGNOSTIC_LINE))
        .filter(
            F.when(F.col("_shaped"), part(4) == "error").otherwise(
                F.contains("_t", F.lit("error")) & ~F.col("_t").rlike(shapes.NOTE_LINE)
            )
        )
    )
    placed = rows.select(
        *keys, "_seq", "_t",
        F.when(F.col("_shaped"), strip(part(5))).otherwise(F.col("_t")).alias("_m"),
        F.when(F.col("_shaped"), part(1)).otherwise(F.lit("")).alias("file"),
        F.when(F.col("_shaped"), part(2).try_cast("int")).otherwise(F.lit(0)).alias("line"),
        F.when(F.col("_shaped"), part(3).try_cast("int")).otherwise(F.lit(0)).alias("col"),
    )
    typed = placed.withColumn("_d", classify_message(F.col("_m"))).select(
        *keys, "_seq", F.col("_t").alias("raw"), "file", "line", "col", "_d.*"
    )
    rest = F.struct("raw", "suggestion", "file", "col")
    return (
        typed.groupBy(*keys, "kind", "symbol", "owner", "line")
        .agg(F.min_by(rest, "_seq").alias("r"), F.min("_seq").alias("seq"))
        .select(*keys, "seq", "kind", "symbol", "owner", "line", "r.*")
    )


def classify_message(message: Column) -> Column:
    """struct<kind, symbol, suggestion, owner> by the first message shape that fits."""

    def take(pattern: str, group: int) -> Column:
        return F.regexp_extract(message, pattern, group) if group else F.lit("")

    out = None
    for kind, pattern, symbol, suggestion, owner in shapes.MESSAGE_SHAPES:
        name = take(pattern, symbol)
        if kind == "undefined-template":
            name = F.element_at(F.split(name, "::"), -1)
        found = F.struct(
            F.lit(kind).alias("kind"),
            name.alias("symbol"),
            take(pattern, suggestion).alias("suggestion"),
            take(pattern, owner).alias("owner"),
        )
        fits = message.rlike(pattern)
        out = F.when(fits, found) if out is None else out.when(fits, found)
    unknown = F.struct(
        F.lit("unknown").alias("kind"),
        F.lit("").alias("symbol"),
        F.lit("").alias("suggestion"),
        F.lit("").alias("owner"),
    )
    return out.otherwise(unknown)


def identity(diags: DataFrame) -> Column:
    """(kind, symbol, owner) that names a defect wherever it is; unknown ones by their text."""
    unknown = F.col("kind") == "unknown"
    return F.struct(
        F.col("kind").alias("kind"),
        F.when(unknown, normalize_unknown(F.col("raw"))).otherwise(F.col("symbol")).alias("symbol"),
        F.when(unknown, F.lit("")).otherwise(F.col("owner")).alias("owner"),
    )


def failure_signature(diags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`compile:` + 12 hex of the SHA-256 over the sorted distinct identities per key."""
    keys = list(keys)
    distinct = diags.select(*keys, identity(diags).alias("i")).distinct()
    said = distinct.withColumn("_s", F.concat_ws(":", "i.kind", "i.symbol", "i.owner"))
    out = ordered_digest(said, keys, ["i"], "_s", prefix="compile:")
    return out.withColumnRenamed("digest", "failure_signature")


def attempt_signature(attempts: DataFrame, keys: Sequence[str], seq: str, raw: str = "raw") -> DataFrame:
    """One signature per attempt of a compiler: empty for one without errors (`raw` null throughout), the
    typed one where an error can be parsed, else the digest of all its messages without their place."""
    keys = list(keys)
    failed = attempts.filter(F.col(raw).isNotNull())
    typed = failure_signature(parse_diagnostics(failed, keys, seq, raw), keys)
    untyped = failed.join(typed.select(*keys), keys, "left_anti")
    bare = untyped.select(*keys, strip(F.regexp_replace(F.col(raw), shapes.MESSAGE_PLACE, "")).alias("_s"))
    plain = ordered_digest(bare, keys, ["_s"], "_s", prefix="compile:").withColumnRenamed("digest", "failure_signature")
    known = typed.unionByName(plain)
    return attempts.select(*keys).distinct().join(known, keys, "left").select(
        *keys, F.coalesce("failure_signature", F.lit("")).alias("failure_signature")
    )


def structural_signature(errors: DataFrame, keys: Sequence[str], text: str = "error") -> DataFrame:
    """A15 for attempts a structural gate stopped: digest over the sorted error texts."""
    # Equal texts travel once, with their count.
    counted = errors.groupBy(*keys, F.col(text).alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
    out = ordered_digest(counted, keys, ["_e"], "_e", F.col("_n"), prefix="structural:")
    return out.withColumnRenamed("digest", "failure_signature")


def scan_tool_log(log: DataFrame, totals: DataFrame, key: str = "path", raw: str = "raw") -> DataFrame:
    """flagged lines and coverage per file.  `totals` has (key, total_lines)."""
    marked = F.lower(F.col(raw)).rlike("|".join(shapes.TOOL_MARKERS))
    flagged = log.groupBy(key).agg(F.count_if(marked).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    pct = F.greatest(F.lit(0.0), (F.col("total_lines") - n) / F.col("total_lines") * 100)
    return totals.join(flagged, key, "left").select(
        key,
        "total_lines",
        n.cast("bigint").alias("unconverted_lines"),
        F.when(F.col("total_lines") > 0, F.bround(pct, 1)).otherwise(F.lit(0.0)).alias("coverage_pct"),
    )


def tool_warnings(log: DataFrame, raw: str = "raw") -> DataFrame:
    """one record per warning or error line with its optional trailing [line]."""
    number = F.nullif(F.regexp_extract(raw, shapes.TOOL_WARNING, 2), F.lit(""))
    keep = [c for c in log.columns if c != raw]
    return log.filter(F.col(raw).rlike(shapes.TOOL_WARNING)).select(
        *keep,
        strip(F.regexp_extract(raw, shapes.TOOL_WARNING, 1)).alias("message"),
        number.try_cast("int").alias("line"),
    )


def locate(diags: DataFrame, regions: DataFrame, on: Sequence[str], point: Sequence[str]) -> DataFrame:
    """Origin of each diagnostic and the first region that holds its line.

    `point` names the columns that identify a diagnostic.  Regions have
    (on, start, end, name) and may overlap; the one that starts first wins.
    """
    on, point = list(on), list(point)
    renamed = regions.select(*on, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("name").alias("_n"))
    lines = diags.select(*on, *point, F.coalesce("line", F.lit(0)).alias("line"))
    pairs = interval_join(lines, renamed, on, "line", "_s", "_e", "inner")
    first = pairs.groupBy(*on, *point).agg(F.min(F.struct("_s", "_e", "_n")).alias("_region"))
    placed = diags.join(first, [*on, *point], "left")
    origin = (
        F.when(F.col("raw").rlike(shapes.MISSING_MAIN), F.lit("link"))
        .when(F.coalesce("line", F.lit(0)) <= 0, F.lit("unknown"))
        .when(F.col("_region").isNotNull(), F.lit("ported_code"))
        .otherwise(F.lit("harness"))
    )
    return placed.select(*diags.columns, F.col("_region._n").alias("region"), origin.alias("origin"))


def origin_flags(diags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All known origins are harness; every error is a linker error and no origin objects."""
    known = F.col("origin") != "unknown"
    said = F.coalesce("raw", F.lit("")).rlike(r"\S")
    agg = diags.groupBy(*keys).agg(
        F.count_if(known).alias("_known"),
        F.count_if(known & (F.col("origin") != "harness")).alias("_elsewhere"),
        F.count_if(said).alias("_said"),
        F.count_if(said & ~F.col("raw").rlike(shapes.LINKER_LINE)).alias("_not_linker"),
        F.count_if(F.col("origin").isin("ported_code", "harness")).alias("_placed"),
    )
    return agg.select(
        *keys,
        ((F.col("_known") > 0) & (F.col("_elsewhere") == 0)).alias("all_harness"),
        ((F.col("_said") > 0) & (F.col("_not_linker") == 0) & (F.col("_placed") == 0)).alias("linker_only"),
    )


def _lookup_map(table: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def resolve(
    diags: DataFrame,
    defs_old: DataFrame,
    defs_new: DataFrame,
    header_map: Mapping[str, str],
    standard_headers: Mapping[str, str],
    key: str = "path",
    near_threshold: float = 0.82,
) -> DataFrame:
    """The first repair that fits each diagnostic, in fixed priority.

    defs_* have (key, kind, name) and may have `text`.  Rows without a deterministic repair have
    a null strategy.  A near name is a hypothesis and is never applied; it is looked for only
    where nothing else fits, among the definitions of those keys.  `inserted_text` is what the
    repair puts in: an include line, the new name or the definition.
    """
    text = F.col("text") if "text" in defs_old.columns else F.lit(None).cast("string")
    ranked = F.array_position(F.array(*[F.lit(k) for k in RESTORE_ORDER]), F.col("kind"))
    old = defs_old.groupBy(key, F.col("name").alias("symbol")).agg(
        F.min_by(F.struct(F.col("kind").alias("old_kind"), text.alias("old_text")), ranked).alias("_o")
    ).select(key, "symbol", "_o.*")
    new = defs_new.select(key, "name").distinct()
    # One row per (key, symbol) with all that is known of it, so diagnostics are joined once.
    known = old.join(new.select(key, F.col("name").alias("symbol"), F.lit(True).alias("in_new")), [key, "symbol"], "full")
    hints = new.select(key, F.col("name").alias("suggestion"), F.lit(True).alias("hint_in_new"))
    by_hint = [key, "suggestion"]
    full = lookup_join(diags, known, [key, "symbol"])
    full = settle(lookup_join(full, hints, by_hint, hot=hot_keys(diags, by_hint)))

    header = _lookup_map(header_map, F.element_at(F.split("symbol", "/"), -1))
    standard = _lookup_map(standard_headers, F.col("symbol"))
    is_header = F.col("kind") == "missing-include"
    open_symbol = ~is_header & (F.col("symbol") != "") & F.col("in_new").isNull()
    left = open_symbol & F.col("hint_in_new").isNull() & F.col("old_kind").isNull() & standard.isNull()
    missing = settle(full.filter(left).select(key, F.col("symbol").alias("name")).distinct())
    near = best_match(
        missing,
        defs_old.select(key, "name").distinct().join(missing.select(key).distinct(), key, "left_semi"),
        [key],
        near_threshold,
    ).select(key, F.col("name").alias("symbol"), F.col("match").alias("near"))
    full = lookup_join(full, near, [key, "symbol"])

    restore = F.coalesce(_lookup_map(shapes.RESTORE_STRATEGY, F.col("old_kind")), F.lit("restore-declaration"))
    removed = F.when(
        F.col("old_kind").isin("kernel", "helper", "function"), F.lit("removed-during-extraction")
    ).otherwise(F.lit("omitted"))

    def step(strategy: Column, cause: str | Column, target: Column, inserted: Column, applied: bool = True) -> Column:
        return F.struct(
            strategy.alias("strategy"),
            (F.lit(cause) if isinstance(cause, str) else cause).alias("root_cause"),
            target.alias("target"),
            inserted.alias("inserted_text"),
            F.lit(applied).alias("applicable"),
        )

    include, rename = F.lit("insert-include"), F.lit("apply-compiler-rename")
    line = lambda name: F.concat(F.lit("#include "), name)
    choice = (
        F.when(is_header & header.isNotNull(), step(include, "hip-replacement-mistake", header, line(header)))
        .when(open_symbol & F.col("hint_in_new"), step(rename, "renamed", F.col("suggestion"), F.col("suggestion")))
        .when(open_symbol & F.col("old_kind").isNotNull(), step(restore, removed, F.col("symbol"), F.col("old_text")))
        .when(open_symbol & standard.isNotNull(), step(include, "omitted", standard, line(standard)))
        .when(left & F.col("near").isNotNull(), step(rename, "renamed", F.col("near"), F.lit(""), False))
    )
    out = full.withColumn("_r", choice).select(*diags.columns, "_r.*")
    tier = _lookup_map(shapes.STRATEGY_CONFIDENCE, F.col("strategy"))
    score = F.create_map(*[F.lit(x) for kv in shapes.CONFIDENCE_SCORE.items() for x in kv])
    return out.withColumn("confidence", tier).withColumn(
        "score", F.try_element_at(score, F.col("confidence"))
    )


RESTORE_ORDER = ("macro", "type", "kernel", "helper", "function", "variable")  # where a name has several kinds


def rank_resolutions(resolved: DataFrame, key: str = "path", lines_per_chunk: int = 4096) -> DataFrame:
    """Place of each resolution by score (best first), line, symbol, strategy."""
    by = resolved.filter("strategy IS NOT NULL").withColumn("_neg", -F.col("score"))
    chunk = F.struct("_neg", F.floor(F.col("line") / F.lit(lines_per_chunk)).alias("c"))
    return running(
        by, [key], ["_neg", "line", "symbol", "strategy", "kind", "owner"], chunk,
        sums={"place": F.lit(1).cast("bigint")},
    ).drop("_neg")


def iteration_sets(errors: DataFrame, keys: Sequence[str] = ("run", "iteration"), raw: str = "raw") -> DataFrame:
    """Error count and digest of the distinct normalised errors per iteration."""
    keys = list(keys)
    lines = errors.filter(F.col(raw).rlike(r"\S"))
    per_text = lines.groupBy(*keys, normalize_error(F.col(raw)).alias("e")).agg(F.count(F.lit(1)).alias("n"))
    per_text = settle(per_text)
    counts = per_text.groupBy(*keys).agg(F.sum("n").alias("n_errors"))
    sets = ordered_digest(per_text, keys, ["e"], "e", separator="\n", length=16)
    return counts.join(sets.withColumnRenamed("digest", "error_set"), keys)


def _counts(empty: Column) -> Column:
    """Rows that belong to a trend: the first iteration and those with errors."""
    return F.coalesce((F.col("iteration") == 0) | (F.col("n_errors") > 0), empty)


def trend_state(rows: DataFrame, trend: DataFrame) -> DataFrame:
    """What a later `iteration_trend` needs of each run: its last rows and, on the last one, the counters.

    `rows` are earlier state rows and new iterations, `trend` is the result over them.
    """
    latest = Window.partitionBy("run").orderBy(F.desc("iteration"))
    kept = rows.filter(_counts(F.lit(False))).withColumn("_back", F.row_number().over(latest))
    kept = kept.filter(F.col("_back") <= shapes.CYCLE_REACH)
    last = trend.groupBy("run").agg(F.max_by(F.struct("stagnation", "plateau"), "iteration").alias("_c"))
    joined = kept.join(last, "run", "left")

    def carried(counter: str) -> Column:
        seed = F.coalesce(f"_c.{counter}", f"seed_{counter}", F.lit(0))
        return F.when(F.col("_back") == 1, seed).otherwise(F.lit(0)).cast("bigint").alias(f"seed_{counter}")

    return joined.select("run", "iteration", F.coalesce("n_errors", F.lit(0)).cast("bigint").alias("n_errors"), "error_set",
                         carried("stagnation"), carried("plateau"))


def iteration_trend(
    iterations: DataFrame,
    rows_per_chunk: int = ITERATIONS_PER_CHUNK,
    stagnation_limit: int = shapes.STAGNATION_LIMIT,
    plateau_limit: int = shapes.PLATEAU_LIMIT,
    held: bool = False,
) -> DataFrame:
    """Does a series of attempts still improve?

    `iterations` has (run, iteration, n_errors, error_set); iteration 0 gives the
    first count but is no part of the set history, and an iteration without
    errors is left out.  Stagnation falls to zero on an improving iteration and
    grows by 1 otherwise, by 2 more when the error set is one of the last four;
    plateau counts consecutive repeats of the set.  Long runs are cut by position.

    A run that goes on is given its last rows (`trend_state`) with `seed_stagnation` and
    `seed_plateau` set; these rows carry the counters on and are not part of the result.
    `held`: see `running`.
    """
    seeds = [c for c in ("seed_stagnation", "seed_plateau") if c in iterations.columns]
    is_seed = F.col("seed_stagnation").isNotNull() if seeds else F.lit(False)
    rows = iterations.filter(_counts(F.lit(False))).select(
        "run", "iteration", F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
        F.when(F.col("iteration") > 0, F.col("error_set")).alias("error_set"), *seeds,
    )
    by_number = F.floor(F.col("iteration") / F.lit(rows_per_chunk)).cast("bigint")
    placed = running(
        rows, ["run"], ["iteration"], by_number,
        sums={"_pos": F.lit(1).cast("bigint")}, exclusive=True, held=held,
    )
    tiled = with_halo(placed, F.col("_pos"), rows_per_chunk, before=shapes.CYCLE_REACH)
    w = Window.partitionBy("run", CHUNK).orderBy("_pos")
    back = [F.lag("error_set", i).over(w) for i in range(1, shapes.CYCLE_REACH + 1)]
    seen = F.lit(False)
    for earlier in back:
        seen = seen | F.coalesce(F.col("error_set") == earlier, F.lit(False))
    flagged = (
        tiled.select(
            "run", "iteration", "n_errors", "error_set", "_pos", "_own", *seeds,
            (F.lag("n_errors", 1, 0).over(w) - F.col("n_errors")).alias("delta"),
            seen.alias("cycle"),
            F.coalesce(F.col("error_set") == back[0], F.lit(False)).alias("_again"),
        )
        .filter("_own AND iteration > 0")
        .drop("_own")
    )
    counted = segmented_sums(
        flagged, ["run"], ["_pos"], F.floor(F.col("_pos") / F.lit(rows_per_chunk)).cast("bigint"),
        {
            "stagnation": (
                F.when(is_seed, F.col("seed_stagnation") if seeds else F.lit(0)).otherwise(
                    (F.col("delta") <= 0).cast("int") + 2 * F.col("cycle").cast("int")
                ),
                is_seed | (F.col("delta") > 0),
            ),
            "plateau": (
                F.when(is_seed, F.col("seed_plateau") if seeds else F.lit(0)).otherwise(F.col("_again").cast("int")),
                is_seed | ~F.col("_again"),
            ),
        },
    )
    counted = counted.filter(~is_seed).drop(*seeds)
    state = (
        F.when(F.col("stagnation") >= stagnation_limit, F.lit("stagnant"))
        .when(F.col("plateau") >= plateau_limit, F.lit("plateau"))
        .when(F.col("delta") > 0, F.lit("improving"))
        .otherwise(F.lit("slow"))
    )
    return counted.drop("_pos", "_again").withColumn("state", state)


def new_resolved(errors: DataFrame, rows_per_chunk: int = ITERATIONS_PER_CHUNK, raw: str = "raw") -> DataFrame:
    """U4: errors that appear in or vanish from an iteration, on normalised text.

    One row per (run, iteration, error); the two sets meet in a join on the
    error, so no set is gathered in one place.
    """
    texts = errors.filter(F.col(raw).rlike(r"\S")).select(
        "run", "iteration", normalize_error(F.col(raw)).alias("error")
    ).distinct()
    texts = settle(texts)
    numbers = texts.select("run", "iteration").distinct()
    order = running(
        numbers, ["run"], ["iteration"],
        F.floor(F.col("iteration") / F.lit(rows_per_chunk)).cast("bigint"),
        sums={"_pos": F.lit(1).cast("bigint")},
    )
    order = settle(order)
    placed = settle(texts.join(order, ["run", "iteration"]))
    now = placed.select("run", "error", "_pos", F.lit(True).alias("_now"))
    then = placed.select("run", "error", (F.col("_pos") + 1).alias("_pos"), F.lit(True).alias("_then"))
    changed = now.join(then, ["run", "error", "_pos"], "full").filter(
        F.col("_now").isNull() | F.col("_then").isNull()
    )
    # A position after the last iteration of a run names no iteration and drops out here.
    return changed.join(order, ["run", "_pos"]).select(
        "run", "iteration", "error",
        F.when(F.col("_now").isNull(), F.lit("resolved")).otherwise(F.lit("new")).alias("status"),
    )


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """K4: the first n rows per group.

    Spark keeps at most n rows per group and task before the shuffle
    (WindowGroupLimit), so a hot group does not travel.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
