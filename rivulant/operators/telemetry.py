"""Run telemetry and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.plans.scratch import settle
from rivulant.plans.scan import range_rank, running

ROWS_PER_CHUNK = 4096


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without time zone; the session zone plays no part."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * F.lit(86_400_000_000)
    seconds = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * F.lit(1_000_000)
    return day + seconds + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def stage_timing(events: DataFrame, stage: str = "stage", ms: str = "ms", failed: str = "failed") -> DataFrame:
    """Calls, total, mean and failures per stage."""
    return events.groupBy(stage).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(ms).alias("total_ms"),
        F.coalesce(F.avg(ms), F.lit(0.0)).alias("mean_ms"),
        F.count_if(F.col(failed)).alias("failures"),
    )


def usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens, cost and latency per (run, model), per run and overall.

    Rows are reduced per (run, model) first; the totals above are built from
    those sums, so the roll-up does not multiply the input.
    """
    base = calls.groupBy("run", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.sum("latency_ms").alias("latency_ms"),
    )
    return base.rollup("run", "model").agg(
        *[F.sum(c).alias(c) for c in ("calls", "tokens", "cost", "latency_ms")],
        F.grouping_id().cast("int").alias("level"),
    ).withColumn("mean_latency_ms", F.col("latency_ms") / F.col("calls"))


def run_metrics(events: DataFrame, run: str = "run", kind: str = "kind", transition: str = "transition") -> DataFrame:
    """Event and transition counts and the counter map per run; distinct kinds only reach a map."""
    counted = events.groupBy(run, kind).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(transition)).alias("t")
    )
    return counted.groupBy(run).agg(
        F.sum("n").alias("events"),
        F.sum("t").alias("transitions"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counters"),
    )


# --- fixed values: abort reasons with a cause of their own --------------------------------
ABORT_CAUSES = {
    "harness_origin": "every diagnostic points at the harness",
    "pipeline_timeout": "time budget ran out before convergence",
    "layer2_rejected": "a refinement broke a build that compiled before",
    "hard_stagnation": "the error set stopped shrinking",
    "kimi_plateau": "identical error set on consecutive iterations",
    "runtime_stagnation": "compiled, but crashed three times in a row",
    "max_iterations_exhausted": "iteration limit reached without a passing compile",
}
ADVICE = {
    "harness_origin": "correct the harness specification",
    "pipeline_timeout": "raise the time budget or narrow the input",
    "runtime_stagnation": "inspect the static lane findings",
    "layer2_rejected": "inspect the static lane findings",
}


def run_counters(events: DataFrame, run: str = "run", order: str = "seq") -> DataFrame:
    """The counters of each run from its events (run, seq, kind, state, abort_reason)."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return events.groupBy(run).agg(
        n("lexical_reject").alias("lexical_rejects"),
        n("structural_reject").alias("structural_rejects"),
        n("generation").alias("generations"),
        n("compile").alias("compiles"),
        n("compile_error").alias("compile_errors"),
        F.coalesce(F.bool_or(F.col("kind") == "compile_passed"), F.lit(False)).alias("compile_passed"),
        F.max_by("abort_reason", F.when(F.col("abort_reason").isNotNull(), F.col(order))).alias("abort_reason"),
        F.max_by("state", order).alias("last_state"),
    )


def root_cause(counters: DataFrame) -> DataFrame:
    """One inferred cause and one recommendation per run; counters outrank the abort reason."""
    gen, never = F.col("generations"), (F.col("compiles") == 0) & (F.col("generations") > 0)
    abort = F.create_map(*[F.lit(x) for kv in ABORT_CAUSES.items() for x in kv])
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    lex, struct = F.col("lexical_rejects"), F.col("structural_rejects")
    state = F.coalesce("last_state", F.lit(""))
    cause = (
        F.when(never & (lex > 0) & (lex >= gen), F.lit("prose instead of source on every generation"))
        .when(never & (struct > 0) & (struct >= gen), F.lit("every generation was structurally broken"))
        .when(never, F.lit("a gate stopped every generation before the compiler"))
        .when(F.col("abort_reason").isin(*ABORT_CAUSES), F.try_element_at(abort, F.col("abort_reason")))
        .when(F.contains(state, F.lit("LEXICAL")), F.lit("last decision was a lexical rejection"))
        .when(F.contains(state, F.lit("STRUCTURAL")), F.lit("last decision was a structural rejection"))
        .when(F.col("compile_passed"), F.lit("no failure: it compiled"))
        .when(F.col("compile_errors") > 0, F.lit("compile errors remain"))
        .otherwise(F.lit("no single cause"))
    )
    recommendation = F.coalesce(
        F.try_element_at(advice, F.col("abort_reason")),
        F.when(F.col("compile_passed"), F.lit("verify the output")).otherwise(
            F.lit("read the last raw response")
        ),
    )
    return counters.withColumns({"cause": cause, "recommendation": recommendation})


def rewards(iterations: DataFrame) -> DataFrame:
    """Delta and reward (its sign) of each iteration from errors_before and errors_after."""
    delta = F.col("errors_before") - F.col("errors_after")
    return iterations.withColumns({"delta": delta, "reward": F.signum(delta).cast("bigint")})


def item_scores(iterations: DataFrame, items: DataFrame, on: Sequence[str] = ("run", "iteration")) -> DataFrame:
    """The summed reward of every checklist item over the iterations that used it."""
    return (
        items.join(rewards(iterations).select(*on, "reward"), list(on))
        .groupBy("item")
        .agg(F.sum("reward").alias("score"), F.count(F.lit(1)).alias("uses"))
    )


def version_stats(iterations: DataFrame, version: str = "version") -> DataFrame:
    """Mean error reduction per iteration and share of winning iterations per version."""
    wins, losses = F.count_if(F.col("reward") > 0), F.count_if(F.col("reward") < 0)
    return rewards(iterations).groupBy(version).agg(
        F.count(F.lit(1)).alias("iterations"),
        wins.alias("wins"),
        losses.alias("losses"),
        F.coalesce(F.sum("delta") / F.count(F.lit(1)), F.lit(0.0)).alias("reward"),
        (wins / F.greatest(wins + losses, F.lit(1))).alias("win_rate"),
    )


# --- fixed values: failures that mean a malformed answer ----------------------------------
MALFORMED = ("reasoning_only", "empty_response", "invalid_json", "extraction_failure", "partial_code")


def provider_health(attempts: DataFrame, keys: Sequence[str] = ("provider",)) -> DataFrame:
    """Reliability per provider from (failure, latency_ms, extraction_ok)."""
    timeouts = F.count_if(F.col("failure") == "api_timeout")
    malformed = F.count_if(F.col("failure").isin(*MALFORMED))
    n = F.count(F.lit(1))
    return attempts.groupBy(*keys).agg(
        n.alias("attempts"),
        timeouts.alias("timeouts"),
        malformed.alias("malformed"),
        F.count_if("extraction_ok").alias("extraction_ok"),
        F.sum("latency_ms").alias("latency_ms"),
        F.coalesce(F.try_divide(timeouts + malformed, n), F.lit(0.0)).alias("failure_rate"),
    )


def state_trace(
    events: DataFrame, chunk: Column, run: str = "run", order: Sequence[str] = ("ts", "seq"), held: bool = False
) -> DataFrame:
    """Index, previous state, time in it and time since the start of the run.

    `chunk` cuts a run along its time (a day, an hour), so that a run with very
    many events is shared by tasks.  `held`: see `running`.
    """
    at = micros(F.col("ts"))
    traced = running(
        events.withColumn("_at", at), [run], list(order), chunk,
        sums={"index": F.lit(1).cast("bigint")},
        maxes={"_first": -F.col("_at")},
        previous={"previous_state": F.col("state"), "_prev": F.col("_at")}, held=held,
    )
    return traced.select(
        *events.columns,
        "index",
        "previous_state",
        ((F.col("_at") - F.col("_prev")) / 1000).alias("elapsed_ms"),
        ((F.col("_at") + F.col("_first")) / 1000).alias("since_start_ms"),
    )


def pack(
    items: DataFrame, max_chars: int, keys: Sequence[str], position: str, length: str,
    header: int = 0, rows_per_chunk: int = ROWS_PER_CHUNK, held: bool = False,
) -> DataFrame:
    """Keep items in order while the running length stays within the budget.

    The length counts the newlines before an item.  It never falls, so every
    item after the first that does not fit is out as well.  `held`: see `running`.
    """
    sized = running(
        items, keys, [position], F.floor(F.col(position) / F.lit(rows_per_chunk)).cast("bigint"),
        sums={"_len": F.col(length) + 1}, held=held,
    )
    return sized.withColumn("running_length", F.lit(header) + F.col("_len") - 1).withColumn(
        "kept", F.col("running_length") <= max_chars
    ).drop("_len")


def pack_summary(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items kept and omitted per group."""
    return packed.groupBy(*keys).agg(
        F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("omitted")
    )


def best_attempt(iterations: DataFrame, key: str = "run", compiled: str = "compiled") -> DataFrame:
    """The latest iteration that compiled; runs without one have no row."""
    rest = F.struct(*[c for c in iterations.columns if c not in (key, compiled)])
    return (
        iterations.filter(F.col(compiled))
        .groupBy(key)
        .agg(F.max_by(rest, "iteration").alias("r"))
        .select(key, "r.*")
    )


def top_items(scores: DataFrame, n: int = 5) -> DataFrame:
    """K2: the n best items; equal scores in name order."""
    return scores.orderBy(F.desc("score"), "item").limit(n)


def evolve_items(
    checklist: DataFrame, scores: DataFrame, hits: DataFrame, key: str = "version"
) -> DataFrame:
    """K2: the next checklist of each version, (key, place, item, score).

    `checklist` has (key, item, position); unscored items count 0.  Of the last
    two by score those below zero go; then keyword items not present follow in
    keyword order (`hits`: key, item, keyword_no).
    """
    scored = checklist.join(scores.select("item", "score"), "item", "left").select(
        key, "item", "position", F.coalesce("score", F.lit(0)).cast("bigint").alias("score")
    ).withColumn("_neg", -F.col("score"))
    ranked = running(
        scored, [key], ["_neg", "position"],
        F.struct("_neg", F.floor(F.col("position") / F.lit(ROWS_PER_CHUNK)).alias("c")),
        sums={"place": F.lit(1).cast("bigint")},
    )
    sizes = checklist.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    last_two = (F.col("_n") >= 2) & (F.col("place") > F.col("_n") - 2)
    kept = settle(ranked.join(sizes, key).filter(~(last_two & (F.col("score") < 0))).select(
        key, F.lit(0).alias("_part"), F.col("place").alias("_o"), "item", "score"
    ))
    fresh = hits.select(key, "item", "keyword_no").distinct().join(
        kept.select(key, "item"), [key, "item"], "left_anti"
    ).select(
        key, F.lit(1).alias("_part"), F.col("keyword_no").cast("bigint").alias("_o"), "item",
        F.lit(0).cast("bigint").alias("score"),
    )
    return running(
        kept.unionByName(fresh), [key], ["_part", "_o"],
        F.struct("_part", F.floor(F.col("_o") / F.lit(ROWS_PER_CHUNK)).alias("c")),
        sums={"place": F.lit(1).cast("bigint")},
    ).select(key, "place", "item", "score")


def next_version(version: Column) -> Column:
    """K2: `v7` after `v6_anything`."""
    return F.concat(F.lit("v"), F.regexp_extract(version, r"^v(\d+)", 1).cast("int") + 1)


def rank_providers(health: DataFrame, position: str = "position") -> DataFrame:
    """K3: place by failure rate, then by the listed order."""
    return range_rank(health, ["failure_rate", position])


def rank_fixes(fixes: DataFrame, key: str = "run", position: str = "position", default: int = 99) -> DataFrame:
    """K3: place of each fix per run: priority ascending, none counts as the default, listed order on ties."""
    by = fixes.withColumn("_p", F.coalesce("priority", F.lit(default)))
    return running(
        by, [key], ["_p", position],
        F.struct("_p", F.floor(F.col(position) / F.lit(ROWS_PER_CHUNK)).alias("c")),
        sums={"place": F.lit(1).cast("bigint")},
    ).drop("_p")


def raw_error_priority(position: Column, text: Column, default: int = 99) -> Column:
    """K3: priority of an unstructured message: warnings last, errors in their order from 10."""
    return F.when(F.contains(F.lower(text), F.lit("warning")), F.lit(default)).otherwise(position + 10)


def keyword_items(errors: DataFrame, keywords: Sequence[tuple[str, str]], key: str = "run", raw: str = "raw") -> DataFrame:
    """(key, item, keyword_no) of keywords that occur in the messages of a run.

    A keyword lies within one message, so messages need not be joined into one
    text: each is matched against the literal list and the hits are made distinct.
    """
    found = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("keyword_no"), F.lit(item).alias("item"),
                    F.contains(F.col(raw), F.lit(word)).alias("hit"),
                )
                for i, (word, item) in enumerate(keywords)
            ]
        ),
        lambda k: k["hit"],
    )
    return errors.select(key, F.inline(found)).groupBy(key, "item").agg(F.min("keyword_no").alias("keyword_no"))


def expand_items(
    errors: DataFrame, keywords: Sequence[tuple[str, str]], items: DataFrame, key: str = "run", raw: str = "raw"
) -> DataFrame:
    """The items to add to each run: hit by a keyword and not there yet."""
    return keyword_items(errors, keywords, key, raw).join(
        items.select(key, "item").distinct(), [key, "item"], "left_anti"
    )


def pending(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files not seen yet or with another mtime or size."""
    s = state.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    same = (
        (listing["path"] == s["path"])
        & listing["mtime"].eqNullSafe(s["_m"])
        & listing["size"].eqNullSafe(s["_s"])
    )
    return listing.join(s, same, "left_anti")


def apply_overrides(
    computed: DataFrame, overrides: DataFrame, key: str, value: str, known: Sequence
) -> DataFrame:
    """A hand-set value wins over the computed one; only known values count."""
    hand = overrides.filter(F.col(value).isin(list(known))).select(key, F.col(value).alias("_hand"))
    return computed.join(hand, key, "left").select(
        *[c for c in computed.columns if c != value],
        F.coalesce("_hand", value).alias(value),
        F.col("_hand").isNotNull().alias("overridden"),
    )


def merge_generated(existing: DataFrame, generated: DataFrame, key: str, marker: str = "auto_generated") -> DataFrame:
    """Generated rows replace generated rows; a hand-made row is never overwritten."""
    by_hand = existing.filter(~F.coalesce(marker, F.lit(False)))
    fresh = generated.join(by_hand.select(key), key, "left_anti")
    old = existing.filter(F.coalesce(marker, F.lit(False))).join(fresh.select(key), key, "left_anti")
    return by_hand.unionByName(old).unionByName(fresh)
