"""Comparing numeric results and labelling outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ATOL = 1e-5
DEFAULT_RTOL = 0.0
TINY = 1e-300


def _per_key(values: Mapping[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, key.cast("string")), F.lit(default))


def numeric_diff(
    actual: DataFrame,
    expected: DataFrame,
    key: str = "key",
    idx: str = "idx",
    value: str = "value",
    atol: Mapping[str, float] | None = None,
    rtol: Mapping[str, float] | None = None,
    default_atol: float = DEFAULT_ATOL,
    default_rtol: float = DEFAULT_RTOL,
) -> DataFrame:
    """Tolerant comparison of two result sets, one verdict row per key.

    Rows meet on (key, idx); values are text.  Identical text passes, a missing
    row or a value that is no number fails, otherwise each row needs
    abs(a - e) <= atol + rtol * max(abs a, abs e).  NaN fails.  The worst row is
    the largest violating difference, or the largest difference if all pass.
    The join keys include idx and the roll-up aggregates before its shuffle.
    """
    a = actual.select(F.col(key).alias("key"), F.col(idx).alias("idx"), F.col(value).cast("string").alias("a_text"), F.lit(True).alias("in_a"))
    e = expected.select(F.col(key).alias("key"), F.col(idx).alias("idx"), F.col(value).cast("string").alias("e_text"), F.lit(True).alias("in_e"))
    a_num, e_num = F.col("a_text").try_cast("double"), F.col("e_text").try_cast("double")
    diff = F.abs(a_num - e_num)
    bound = _per_key(atol or {}, F.col("key"), default_atol) + _per_key(
        rtol or {}, F.col("key"), default_rtol
    ) * F.greatest(F.abs(a_num), F.abs(e_num))
    rows = a.join(e, ["key", "idx"], "full").select(
        "key",
        "idx",
        (F.col("in_a").isNull() | F.col("in_e").isNull()).alias("missing"),
        F.col("a_text").eqNullSafe(F.col("e_text")).alias("same"),
        (a_num.isNull() | e_num.isNull()).alias("unparsed"),
        diff.alias("diff"),
        (F.isnan(diff) | (diff > bound)).alias("violates"),
        F.when(F.abs(e_num) > 0, diff / F.greatest(F.abs(e_num), F.lit(TINY)))
        .otherwise(F.when(diff > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
        .alias("rel"),
    )
    worst = F.max_by(
        F.struct("idx", "diff", "rel"),
        F.when(F.col("diff").isNotNull(), F.struct("violates", "diff", (-F.col("idx")).alias("neg"))),
    )
    grouped = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("missing").alias("n_missing"),
        F.count_if(~F.col("missing") & F.col("unparsed")).alias("n_unparsed"),
        F.count_if("violates").alias("n_violations"),
        F.bool_and("same").alias("identical"),
        worst.alias("w"),
    )
    clean = (F.col("n_missing") == 0) & (F.col("n_unparsed") == 0) & (F.col("n_violations") == 0)
    return grouped.select(
        "key", "n_rows", "n_missing", "n_unparsed", "n_violations", "identical",
        (F.col("identical") | clean).alias("passed"),
        F.col("w.idx").alias("worst_idx"),
        F.col("w.diff").alias("worst_abs"),
        F.col("w.rel").alias("worst_rel"),
    )


def compare_runs(
    run1: DataFrame,
    run2: DataFrame,
    key: str = "key",
    idx: str = "idx",
    value: str = "value",
    opted_out: Sequence[str] = (),
) -> DataFrame:
    """Two runs on one input must agree exactly; opted-out keys always count as stable."""
    a = run1.select(F.col(key).alias("key"), F.col(idx).alias("idx"), F.struct(F.col(value).alias("v")).alias("a"))
    b = run2.select(F.col(key).alias("key"), F.col(idx).alias("idx"), F.struct(F.col(value).alias("v")).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    excused = F.col("key").isin(list(opted_out)) if opted_out else F.lit(False)
    return (
        a.join(b, ["key", "idx"], "full")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).alias("n_different"))
        .withColumn("deterministic", excused | (F.col("n_different") == 0))
    )


def gate_confidence(confidence: Column, passed: Column) -> Column:
    """Confidence is a claim about a verified result; anything else has none."""
    return F.when(passed, confidence).otherwise(F.lit(0).cast("double"))


def verdict(runs: DataFrame, verifications: DataFrame, key: str = "run") -> DataFrame:
    """A5: one verdict per run.  `verifications` has (key, passed, testable); a run without rows needed none."""
    grouped = verifications.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("passed")).alias("passed"),
        F.bool_or("testable").alias("_testable"),
    )
    n, p = F.coalesce("attempted", F.lit(0)), F.coalesce("passed", F.lit(0))
    failed = (n > 0) & F.col("_testable") & (p == 0)
    return runs.select(key).join(grouped, key, "left").select(
        key,
        n.cast("bigint").alias("attempted"),
        p.cast("bigint").alias("passed"),
        F.when(n == 0, F.lit("NO PORTS NEEDED"))
        .when(~F.col("_testable"), F.lit("UNVERIFIED (no GPU)"))
        .when(p == 0, F.lit("FAILED"))
        .when(p == n, F.lit("PASSED"))
        .otherwise(F.concat(F.lit("PARTIAL ("), p, F.lit("/"), n, F.lit(" verified)")))
        .alias("verdict"),
        F.coalesce(failed, F.lit(False)).alias("exit_fail"),
    )


# --- fixed values: POSIX signal names, by number from 1 ----------------------------------
SIGNALS = (
    "SIGHUP", "SIGINT", "SIGQUIT", "SIGILL", "SIGTRAP", "SIGABRT", "SIGBUS", "SIGFPE",
    "SIGKILL", "SIGUSR1", "SIGSEGV", "SIGUSR2", "SIGPIPE", "SIGALRM", "SIGTERM",
    "SIGSTKFLT", "SIGCHLD", "SIGCONT", "SIGSTOP", "SIGTSTP", "SIGTTIN", "SIGTTOU",
    "SIGURG", "SIGXCPU", "SIGXFSZ", "SIGVTALRM", "SIGPROF", "SIGWINCH", "SIGIO",
    "SIGPWR", "SIGSYS",
)


def signal_name(exit_code: Column) -> Column:
    """Name of the signal behind a negative exit code; empty for other codes."""
    number = -exit_code
    named = F.get(F.array(*[F.lit(s) for s in SIGNALS]), (number - 1).cast("int"))
    return F.when(exit_code < 0, F.coalesce(named, F.concat(F.lit("signal "), number))).otherwise(F.lit(""))


def failure_label(df: DataFrame) -> DataFrame:
    """F16: the first failing step of a run that did not pass.

    Needs compile_success, run_success, run_exit_code (nullable).
    """
    code = F.col("run_exit_code")
    crash = F.lit("Compiled, but crashed at runtime (")
    label = (
        F.when(~F.coalesce("compile_success", F.lit(False)), F.lit("Not compiled — saved for manual hipcc"))
        .when(
            ~F.coalesce("run_success", F.lit(False)),
            F.when(code < 0, F.concat(crash, signal_name(code), F.lit(", exit "), code, F.lit(")")))
            .when(code.isNotNull(), F.concat(crash, F.lit("exit "), code, F.lit(")")))
            .otherwise(F.lit("Compiled, but failed to run")),
        )
        .otherwise(F.lit("Output mismatch"))
    )
    return df.withColumn("label", label)


# --- fixed values: failure classes worth trying again ------------------------------------
TRANSIENT = ("api_timeout", "network_error", "rate_limit", "http_error")


def failure_class(http_status: Column, message: Column) -> Column:
    """F16: class of a failed call from its HTTP status or its exception text."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(http_status == 429, F.lit("rate_limit"))
        .when(http_status >= 500, F.lit("api_timeout"))
        .when(http_status.isNotNull(), F.lit("http_error"))
        .when(F.contains(text, F.lit("timed out")) | F.contains(text, F.lit("timeout")), F.lit("api_timeout"))
        .otherwise(F.lit("network_error"))
    )


def is_transient(failure: Column) -> Column:
    return F.coalesce(failure.isin(*TRANSIENT), F.lit(False))
