"""Rule scans on small texts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulant.functions.text import duration_text, lines_of, normalize_error, running_total, slug
from rivulant.operators import findings as ops
from rivulant.operators.store import signature, signature_of_corpus
from rivulant.rules import Rule
from rivulant.rules.device import LANE_SENSITIVE, LANE_SENSITIVE_WORDS, RESIDUAL_PATTERN, RISK_RULES

KERNEL = """#include <cuda_runtime.h>
__global__ void reduce(float* a) {
  __shared__ float tile[32];
  float v = a[0];
  v += __shfl_down_sync(0xffffffff, v,
                        16);
  v += __shfl_xor_sync(0xffffffff, v, 1);
  if (threadIdx.x >> 5) __syncwarp();
}
"""


def test_lines_of_matches_and_context(corpus_of):
    rows = ops.scan_rules(corpus_of(a=KERNEL, b="int x;\n"), RISK_RULES, context=(1, 1)).collect()
    at = {(r.rule, r.line) for r in rows}
    assert ("shfl_down_sync", 5) in at  # the match spans two lines and starts on the first
    assert ("shfl_xor_sync", 7) in at
    assert ("warp_lane_shift", 8) in at and ("syncwarp", 8) in at
    assert ("shared_mem_warp_tiling", 3) in at
    assert {r.path for r in rows} == {"a"}
    xor = next(r for r in rows if r.rule == "shfl_xor_sync")
    assert xor.context.split("\n")[1].strip().startswith("v += __shfl_xor_sync")
    assert len(xor.context.split("\n")) == 3


def test_scan_against_python(spark):
    import re

    texts = [("t%d" % i, ("ab\n" * i + "x12y\n\n7" * (i % 5)) * 3) for i in range(40)]
    df = spark.createDataFrame(texts, "path string, source string")
    rule = Rule("digits", "[0-9]+\n*")
    got = {
        (r.path, r.line, r.matched_text) for r in ops.scan_rules(df, [rule]).collect()
    }
    want = {
        (p, t[: m.start()].count("\n") + 1, m.group()[:100])
        for p, t in texts
        for m in re.finditer(rule.pattern, t)
    }
    assert got == want


def test_context_joined_equals_inline(corpus_of):
    docs = corpus_of(a=KERNEL, b=KERNEL + KERNEL)
    inline = ops.scan_rules(docs, RISK_RULES, context=(2, 2))
    joined = ops.with_context(ops.scan_rules(docs, RISK_RULES), docs, 2, 2).select(*inline.columns)
    assert sorted(map(str, inline.collect())) == sorted(map(str, joined.collect()))


def test_risk_levels(corpus_of):
    docs = corpus_of(high=KERNEL, medium="__activemask()", low="__syncwarp()", none="int a;")
    levels = {r.path: r.risk_level for r in ops.risk(docs, RISK_RULES).collect()}
    assert levels == {"high": "red", "medium": "yellow", "low": "green", "none": "green"}
    found = ops.scan_rules(docs, RISK_RULES)
    grouped = ops.risk_of_findings(docs, found, RISK_RULES)
    assert sorted(map(str, grouped.collect())) == sorted(
        map(str, ops.risk(docs, RISK_RULES).select(*grouped.columns).collect())
    )


def test_rule_counts_both_ways(corpus_of):
    docs = corpus_of(a=KERNEL, b=KERNEL)
    direct = {r.rule: r.n_matches for r in ops.rule_counts(docs, RISK_RULES).collect()}
    grouped = {
        r.rule: r.n_matches
        for r in ops.rule_counts_of_findings(ops.scan_rules(docs, RISK_RULES), RISK_RULES).collect()
    }
    assert direct == grouped and direct["match_all_sync"] == 0 and direct["shfl_xor_sync"] == 2


def test_review_and_residual(corpus_of):
    docs = corpus_of(a=KERNEL, b="cudaMalloc(&p, 4); cudaFree(p); cudaFree(q);", c="int x;")
    flags = {
        r.path: r.needs_review
        for r in ops.needs_review(docs, RISK_RULES, LANE_SENSITIVE, LANE_SENSITIVE_WORDS).collect()
    }
    assert flags == {"a": True, "b": False, "c": False}
    left = {r.path: r.symbols for r in ops.residual_symbols(docs, RESIDUAL_PATTERN).collect()}
    assert left["b"] == ["cudaFree", "cudaMalloc"] and left["c"] == []


def test_signature_keys(spark):
    rows = [
        ("w", "warp_size_constant", "medium"), ("w", "shfl_down_sync", "HIGH"),
        ("w", "shared_mem_warp_tiling", "med"), ("w", "shfl_down_sync", "critical"),
        ("h", "shfl_xor_sync", "high"), ("h", " Warp_Size_Constant ", "Medium"),
    ]
    df = spark.createDataFrame(rows, "path string, rule string, severity string")
    got = {r.path: (r.signature, r.digest) for r in signature(df).collect()}
    assert got["w"] == (
        "shared_mem_warp_tiling:MEDIUM|shfl_down_sync:HIGH|warp_size_constant:MEDIUM", "72d10573e8bf2747",
    )
    assert got["h"] == ("shfl_xor_sync:HIGH|warp_size_constant:MEDIUM", "7d93007797cb2f5d")
    again = {r.path: r.digest for r in signature(df.orderBy(F.desc("rule"))).collect()}
    assert again == {p: d for p, (_, d) in got.items()}


def test_signature_direct_equals_grouped(corpus_of):
    docs = corpus_of(a=KERNEL, b="__activemask()", c="nothing")
    direct = {r.path: r.signature for r in signature_of_corpus(docs, RISK_RULES).collect()}
    grouped = {r.path: r.signature for r in signature(ops.scan_rules(docs, RISK_RULES)).collect()}
    assert {p: s for p, s in direct.items() if s} == grouped and direct["c"] == ""


def test_running_total_long_array(spark):
    df = spark.createDataFrame([(list(range(1000)),), ([],), ([5],)], "a array<bigint>")
    out = [r.t for r in df.select(running_total(F.col("a"), block=7).alias("t")).collect()]
    assert out[0] == [sum(range(i + 1)) for i in range(1000)] and out[1] == [] and out[2] == [5]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="a \r\n", max_size=12), min_size=1, max_size=8))
def test_lines_of_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.ls for r in df.select("i", lines_of(F.col("t")).alias("ls")).collect()}
    for i, t in enumerate(texts):
        parts = t.replace("\r\n", "\n").split("\n")
        assert got[i] == (parts[:-1] if parts[-1] == "" else parts)


def test_small_text_functions(spark):
    row = spark.range(1).select(
        slug(F.lit("a b/c!")).alias("s"), slug(F.lit("!!")).alias("u"),
        duration_text(F.lit(0.4)).alias("d1"), duration_text(F.lit(12.34)).alias("d2"),
        duration_text(F.lit(2500.0)).alias("d3"),
        normalize_error(F.lit(" /tmp/x/y/k.cpp:7:5: error:  a   b ")).alias("e"),
    ).first()
    assert (row.s, row.u) == ("a_b_c", "unnamed")
    assert (row.d1, row.d2, row.d3) == ("400µs", "12.3ms", "2.50s")
    assert row.e == "error: a b"


def test_order_position(spark):
    rows = [("p", i % 3000, ("low", "high", "medium")[i % 3], "r%d" % (i % 7), "m%d" % i) for i in range(9000)]
    df = spark.createDataFrame(rows, "path string, line int, severity string, rule string, message string")
    got = {(r.message): r.position for r in ops.order_findings(df, lines_per_chunk=100).collect()}
    rank = {"high": 0, "medium": 1, "low": 2}
    want = sorted(rows, key=lambda r: (r[1], rank[r[2]], r[3], r[4]))
    assert [got[r[4]] for r in want] == list(range(1, 9001))


def test_report(spark):
    risks = spark.createDataFrame([("a", "red", 1), ("b", "green", 0)], "path string, risk_level string, n_findings long")
    runs = spark.createDataFrame([(True, 90.0), (True, 85.0), (False, 99.0), (True, None)], "passed boolean, confidence double")
    store = spark.createDataFrame([(5, 92.0, 10)], "entries long, avg_confidence double, retrievals long")
    row = ops.report(risks, runs, store).first()
    assert row.hours_saved == 12.0 and row.avg_confidence == 58.3 and row.total_files == 2
    assert "5 verified patterns" in row.summary and "92" in row.summary and "10 retrievals" in row.summary
    assert "hours" not in ops.report(risks, runs.filter("NOT passed")).first().summary
