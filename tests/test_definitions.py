"""Definition and region index on small sources, and the interval join against loops."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from rivulant.functions.text import running_total
from rivulant.operators.definitions import definitions, device_words_outside, enclosing_region, matches, regions
from rivulant.operators.diagnostics import locate, parse_diagnostics, resolve
from rivulant.plans.joins import interval_join
from rivulant.rules import definitions as shapes
from rivulant.rules.device import HEADER_MAP, STANDARD_HEADERS

SOURCE = """#include <cuda_runtime.h>
#define TILE 32 // tiles \\
  of 32
#define AREA(a, b) ((a) \\
  * (b))
/* struct Ghost { int n; }; */
struct Params { int n; struct { float x; } in; }  ;

typedef unsigned long long u64;
typedef struct Pair { int a; } Pair;
using real = float;
__constant__ float table[4] = {1, 2};
static const int plain = 3;

template <typename T>
__device__ T reduce(T v) {
    const char* s = "} not the end {"; // } neither
    if (v > 0) { for (;;) { break; } }
    return v;
}

__global__ void kern(const float* in, float* out, Params p) {
    out[threadIdx.x] = reduce(in[blockIdx.x]);
}

int main(int argc) {
    int i = threadIdx.x; int j = threadIdx.y;
    /* warpSize */ return "blockDim"[0];
}
int TILE_of(int x) { return x; }
struct Params2 { int open;
"""


def test_every_kind_with_its_text(corpus_of):
    got = {r.name: r for r in definitions(corpus_of(a=SOURCE)).collect()}
    kinds = {n: r.kind for n, r in got.items()}
    assert kinds == {
        "TILE": "macro", "AREA": "macro", "Params": "type", "u64": "type", "Pair": "type", "real": "type", "table": "variable",
        "reduce": "helper", "kern": "kernel", "main": "helper", "TILE_of": "helper",
    }
    for r in got.values():
        assert SOURCE[r.start : r.end] == r.text
    assert got["TILE"].text == "#define TILE 32 // tiles \\\n  of 32"
    assert got["AREA"].text.endswith("* (b))")
    assert got["Params"].text.endswith("in; }  ;") and got["u64"].text == "typedef unsigned long long u64;"
    assert got["reduce"].text.startswith("__device__ T reduce") and got["reduce"].text.endswith("return v;\n}")


def test_one_definition_a_name(corpus_of):
    source = "#define same 1\nvoid same(int a) { }\nstruct same { int b; };\nstruct same { int c; };\nvoid other(int a) { }\nvoid other(int b) { }\n"
    got = {r.name: r.text for r in definitions(corpus_of(a=source, b="", c="no code")).collect()}
    assert got == {"same": "struct same { int b; };", "other": "void other(int a) { }"}


def test_braces_in_any_order(corpus_of):
    got = definitions(corpus_of(a="} } void f(int a) { { } }\n}\nvoid g(int b) { {\n", b="{" * 500 + "\nvoid h(int c) { }" + "}" * 500)).collect()
    assert {(r.path, r.name) for r in got} == {("a", "f"), ("b", "h")} or {(r.path, r.name) for r in got} == {("b", "h")}
    assert [r.text for r in got if r.name == "h"] == ["void h(int c) { }"]


def test_regions_and_device_words(spark, corpus_of):
    corpus = corpus_of(a=SOURCE)
    found = {r.name: r for r in regions(corpus).collect()}
    assert {n: r.is_device for n, r in found.items()} == {"reduce": True, "kern": True, "main": False, "TILE_of": False}
    lines = SOURCE.split("\n")
    assert lines[found["kern"].first_line - 1].startswith("__global__") and lines[found["kern"].last_line - 1] == "}"
    main = SOURCE.count("\n", 0, SOURCE.index("int i = ")) + 1
    assert [(r.path, r.word, r.line) for r in device_words_outside(corpus, ["path"]).collect()] == [("a", "threadIdx", main)]
    points = spark.createDataFrame([("a", i) for i in range(len(SOURCE))], "path string, offset long")
    got = {r.offset: r.region.name if r.region else None for r in enclosing_region(points, regions(corpus), ["path"]).collect()}
    for i in range(len(SOURCE)):
        held = [r for r in found.values() if r.start <= i < r.end]
        assert got[i] == (held[0].name if held else None)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join(spark, how):
    rng = random.Random(3)
    spans = [(g, i, s, s + rng.choice([0, 1, 5, 77, 3000])) for g in "ab" for i, s in enumerate(rng.sample(range(-50, 4000), 40))]
    points = [(g, p) for g in "abc" for p in rng.sample(range(-60, 6000), 150)]
    a = spark.createDataFrame(points, "g string, at long")
    b = spark.createDataFrame(spans, "g string, i int, s long, e long")
    got = {(r.g, r.at, r.i) for r in interval_join(a, b, ["g"], "at", "s", "e", how).collect() if r.i is not None}
    assert got == {(g, p, i) for g, p in points for h, i, s, e in spans if g == h and s <= p <= e}
    if how == "inner":
        assert interval_join(a, b, ["g"], "at", "s", "e", how).count() == len(got)
    else:
        kept = interval_join(a, b, ["g"], "at", "s", "e", how).select("g", "at").distinct().count()
        assert kept == len(points)


def test_a_long_region_has_few_keys(spark):
    from rivulant.plans.joins import _cover

    df = spark.createDataFrame([(1, 1_000_000), (7, 7 + 2**30), (5, 5), (-9, 3)], "s long, e long")
    rows = df.select("s", "e", _cover(F.col("s"), F.col("e"), 48).alias("c")).collect()
    for r in rows:
        slots = sorted((x.slot << x.level, (x.slot + 1) << x.level) for x in r.c)
        assert slots[0][0] == r.s and slots[-1][1] == r.e + 1 and all(a[1] == b[0] for a, b in zip(slots, slots[1:]))
        assert len(r.c) <= 60
    assert len(rows[0].c) <= 40


def test_origins(spark):
    diags = spark.createDataFrame(
        [(1, 1, "a.cpp:5:1: error: x", 5), (1, 2, "a.cpp:99:1: error: x", 99), (1, 3, "undefined reference to `main'", 0), (1, 4, "odd", None)],
        "run int, seq int, raw string, line int",
    )
    spans = spark.createDataFrame([(1, 4, 9, "late"), (1, 2, 6, "early")], "run int, start int, end int, name string")
    got = {r.seq: (r.region, r.origin) for r in locate(diags, spans, ["run"], ["seq"]).collect()}
    assert got == {1: ("early", "ported_code"), 2: (None, "harness"), 3: (None, "link"), 4: (None, "unknown")}


def test_repairs_come_from_the_original(spark, corpus_of):
    ported = "__global__ void kern(const float* in, float* out, Params p) {\n    out[0] = reduce(in[TILE]);\n}\nint helper_of(int a) { return a; }\n"
    log = [
        "k.cpp:1:41: error: unknown type name 'Params'", "k.cpp:2:5: error: use of undeclared identifier 'TILE'",
        "k.cpp:2:9: error: use of undeclared identifier 'reduce'", "k.cpp:3:1: error: use of undeclared identifier 'kern'",
        "k.cpp:4:1: error: use of undeclared identifier 'helper'; did you mean 'helper_of'?", "k.cpp:5:1: fatal error: 'cuda.h' file not found",
        "k.cpp:6:1: error: use of undeclared identifier 'printf'", "k.cpp:7:1: error: use of undeclared identifier 'red_uce'",
        "k.cpp:8:1: error: use of undeclared identifier 'nothing_like_it'",
    ]
    rows = spark.createDataFrame([("a", i, line) for i, line in enumerate(log)], "path string, seq int, raw string")
    diags = parse_diagnostics(rows, ["path"], "seq")
    out = resolve(diags, definitions(corpus_of(a=SOURCE)), definitions(corpus_of(a=ported)), HEADER_MAP, STANDARD_HEADERS)
    got = {r.seq: (r.strategy, r.applicable, r.inserted_text) for r in out.collect()}
    assert got[0][0] == "restore-type" and got[0][2].startswith("struct Params {")
    assert got[1][0] == "restore-macro" and got[2][0] == "restore-helper" and got[2][2].startswith("__device__")
    assert got[3] == (None, None, None)
    assert got[4] == ("apply-compiler-rename", True, "helper_of")
    assert got[5] == ("insert-include", True, "#include <hip/hip_runtime.h>") and got[6] == ("insert-include", True, "#include <cstdio>")
    assert got[7] == ("apply-compiler-rename", False, "") and got[8][0] is None


def test_matches_in_one_pass_equal_those_of_marked_texts(spark):
    """A text that holds the marking sign is cut the longer way; both must give the same."""
    rng = random.Random(5)
    pieces = ["struct a1 {", "\n", "};", "  class Bb {\n", "enum class c {", "x$1", "\\$0", "é", "😀", "struct", " int f(int a) {", "", "\r\n"]
    texts = ["", "\n", "struct a {", *["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(200)]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string")
    for pattern in (shapes.RECORD, shapes.FUNCTION, r"(struct)|x"):
        quick = matches(F.col("t"), pattern)
        slow = matches(F.concat("t", F.lit("\n\x01;")), pattern)
        got = rows.select("i", quick.alias("q"), slow.alias("s")).filter("i >= 0").collect()
        assert len(got) == len(texts) and sum(len(r.q) for r in got) > 50 and all(r.q == r.s for r in got)
        assert rows.filter("i < 0").select(quick.alias("q")).first().q == []


def test_matches_read_a_text_once(spark):
    """One pass of the pattern over a text without the marking sign; before, hits, names and pieces took one each."""
    plan = str(matches(F.col("t"), "(q+)"))
    assert "regexp_replace(t, '(q+)'" in plan


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 128, 1000, 20000])
def test_running_totals_of_any_length(spark, n):
    row = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda x: (x * 7) % 11 - 5).alias("a"))
    row = row.select(F.slice("a", 1, n).alias("a")).select("a", running_total(F.col("a")).alias("t")).first()
    assert row.t == list(accumulate(row.a))
