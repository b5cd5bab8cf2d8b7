"""Masking, gates, extraction, rewriting and static checks on device source."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulant.operators import extraction, masking, quality, rewrite, static, symbols
from rivulant.operators.findings import order_findings
from rivulant.rules import rubrics
from rivulant.rules.device import DEVICE_RENAMES

SOURCE = '''#include <cuda_runtime.h>
#include "util.cuh"
// a comment with { and "quote
#define TILE 32  // width
__device__ inline float helper(float a) { return a; }
__global__ void scan(const float* in, float *out, int n = 4)
{
  /* multi
     } line */
  const char* s = "}{ \\" // no comment";
  char c = '{';
  float v = helper(in[0]);
  return;
  out[0] = v;
}
int main() { scan<<<1, 1>>>(0, 0, 1); cudaFree(0); }
'''


def test_mask_keeps_shape(corpus_of):
    row = masking.mask(corpus_of(a=SOURCE)).first()
    assert len(row.masked) == len(row.source)
    assert [i for i, c in enumerate(row.masked) if c == "\n"] == [i for i, c in enumerate(row.source) if c == "\n"]
    assert "comment" not in row.masked and "multi" not in row.masked
    assert row.masked.count("{") == row.masked.count("}") == 3
    kept = masking.mask(corpus_of(a=SOURCE), keep_literals=True).first().masked
    assert '"util.cuh"' in kept and "// width" not in kept and '// no comment"' in kept


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab\"'/*\\\n{}", max_size=20), min_size=1, max_size=10))
def test_mask_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "path int, source string")
    for r in masking.mask(df).collect():
        assert len(r.masked) == len(r.source)
        assert [c == "\n" for c in r.masked] == [c == "\n" for c in r.source]


def test_mask_long_literal(corpus_of):
    text = 'x = "' + "a\\n" * 60000 + '";  /* ' + "b" * 100000
    assert len(masking.mask(corpus_of(a=text)).first().masked) == len(text)


def test_symbols_and_signatures(corpus_of):
    rows = {(r.kind, r.name, r.body) for r in symbols.extract_symbols(corpus_of(a=SOURCE)).collect()}
    assert rows == {
        ("helper", "helper", None), ("function", "main", None), ("macro", "TILE", "32"),
        ("include", "<cuda_runtime.h>", None), ("include", '"util.cuh"', None),
    } | {r for r in rows if r[0] == "kernel"}
    one_line = SOURCE.replace(")\n{", ") {")
    assert ("kernel", "scan", None) in {(r.kind, r.name, r.body) for r in symbols.extract_symbols(corpus_of(a=one_line)).collect()}
    params = symbols.signature_params(corpus_of(a=SOURCE))
    assert [(r.position, r.name, r.type, r.direction) for r in params.orderBy("position").collect()] == [
        (1, "in", "const float*", "in"), (2, "out", "float*", "out"), (3, "n", "int", "scalar"),
    ]
    assert symbols.output_elements(params, ["path"]).first().element_type == "float"


@pytest.mark.parametrize(
    "text, reason",
    [
        (SOURCE, None),
        ("", "empty extraction"),
        ("int a;\n```cpp\nint b;\n```", "markdown code fence"),
        ("## Heading\nint a;", "markdown heading"),
        ("Assistant: here\nint a;", "role tag"),
        ("int a;\nand then...", "trailing ellipsis"),
        ("int a;\n**Bold words**\n", "markdown bold"),
        ("int a;\nLet's port this kernel now\nint b;", "reasoning"),
        ("int a;\nSummary: Done\nint b;", "section-heading"),
        ("int a;\n- first point\nint b;", "list"),
        ("plain words\nmore words", "no code lines"),
        ("int a;\nThis is prose about it.\nint b;", "prose ratio"),
        ("int a;\n// Let's say so in a comment\nint b;\nint c;\nint d;\nint e;\nint f;", None),
    ],
)
def test_lexical_gate(corpus_of, text, reason):
    row = quality.lexical_gate(corpus_of(a=text)).first()
    assert row.reason == reason and row.ok == (reason is None)


def test_depth_and_regions(corpus_of):
    docs = corpus_of(a="a {\n} }\n{ {\n}", b="}{")
    out = {r.path: (r.final_depth, r.min_depth, r.first_unbalanced_line) for r in quality.depth_summary(quality.bracket_depth(docs), ["path"]).collect()}
    assert out == {"a": (0, -1, 2), "b": (0, -1, 1)}
    got = [(r.start, r.end) for r in quality.region_lines(corpus_of(a=SOURCE)).orderBy("start").collect()]
    assert got[0] == (5, 5) and got[1][0] == 6
    kr = "__global__ void k()\n{\n  if (a) {\n  }\n}\nint x;\n__device__ int y;\n"
    assert [(r.start, r.end) for r in quality.region_lines(corpus_of(a=kr)).collect()] == [(1, 5), (7, 7)]


def test_structural_gate(spark):
    src = "int f(int a) { return a; }\n" * 1 + "int g(int a) { return a; }\n" + "int x;\n" * 6
    rows = [
        ("ok", src, src, "FULL"),
        ("brace", src, src + "{", "FULL"),
        ("cut", src, "int f(int a) { return a; }", "FULL"),
        ("twice", src, src + "int f(int a) { return a; }\n", "FULL"),
        ("mark", src, src + "// ... rest of code\n", "FULL"),
        ("empty", src, "  ", "FULL"),
        ("drop", src, src.replace("int g(int a) { return a; }\n", "int y;\n"), "FULL"),
        ("subset", "__global__ void k() {\n}\n" + "int x;\n" * 50, "__global__ void k() {\n}\n", "DEVICE_SUBSET"),
    ]
    df = spark.createDataFrame(rows, "path string, source string, ported string, port_mode string")
    got = {r.path: r for r in quality.structural_gate(df).collect()}
    assert {p for p, r in got.items() if r.ok} == {"ok", "drop", "subset"}
    assert got["brace"].errors == ["braces"] and got["twice"].errors == ["duplicate definitions"]
    assert got["mark"].errors == ["truncation marker"] and got["empty"].errors == ["empty"]
    assert "size" in got["cut"].errors and got["drop"].missing_symbols == ["g"] and got["drop"].score == 0.9


def test_code_extraction(spark):
    kernel = "#include <hip/hip_runtime.h>\n__global__ void k() {\n  int a;\n}"
    rows = [
        ("json", '{"note": 1, "ported_code": "int a;\\nint b;"}'),
        ("number", '{"code": 5}'),
        ("block", 'Text\n```json\n{"code": "int c;"}\n```\n'),
        ("cut", 'Here: {"code": "int d;\\n int e'),
        ("fence", "Look\n```text\nThis is only a long line of plain prose.\n```\n```cpp\n" + kernel + "\n```\nBye."),
        ("window", "Some words first\n" + kernel + "\n\nThat was it\nand more\nand more\nint z;\n"),
        ("none", "No source in here at all."),
    ]
    out = extraction.extraction_report(extraction.extract_code(spark.createDataFrame(rows, "id string, response string")))
    got = {r.id: r for r in out.collect()}
    assert {k: r.strategy for k, r in got.items()} == {
        "json": "json-field", "number": "rejected", "block": "json-field", "cut": "json-field",
        "fence": "markdown-fence", "window": "raw-window", "none": "rejected",
    }
    assert got["json"].code == "int a;\nint b;" and got["block"].code == "int c;" and got["cut"].code == "int d;\n int e"
    assert got["fence"].code == kernel + "\n" and got["window"].code == kernel + "\n"
    assert got["none"].extraction_failed and got["none"].confidence == 0.0 and got["none"].discarded == rows[-1][1]
    assert got["window"].discarded.startswith("Some words first") and "omitted" in got["window"].discarded


def test_device_rewrite(corpus_of):
    text = (
        '#include <cuda_runtime.h>\n#include "helper_cuda.h"\n#include "own.cuh"\nuint4 v;\n'
        "cudaMalloc(&p, 4); cudaMalloc(&q, 4); cudaMallocHost(&h, 4);\nint w = warpSize;\n"
        "x = __shfl_xor_sync(0xffffffff, x, 1); __syncwarp();\n#define warpSize 64\n"
    )
    row = rewrite.rewrite(corpus_of(a=text), DEVICE_RENAMES).first()
    assert row.new_source == (
        "#include <hip/hip_runtime.h>\n#define WAVEFRONT_SIZE 64\nunsigned int v;\n"
        "hipMalloc(&p, 4); hipMalloc(&q, 4); hipHostMalloc(&h, 4);\nint w = 64;\n"
        "x = __shfl_xor_sync(0xffffffffffffffffULL, x, 1); __syncthreads();\n#define warpSize 64\n"
    )
    log = {c.label: c.n for c in row.changes}
    assert log["cudaMalloc→hipMalloc"] == 2 and log["local .cuh headers removed"] == 1
    again = rewrite.rewrite(corpus_of(a=row.new_source), DEVICE_RENAMES).first()
    assert again.new_source == row.new_source and again.changes == []


def test_filter_on_rewrite_stays_small(corpus_of):
    out = rewrite.rewrite(corpus_of(a="cudaFree(0);", b="#define WAVEFRONT_SIZE 64\nint x;"), DEVICE_RENAMES).filter(F.size("changes") > 0)
    assert [r.path for r in out.collect()] == ["a"]


def test_static_findings(corpus_of):
    text = SOURCE + "__global__ int bad(int a) { return 0; }\n__shared__ int odd\n" + "int main() { return 0; }\n"
    found = order_findings(static.all_source_findings(corpus_of(a=text)))
    rows = [(r.line, r.rule) for r in found.orderBy("position").collect()]
    assert (1, "cuda-header") in rows and (2, "cuda-header") in rows
    assert (16, "residual-cuda-symbol") in rows and (14, "unreachable-code") in rows
    assert (17, "global-non-void") in rows and (18, "malformed-declaration") in rows and (19, "duplicate-definition") in rows
    assert rows == sorted(rows, key=lambda r: r[0])


def test_rubrics(spark):
    good = "#include <hip/hip_runtime.h>\n#define WAVEFRONT_SIZE 64\n__global__ void k() { int i = threadIdx.x; hipMalloc; hipFree; }" + " " * 9
    df = spark.createDataFrame(
        [(good, good, ["__shfl mask 0x1f", "tile"], True, True, True, True)],
        "source string, code string, changes array<string>, cached boolean, coder_ok boolean, evaluator_ok boolean, verifier_ok boolean",
    ).withColumn("passed", F.lit(True))
    assert rewrite.rubric_score(df, rubrics.run_rubric()).first().score == 12 + 18 + 5 + 10 + 15 + 10 + 30
    port = rewrite.rubric_score(df, rubrics.port_rubric(), group_caps=rubrics.PORT_CAPS).first().score
    assert port == 20 + (15 + 5 * 3) + (5 + 5 + 0 + 10 + 5) + 5 + 5
    assert rewrite.rubric_score(df, rubrics.EXTRACTED_RUBRIC).first().score == 10 + 15 + 25 + 10 + 5 + 15 + 10
    resp = df.withColumnRenamed("code", "response")
    assert rewrite.rubric_score(resp, rubrics.response_rubric(), cap=1.0).first().score == pytest.approx(0.3 + 0.1 + 0.15 + 0.15 + 0.15)
