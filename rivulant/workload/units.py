"""Queries over source units made of the rows of `part`: J8 regions, J9 definitions and repairs."""

from pyspark.sql import functions as F

from rivulant.operators import definitions as defs
from rivulant.operators.diagnostics import parse_diagnostics, resolve
from rivulant.operators.findings import order_findings
from rivulant.plans.scratch import settle
from rivulant.operators.rewrite import rewrite
from rivulant.operators.static import all_source_findings
from rivulant.rules.device import DEVICE_RENAMES, HEADER_MAP, STANDARD_HEADERS
from rivulant.workload import views as v
from rivulant.workload.registry import query

# (name prefix, text around the name and the size) of the snippet of part p, by p % 8
SNIPPETS = (
    ("M", "#define {n} \\\n ({s}) // n\n"),
    ("T", "struct {n} {{\n  int n; // }}\n  float s[{s}];\n}};\n"),
    ("h", "__device__ float {n}(float v) {{\n  if (v > {s}) {{ return __shfl(v, 0); }}\n  return v;\n}}\n"),
    ("k", "__global__ void {n}(float* out) {{\n  const char* b = \"{{\";\n  out[threadIdx.x] = {s};\n}}\n"),
    ("u", "typedef unsigned long long {n};\n"),
    ("a", "using {n} = float;\n"),
    ("c", "__constant__ float {n}[{s}];\n"),
    ("g", "static int {n}(int n) {{\n  /* blockIdx */ /* {{ */\n  return n + blockIdx.x + {s};\n}}\n"),
)
PARTS_PER_UNIT = 48


def _sql_snippet() -> str:
    out = []
    for i, (_, text) in enumerate(SNIPPETS):
        pieces = text.replace("{{", "\x01").replace("}}", "\x02").replace("{n}", "\x03n\x03").replace("{s}", "\x03s\x03").split("\x03")
        terms = []
        for piece in pieces:
            if piece == "n":
                terms.append("name")
            elif piece == "s":
                terms.append("CAST(p_size AS VARCHAR)")
            else:
                lines = piece.replace("\x01", "{").replace("\x02", "}").split("\n")
                terms.append(" || chr(10) || ".join(v.sql_text(x) for x in lines))
        out.append(f"WHEN {i} THEN " + " || ".join(terms))
    return "CASE m " + " ".join(out) + " END"


# A record and a kernel share the name x<k> where both sizes divide by 4.
UNITS_SQL = f"""
named AS (
  SELECT p_partkey AS p, p_partkey // {PARTS_PER_UNIT} AS path, p_partkey % 8 AS m, p_size,
    CASE WHEN p_partkey % 8 IN (1, 3) AND p_size % 4 = 0 THEN 'x'
      ELSE substring('MThkuacg', CAST(p_partkey % 8 AS INTEGER) + 1, 1) END || (p_partkey % 3) AS name FROM part),
snips AS (SELECT *, {_sql_snippet()} AS snippet FROM named),
placed AS (
  SELECT *, {{kept}} AS kept, sum(CASE WHEN {{kept}} THEN length(snippet) ELSE 0 END) OVER w - CASE WHEN {{kept}} THEN length(snippet) ELSE 0 END AS start,
    sum(CASE WHEN {{kept}} THEN length(snippet) - length(replace(snippet, chr(10), '')) ELSE 0 END) OVER w
      - CASE WHEN {{kept}} THEN length(snippet) - length(replace(snippet, chr(10), '')) ELSE 0 END AS lines
  FROM snips WINDOW w AS (PARTITION BY path ORDER BY p)),
defs AS (
  SELECT path, name, CASE m WHEN 0 THEN 'macro' WHEN 2 THEN 'helper' WHEN 3 THEN 'kernel' WHEN 6 THEN 'variable' WHEN 7 THEN 'helper' ELSE 'type' END AS kind,
    rtrim(snippet, chr(10)) AS text, CAST(start AS BIGINT) AS start, CAST(start + length(snippet) - 1 AS BIGINT) AS "end"
  FROM placed WHERE kept
  QUALIFY row_number() OVER (PARTITION BY path, name ORDER BY CASE m WHEN 1 THEN 0 WHEN 0 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 5 ELSE 1 END, p) = 1)"""
OLD_SQL, NEW_SQL = UNITS_SQL.replace("{kept}", "true"), UNITS_SQL.replace("{kept}", "p % 5 <> 0")


def named_parts(spark, sf):
    p = F.col("p_partkey")
    letter = F.substr(F.lit("".join(s[0] for s in SNIPPETS)), (p % 8 + 1).cast("int"), F.lit(1))
    shared = (p % 8).isin(1, 3) & (F.col("p_size") % 4 == 0)
    name = F.concat(F.when(shared, F.lit("x")).otherwise(letter), p % 3)
    rows = v.table(spark, sf, "part").select(
        p.alias("p"), F.floor(p / PARTS_PER_UNIT).cast("bigint").alias("path"), F.col("p_size").cast("string").alias("s"), name.alias("n")
    )
    snippet = None
    for i, (_, text) in enumerate(SNIPPETS):
        shape = text.replace("%", "%%").replace("{n}", "%1$s").replace("{s}", "%2$s").replace("{{", "{").replace("}}", "}")
        made = F.format_string(shape, "n", "s")
        snippet = F.when(F.col("p") % 8 == i, made) if snippet is None else snippet.when(F.col("p") % 8 == i, made)
    return rows.withColumn("snippet", snippet)


def units(parts):
    """One source text per unit: its snippets in order of the part, at most PARTS_PER_UNIT of them."""
    texts = F.array_sort(F.collect_list(F.struct("p", "snippet")))
    return parts.groupBy("path").agg(F.array_join(F.transform(texts, lambda t: t["snippet"]), "").alias("source"))


def ported(parts):
    return units(parts.filter("p % 5 <> 0"))


@query("J9_definitions", f"WITH {OLD_SQL} SELECT * FROM defs")
def definitions(spark, sf):
    return defs.definitions(units(named_parts(spark, sf)))


@query(
    "J8_regions",
    f"""WITH {NEW_SQL} SELECT path, name, m < 7 AS is_device, CAST(start AS BIGINT) AS start, CAST(start + length(snippet) - 1 AS BIGINT) AS "end",
      CAST(lines + 1 AS BIGINT) AS first_line, CAST(lines + length(snippet) - length(replace(snippet, chr(10), '')) AS BIGINT) AS last_line
    FROM placed WHERE kept AND m IN (2, 3, 7)""",
)
def regions(spark, sf):
    return defs.regions(ported(named_parts(spark, sf)))


@query(
    "J8_device_words",
    f"WITH {NEW_SQL} SELECT DISTINCT path, 'blockIdx' AS word, CAST(lines + 3 AS BIGINT) AS line FROM placed WHERE kept AND m = 7",
)
def device_words(spark, sf):
    return defs.device_words_outside(ported(named_parts(spark, sf)), ["path"])


@query(
    "J8_enclosing",
    f"""WITH {NEW_SQL}, points AS (SELECT path, p, CAST(start + p % 23 AS BIGINT) AS "offset" FROM placed WHERE kept)
    SELECT path, q.p, q."offset", (SELECT arg_min(r.name, r.start) FROM placed r WHERE r.kept AND r.m IN (2, 3, 7) AND r.path = q.path
      AND q."offset" >= r.start AND q."offset" < r.start + length(r.snippet) - 1) AS region FROM points q""",
)
def enclosing(spark, sf):
    """Offsets a few signs into each snippet, counted without reading the text."""
    from rivulant.plans.scan import running

    parts = named_parts(spark, sf).filter("p % 5 <> 0")
    at = running(parts.select("path", "p", F.length("snippet").alias("size")), ["path"], ["p"], F.lit(0), sums={"before": F.col("size")}, exclusive=True)
    points = at.select("path", "p", (F.col("before") + F.col("p") % 23).alias("offset"))
    out = defs.enclosing_region(points, defs.regions(ported(named_parts(spark, sf))), ["path"])
    return out.select("path", "p", "offset", F.col("region.name").alias("region"))


_REPAIRS = f"""{OLD_SQL}, {NEW_SQL.replace('defs AS', 'new_defs AS').replace('placed AS', 'new_placed AS').replace('FROM placed', 'FROM new_placed').replace('snips AS', 'new_snips AS').replace('FROM snips', 'FROM new_snips').replace('named AS', 'new_named AS').replace('FROM named', 'FROM new_named')},
d AS (
  SELECT n.path, n.p AS seq, p % 9 AS r, o.name AS own, o.kind, o.text, w.name IS NOT NULL AS there
  FROM named n JOIN defs o ON o.path = n.path AND o.name = n.name LEFT JOIN new_defs w ON w.path = n.path AND w.name = n.name),
out AS (
  SELECT path, seq,
    CASE WHEN r = 4 THEN 'insert-include' WHEN r = 5 THEN NULL WHEN r = 6 THEN CASE WHEN there THEN 'apply-compiler-rename' END
      WHEN r = 7 THEN 'insert-include' WHEN r = 8 THEN 'apply-compiler-rename'
      WHEN there THEN NULL WHEN kind IN ('helper', 'kernel') THEN 'restore-helper' ELSE 'restore-' || kind END AS strategy,
    CASE WHEN r = 4 THEN 'hip-replacement-mistake' WHEN r = 5 THEN NULL WHEN r = 6 THEN CASE WHEN there THEN 'renamed' END
      WHEN r = 7 THEN 'omitted' WHEN r = 8 THEN 'renamed'
      WHEN there THEN NULL WHEN kind IN ('helper', 'kernel') THEN 'removed-during-extraction' ELSE 'omitted' END AS root_cause,
    CASE WHEN r = 4 THEN '#include <hip/hip_runtime.h>' WHEN r = 6 AND there THEN own WHEN r = 7 THEN '#include <cstring>' WHEN r = 8 THEN ''
      WHEN r < 4 AND NOT there THEN text END AS inserted_text,
    CASE WHEN r = 8 THEN false WHEN r IN (4, 7) OR (r = 6 AND there) OR (r < 4 AND NOT there) THEN true END AS applicable FROM d)"""


def build_log(parts):
    """One compiler message per part: dropped names, headers, hints, library functions, misspelt names."""
    r, p = F.col("p") % 9, F.col("p").cast("string")
    undeclared = lambda name: F.concat(F.lit("use of undeclared identifier '"), name, F.lit("'"))
    message = (
        F.when(r == 4, F.lit("'sub/cuda.h' file not found"))
        .when(r == 5, F.concat(F.lit("'odd"), p, F.lit(".cuh' file not found")))
        .when(r == 6, F.concat(undeclared(F.concat(F.lit("zz"), p)), F.lit("; did you mean '"), F.col("n"), F.lit("'?")))
        .when(r == 7, undeclared(F.lit("memcpy")))
        .when(r == 8, undeclared(F.concat(F.substring("n", 1, 1), F.lit("__"), F.substring("n", 2, 1))))
        .otherwise(undeclared(F.col("n")))
    )
    line = F.concat(F.lit("unit.cpp:"), F.col("p") % 4000 + 1, F.lit(":7: error: "), message)
    return parts.select("path", F.col("p").alias("seq"), line.alias("raw"))


@query(
    "J9_repairs",
    f"""WITH {_REPAIRS} SELECT path, seq, strategy, root_cause, inserted_text, applicable,
      CASE WHEN strategy IS NOT NULL THEN 'high' END AS confidence FROM out""",
)
def repairs(spark, sf):
    """Every strategy occurs, and diagnostics without a repair."""
    parts = settle(named_parts(spark, sf).repartition("path"))  # a small file is one task, and its rows cost much
    diags = settle(parse_diagnostics(build_log(parts), ["path"], "seq"))
    old, new = settle(defs.definitions(units(parts))), settle(defs.definitions(ported(parts)).select("path", "kind", "name"))
    out = resolve(diags, old, new, HEADER_MAP, STANDARD_HEADERS)
    return out.select("path", "seq", "strategy", "root_cause", "inserted_text", "applicable", "confidence")


# line of a device source, the same line after the port, and the change log it adds: (label, times)
DEVICE_LINES = (
    ("  cudaMalloc(&p, {s});", "  hipMalloc(&p, {s});", (("cudaMalloc→hipMalloc", 1),)),
    ("  cudaGetDevice(&d); // {s}", "  hipGetDevice(&d); // {s}", (("cudaGetDevice→hipDeviceGet", 1),)),
    ("  checkCudaErrors( cudaFree(p) );", "  (void)( hipFree(p) );", (("cudaFree→hipFree", 1), ("checkCudaErrors→(void)(", 1))),
    ("  __shared__ float4 t[{s}];", "  __shared__ float t[{s}];", (("float4→float (shared)", 1),)),
    ("  float4 q = f(uint2 z, uint2* w);", "  float q = f(unsigned int z, unsigned int* w);", (("vector type float4", 1), ("vector type unsigned int4", 2))),
    ("  v = __shfl_xor_sync(0x1f, v, {s});", "  v = __shfl_xor_sync(0x3f, v, {s});", (("__shfl_xor_sync mask 0x1f→0x3f", 1),)),
    ("  v = __shfl_down_sync(0xffffffff, v, 2); __syncwarp();", "  v = __shfl_down_sync(0xffffffffffffffffULL, v, 2); __syncthreads();",
     (("__shfl mask 0xffffffff→0xffffffffffffffffULL", 1), ("__syncwarp()→__syncthreads()", 1))),
    ("  int n = warpSize + WARP_SIZE + warpSize;", "  int n = 64 + WAVEFRONT_SIZE + 64;", (("warpSize→64", 2), ("WARP_SIZE→WAVEFRONT_SIZE", 1))),
    ("  // my_cudaMalloc stays, so does x.float4 {s}", "  // my_cudaMalloc stays, so does x.float4 {s}", ()),
    ("  cudaEventElapsedTime(&ms, a, b); cudaDeviceProp q;", "  hipEventElapsedTime(&ms, a, b); hipDeviceProp_t q;",
     (("cudaEventElapsedTime→hipEventElapsedTime", 1), ("cudaDeviceProp→hipDeviceProp_t", 1))),
    ("  cudaMemcpy(d, h, {s}, cudaMemcpyHostToDevice);", "  hipMemcpy(d, h, {s}, hipMemcpyHostToDevice);",
     (("cudaMemcpy→hipMemcpy", 1), ("cudaMemcpyHostToDevice→hipMemcpyHostToDevice", 1))),
    ("  cudaError_t e = cudaGetLastError();", "  hipError_t e = hipGetLastError();", (("cudaError_t→hipError_t", 1), ("cudaGetLastError→hipGetLastError", 1))),
)
_SIZED = lambda t: " || CAST(p_size AS VARCHAR) || ".join(v.sql_text(x) for x in t.split("{s}"))
_LINES_SQL = f"""
lines AS (SELECT p_partkey AS p, p_partkey // 30 AS path, CASE p_partkey % {len(DEVICE_LINES)} {' '.join(f"WHEN {i} THEN {_SIZED(row[1])}" for i, row in enumerate(DEVICE_LINES))} END AS line FROM part),
logged(m, label, n) AS (VALUES {', '.join(f"({i}, {v.sql_text(label)}, {n})" for i, row in enumerate(DEVICE_LINES) for label, n in row[2])})"""


def device_sources(spark, sf):
    """Sources of thirty lines under a device header, one more header that the port drops."""
    key, line = F.col("p_partkey"), None
    for i, (text, _, _) in enumerate(DEVICE_LINES):
        made = F.format_string(text.replace("%", "%%").replace("{s}", "%1$s"), F.col("p_size").cast("string"))
        line = F.when(key % len(DEVICE_LINES) == i, made) if line is None else line.when(key % len(DEVICE_LINES) == i, made)
    rows = v.table(spark, sf, "part").select(F.floor(key / 30).cast("bigint").alias("path"), key.alias("p"), line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda r: r["line"]), "\n")
    head = F.lit('#include <cuda_runtime.h>\n#include "extra.cuh"\n#include <vector>\n')
    return rows.groupBy("path").agg(F.concat(head, body).alias("source"))


@query(
    "F13_device_rewrite",
    f"""WITH {_LINES_SQL} SELECT path, '#include <hip/hip_runtime.h>' || chr(10) || '#include <vector>' || chr(10) || '#define WAVEFRONT_SIZE 64' || chr(10)
      || string_agg(line, chr(10) ORDER BY p) AS new_source FROM lines GROUP BY 1""",
)
def device_rewrite(spark, sf):
    return rewrite(device_sources(spark, sf), DEVICE_RENAMES).select("path", "new_source")


@query(
    "F13_device_changes",
    f"""WITH {_LINES_SQL}, n AS (
      SELECT path, label, CAST(sum(n) AS BIGINT) AS n FROM lines JOIN logged ON m = p % {len(DEVICE_LINES)} GROUP BY 1, 2
      UNION ALL SELECT DISTINCT path, unnest(['cuda_runtime.h→hip/hip_runtime.h', 'local .cuh headers removed', '#define WAVEFRONT_SIZE 64 added']), CAST(1 AS BIGINT) FROM lines)
    SELECT path, label, n FROM n""",
)
def device_changes(spark, sf):
    changed = rewrite(device_sources(spark, sf), DEVICE_RENAMES).select("path", F.inline("changes"))
    return changed.groupBy("path", "label").agg(F.sum("n").alias("n"))


@query(
    "F21_all_findings",
    f"""WITH {OLD_SQL}, f AS (SELECT path, name, p, lines + 1 AS line, count(*) OVER (PARTITION BY path, name) AS n,
        row_number() OVER (PARTITION BY path, name ORDER BY p) AS nth FROM placed WHERE m IN (2, 3, 7))
    SELECT path, 'duplicate-definition' AS rule, 'error' AS severity, CAST(line AS BIGINT) AS line, name AS evidence,
      row_number() OVER (PARTITION BY path ORDER BY line) AS position FROM f WHERE n > 1 AND nth = 2""",
)
def all_findings(spark, sf):
    """All static rules in one report, each unit's findings in their order."""
    found = all_source_findings(units(named_parts(spark, sf)))
    placed = order_findings(found).select("path", "rule", "severity", F.col("line").cast("bigint").alias("line"), "evidence", "position")
    return placed
