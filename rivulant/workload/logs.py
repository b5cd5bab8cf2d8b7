"""Build-log queries: F10-F12, A15, A18, J8, J9, W3, U4, K4."""

from pyspark.sql import functions as F

from rivulant.functions.text import normalize_error, normalize_unknown
from rivulant.operators import diagnostics as ops
from rivulant.plans.scratch import settle
from rivulant.workload import views as v
from rivulant.workload.registry import query


@query("F10_parse_diagnostics", f"WITH {v.DIAGS} SELECT run, seq, kind, symbol, owner, line, raw, '' AS suggestion, file, col FROM diags")
def parse_diagnostics(spark, sf):
    return v.diagnostics(spark, sf)


# (message of event e, kind, symbol, suggestion, owner); a null kind is a line that yields nothing
_SHAPES = (
    ("error: 'sub/x{e}.cuh' file not found", "missing-include", "sub/x{e}.cuh", "", ""),
    ("error: no member named 'm{e}' in 'Box<int>'", "no-member", "m{e}", "", "Box<int>"),
    ("error: use of undeclared identifier 'id{e}'; did you mean 'other_{e}'?", "undeclared", "id{e}", "other_{e}", ""),
    ("error: unknown type name 'T{e}'; did you mean 'Tee'?", "unknown-type", "T{e}", "Tee", ""),
    ("error: no template named 'tmpl{e}'", "unknown-type", "tmpl{e}", "", ""),
    ("error: implicit instantiation of undefined template 'std::in::tup{e}'", "undefined-template", "tup{e}", "", ""),
    ("error: 'z{e}' was not declared in this scope", "unknown-type", "z{e}", "", ""),
    ("fatal error: no matching function for call to 'f{e}'", "no-matching-function", "f{e}", "", ""),
    ("error: too few arguments to function 'g{e}'", "arg-count", "g{e}", "", ""),
    ("error: something odd {e}", "unknown", "", "", ""),
    ("warning: unused variable 'w{e}'", None, "", "", ""),
    ("note: expanded from macro 'n{e}'", None, "", "", ""),
)


def _of_shape(i: int) -> str:
    """SQL: field `i` of the shape of an event, its number put in."""
    said = lambda t: "NULL" if t is None else " || event_id || ".join(v.sql_text(x) for x in t.split("{e}"))
    return f"CASE event_id % {len(_SHAPES)} " + " ".join(f"WHEN {k} THEN {said(row[i])}" for k, row in enumerate(_SHAPES)) + " END"


@query(
    "F10_all_shapes",
    f"""WITH x AS (SELECT user_id AS run, event_id AS seq, {_of_shape(1)} AS kind, {_of_shape(2)} AS symbol, {_of_shape(3)} AS suggestion, {_of_shape(4)} AS owner,
      CAST(event_id % 90 + 1 AS INTEGER) AS line, event_id % {len(_SHAPES)} = 9 AS odd FROM events)
    SELECT run, min(seq) AS seq, kind, symbol, arg_min(suggestion, seq) AS suggestion, owner, line FROM x WHERE kind IS NOT NULL GROUP BY run, kind, symbol, owner, line""",
)
def all_shapes(spark, sf):
    """Every shape of message, notes and warnings among them; every fifth line has a path of several folders."""
    e = F.col("event_id")
    message = None
    for k, row in enumerate(_SHAPES):
        pieces = row[0].split("{e}")
        terms = [F.lit(pieces[0])]
        for piece in pieces[1:]:
            terms += [e.cast("string"), F.lit(piece)]
        hit = e % len(_SHAPES) == k
        message = F.when(hit, F.concat(*terms)) if message is None else message.when(hit, F.concat(*terms))
    place = F.concat(F.when(e % 5 == 0, F.lit("src/a/u.cpp:")).otherwise(F.lit("u.cpp:")), e % 90 + 1, F.lit(":7: "))
    log = v.table(spark, sf, "events").select(F.col("user_id").alias("run"), "event_id", F.concat(place, message).alias("raw"))
    out = ops.parse_diagnostics(log, ["run"], "event_id")
    return out.select("run", "seq", "kind", "symbol", "suggestion", "owner", "line")


@query(
    "F11_normalize_error",
    f"""WITH {v.ERR_LOG}, n AS (
      SELECT regexp_replace(raw, '^[A-Za-z0-9_./-]+:[0-9]+:[0-9]+:\\s*', '') AS error,
        regexp_replace(raw, '^.*: error: ', '') AS message FROM err_log)
    SELECT error, message, count(*) AS n FROM n GROUP BY 1, 2""",
)
def normalize_errors(spark, sf):
    log = v.err_log(spark, sf).withColumn("raw", F.concat(F.lit("/tmp/build_x/a/"), F.col("raw"), F.lit("  ")))
    return log.groupBy(
        normalize_error(F.col("raw")).alias("error"), normalize_unknown(F.col("raw")).alias("message")
    ).agg(F.count(F.lit(1)).alias("n"))


def _tool_log(spark, sf):
    tail = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" ["), F.col("event_id") % 90, F.lit("]"))).otherwise(F.lit(""))
    return v.err_log(spark, sf).select(F.col("run").alias("path"), "event_id", F.concat("raw", tail).alias("raw"))


@query(
    "F12_scan_tool_log",
    """WITH t AS (SELECT user_id AS path, CAST(count(*) AS BIGINT) AS total_lines,
        count(*) FILTER (WHERE event_type = 'error') AS unconverted_lines FROM events GROUP BY 1)
    SELECT path, total_lines, unconverted_lines,
      round_even(greatest(0.0, (total_lines - unconverted_lines) / CAST(total_lines AS DOUBLE) * 100), 1) AS coverage_pct FROM t""",
)
def scan_tool_log(spark, sf):
    totals = v.table(spark, sf, "events").groupBy(F.col("user_id").alias("path")).agg(F.count(F.lit(1)).alias("total_lines"))
    return ops.scan_tool_log(_tool_log(spark, sf), totals)


@query(
    "F12_tool_warnings",
    f"""WITH {v.ERR_LOG} SELECT run AS path, event_id, regexp_replace(raw, '^.*: error: ', '') AS message,
      CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 90 AS INTEGER) END AS line FROM err_log""",
)
def tool_warnings(spark, sf):
    return ops.tool_warnings(_tool_log(spark, sf))


_IDENTITY = """
ids AS (SELECT DISTINCT {keys}, kind,
    CASE WHEN kind = 'unknown' THEN regexp_replace(raw, '^.*: error: ', '') ELSE symbol END AS symbol FROM {source}),
sig AS (SELECT {keys}, 'compile:' || substring(sha256(string_agg(kind || ':' || symbol || ':', '|' ORDER BY kind, symbol)), 1, 12)
    AS failure_signature FROM ids GROUP BY ALL)"""


@query(
    "A15_failure_signature",
    f"""WITH {v.ITERATIONS}, every AS (
      SELECT run, iteration, event_id, raw, CASE event_id % 4 WHEN 0 THEN 'undeclared' WHEN 1 THEN 'unknown-type'
          WHEN 2 THEN 'missing-include' ELSE 'unknown' END AS kind,
        CASE WHEN event_id % 4 < 3 THEN regexp_extract(raw, '''([a-z0-9.]+)''', 1) ELSE '' END AS symbol
      FROM iter_err WHERE raw IS NOT NULL),
    typed AS (SELECT run, iteration, kind, symbol, arg_min(raw, event_id) AS raw FROM every GROUP BY run, iteration, kind, symbol, event_id % 90),{_IDENTITY.format(keys='run, iteration', source='typed')}
    SELECT * FROM sig""",
)
def failure_signature(spark, sf):
    rows = v.iteration_errors(spark, sf).filter("raw IS NOT NULL")
    keys = ["run", "iteration"]
    return ops.failure_signature(ops.parse_diagnostics(rows, keys, "event_id"), keys)


@query(
    "A15_attempt_signature",
    f"""WITH {v.ITERATIONS}, every AS (
      SELECT run, iteration, event_id, CASE WHEN run % 4 = 0 THEN 'u.o:' || (event_id % 9) || ':' || (event_id % 5) || ': undefined symbol ' || (event_id % 3) ELSE raw END AS raw,
        run % 4 = 0 AS linked, CASE event_id % 4 WHEN 0 THEN 'undeclared' WHEN 1 THEN 'unknown-type' WHEN 2 THEN 'missing-include' ELSE 'unknown' END AS kind,
        CASE WHEN event_id % 4 < 3 THEN regexp_extract(raw, '''([a-z0-9.]+)''', 1) ELSE '' END AS symbol
      FROM iter_err WHERE raw IS NOT NULL),
    typed AS (SELECT run, iteration, kind, symbol, arg_min(raw, event_id) AS raw FROM every WHERE NOT linked GROUP BY run, iteration, kind, symbol, event_id % 90),{_IDENTITY.format(keys='run, iteration', source='typed')},
    bare AS (SELECT run, iteration, 'compile:' || substring(sha256(string_agg(regexp_replace(raw, '^[^:]+:[0-9]+:[0-9]+: ', ''), '|'
      ORDER BY regexp_replace(raw, '^[^:]+:[0-9]+:[0-9]+: ', ''))), 1, 12) AS failure_signature FROM every WHERE linked GROUP BY 1, 2)
    SELECT n.run, n.iteration, coalesce(s.failure_signature, b.failure_signature, '') AS failure_signature FROM numbered n
      LEFT JOIN sig s ON s.run = n.run AND s.iteration = n.iteration LEFT JOIN bare b ON b.run = n.run AND b.iteration = n.iteration""",
)
def attempt_signature(spark, sf):
    """Runs whose number divides by 4 fail at the linker, whose messages no typed shape fits."""
    e = F.col("event_id")
    linker = F.concat(F.lit("u.o:"), e % 9, F.lit(":"), e % 5, F.lit(": undefined symbol "), e % 3)
    rows = v.iteration_errors(spark, sf)
    rows = rows.withColumn("raw", F.when((F.col("run") % 4 == 0) & F.col("raw").isNotNull(), linker).otherwise(F.col("raw")))
    return ops.attempt_signature(settle(rows), ["run", "iteration"], "event_id")


@query(
    "A15_structural_signature",
    f"""WITH {v.ERR_LOG}, r AS (SELECT run, regexp_replace(raw, '^[A-Za-z0-9_./-]+:[0-9]+:[0-9]+:\\s*', '') AS error FROM err_log)
    SELECT run, 'structural:' || substring(sha256(string_agg(error, '|' ORDER BY error)), 1, 12) AS failure_signature FROM r GROUP BY 1""",
)
def structural_signature(spark, sf):
    rows = v.err_log(spark, sf).select("run", normalize_error(F.col("raw")).alias("error"))
    return ops.structural_signature(rows, ["run"])


_REGIONS = """
regions AS (
  SELECT user_id AS run, event_id % 60 + 1 AS start, event_id % 60 + 1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 AS "end",
    'r' || event_id AS name FROM events WHERE event_type = 'signup'),
pairs AS (
  SELECT d.run, d.seq, arg_min(r.name, (r.start, r."end", r.name)) AS region
  FROM diags d JOIN regions r ON r.run = d.run AND d.line BETWEEN r.start AND r."end" GROUP BY 1, 2),
located AS (
  SELECT d.run, d.seq, d.raw, d.line, p.region, CASE WHEN p.region IS NULL THEN 'harness' ELSE 'ported_code' END AS origin
  FROM diags d LEFT JOIN pairs p ON p.run = d.run AND p.seq = d.seq)"""


def _event_regions(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    start = F.col("event_id") % 60 + 1
    return v.table(spark, sf, "events").filter("event_type = 'signup'").select(
        F.col("user_id").alias("run"), start.alias("start"), (start + k % 6).alias("end"),
        F.concat(F.lit("r"), F.col("event_id")).alias("name"),
    )


def _located(spark, sf):
    points = v.diagnostics(spark, sf).select("run", "seq", "raw", "line")
    return ops.locate(points, _event_regions(spark, sf), ["run"], ["seq"])


@query("J8_locate", f"WITH {v.DIAGS}, {_REGIONS} SELECT run, seq, raw, line, region, origin FROM located")
def locate(spark, sf):
    return _located(spark, sf)


@query(
    "A18_origin_flags",
    f"""WITH {v.DIAGS}, {_REGIONS} SELECT run, bool_and(origin = 'harness') AS all_harness, false AS linker_only FROM located GROUP BY 1""",
)
def origin_flags(spark, sf):
    return ops.origin_flags(_located(spark, sf), ["run"])


# Runs whose number divides by 3 end at the linker: every error of theirs has no line.
_LINKED = f"""{v.DIAGS}, {_REGIONS},
mixed AS (
  SELECT run, seq, CASE WHEN run % 3 = 0 THEN CASE seq % 2 WHEN 0 THEN 'undefined reference to main' ELSE 'ld.lld: error: undefined symbol: f' || seq END ELSE raw END AS raw,
    CASE WHEN run % 3 = 0 THEN CASE seq % 2 WHEN 0 THEN 'link' ELSE 'unknown' END ELSE origin END AS origin,
    CASE WHEN run % 3 <> 0 THEN region END AS region FROM located)"""


def _linked(spark, sf):
    linker = F.when(F.col("seq") % 2 == 0, F.lit("undefined reference to main")).otherwise(
        F.concat(F.lit("ld.lld: error: undefined symbol: f"), "seq")
    )
    ended = F.col("run") % 3 == 0
    points = v.diagnostics(spark, sf).select(
        "run", "seq", F.when(ended, linker).otherwise(F.col("raw")).alias("raw"), F.when(ended, F.lit(0)).otherwise(F.col("line")).alias("line")
    )
    return ops.locate(points, _event_regions(spark, sf), ["run"], ["seq"])


@query("J8_origins", f"WITH {_LINKED} SELECT run, seq, raw, region, origin FROM mixed")
def origins(spark, sf):
    return _linked(spark, sf).select("run", "seq", "raw", "region", "origin")


@query(
    "A18_linker_runs",
    f"""WITH {_LINKED} SELECT run, count(*) FILTER (WHERE origin <> 'unknown') > 0 AND count(*) FILTER (WHERE origin IN ('link', 'ported_code')) = 0 AS all_harness,
      run % 3 = 0 AS linker_only FROM mixed GROUP BY 1""",
)
def linker_runs(spark, sf):
    return ops.origin_flags(_linked(spark, sf), ["run"])


_DEFS = """
defs AS (SELECT DISTINCT user_id AS run, event_type,
    CASE event_id % 3 WHEN 0 THEN 's' WHEN 1 THEN 't' ELSE 'u' END || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 7) AS name,
    CASE event_id % 4 WHEN 0 THEN 'macro' WHEN 1 THEN 'type' WHEN 2 THEN 'kernel' ELSE 'variable' END AS kind FROM events),
old AS (SELECT run, name AS symbol, arg_min(kind, CASE kind WHEN 'macro' THEN 1 WHEN 'type' THEN 2 WHEN 'kernel' THEN 3 ELSE 6 END) AS kind
  FROM defs WHERE event_type = 'click' GROUP BY 1, 2),
new AS (SELECT DISTINCT run, name AS symbol FROM defs WHERE event_type = 'purchase'),
res AS (
  SELECT d.run, d.seq, d.kind, d.symbol, d.owner, d.line,
    CASE WHEN d.kind = 'missing-include' THEN CASE d.symbol WHEN 'h0.h' THEN 'insert-include' END
      WHEN d.symbol = '' OR n.symbol IS NOT NULL THEN NULL
      WHEN o.kind = 'macro' THEN 'restore-macro' WHEN o.kind = 'type' THEN 'restore-type'
      WHEN o.kind = 'kernel' THEN 'restore-helper' WHEN o.kind = 'variable' THEN 'restore-variable'
      WHEN d.symbol = 't3' THEN 'insert-include' END AS strategy,
    CASE WHEN d.kind = 'missing-include' THEN CASE d.symbol WHEN 'h0.h' THEN 'hip-replacement-mistake' END
      WHEN d.symbol = '' OR n.symbol IS NOT NULL THEN NULL
      WHEN o.kind = 'kernel' THEN 'removed-during-extraction' WHEN o.kind IS NOT NULL THEN 'omitted'
      WHEN d.symbol = 't3' THEN 'omitted' END AS root_cause,
    CASE WHEN d.kind = 'missing-include' THEN CASE d.symbol WHEN 'h0.h' THEN '<h/zero.h>' END
      WHEN d.symbol = '' OR n.symbol IS NOT NULL THEN NULL WHEN o.kind IS NOT NULL THEN d.symbol
      WHEN d.symbol = 't3' THEN '<tee>' END AS target
  FROM diags d LEFT JOIN old o ON o.run = d.run AND o.symbol = d.symbol LEFT JOIN new n ON n.run = d.run AND n.symbol = d.symbol)"""


def _resolved(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = F.col("event_id")
    letter = F.when(e % 3 == 0, F.lit("s")).when(e % 3 == 1, F.lit("t")).otherwise(F.lit("u"))
    kind = F.when(e % 4 == 0, F.lit("macro")).when(e % 4 == 1, F.lit("type")).when(e % 4 == 2, F.lit("kernel")).otherwise(F.lit("variable"))
    defs = v.table(spark, sf, "events").select(
        F.col("user_id").alias("run"), "event_type", kind.alias("kind"), F.concat(letter, k % 7).alias("name")
    )
    return ops.resolve(
        settle(v.diagnostics(spark, sf)),
        defs.filter("event_type = 'click'"),
        defs.filter("event_type = 'purchase'"),
        {"h0.h": "<h/zero.h>"},
        {"t3": "<tee>"},
        key="run",
    )


@query(
    "J9_resolve",
    f"""WITH {v.DIAGS}, {_DEFS} SELECT run, seq, strategy, root_cause, target,
      CASE WHEN strategy IS NOT NULL THEN 'high' END AS confidence, CASE WHEN strategy IS NOT NULL THEN CAST(0.9 AS DOUBLE) END AS score FROM res""",
)
def resolve(spark, sf):
    return _resolved(spark, sf).select("run", "seq", "strategy", "root_cause", "target", "confidence", "score")


@query(
    "J9_rank_resolutions",
    f"""WITH {v.DIAGS}, {_DEFS} SELECT run, seq, row_number() OVER (PARTITION BY run ORDER BY line, symbol, strategy, kind, owner) AS place
      FROM res WHERE strategy IS NOT NULL""",
)
def rank_resolutions(spark, sf):
    return ops.rank_resolutions(_resolved(spark, sf), "run").select("run", "seq", "place")


_TREND = f"""{v.ITERATIONS},
kept AS (SELECT run, iteration, n_errors, CASE WHEN iteration > 0 THEN error_set END AS s FROM iters WHERE iteration = 0 OR n_errors > 0),
lagged AS (
  SELECT *, lag(n_errors, 1, 0) OVER w - n_errors AS delta,
    coalesce(s = lag(s, 1) OVER w, false) AS again,
    coalesce(s = lag(s, 1) OVER w, false) OR coalesce(s = lag(s, 2) OVER w, false)
      OR coalesce(s = lag(s, 3) OVER w, false) OR coalesce(s = lag(s, 4) OVER w, false) AS cycle
  FROM kept WINDOW w AS (PARTITION BY run ORDER BY iteration)),
segs AS (
  SELECT *, sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) OVER w AS seg, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER w AS rep
  FROM lagged WHERE iteration > 0 WINDOW w AS (PARTITION BY run ORDER BY iteration)),
trend AS (
  SELECT run, iteration, n_errors, s AS error_set, delta, cycle,
    CAST(sum((CASE WHEN delta <= 0 THEN 1 ELSE 0 END) + (CASE WHEN cycle THEN 2 ELSE 0 END))
      OVER (PARTITION BY run, seg ORDER BY iteration) AS BIGINT) AS stagnation,
    CAST(sum(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY run, rep ORDER BY iteration) AS BIGINT) AS plateau FROM segs)"""


@query(
    "W3_iteration_trend",
    f"""WITH {_TREND} SELECT *, CASE WHEN stagnation >= 4 THEN 'stagnant' WHEN plateau >= 2 THEN 'plateau'
      WHEN delta > 0 THEN 'improving' ELSE 'slow' END AS state FROM trend""",
)
def iteration_trend(spark, sf):
    return ops.iteration_trend(v.iterations(spark, sf), rows_per_chunk=8)


@query(
    "U4_new_resolved",
    f"""WITH {v.ITERATIONS}, e AS (SELECT DISTINCT run, iteration, err AS error FROM iter_err WHERE raw IS NOT NULL),
    p AS (SELECT run, iteration, row_number() OVER (PARTITION BY run ORDER BY iteration) AS pos FROM (SELECT DISTINCT run, iteration FROM e)),
    x AS (SELECT e.run, e.error, p.pos FROM e JOIN p ON p.run = e.run AND p.iteration = e.iteration)
    SELECT p.run, p.iteration, c.error, c.status FROM (
      SELECT run, pos, error, 'new' AS status FROM (SELECT run, pos, error FROM x EXCEPT SELECT run, pos + 1, error FROM x)
      UNION ALL SELECT run, pos, error, 'resolved' FROM (SELECT run, pos + 1 AS pos, error FROM x EXCEPT SELECT run, pos, error FROM x)) c
    JOIN p ON p.run = c.run AND p.pos = c.pos""",
)
def new_resolved(spark, sf):
    return ops.new_resolved(v.iteration_errors(spark, sf).filter("raw IS NOT NULL"), rows_per_chunk=8)


@query(
    "K4_first_n",
    f"""WITH {v.ERR_LOG} SELECT run, event_id, raw, CAST(rn AS INTEGER) AS rn FROM (
      SELECT *, row_number() OVER (PARTITION BY run ORDER BY event_id) AS rn FROM err_log) WHERE rn <= 8""",
)
def first_n(spark, sf):
    return ops.first_n(v.err_log(spark, sf).drop("day"), ["run"], ["event_id"], 8)
