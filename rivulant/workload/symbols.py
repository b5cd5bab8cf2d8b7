"""Symbol queries: F9, F18, J3-J7, J15, U1-U3."""

from pyspark.sql import functions as F

from rivulant.operators import similarity, symbols
from rivulant.operators.quality import bracket_depth
from rivulant.workload import views as v
from rivulant.workload.registry import query

_HREF, _TAG, _ATTR = 'href="([^"]*)"', "<([a-z0-9]+)", " ([a-z-]+)="


def page_symbols(spark, sf):
    """Link targets, tag names and attribute names of pages, most specific first."""
    rules = (("href", _HREF), ("tag", _TAG), ("attribute", _ATTR))
    return symbols.extract_symbols(
        v.pages(spark, sf), rules, not_names=("br",), macro=None, include=None,
        mask=lambda text, keep_literals=False: text,
    ).drop("body")


_SYMBOLS = f"""
href AS (SELECT DISTINCT page_id AS path, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS name FROM pages),
tag AS (SELECT DISTINCT page_id AS path, unnest(regexp_extract_all(html, '{_TAG}', 1)) AS name FROM pages),
att AS (SELECT DISTINCT page_id AS path, unnest(regexp_extract_all(html, '{_ATTR}', 1)) AS name FROM pages),
syms AS (
  SELECT path, kind, name FROM (
    SELECT path, name, kind, row_number() OVER (PARTITION BY path, name ORDER BY r) AS k FROM (
      SELECT path, name, 'href' AS kind, 1 AS r FROM href UNION ALL SELECT path, name, 'tag', 2 FROM tag UNION ALL SELECT path, name, 'attribute', 3 FROM att))
  WHERE k = 1 AND name <> 'br')"""


@query("F9_extract_symbols", f"WITH {_SYMBOLS} SELECT * FROM syms")
def extract_symbols(spark, sf):
    return page_symbols(spark, sf)


_SIGS = """
params(position, name, type, direction) AS (VALUES (1, 'in', 'const float*', 'in'), (2, 'out', 'float*', 'out'), (3, 'n', 'int', 'scalar'))"""


def _signatures(spark, sf):
    sig = F.concat(
        F.lit("// kernel of "), "p_name", F.lit("\n__global__ void k"), F.col("p_partkey"),
        F.lit("(const float* in, float *out, int n = "), F.col("p_size"), F.lit(") {\n}\n"),
    )
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("path"), sig.alias("source"))


@query(
    "F18_signature_params",
    f"""WITH {_SIGS} SELECT p_partkey AS path, CAST(0 AS INTEGER) AS function_no, 'k' || p_partkey AS function,
      CAST(position AS INTEGER) AS position, name, type, direction FROM part CROSS JOIN params""",
)
def signature_params(spark, sf):
    return symbols.signature_params(_signatures(spark, sf))


@query("F18_output_elements", "SELECT p_partkey AS path, 'k' || p_partkey AS function, 'float' AS element_type FROM part")
def output_elements(spark, sf):
    return symbols.output_elements(symbols.signature_params(_signatures(spark, sf)), ["path", "function"])


_INV = """
inv AS (SELECT l_suppkey AS path, 'part' AS kind, l_partkey AS name, CAST(max(l_discount) AS VARCHAR) AS body, l_shipdate < TIMESTAMP '1998-01-01' AS old
  FROM lineitem GROUP BY 1, 2, 3, 5),
a AS (SELECT * FROM inv WHERE old), b AS (SELECT * FROM inv WHERE NOT old),
diff AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.kind, b.kind) AS kind, coalesce(a.name, b.name) AS name,
    CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'added' WHEN a.body <> b.body THEN 'changed' ELSE 'preserved' END AS status
  FROM a FULL JOIN b ON a.path = b.path AND a.kind = b.kind AND a.name = b.name)"""


def _inventories(spark, sf):
    inv = v.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("path"),
        F.lit("part").alias("kind"),
        F.col("l_partkey").alias("name"),
        (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("old"),
    ).agg(F.max("l_discount").cast("string").alias("body"))
    return inv.filter("old"), inv.filter("NOT old")


@query("J3_diff_inventory", f"WITH {_INV} SELECT * FROM diff")
def diff_inventory(spark, sf):
    return symbols.diff_inventory(*_inventories(spark, sf)).select("path", "kind", "name", "status")


@query(
    "J3_bodies",
    f"""WITH {_INV} SELECT d.*, a.body AS old_body, b.body AS new_body FROM diff d
      LEFT JOIN a ON a.path = d.path AND a.name = d.name LEFT JOIN b ON b.path = d.path AND b.name = d.name""",
)
def diff_bodies(spark, sf):
    return symbols.diff_inventory(*_inventories(spark, sf))


@query(
    "J3_device_subset",
    """WITH f AS (
      SELECT DISTINCT l_suppkey AS path, CASE l_partkey % 9 WHEN 0 THEN 'main' WHEN 1 THEN 'shuffle_' || l_partkey % 4 || '_test' ELSE 'f' || l_partkey % 50 END AS name,
        l_shipdate < TIMESTAMP '1998-01-01' AS old FROM lineitem),
    a AS (SELECT path, name FROM f WHERE old), b AS (SELECT path, name FROM f WHERE NOT old)
    SELECT coalesce(a.path, b.path) AS path, 'function' AS kind, coalesce(a.name, b.name) AS name,
      CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'added' ELSE 'preserved' END AS status
    FROM a FULL JOIN b ON a.path = b.path AND a.name = b.name
    WHERE NOT (b.path IS NULL AND a.path % 2 = 0 AND (a.name = 'main' OR a.name LIKE 'shuffle%test'))""",
)
def device_subset(spark, sf):
    """Suppliers with an even number port the device part only."""
    part = F.col("l_partkey")
    name = F.when(part % 9 == 0, F.lit("main")).when(
        part % 9 == 1, F.concat(F.lit("shuffle_"), part % 4, F.lit("_test"))
    ).otherwise(F.concat(F.lit("f"), part % 50))
    rows = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("path"), F.lit("function").alias("kind"), name.alias("name"), F.lit("").alias("body"),
        (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("old"),
    ).distinct()
    mode = F.when(F.col("path") % 2 == 0, F.lit("DEVICE_SUBSET")).otherwise(F.lit("WHOLE_PROGRAM"))
    modes = rows.select("path").distinct().withColumn("port_mode", mode)
    columns = ["path", "kind", "name", "body"]
    out = symbols.diff_inventory(rows.filter("old").select(*columns), rows.filter("NOT old").select(*columns), modes=modes)
    return out.select("path", "kind", "name", "status")


_HEADS = (
    "__global__ void k{p}(const float* __restrict__ in, float* out, int n = {s})",
    "__global__  void k{p}(float *y, const int* idx)",
    "__global__ void k{p}(unsigned int n, double* data /* {s} */)",
    "__global__ void k{p}(int* result, float x)",
    "__global__ void k{p}()",
)


@query(
    "F18_shapes",
    """WITH shapes(m, position, name, type, direction) AS (VALUES
      (0, 1, 'in', 'const float* __restrict__', 'in'), (0, 2, 'out', 'float*', 'out'), (0, 3, 'n', 'int', 'scalar'),
      (1, 1, 'y', 'float*', 'out'), (1, 2, 'idx', 'const int*', 'in'),
      (2, 1, 'n', 'unsigned int', 'scalar'), (2, 2, 'data', 'double*', 'in'),
      (3, 1, 'result', 'int*', 'out'), (3, 2, 'x', 'float', 'scalar'))
    SELECT p_partkey AS path, CAST(0 AS INTEGER) AS function_no, 'k' || p_partkey AS function, CAST(position AS INTEGER) AS position, name, type, direction
    FROM part JOIN shapes ON m = p_partkey % 5""",
)
def signature_shapes(spark, sf):
    """Five kinds of head: no parameter, a star on either side, comments, defaults, names that say output."""
    key, head = F.col("p_partkey"), None
    for i, text in enumerate(_HEADS):
        made = F.format_string(text.replace("{p}", "%1$s").replace("{s}", "%2$s") + " { }", key.cast("string"), F.col("p_size").cast("string"))
        head = F.when(key % 5 == i, made) if head is None else head.when(key % 5 == i, made)
    return symbols.signature_params(v.table(spark, sf, "part").select(key.alias("path"), head.alias("source")))


@query(
    "J3_diff_summary",
    f"""WITH {_INV} SELECT path, kind, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'added') AS added,
      count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'preserved') AS preserved FROM diff GROUP BY 1, 2""",
)
def diff_summary(spark, sf):
    return symbols.diff_summary(symbols.diff_inventory(*_inventories(spark, sf)))


@query(
    "U1_name_set_diff",
    f"""WITH {_INV} SELECT path, name, CASE status WHEN 'missing' THEN 'missing' WHEN 'added' THEN 'added' ELSE 'preserved' END AS status FROM diff""",
)
def name_set_diff(spark, sf):
    return symbols.name_set_diff(*_inventories(spark, sf), ["path"])


@query(
    "U2_namespace_report",
    f"""WITH {v.PAGE_VERSIONS}, a AS (SELECT path, list_sort(list_distinct(regexp_extract_all(source, '{_ATTR}', 1))) AS o,
        list_sort(list_distinct(regexp_extract_all(ported, '{_ATTR}', 1))) AS n,
        list_sort(list_distinct(regexp_extract_all(source, '{_TAG}', 1))) AS ou, list_sort(list_distinct(regexp_extract_all(ported, '{_TAG}', 1))) AS nu FROM pg)
    SELECT path, array_to_string(list_filter(o, lambda x: NOT list_contains(n, x)), ',') AS dropped_declarations,
      array_to_string(list_filter(n, lambda x: NOT list_contains(o, x)), ',') AS added_declarations,
      array_to_string(list_filter(ou, lambda x: NOT list_contains(nu, x)), ',') AS dropped_using,
      len(list_filter(o, lambda x: NOT list_contains(n, x))) = 0 AS preserved FROM a""",
)
def namespace_report(spark, sf):
    names = lambda t, p: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(1))))
    pairs = v.page_versions(spark, sf).select(
        "path",
        names(F.col("source"), _ATTR).alias("old_names"),
        names(F.col("ported"), _ATTR).alias("new_names"),
        names(F.col("source"), _TAG).alias("old_using"),
        names(F.col("ported"), _TAG).alias("new_using"),
    )
    out = symbols.namespace_report(pairs)
    return out.withColumns(
        {c: F.array_join(c, ",") for c in ("dropped_declarations", "added_declarations", "dropped_using")}
    )


@query(
    "U3_changed_values",
    """WITH p AS (SELECT l_partkey, l_shipdate < TIMESTAMP '1998-01-01' AS old, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)
    SELECT a.l_partkey, a.value AS old_value, b.value AS new_value FROM p a JOIN p b ON a.l_partkey = b.l_partkey AND a.old AND NOT b.old
    WHERE a.value IS DISTINCT FROM b.value""",
)
def changed_values(spark, sf):
    prices = v.table(spark, sf, "lineitem").groupBy(
        "l_partkey", (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("old")
    ).agg(F.max("l_extendedprice").alias("value"))
    return symbols.changed_values(prices.filter("old"), prices.filter("NOT old"), ["l_partkey"])


def _names_by_group(spark, sf):
    """Part labels per type: those of small parts are `removed`, those of large ones `added`."""
    p = v.table(spark, sf, "part")
    label = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey") % 23)
    named = p.select(F.col("p_type").alias("path"), label.alias("name"), (F.col("p_size") <= 25).alias("old"))
    old = named.filter("old").select("path", "name").distinct()
    new = named.filter("NOT old").select("path", "name").distinct()
    removed = old.join(new, ["path", "name"], "left_anti")
    added = new.join(old, ["path", "name"], "left_anti")
    return removed, added


def _longest(a: str, b: str) -> str:
    """SQL: struct (k, i) of the longest common block of two texts, the earliest in the first one."""
    return f"""list_max(list_transform(list_filter(flatten(list_transform(range(1, len({a}) + 1),
      lambda i: list_transform(range(1, len({a}) - i + 2), lambda k: {{'k': k, 'i': -i}}))),
      lambda z: contains({b}, substring({a}, CAST(-z.i AS BIGINT), z.k))), lambda z: {{'k': z.k, 'i': z.i}}))"""


_FOLD = "replace(replace(replace(replace(lower({0}), '_', ''), 'warp', 'wave'), 'wavefront', 'wave'), 'cuda', 'hip')"
# The ratio's definition: the longest common block, then the same on both sides of it.
_SIMILAR = f"""
labels AS (SELECT DISTINCT p_type AS path, replace(p_name, ' ', '_') || '_' || (p_partkey % 23) AS name, p_size <= 25 AS old FROM part),
removed AS (SELECT path, name, {_FOLD.format('name')} AS f FROM labels l WHERE old AND NOT EXISTS (SELECT 1 FROM labels m WHERE m.path = l.path AND m.name = l.name AND NOT m.old)),
added AS (SELECT path, name, {_FOLD.format('name')} AS f FROM labels l WHERE NOT old AND NOT EXISTS (SELECT 1 FROM labels m WHERE m.path = l.path AND m.name = l.name AND m.old)),
both_names AS (
  SELECT path, removed.name, added.name AS match, removed.f AS fa, added.f AS fb, len(removed.f) + len(added.f) AS total
  FROM removed JOIN added USING (path) WHERE 2.0 * least(len(removed.f), len(added.f)) >= 0.72 * (len(removed.f) + len(added.f))),
blocks AS (
  SELECT path, name, match, fa, fb, {_longest('fa', 'fb')} AS b FROM both_names
  UNION ALL
  SELECT path, name, match, x.fa, x.fb, {_longest('x.fa', 'x.fb')} FROM (
    SELECT path, name, match, unnest([
      {{'fa': substring(fa, 1, CAST(-b.i - 1 AS BIGINT)), 'fb': substring(fb, 1, instr(fb, substring(fa, CAST(-b.i AS BIGINT), b.k)) - 1)}},
      {{'fa': substring(fa, CAST(-b.i AS BIGINT) + b.k), 'fb': substring(fb, instr(fb, substring(fa, CAST(-b.i AS BIGINT), b.k)) + b.k)}}]) AS x
    FROM blocks WHERE b IS NOT NULL)
  WHERE x.fa <> '' AND x.fb <> ''),
scored AS (
  SELECT path, name, match, 2.0::DOUBLE * coalesce(sum(b.k), 0) / any_value(total) AS similarity
  FROM blocks JOIN both_names USING (path, name, match) GROUP BY 1, 2, 3)"""


@query(
    "J4_rename_candidates",
    f"""WITH RECURSIVE {_SIMILAR},
    pairs AS (SELECT * FROM scored WHERE similarity >= 0.72),
    turns AS (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY name) AS i FROM (SELECT DISTINCT path, name FROM pairs)),
    served AS (
      SELECT DISTINCT path, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS old, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS new FROM turns
      UNION ALL
      SELECT s.path, t.i, t.name,
        CASE WHEN count(p.match) = 0 THEN any_value(s.used) ELSE list_append(any_value(s.used), arg_min(p.match, (-p.similarity, p.match))) END,
        arg_min(p.match, (-p.similarity, p.match))
      FROM served s JOIN turns t ON t.path = s.path AND t.i = s.i + 1
        LEFT JOIN pairs p ON p.path = s.path AND p.name = t.name AND NOT list_contains(s.used, p.match)
      GROUP BY s.path, t.i, t.name)
    SELECT s.path, s.old, s.new, round_even(p.similarity, 4) AS similarity
    FROM served s JOIN pairs p ON p.path = s.path AND p.name = s.old AND p.match = s.new""",
)
def rename_candidates(spark, sf):
    return similarity.rename_candidates(*_names_by_group(spark, sf), ["path"], 0.72)


@query(
    "J4_nearest_name",
    f"""WITH RECURSIVE {_SIMILAR} SELECT path, name, match, round(similarity, 4) AS similarity FROM scored WHERE similarity >= 0.82
    QUALIFY row_number() OVER (PARTITION BY path, name ORDER BY similarity DESC, match) = 1""",
)
def nearest_name(spark, sf):
    out = similarity.best_match(*_names_by_group(spark, sf), ["path"], 0.82)
    return out.withColumn("similarity", F.round("similarity", 4))


@query(
    "J5_unresolved_includes",
    f"""WITH {_SYMBOLS} SELECT s.path, s.name FROM syms s WHERE kind = 'href'
      AND regexp_extract(name, '([^/]*)$', 1) NOT IN (SELECT regexp_extract(url, '([^/]*)$', 1) FROM pages)""",
)
def unresolved_includes(spark, sf):
    links = page_symbols(spark, sf).filter("kind = 'href'").select("path", "name")
    files = v.table(spark, sf, "pages").select(F.col("url").alias("file"))
    return symbols.unresolved_includes(links, files)


@query(
    "J6_unsatisfied_calls",
    """SELECT DISTINCT l_partkey AS name FROM lineitem WHERE l_quantity > 45 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)
      AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-06-01')""",
)
def unsatisfied_calls(spark, sf):
    l = v.table(spark, sf, "lineitem")  # noqa: E741
    calls = l.filter("l_quantity > 45").select(F.col("l_partkey").alias("name"))
    old = v.table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("name"))
    new = l.filter(F.col("l_shipdate") >= F.lit("2000-06-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("name"))
    return symbols.unsatisfied_calls(calls, old, new, ["name"])


@query(
    "J7_undefined_launches",
    f"""WITH {_SYMBOLS}, used AS (SELECT DISTINCT page_id AS path, unnest(regexp_extract_all(html, '</([a-z0-9]+)', 1)) AS name FROM pages)
    SELECT path, name FROM (SELECT path, name FROM att UNION SELECT path, name FROM used)
    WHERE name NOT IN ('class', 'if') AND (path, name) NOT IN (SELECT path, name FROM tag)""",
)
def undefined_launches(spark, sf):
    pages = v.pages(spark, sf)
    grab = lambda p: pages.select(
        "path", F.explode(F.regexp_extract_all("source", F.lit(p), F.lit(1))).alias("name")
    )
    calls = grab(_ATTR).union(grab("</([a-z0-9]+)"))
    return symbols.undefined_launches(calls, grab(_TAG).distinct(), ["path", "name"], keywords=("class", "if"))


@query(
    "J7_file_scope_lines",
    """WITH pl AS (SELECT page_id AS path, string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)) AS ls FROM pages),
    l AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM pl),
    c AS (SELECT path, line, text, len(replace(regexp_replace(text, '[^()]', '', 'g'), '()', '')) AS odd,
      sum(len(regexp_extract_all(text, '[(]')) - len(regexp_extract_all(text, '[)]'))) OVER (PARTITION BY path ORDER BY line) AS depth FROM l)
    SELECT path, CAST(line AS INTEGER) AS line, text FROM c WHERE depth = 0 AND odd = 0 AND regexp_matches(text, 'track|<a ')""",
)
def file_scope_lines(spark, sf):
    from rivulant.sources.corpus import to_lines

    pages = v.pages(spark, sf).withColumn("source", F.replace("source", F.lit("><"), F.lit(">\n<")))
    return symbols.file_scope_lines(
        to_lines(pages), bracket_depth(pages, "(", ")"), ["path", "line"], "track|<a "
    )


@query(
    "J15_port_mode",
    """SELECT doc_id AS path, CASE WHEN NOT contains(text, 'the') THEN 'WHOLE_PROGRAM'
      WHEN regexp_matches(text, 'License') OR regexp_matches(text, '@') OR n_chars % 11 = 0 THEN 'DEVICE_SUBSET' ELSE 'WHOLE_PROGRAM' END AS port_mode FROM documents""",
)
def port_mode(spark, sf):
    docs = v.corpus(spark, sf)
    files = docs.select(
        "path",
        F.contains("source", F.lit("the")).alias("has_main"),
        (F.length("source") % 11 != 0).alias("main_extractable"),
    )
    return symbols.port_mode(
        files,
        docs.filter(F.contains("source", F.lit("License"))),
        docs.filter(F.contains("source", F.lit("@"))),
    )
