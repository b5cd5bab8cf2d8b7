"""Quality queries: F6-F8, F13, F15, F17, F19-F21, A9-A11, W1, W2, W5."""

from pyspark.sql import functions as F

from rivulant.operators import extraction, masking, quality, rewrite
from rivulant.operators import findings as scans
from rivulant.operators.quality import GateRules
from rivulant.rules import Rule, rubrics
from rivulant.rules.portable import REDACTIONS
from rivulant.workload import views as v
from rivulant.workload.registry import query

# lines of a page: one tag boundary per line
_PAGE = "replace(html, '><', '>' || chr(10) || '<')"


def _pages(spark, sf):
    return v.pages(spark, sf).withColumn("source", F.replace("source", F.lit("><"), F.lit(">\n<")))


_MASKED = f"""
m AS (SELECT page_id AS path, {_PAGE} AS t FROM pages),
parts AS (SELECT path, t, regexp_extract_all(t, '<!--(?s:.*?)-->|"[^"]*"') AS h, regexp_split_to_array(t, '<!--(?s:.*?)-->|"[^"]*"') AS p FROM m),
masked AS (
  SELECT path, t AS source, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE
      WHEN i > len(h) THEN ''
      WHEN starts_with(h[i], '<!--') THEN regexp_replace(h[i], '[^\\n]', ' ', 'g')
      ELSE '"' || regexp_replace(h[i][2:-2], '[^\\n]', ' ', 'g') || '"' END), '') AS masked
  FROM parts)"""


@query("F6_mask", f"WITH {_MASKED} SELECT path, masked FROM masked")
def mask(spark, sf):
    return masking.mask(_pages(spark, sf), **masking.MARKUP).select("path", "masked")


@query(
    "F6_mask_keep_literals",
    f"""WITH m AS (SELECT page_id AS path, {_PAGE} AS t FROM pages),
    p AS (SELECT path, regexp_extract_all(t, '<!--(?s:.*?)-->') AS h, regexp_split_to_array(t, '<!--(?s:.*?)-->') AS p FROM m)
    SELECT path, array_to_string(list_transform(range(1, len(p) + 1),
      lambda i: p[i] || CASE WHEN i > len(h) THEN '' ELSE regexp_replace(h[i], '[^\\n]', ' ', 'g') END), '') AS masked FROM p""",
)
def mask_keep_literals(spark, sf):
    return masking.mask(_pages(spark, sf), keep_literals=True, **masking.MARKUP).select("path", "masked")


_KINDS = (
    ("noise", "[#$%&*]{3}", False),
    ("shout", "!!", False),
    ("list-item", r"^\s*[-*]\s+[A-Za-z]", False),
    ("sentence", r"^[A-Z].*\.$", True),
)
_LINES = """
raw_lines AS (SELECT doc_id AS path, text, CASE WHEN text[-1] = chr(10) THEN string_split(text[1:-2], chr(10))
    ELSE string_split(text, chr(10)) END AS ls FROM documents),
lines AS (SELECT path, text AS doc, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM raw_lines)"""
_KIND_SQL = r"""CASE WHEN NOT regexp_matches(text, '\S') THEN 'blank' WHEN regexp_matches(text, '@|License') THEN 'code'
    WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'noise' WHEN contains(text, '!!') THEN 'shout'
    WHEN regexp_matches(text, '^\s*[-*]\s+[A-Za-z]') THEN 'list-item' WHEN regexp_matches(trim(text), '^[A-Z].*\.$') THEN 'sentence' ELSE 'other' END"""


def _lines(spark, sf):
    from rivulant.sources.corpus import to_lines

    return to_lines(v.corpus(spark, sf))


@query("F7_classify_lines", f"WITH {_LINES} SELECT path, CAST(line AS INTEGER) AS line, {_KIND_SQL} AS kind FROM lines")
def classify_lines(spark, sf):
    rules = GateRules(code="@|License", prose=_KINDS)
    return quality.classify_lines(_lines(spark, sf), rules).select("path", "line", "kind")


_SCORE = r"""
said AS (SELECT path, doc, trim(text) AS s, text FROM lines WHERE regexp_matches(text, '\S')),
coded AS (SELECT path, doc, regexp_matches(s, '[,;]|^An') AS c, regexp_matches(s, '^(The|Der|Le|La) ') OR regexp_matches(s, '^[A-Z].{20,}\.$') AS p FROM said),
counts AS (SELECT path, doc, count(*) FILTER (WHERE c) AS n_code, count(*) FILTER (WHERE p AND NOT c) AS n_prose FROM coded GROUP BY 1, 2)"""


@query(
    "F8_code_score",
    f"""WITH {_LINES}, {_SCORE} SELECT d.doc_id AS path, round(coalesce(CASE WHEN n_code + n_prose > 0 THEN
      least(1.0, n_code / CAST(n_code + n_prose AS DOUBLE) + CASE WHEN contains(d.text, 'License') THEN 0.15 ELSE 0 END) ELSE 0 END, 0), 6) AS code_score
    FROM documents d LEFT JOIN counts c ON c.path = d.doc_id""",
)
def code_score(spark, sf):
    out = quality.code_score(
        v.corpus(spark, sf), code="[,;]|^An", lead="^(?:The|Der|Le|La) ", bullet="^$", sentence=r"^[A-Z].{20,}\.$",
        bonus="License",
    )
    return out.select("path", F.round("code_score", 6).alias("code_score"))


# The adapted gate: a line with noise or shouting is bad, any other line is good.
_GATE = GateRules(
    code=r"^(?:(?![#$%&*]{3}|!!)[\s\S])*$",
    prose=(("noise", "[#$%&*]{3}", False), ("shout", "!!", False)),
    rejects=(("token", 'token = "'), ("mail", "[A-Za-z0-9.]+@[A-Za-z0-9.]+")),
    strong="License",
)


@query(
    "A9_lexical_gate",
    f"""WITH {_LINES}, said AS (SELECT path, line, trim(text) AS s, CASE WHEN regexp_matches(text, '[#$%&*]{{3}}') THEN 'noise'
        WHEN contains(text, '!!') THEN 'shout' END AS kind FROM lines WHERE regexp_matches(text, '\\S')),
    c AS (SELECT path, count(*) AS n, count(kind) AS bad,
        string_agg('L' || line || ' [' || kind || ']: ' || s, chr(10) ORDER BY line) FILTER (WHERE kind IS NOT NULL AND rk <= 3) AS samples
      FROM (SELECT *, row_number() OVER (PARTITION BY path, kind IS NULL ORDER BY line) AS rk FROM said) GROUP BY 1),
    r AS (SELECT d.doc_id AS path, d.text, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(samples, '') AS samples,
        CASE WHEN NOT regexp_matches(d.text, '\\S') THEN 'empty extraction' WHEN contains(d.text, 'token = "') THEN 'token'
          WHEN regexp_matches(d.text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') THEN 'mail' WHEN n > 0 AND n = bad THEN 'no code lines'
          WHEN n > 0 AND bad / CAST(n AS DOUBLE) > 0.15 THEN 'prose ratio' END AS reason
      FROM documents d LEFT JOIN c ON c.path = d.doc_id)
    SELECT path, reason IS NULL AS ok, reason, n AS non_empty_lines, n - bad AS code_lines, bad AS prose_lines, samples,
      reason IS NULL AND NOT contains(text, 'License') AS warning FROM r""",
)
def lexical_gate(spark, sf):
    out = quality.lexical_gate(v.corpus(spark, sf), _GATE, samples=3)
    return out.withColumn("samples", F.array_join("samples", "\n"))


_DEPTH = f"""
pl AS (SELECT page_id AS path, string_split({_PAGE}, chr(10)) AS ls FROM pages),
l AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM pl),
ch AS (SELECT path, line, unnest(range(1, len(cs) + 1)) AS pos, unnest(cs) AS c FROM (SELECT path, line, regexp_extract_all(text, '[()]') AS cs FROM l)),
run AS (SELECT path, line, pos, sum(CASE c WHEN '(' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY line, pos) AS d FROM ch),
per AS (SELECT path, line, arg_max(d, pos) AS depth, min(d) AS low FROM run GROUP BY 1, 2)"""


@query(
    "W1_bracket_depth",
    f"""WITH {_DEPTH}, f AS (
      SELECT l.path, l.line, p.depth, p.low, coalesce(last_value(p.depth IGNORE NULLS) OVER (PARTITION BY l.path ORDER BY l.line
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM l LEFT JOIN per p ON p.path = l.path AND p.line = l.line)
    SELECT path, CAST(line AS INTEGER) AS line, CAST(coalesce(depth, before) AS BIGINT) AS depth, CAST(least(before, coalesce(low, before)) AS BIGINT) AS low FROM f""",
)
def bracket_depth(spark, sf):
    return quality.bracket_depth(_pages(spark, sf), "(", ")")


@query(
    "W1_depth_summary",
    f"""WITH {_DEPTH} SELECT p.page_id AS path, coalesce(arg_max(depth, line), 0)::BIGINT AS final_depth,
      least(0, coalesce(min(low), 0))::BIGINT AS min_depth, CAST(min(line) FILTER (WHERE low < 0) AS INTEGER) AS first_unbalanced_line
    FROM pages p LEFT JOIN per ON per.path = p.page_id GROUP BY 1""",
)
def depth_summary(spark, sf):
    return quality.depth_summary(quality.bracket_depth(_pages(spark, sf), "(", ")"), ["path"])


@query(
    "W1_region_lines",
    f"""WITH RECURSIVE pl AS (SELECT page_id AS path, string_split({_PAGE}, chr(10)) AS ls FROM pages),
    l AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text, len(ls) AS n FROM pl),
    m AS (SELECT path, line, n, regexp_matches(text, '<style>|<script>') AS hit, len(regexp_extract_all(text, '[{{]')) AS o, len(regexp_extract_all(text, '[}}]')) AS c FROM l),
    walk(path, line, n, start, depth, seen, done) AS (
      SELECT path, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST(0 AS BIGINT) FROM pl
      UNION ALL
      SELECT path, line, n, CASE WHEN inside AND NOT closes THEN start ELSE 0 END, CASE WHEN inside AND NOT closes THEN depth ELSE 0 END,
        inside AND NOT closes AND seen, CASE WHEN closes OR (inside AND line = n) THEN start ELSE 0 END
      FROM (SELECT *, inside AND seen AND depth <= 0 AS closes FROM (
        SELECT m.path, m.line, m.n, w.start > 0 OR m.hit AS inside, CASE WHEN w.start > 0 THEN w.start ELSE m.line END AS start,
          w.depth + m.o - m.c AS depth, w.seen OR m.o > 0 AS seen
        FROM walk w JOIN m ON m.path = w.path AND m.line = w.line + 1)))
    SELECT path, CAST(done AS INTEGER) AS start, CAST(line AS INTEGER) AS "end" FROM walk WHERE done > 0""",
)
def region_lines(spark, sf):
    return quality.region_lines(_pages(spark, sf), "<style>|<script>")


_VERSIONS = """
vers AS (SELECT doc_id AS path, text AS source, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS ported FROM documents),
pairs AS (SELECT * FROM vers WHERE ported IS NOT NULL)"""


def _doc_versions(spark, sf):
    """Each document with the next one of its source; neighbours meet by position, chunked."""
    from rivulant.plans.scan import running

    docs = v.table(spark, sf, "documents").select("doc_id", F.col("source").alias("src"))
    numbered = running(
        docs, ["src"], ["doc_id"], F.floor(F.col("doc_id") / F.lit(4096)).cast("bigint"),
        sums={"pos": F.lit(1).cast("bigint")},
    )
    after = numbered.select("src", (F.col("pos") - 1).alias("pos"), F.col("doc_id").alias("next_id"))
    ids = numbered.join(after, ["src", "pos"]).select("doc_id", "next_id")
    texts = v.table(spark, sf, "documents").select("doc_id", "text")
    return (
        ids.join(texts.select("doc_id", F.col("text").alias("source")), "doc_id")
        .join(texts.select(F.col("doc_id").alias("next_id"), F.col("text").alias("ported")), "next_id")
        .select(F.col("doc_id").alias("path"), "source", "ported")
    )


@query(
    "F19_shape_flags",
    rf"""WITH {_VERSIONS}, c AS (
      SELECT path, len(list_filter(string_split(source, chr(10)), lambda x: regexp_matches(x, '\S'))) AS source_lines,
        len(list_filter(string_split(ported, chr(10)), lambda x: regexp_matches(x, '\S'))) AS ported_lines,
        regexp_matches(ported, 'Released|clown') AS truncation_mark FROM pairs)
    SELECT *, source_lines > 0 AND ported_lines < source_lines * 0.25 AS too_short,
      source_lines > 0 AND ported_lines < source_lines * 0.5 AS rather_short FROM c""",
)
def shape_flags(spark, sf):
    flagged = quality.shape_flags(_doc_versions(spark, sf), marker="Released|clown")
    return flagged.drop("source", "ported")


_CUT = f"""{v.PAGE_VERSIONS},
n AS (SELECT path, source, ported,
    regexp_extract_all(source, 'href="([^"]*)"', 1) AS old_names, regexp_extract_all(ported, 'href="([^"]*)"', 1) AS new_names FROM pg)"""


@query(
    "A10_structural_gate",
    f"""WITH {_CUT}, ch AS (SELECT path, unnest(range(1, len(cs) + 1)) AS pos, unnest(cs) AS c FROM (SELECT path, regexp_extract_all(ported, '[{{}}]') AS cs FROM n)),
    run AS (SELECT path, pos, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY pos) AS d FROM ch),
    b AS (SELECT path, CASE WHEN min(d) < 0 THEN -1 ELSE arg_max(d, pos) END AS depth FROM run GROUP BY 1),
    chp AS (SELECT path, unnest(range(1, len(cs) + 1)) AS pos, unnest(cs) AS c FROM (SELECT path, regexp_extract_all(ported, '[()]') AS cs FROM n)),
    runp AS (SELECT path, pos, sum(CASE c WHEN '(' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY pos) AS d FROM chp),
    bp AS (SELECT path, CASE WHEN min(d) < 0 THEN -1 ELSE arg_max(d, pos) END AS depth FROM runp GROUP BY 1),
    f AS (SELECT n.path, coalesce(b.depth, 0) <> 0 AS e1, coalesce(bp.depth, 0) <> 0 AS e2, regexp_matches(ported, 'clown') AS e3,
        len(new_names) > len(list_distinct(new_names)) AS e4,
        array_to_string(list_sort(list_distinct(list_filter(old_names, lambda x: NOT list_contains(new_names, x)))), ',') AS missing_symbols,
        len(list_filter(string_split(source, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS sl, len(list_filter(string_split(ported, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS pl
      FROM n LEFT JOIN b ON b.path = n.path LEFT JOIN bp ON bp.path = n.path),
    g AS (SELECT *, sl > 0 AND pl < sl * 0.25 AS e5, sl > 0 AND pl < sl * 0.5 AS w2 FROM f)
    SELECT path, array_to_string(list_filter([CASE WHEN e1 THEN 'braces' END, CASE WHEN e2 THEN 'parentheses' END, CASE WHEN e3 THEN 'truncation marker' END,
        CASE WHEN e5 THEN 'size' END, CASE WHEN e4 THEN 'duplicate definitions' END], lambda x: x IS NOT NULL), ',') AS errors,
      array_to_string(list_filter([CASE WHEN missing_symbols <> '' THEN 'symbols dropped' END, CASE WHEN w2 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS warnings,
      missing_symbols, NOT (e1 OR e2 OR e3 OR e4 OR e5) AS ok,
      CASE WHEN e1 OR e2 OR e3 OR e4 OR e5 THEN 0.0::DOUBLE ELSE round(1.0 - 0.1 * ((missing_symbols <> '')::INT + w2::INT), 4)::DOUBLE END AS score FROM g""",
)
def structural_gate(spark, sf):
    pairs = v.page_versions(spark, sf).withColumn("port_mode", F.lit("FULL"))
    out = quality.structural_gate(
        pairs,
        names=lambda t: F.regexp_extract_all(t, F.lit('href="([^"]*)"'), F.lit(1)),
        mask=lambda t: t,
        region=None,
        marker="clown",
    )
    return out.withColumns({c: F.array_join(c, ",") for c in ("errors", "warnings", "missing_symbols")})


@query(
    "A11_duplicates",
    f"""WITH {_LINES}, r AS (SELECT path, text AS name, line, row_number() OVER (PARTITION BY path, text ORDER BY line) AS rk,
        count(*) OVER (PARTITION BY path, text) AS n FROM lines WHERE regexp_matches(text, '\\S'))
    SELECT path, name, CAST(line AS INTEGER) AS line, n FROM r WHERE n > 1 AND rk = 2""",
)
def duplicates(spark, sf):
    lines = _lines(spark, sf).filter(F.col("text").rlike(r"\S")).withColumnRenamed("text", "name")
    return quality.duplicates(lines, ["path"])


@query(
    "W2_unreachable_lines",
    rf"""WITH {_LINES}, s AS (SELECT path, line, text, row_number() OVER (PARTITION BY path ORDER BY line) AS rk FROM lines WHERE regexp_matches(text, '\S')),
    n AS (SELECT a.path, a.line AS jump_line, a.text AS jump, b.line, b.text FROM s a JOIN s b ON b.path = a.path AND b.rk = a.rk + 1)
    SELECT path, CAST(line AS INTEGER) AS line, CAST(jump_line AS INTEGER) AS jump_line, trim(text) AS evidence FROM n
    WHERE regexp_matches(trim(jump), '^[A-Z][a-z ]+\.$') AND NOT regexp_matches(jump, 'tion') AND NOT regexp_matches(trim(text), '^(The|Le|De) ')""",
)
def unreachable_lines(spark, sf):
    docs = v.corpus(spark, sf)
    return quality.unreachable_lines(
        docs, jump=r"^[A-Z][a-z ]+\.$", guard="tion", fine="^(?:The|Le|De) ", masked=F.col("source")
    )


@query(
    "W2_malformed_declarations",
    rf"""WITH {_LINES}, n AS (SELECT path, line, text, coalesce(lead(text) OVER (PARTITION BY path ORDER BY line), '') AS nxt FROM lines)
    SELECT path, CAST(line AS INTEGER) AS line, trim(text) AS evidence FROM n
    WHERE regexp_matches(text, '^(An|De|The|Le)') AND NOT regexp_matches(trim(text), '[,;:!?]$')
      AND length(text) - length(replace(text, '(', '')) <= length(text) - length(replace(text, ')', '')) AND NOT regexp_matches(trim(nxt), '^[A-M]')""",
)
def malformed_declarations(spark, sf):
    return quality.malformed_declarations(
        v.corpus(spark, sf), start="^(?:An|De|The|Le)", goes_on="[,;:!?]$", body="^[A-M]"
    )


@query(
    "W5_code_window",
    rf"""WITH {_LINES}, l AS (SELECT path, line, text, trim(text) AS s FROM lines),
    a AS (SELECT path, min(line) AS anchor FROM l WHERE regexp_matches(text, 'tion') GROUP BY 1),
    f AS (SELECT l.path, min(l.line) AS first FROM l JOIN a ON a.path = l.path AND l.line >= a.anchor WHERE s = '' OR regexp_matches(s, '^(The|De|An|La|En)') GROUP BY 1),
    c AS (SELECT l.path, l.line, regexp_matches(s, 'ing|eau|ción|ung') AS code FROM l JOIN f ON f.path = l.path AND l.line >= f.first WHERE s <> ''),
    g AS (SELECT *, sum(code::INT) OVER (PARTITION BY path ORDER BY line) AS grp FROM c),
    k AS (SELECT *, sum((NOT code)::INT) OVER (PARTITION BY path, grp ORDER BY line) AS streak FROM g),
    z AS (SELECT path, min(line) AS stop FROM k WHERE grp > 0 AND NOT code AND streak = 3 GROUP BY 1),
    b AS (SELECT k.path, f.first, max(k.line) AS last
      FROM k JOIN f ON f.path = k.path LEFT JOIN z ON z.path = k.path WHERE k.code AND (z.stop IS NULL OR k.line < z.stop) GROUP BY 1, 2)
    SELECT b.path, CAST(first AS INTEGER) AS first_line, CAST(last AS INTEGER) AS last_line,
      sha256(trim(string_agg(l.text, chr(10) ORDER BY l.line), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10)) AS window_sha256
    FROM b JOIN l ON l.path = b.path AND l.line BETWEEN b.first AND b.last GROUP BY b.path, first, last""",
)
def code_window(spark, sf):
    out = extraction.code_window(
        v.corpus(spark, sf), "source", anchor="tion",
        strict=lambda bare: bare.rlike("^(?:The|De|An|La|En)"), lenient="ing|eau|ción|ung",
    )
    return out.filter("last_line IS NOT NULL").select("path", "first_line", "last_line", F.sha2("window", 256).alias("window_sha256"))


_RESPONSES = r"""
resp AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN CAST(to_json({'code': text}) AS VARCHAR)
    WHEN 1 THEN 'Look:' || chr(10) || '```cpp' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.' ELSE text END AS response FROM conversations),
shape AS (SELECT conv_id, turn, text, response, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '[,]|^An'))) AS c,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^[A-Z].*\.$') AND NOT regexp_matches(trim(x), '[,]|^An'))) AS p FROM resp),
ext AS (SELECT conv_id, turn, response, CASE WHEN turn % 3 = 0 AND regexp_matches(text, '\S') THEN 'json-field'
      WHEN turn % 3 = 1 AND c + p > 0 AND c / CAST(greatest(c + p, 1) AS DOUBLE) >= 0.5 THEN 'markdown-fence' ELSE 'rejected' END AS strategy,
    text FROM shape),
got AS (SELECT conv_id, turn, response, strategy, CASE strategy WHEN 'json-field' THEN regexp_replace(text, '^\s+|\s+$', '', 'g')
      WHEN 'markdown-fence' THEN regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) END AS code FROM ext)"""


def _responses(spark, sf):
    c = v.table(spark, sf, "conversations")
    fenced = F.concat(F.lit("Look:\n```cpp\n"), "text", F.lit("\n```\nDone."))
    response = (
        F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("text").alias("code"))))
        .when(F.col("turn") % 3 == 1, fenced)
        .otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", response.alias("response"))


def _extracted(spark, sf):
    score = lambda t: quality.code_score_of(
        t, code="[,]|^An", lead=r"^[A-Z].*\.$", bullet="^$", sentence="^$", bonus="^$"
    )
    return extraction.extract_code(_responses(spark, sf), score=score)


@query(
    "F17_extract_code",
    f"""WITH {_RESPONSES} SELECT conv_id, turn, strategy, code, CAST(CASE WHEN strategy = 'rejected' AND turn % 3 <> 1 THEN 0 ELSE 1 END AS INTEGER) AS candidates,
      CAST(length(response) AS INTEGER) AS response_length, CAST(coalesce(length(code), 0) AS INTEGER) AS code_length,
      CAST(greatest(length(response) - coalesce(length(code), 0), 0) AS INTEGER) AS discarded_length FROM got""",
)
def extract_code(spark, sf):
    return _extracted(spark, sf).drop("response")


@query(
    "F20_extraction_report",
    f"""WITH {_RESPONSES}, said AS (
      SELECT *, code IS NULL OR NOT regexp_matches(code, '\\S') AS none,
        list_filter(string_split(coalesce(code, ''), chr(10)), lambda x: regexp_matches(x, '\\S')) AS ls FROM got),
    ends AS (SELECT *, strpos(response, ls[1]) AS a, strpos(reverse(response), reverse(ls[-1])) AS back, length(ls[-1]) AS n FROM said),
    placed AS (SELECT *, length(response) - back - n + 2 AS z FROM ends)
    SELECT conv_id, turn, CAST(CASE WHEN none THEN 0 ELSE
      round_even(least(1.0, 0.5 + 0.5 * length(code) / CAST(length(response) AS DOUBLE)), 4) END AS DOUBLE) AS confidence,
      strategy = 'markdown-fence' AS markdown_removed, none AS extraction_failed,
      CASE WHEN none THEN response
        WHEN contains(response, code) THEN regexp_replace(substring(response, 1, strpos(response, code) - 1) || chr(10) || '<<< extracted code omitted >>>' || chr(10)
          || substring(response, strpos(response, code) + length(code)), '^\\s+|\\s+$', '', 'g')
        WHEN a > 0 AND back > 0 AND z > a THEN regexp_replace(substring(response, 1, a - 1) || chr(10) || '<<< extracted code omitted >>>' || chr(10)
          || substring(response, z + n), '^\\s+|\\s+$', '', 'g') ELSE response END AS discarded
    FROM placed""",
)
def extraction_report(spark, sf):
    out = extraction.extraction_report(_extracted(spark, sf))
    return out.select("conv_id", "turn", "confidence", "markdown_removed", "extraction_failed", "discarded")


_REWRITE = "text"
for _r in REDACTIONS:
    _REWRITE = f"regexp_replace({_REWRITE}, {v.sql_text(_r.pattern)}, {v.sql_text(_r.replacement)}, 'g')"


def _changes() -> str:
    """The labels that fired with their counts, in order, as text."""
    text, parts = "text", []
    for r in REDACTIONS:
        n = f"len(regexp_extract_all({text}, {v.sql_text(r.pattern)}))"
        parts.append(f"CASE WHEN {n} > 0 THEN {v.sql_text(r.label + '=')} || {n} END")
        text = f"regexp_replace({text}, {v.sql_text(r.pattern)}, {v.sql_text(r.replacement)}, 'g')"
    return f"concat_ws(',', {', '.join(parts)})"


@query("F13_rewrite", f"SELECT doc_id AS path, {_REWRITE} AS new_source, {_changes()} AS changes FROM documents")
def rewrite_text(spark, sf):
    out = rewrite.rewrite(v.corpus(spark, sf), REDACTIONS)
    fired = F.transform("changes", lambda c: F.concat(c["label"], F.lit("="), c["n"]))
    return out.select("path", "new_source", F.array_join(fired, ",").alias("changes"))


def _change_sql() -> str:
    text, parts = "text", []
    for r in REDACTIONS:
        parts.append(
            f"SELECT {v.sql_text(r.label)} AS label, len(regexp_extract_all({text}, {v.sql_text(r.pattern)})) AS n FROM documents"
        )
        text = f"regexp_replace({text}, {v.sql_text(r.pattern)}, {v.sql_text(r.replacement)}, 'g')"
    return (
        "SELECT label, CAST(sum(n) AS BIGINT) AS n, count(*) AS texts FROM ("
        + " UNION ALL ".join(parts)
        + ") WHERE n > 0 GROUP BY 1"
    )


@query("F13_change_counts", _change_sql())
def change_counts(spark, sf):
    return rewrite.change_counts(rewrite.rewrite(v.corpus(spark, sf), REDACTIONS))


@query(
    "F15_run_rubric",
    """WITH d AS (SELECT doc_id AS path, text AS code, quality = 1 AS a, doc_id % 2 = 0 AS b, toxic = 0 AS c, quality = 1 AND toxic = 0 AS p
      FROM documents JOIN labels USING (doc_id)),
    n AS (SELECT *, contains(code, 'the')::INT + contains(code, 'que')::INT + contains(code, 'der')::INT + contains(code, 'and')::INT AS hits,
      contains(code, '###')::INT + contains(code, 'clown')::INT + contains(code, '@')::INT AS rest, length(trim(code)) > 50 AS l FROM d)
    SELECT path, CAST(least(100, 12 * a::INT + 18 * b::INT + 5 * c::INT + CASE WHEN l THEN 10 + CASE WHEN hits >= 3 THEN 15 WHEN hits >= 1 THEN 8 ELSE 0 END
      + CASE WHEN rest = 0 THEN 10 WHEN rest <= 2 THEN 3 ELSE 0 END ELSE 0 END + CASE WHEN p THEN 30 WHEN c THEN 10 ELSE 0 END) AS DOUBLE) AS score FROM n""",
)
def run_rubric(spark, sf):
    labels = v.table(spark, sf, "labels").withColumnRenamed("doc_id", "path")
    runs = v.corpus(spark, sf).withColumnRenamed("source", "code").join(labels, "path").select(
        "path", "code",
        (F.col("quality") == 1).alias("coder_ok"),
        (F.col("path") % 2 == 0).alias("evaluator_ok"),
        (F.col("toxic") == 0).alias("verifier_ok"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"),
    )
    terms = rubrics.run_rubric(apis=("the", "que", "der", "and"), leftovers=("###", "clown", "@"))
    return rewrite.rubric_score(runs, terms).select("path", "score")


@query(
    "F15_port_rubric",
    f"""WITH h AS (SELECT doc_id, text, [ {', '.join(f"CASE WHEN regexp_matches(text, {v.sql_text(r.pattern)}) THEN {v.sql_text(r.label)} END" for r in REDACTIONS)} ] AS raw FROM documents),
    c AS (SELECT doc_id AS path, text, list_filter(raw, lambda x: x IS NOT NULL) AS ch, doc_id % 5 = 0 AS cached FROM h),
    n AS (SELECT *, len(trim(text)) AS n, len(list_filter(ch, lambda x: contains(x, 'token'))) > 0 AS a, len(list_filter(ch, lambda x: contains(x, 'hidden'))) > 0 AS b,
      len(list_filter(ch, lambda x: contains(x, 'symbol') OR contains(x, 'run'))) > 0 AS d FROM c)
    SELECT path, CAST(least(100, 15 + 5 * a::INT + 5 * b::INT + 5 * d::INT + 5 * (n > 0)::INT + 5 * (n > 50)::INT + 5 * (n > 200)::INT
      + CASE WHEN contains(text, 'void') AND contains(text, '(') AND contains(text, ')') THEN 5 ELSE 0 END + 5 * (length(text) > 0)::INT
      + 5 * (len(ch) >= 1)::INT + 5 * (len(ch) >= 3)::INT + 5 * cached::INT) AS DOUBLE) AS score FROM n""",
)
def port_rubric(spark, sf):
    fired = F.array_compact(
        F.array(*[F.when(F.col("source").rlike(r.pattern), F.lit(r.label)) for r in REDACTIONS])
    )
    ports = v.corpus(spark, sf).select(
        "path", "source", F.col("source").alias("code"), fired.alias("changes"), (F.col("path") % 5 == 0).alias("cached")
    )
    terms = rubrics.port_rubric((("token",), ("hidden",), ("symbol", "run")))
    return rewrite.rubric_score(ports, terms, group_caps=rubrics.PORT_CAPS).select("path", "score")


@query(
    "F15_extracted_rubric",
    r"""SELECT page_id AS path, CAST(least(100, 10 + 15 * (length(code) > 50)::INT + CASE WHEN contains(code, 'void') AND regexp_matches(code, '[A-Za-z0-9_]+\s*\(') THEN 10 ELSE 0 END
      + 5 * regexp_matches(code, '\{[^}]*\}')::INT) AS DOUBLE) AS score FROM (SELECT page_id, html AS code FROM pages)""",
)
def extracted_rubric(spark, sf):
    pages = v.pages(spark, sf).withColumnRenamed("source", "code")
    return rewrite.rubric_score(pages, rubrics.EXTRACTED_RUBRIC).select("path", "score")


@query(
    "F15_response_rubric",
    rf"""WITH {_RESPONSES} SELECT conv_id, turn, CASE WHEN regexp_matches(response, '\S') THEN round(least(1.0, 0.3 + 0.1 * (length(response) > 100)::INT
      + 0.15 * (contains(response, 'the') OR contains(response, 'que'))::INT + 0.15 * regexp_matches(response, '```(cuda|hip|cpp)?\n')::INT
      + 0.15 * regexp_matches(response, '\{{[^}}]*\}}')::INT + 0.15 * (NOT contains(response, 'der'))::INT), 6)::DOUBLE ELSE 0.0::DOUBLE END AS score FROM resp""",
)
def response_rubric(spark, sf):
    terms = rubrics.response_rubric(apis=("the", "que"), leftovers=("der",))
    out = rewrite.rubric_score(_responses(spark, sf), terms, cap=1.0)
    return out.select("conv_id", "turn", F.round("score", 6).alias("score"))


_STATIC = (
    Rule("script-call", r"track\([0-9]+\)", "error", "call in a script"),
    Rule("bare-amp", "&[^a-z#]", "warning", "bare ampersand"),
    Rule("advert", 'class="[ ]+"', "info", "attribute with a masked value"),
)


@query(
    "F21_static_findings",
    f"""WITH {_MASKED}, hit AS ({' UNION ALL '.join(
        f"SELECT path, source, {v.sql_text(r.name)} AS rule, {v.sql_text(r.severity)} AS severity, {v.sql_text(r.description)} AS message, "
        f"regexp_extract_all(masked, {v.sql_text(r.pattern)}) AS m, regexp_split_to_array(masked, {v.sql_text(r.pattern)}) AS p FROM masked" for r in _STATIC)}),
    e AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM hit),
    q AS (SELECT path, source, rule, severity, message, 1 + length(array_to_string(p[1:k], '')) - length(replace(array_to_string(p[1:k], ''), chr(10), '')) AS line FROM e)
    SELECT path, rule, severity, CAST(line AS INTEGER) AS line, message, trim(string_split(source, chr(10))[line]) AS evidence FROM q""",
)
def static_findings(spark, sf):
    from rivulant.operators.static import static_findings as scan

    return scan(_pages(spark, sf), [(r, "masked") for r in _STATIC], masks=masking.MARKUP)
