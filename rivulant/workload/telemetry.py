"""Telemetry queries: A12-A14, A16, A17, J12-J14, W4, W6, W7, K2, K3."""

from pyspark.sql import functions as F

from rivulant.functions.text import slug
from rivulant.operators import telemetry as ops
from rivulant.plans.scan import running
from rivulant.workload import views as v
from rivulant.workload.registry import query

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


def _cents(c):
    return F.col(c).cast("decimal(18,2)")


@query(
    "A12_stage_timing",
    """SELECT event_type AS stage, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total_ms,
      round(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 6) AS mean_ms, count(*) FILTER (WHERE value > 50) AS failures FROM events GROUP BY 1""",
)
def stage_timing(spark, sf):
    e = v.table(spark, sf, "events").select(
        F.col("event_type").alias("stage"), _cents("value").alias("ms"), (F.col("value") > 50).alias("failed")
    )
    out = ops.stage_timing(e).withColumn("total_ms", F.col("total_ms").cast("double"))
    return out.withColumn("mean_ms", F.round(F.col("total_ms") / F.col("calls"), 6))


@query(
    "A13_usage",
    f"""WITH c AS (SELECT user_id AS run, event_type AS model, {_K} AS tokens, CAST(value AS DECIMAL(18, 2)) AS cost, event_id % 1000 AS lat FROM events)
    SELECT run, model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(lat) AS BIGINT) AS latency_ms,
      CAST(grouping(run, model) AS INTEGER) AS level, round(sum(lat) / CAST(count(*) AS DOUBLE), 6) AS mean_latency_ms FROM c GROUP BY ROLLUP (run, model)""",
)
def usage(spark, sf):
    calls = v.table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("model"), _k().alias("tokens"),
        _cents("value").alias("cost"), (F.col("event_id") % 1000).alias("latency_ms"),
    )
    out = ops.usage(calls)
    return out.withColumns(
        {"cost": F.col("cost").cast("double"), "mean_latency_ms": F.round("mean_latency_ms", 6)}
    )


@query(
    "A13_run_metrics",
    """WITH c AS (SELECT user_id AS run, event_type AS kind, count(*) AS n, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS t FROM events GROUP BY 1, 2)
    SELECT run, CAST(sum(n) AS BIGINT) AS events, CAST(sum(t) AS BIGINT) AS transitions, string_agg(kind || '=' || n, ',' ORDER BY kind) AS counters FROM c GROUP BY 1""",
)
def run_metrics(spark, sf):
    e = v.table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("kind"),
        F.col("event_type").isin("click", "view").alias("transition"),
    )
    entries = F.transform(F.array_sort(F.map_entries("counters")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return ops.run_metrics(e).withColumn("counters", F.array_join(entries, ","))


_RUN_EVENTS = f"""
re AS (SELECT user_id AS run, event_id AS seq, CASE WHEN user_id % 10 < 2 THEN (CASE event_type WHEN 'view' THEN 'lexical_reject' WHEN 'click' THEN 'lexical_reject' WHEN 'signup' THEN 'structural_reject' ELSE 'generation' END)
      WHEN user_id % 10 < 4 THEN (CASE event_type WHEN 'view' THEN 'structural_reject' WHEN 'click' THEN 'structural_reject' WHEN 'signup' THEN 'other' ELSE 'generation' END)
      WHEN user_id % 10 = 4 THEN (CASE event_type WHEN 'error' THEN 'generation' ELSE 'other' END)
      ELSE (CASE event_type WHEN 'view' THEN 'compile' WHEN 'error' THEN 'compile_error' WHEN 'click' THEN (CASE WHEN user_id % 3 = 0 THEN 'compile_passed' ELSE 'other' END) ELSE 'generation' END) END AS kind,
    CASE {_K} % 5 WHEN 0 THEN 'LEXICAL_REJECT' WHEN 1 THEN 'STRUCTURAL_REJECT' ELSE 'COMPILE' END AS state,
    CASE WHEN user_id % 4 = 0 AND event_type = 'purchase' THEN CASE {_K} % 4 WHEN 0 THEN 'harness_origin' WHEN 1 THEN 'pipeline_timeout' WHEN 2 THEN 'hard_stagnation' ELSE 'unlisted' END END AS abort_reason
  FROM events),
rc AS (SELECT run, count(*) FILTER (WHERE kind = 'lexical_reject') AS lexical_rejects, count(*) FILTER (WHERE kind = 'structural_reject') AS structural_rejects,
    count(*) FILTER (WHERE kind = 'generation') AS generations, count(*) FILTER (WHERE kind = 'compile') AS compiles, count(*) FILTER (WHERE kind = 'compile_error') AS compile_errors,
    bool_or(kind = 'compile_passed') AS compile_passed, arg_max(abort_reason, seq) FILTER (WHERE abort_reason IS NOT NULL) AS abort_reason, arg_max(state, seq) AS last_state
  FROM re GROUP BY 1)"""


@query(
    "A14_root_cause",
    f"""WITH {_RUN_EVENTS} SELECT *, CASE WHEN compiles = 0 AND generations > 0 AND lexical_rejects > 0 AND lexical_rejects >= generations THEN 'prose instead of source on every generation'
      WHEN compiles = 0 AND generations > 0 AND structural_rejects > 0 AND structural_rejects >= generations THEN 'every generation was structurally broken'
      WHEN compiles = 0 AND generations > 0 THEN 'a gate stopped every generation before the compiler'
      WHEN abort_reason = 'harness_origin' THEN 'every diagnostic points at the harness' WHEN abort_reason = 'pipeline_timeout' THEN 'time budget ran out before convergence'
      WHEN abort_reason = 'hard_stagnation' THEN 'the error set stopped shrinking'
      WHEN contains(last_state, 'LEXICAL') THEN 'last decision was a lexical rejection' WHEN contains(last_state, 'STRUCTURAL') THEN 'last decision was a structural rejection'
      WHEN compile_passed THEN 'no failure: it compiled' WHEN compile_errors > 0 THEN 'compile errors remain' ELSE 'no single cause' END AS cause,
    CASE WHEN abort_reason = 'harness_origin' THEN 'correct the harness specification' WHEN abort_reason = 'pipeline_timeout' THEN 'raise the time budget or narrow the input'
      WHEN compile_passed THEN 'verify the output' ELSE 'read the last raw response' END AS recommendation FROM rc""",
)
def root_cause(spark, sf):
    t, u = F.col("event_type"), F.col("user_id")
    other = F.lit("other")
    rejects = lambda a, b: F.when(t.isin("view", "click"), F.lit(a)).when(t == "signup", F.lit(b)).otherwise(F.lit("generation"))
    kind = (
        F.when(u % 10 < 2, rejects("lexical_reject", "structural_reject"))
        .when(u % 10 < 4, rejects("structural_reject", "other"))
        .when(u % 10 == 4, F.when(t == "error", F.lit("generation")).otherwise(other))
        .otherwise(
            F.when(t == "view", F.lit("compile"))
            .when(t == "error", F.lit("compile_error"))
            .when(t == "click", F.when(u % 3 == 0, F.lit("compile_passed")).otherwise(other))
            .otherwise(F.lit("generation"))
        )
    )
    five, four = _k() % 5, _k() % 4
    state = F.when(five == 0, F.lit("LEXICAL_REJECT")).when(five == 1, F.lit("STRUCTURAL_REJECT")).otherwise(F.lit("COMPILE"))
    abort = F.when(
        (u % 4 == 0) & (t == "purchase"),
        F.when(four == 0, F.lit("harness_origin")).when(four == 1, F.lit("pipeline_timeout"))
        .when(four == 2, F.lit("hard_stagnation")).otherwise(F.lit("unlisted")),
    )
    events = v.table(spark, sf, "events").select(
        u.alias("run"), F.col("event_id").alias("seq"), kind.alias("kind"), state.alias("state"), abort.alias("abort_reason")
    )
    return ops.root_cause(ops.run_counters(events))


_STEPS = f"""{v.ITERATIONS},
steps AS (SELECT run, iteration, errors_before, errors_after, run % 7 AS version FROM (
  SELECT run, iteration, lag(n_errors) OVER (PARTITION BY run ORDER BY iteration) AS errors_before, n_errors AS errors_after FROM iters) WHERE errors_before IS NOT NULL),
items AS (SELECT DISTINCT n.run, n.iteration, e.event_type || '-' || ({_K} % 4) AS item FROM numbered n JOIN events e ON e.user_id = n.run AND CAST(e.ts AS DATE) = n.day),
scores AS (SELECT item, CAST(sum(sign(errors_before - errors_after)) AS BIGINT) AS score, count(*) AS uses FROM items JOIN steps USING (run, iteration) GROUP BY 1)"""


def _steps(spark, sf):
    moved = running(
        v.iterations(spark, sf), ["run"], ["iteration"], F.floor(F.col("iteration") / 4096).cast("bigint"),
        previous={"errors_before": F.col("n_errors")},
    )
    return moved.filter("errors_before IS NOT NULL").select(
        "run", "iteration", "errors_before", F.col("n_errors").alias("errors_after"), (F.col("run") % 7).alias("version")
    )


def _items(spark, sf):
    e = v.table(spark, sf, "events")
    days = e.select(F.col("user_id").alias("run"), F.to_date("ts").alias("day")).distinct()
    numbered = running(
        days, ["run"], ["day"], F.date_trunc("year", "day"),
        sums={"iteration": F.lit(1).cast("bigint")}, exclusive=True,
    )
    used = e.select(
        F.col("user_id").alias("run"), F.to_date("ts").alias("day"),
        F.concat("event_type", F.lit("-"), _k() % 4).alias("item"),
    ).distinct()
    return used.join(numbered, ["run", "day"]).select("run", "iteration", "item")


@query("A16_item_scores", f"WITH {_STEPS} SELECT * FROM scores")
def item_scores(spark, sf):
    return ops.item_scores(_steps(spark, sf), _items(spark, sf))


@query(
    "A16_version_stats",
    f"""WITH {_STEPS} SELECT version, count(*) AS iterations, count(*) FILTER (WHERE errors_before > errors_after) AS wins,
      count(*) FILTER (WHERE errors_before < errors_after) AS losses, round(sum(errors_before - errors_after) / CAST(count(*) AS DOUBLE), 6) AS reward,
      round(count(*) FILTER (WHERE errors_before > errors_after) / CAST(greatest(count(*) FILTER (WHERE errors_before <> errors_after), 1) AS DOUBLE), 6) AS win_rate
    FROM steps GROUP BY 1""",
)
def version_stats(spark, sf):
    out = ops.version_stats(_steps(spark, sf))
    return out.withColumns({"reward": F.round("reward", 6), "win_rate": F.round("win_rate", 6)})


_TOP = "SELECT item, score, uses FROM scores ORDER BY score DESC, item LIMIT 5"


@query("K2_top_items", f"WITH {_STEPS} {_TOP}")
def top_items(spark, sf):
    return ops.top_items(ops.item_scores(_steps(spark, sf), _items(spark, sf)))


@query(
    "K2_evolve_items",
    f"""WITH {_STEPS}, cl AS (SELECT run % 7 AS version, item, min(event_id) AS position FROM (SELECT user_id AS run, event_id, event_type || '-' || ({_K} % 4) AS item FROM events) GROUP BY 1, 2),
    sc AS (SELECT cl.*, coalesce(s.score, 0) AS score FROM cl LEFT JOIN scores s USING (item)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY score DESC, position) AS place, count(*) OVER (PARTITION BY version) AS n FROM sc),
    kept AS (SELECT version, 0 AS part, place AS o, item, score FROM rk WHERE NOT (n >= 2 AND place > n - 2 AND score < 0)),
    words(keyword_no, word, item) AS (VALUES (0, 's3', 'add s3'), (1, 'odd 2', 'add odd'), (2, 'h9', 'add h9'), (3, 't1', 'view-1')),
    hits AS (SELECT DISTINCT e.run % 7 AS version, w.item, w.keyword_no FROM err_log e JOIN words w ON contains(e.raw, w.word)),
    fresh AS (SELECT version, 1 AS part, keyword_no AS o, item, 0 AS score FROM hits WHERE (version, item) NOT IN (SELECT version, item FROM kept)),
    allr AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)
    SELECT version, row_number() OVER (PARTITION BY version ORDER BY part, o) AS place, item, CAST(score AS BIGINT) AS score FROM allr""",
)
def evolve_items(spark, sf):
    scores = ops.item_scores(_steps(spark, sf), _items(spark, sf))
    checklist = v.table(spark, sf, "events").groupBy(
        (F.col("user_id") % 7).alias("version"), F.concat("event_type", F.lit("-"), _k() % 4).alias("item")
    ).agg(F.min("event_id").alias("position"))
    words = (("s3", "add s3"), ("odd 2", "add odd"), ("h9", "add h9"), ("t1", "view-1"))
    log = v.err_log(spark, sf).withColumn("version", F.col("run") % 7)
    return ops.evolve_items(checklist, scores, ops.keyword_items(log, words, "version"))


_HEALTH = """
h AS (SELECT user_id AS provider, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS timeouts,
    count(*) FILTER (WHERE event_type = 'view') AS malformed, count(*) FILTER (WHERE event_type = 'purchase') AS extraction_ok,
    CAST(sum(event_id % 1000) AS BIGINT) AS latency_ms FROM events GROUP BY 1),
health AS (SELECT *, round((timeouts + malformed) / CAST(attempts AS DOUBLE), 6) AS failure_rate FROM h)"""


def _health(spark, sf):
    t = F.col("event_type")
    failure = (
        F.when(t == "error", F.lit("api_timeout")).when(t == "view", F.lit("invalid_json")).when(t == "click", F.lit("http_error"))
    )
    attempts = v.table(spark, sf, "events").select(
        F.col("user_id").alias("provider"), failure.alias("failure"), (F.col("event_id") % 1000).alias("latency_ms"),
        (t == "purchase").alias("extraction_ok"),
    )
    return ops.provider_health(attempts).withColumn("failure_rate", F.round("failure_rate", 6))


@query("A17_provider_health", f"WITH {_HEALTH} SELECT * FROM health")
def provider_health(spark, sf):
    return _health(spark, sf)


@query(
    "K3_rank_providers",
    f"WITH {_HEALTH} SELECT provider, failure_rate, row_number() OVER (ORDER BY failure_rate, provider) AS place FROM health",
)
def rank_providers(spark, sf):
    return ops.rank_providers(_health(spark, sf), "provider").select("provider", "failure_rate", "place")


@query(
    "K3_rank_fixes",
    f"""WITH {v.ERR_LOG}, f AS (SELECT run, event_id AS position, CASE WHEN event_id % 3 = 0 THEN NULL WHEN contains(lower(raw), 'odd') THEN 99 ELSE event_id % 9 + 10 END AS priority FROM err_log)
    SELECT run, position, row_number() OVER (PARTITION BY run ORDER BY coalesce(priority, 99), position) AS place FROM f""",
)
def rank_fixes(spark, sf):
    text = F.replace("raw", F.lit("something odd"), F.lit("Warning: odd"))
    fixes = v.err_log(spark, sf).select(
        "run", F.col("event_id").alias("position"),
        F.when(F.col("event_id") % 3 != 0, ops.raw_error_priority(F.col("event_id") % 9, text)).alias("priority"),
    )
    return ops.rank_fixes(fixes).select("run", "position", "place")


@query(
    "W4_state_trace",
    """SELECT user_id AS run, event_id AS seq, event_type AS state, row_number() OVER w AS "index", lag(event_type) OVER w AS previous_state,
      date_diff('microsecond', lag(ts) OVER w, ts) / 1000.0 AS elapsed_ms, date_diff('microsecond', first_value(ts) OVER w, ts) / 1000.0 AS since_start_ms
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def state_trace(spark, sf):
    e = v.table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("state")
    )
    return ops.state_trace(e, F.to_date("ts"), held=True).drop("ts")


_PACK = """
p AS (SELECT source, doc_id, n_chars, 40 + sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id) - 1 AS running_length FROM documents)"""


@query(
    "W6_pack",
    f"WITH {_PACK} SELECT source, doc_id, n_chars, CAST(running_length AS BIGINT) AS running_length, running_length <= 20000 AS kept FROM p",
)
def pack(spark, sf):
    docs = v.table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return ops.pack(docs, 20000, ["source"], "doc_id", "n_chars", header=40, rows_per_chunk=256, held=True)


@query(
    "W6_pack_summary",
    f"""WITH {_PACK} SELECT source, count(*) FILTER (WHERE running_length <= 20000) AS kept, count(*) FILTER (WHERE NOT running_length <= 20000) AS omitted FROM p GROUP BY 1""",
)
def pack_summary(spark, sf):
    docs = v.table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return ops.pack_summary(ops.pack(docs, 20000, ["source"], "doc_id", "n_chars", header=40, held=True), ["source"])


@query(
    "W7_best_attempt",
    """SELECT o_custkey AS run, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def best_attempt(spark, sf):
    o = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"), F.struct("o_orderdate", "o_orderkey").alias("iteration"), "o_orderkey",
        (F.col("o_orderstatus") == "F").alias("compiled"),
    )
    return ops.best_attempt(o).select("run", "o_orderkey")


_WORDS = (("clown", "insult"), ("License", "licence"), ("@", "mail"), ("token", "secret"), ("###", "noise"))


@query(
    "J12_expand_items",
    f"""WITH words(keyword_no, word, item) AS (VALUES {', '.join(f"({i}, '{w}', '{item}')" for i, (w, item) in enumerate(_WORDS))}),
    have AS (SELECT DISTINCT source AS run, CASE WHEN doc_id % 2 = 0 THEN 'mail' ELSE 'noise' END AS item FROM documents WHERE doc_id % 31 = 0)
    SELECT DISTINCT d.source AS run, w.item, CAST(w.keyword_no AS INTEGER) AS keyword_no FROM documents d JOIN words w ON contains(d.text, w.word)
    WHERE (d.source, w.item) NOT IN (SELECT run, item FROM have)""",
)
def expand_items(spark, sf):
    docs = v.table(spark, sf, "documents")
    texts = docs.select(F.col("source").alias("run"), F.col("text").alias("raw"))
    have = docs.filter("doc_id % 31 = 0").select(
        F.col("source").alias("run"), F.when(F.col("doc_id") % 2 == 0, F.lit("mail")).otherwise(F.lit("noise")).alias("item")
    )
    return ops.expand_items(texts, _WORDS, have)


@query(
    "J13_pending",
    f"""SELECT event_id AS path, ts AS mtime, {_K} AS size FROM events
      WHERE NOT (event_id % 10 < 8 AND event_id % 7 <> 0)""",
)
def pending(spark, sf):
    listing = v.table(spark, sf, "events").select(F.col("event_id").alias("path"), F.col("ts").alias("mtime"), _k().alias("size"))
    changed = F.when(F.col("path") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))
    return ops.pending(listing, listing.filter("path % 10 < 8").withColumn("size", changed))


@query(
    "J14_apply_overrides",
    """SELECT d.doc_id AS path, coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN CASE WHEN l.toxic = 1 THEN 'bad' END END,
        CASE WHEN d.n_chars > 2000 THEN 'good' ELSE 'bad' END) AS label,
      l.doc_id IS NOT NULL AND (l.quality = 1 OR l.toxic = 1) AS overridden FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def apply_overrides(spark, sf):
    computed = v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("path"), F.when(F.col("n_chars") > 2000, F.lit("good")).otherwise(F.lit("bad")).alias("label")
    )
    by_hand = v.table(spark, sf, "labels").select(
        F.col("doc_id").alias("path"),
        F.when(F.col("quality") == 1, F.lit("good")).when(F.col("toxic") == 1, F.lit("bad")).otherwise(F.lit("unsure")).alias("label"),
    )
    return ops.apply_overrides(computed, by_hand, "path", "label", ["good", "bad"])


@query(
    "J14_merge_generated",
    """SELECT p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'hand' WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END AS origin,
      p_partkey % 3 <> 0 AS auto_generated FROM part""",
)
def merge_generated(spark, sf):
    p = v.table(spark, sf, "part").select(F.col("p_partkey").alias("name"))
    existing = p.withColumn("origin", F.when(F.col("name") % 3 == 0, F.lit("hand")).otherwise(F.lit("old"))).withColumn(
        "auto_generated", F.when(F.col("name") % 3 != 0, F.lit(True))
    )
    generated = p.filter("name % 2 = 0").withColumn("origin", F.lit("new")).withColumn("auto_generated", F.lit(True))
    out = ops.merge_generated(existing, generated, "name")
    return out.withColumn("auto_generated", F.coalesce("auto_generated", F.lit(False)))


@query(
    "K2_next_version",
    "SELECT DISTINCT 'v' || user_id || '_' || event_type AS version, 'v' || (user_id + 1) AS next_version FROM events",
)
def next_version(spark, sf):
    versions = v.table(spark, sf, "events").select(
        F.concat(F.lit("v"), "user_id", F.lit("_"), "event_type").alias("version")
    ).distinct()
    return versions.withColumn("next_version", ops.next_version(F.col("version")))


@query(
    "S7_slug",
    r"""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9_.\-]+', '_', 'g'),
      '^_+|_+$', '', 'g'), ''), 'unnamed') AS slug FROM part""",
)
def slug_names(spark, sf):
    name = F.concat("p_name", F.lit(" / "), "p_type")
    return v.table(spark, sf, "part").select("p_partkey", slug(name).alias("slug"))
