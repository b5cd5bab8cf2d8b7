"""Store merge: sequential fold as the reference, any split of the batch, load of damaged rows."""

import random

import pytest

from rivulant.operators import store as ops
from rivulant.plans.scratch import settle
from rivulant.sources.store import RAW_COLUMNS, load_store

BATCH = (
    "signature string, seq bigint, negative boolean, fix string, confidence double, llm_time_s double, "
    "verified boolean, metadata map<string,string>, error string"
)


def fold(rows):
    """Row by row, as a plain loop."""
    store = {}
    for sig, _, negative, fix, conf, _, verified, meta, error in sorted(rows, key=lambda r: r[1]):
        if not sig:
            continue
        e = store.get(sig)
        if negative:
            e = store.setdefault(sig, {"fix": "", "conf": 0.0, "ver": False, "fail": 0, "meta": {}})
            e["fail"] += 1
            if error:
                e["meta"]["last_error"] = error
        elif e is None:
            store[sig] = {"fix": fix, "conf": conf, "ver": verified, "fail": 0, "meta": dict(meta)}
        elif e["ver"] and not verified:
            continue
        elif (verified and not e["ver"]) or conf >= e["conf"]:
            e.update(fix=fix, conf=conf, ver=verified or e["ver"])
            e["meta"].update(meta)
    return store


def batch(seed, n=300, keys=5):
    rng = random.Random(seed)
    return [
        (
            rng.choice(["", *["s%d:HIGH" % i for i in range(keys)]]), i, rng.random() < 0.25, "f%d" % i,
            round(rng.random(), 2), 1.0, rng.random() < 0.5, {"k%d" % rng.randrange(3): "v%d" % i},
            rng.choice(["", "e%d" % i]),
        )
        for i in range(n)
    ]


def as_dict(df):
    return {
        r.signature: {"fix": r.verified_fix, "conf": r.confidence, "ver": r.verified, "fail": r.failure_count, "meta": r.metadata}
        for r in df.collect()
    }


@pytest.mark.parametrize("seed", range(4))
def test_merge_equals_fold(spark, seed):
    rows = batch(seed)
    got = as_dict(ops.merge_store(None, spark.createDataFrame(rows, BATCH), seq_per_chunk=17))
    assert got == fold(rows)


def test_any_split_gives_the_same_store(spark):
    rows = batch(9)
    whole = as_dict(ops.merge_store(None, spark.createDataFrame(rows, BATCH)))
    store = None
    for part in (rows[:70], rows[70:71], rows[71:200], rows[200:]):
        store = settle(ops.merge_store(store, spark.createDataFrame(part, BATCH)))
    assert as_dict(store) == whole


def test_lookup_serves_verified_fixes_only(spark):
    store = spark.createDataFrame(
        [
            ("a:HIGH", "1", "fix", 0.9, 0.0, 0, 0, True, {}),
            ("b:HIGH", "2", "", 0.0, 0.0, 0, 2, False, {}),
            ("c:HIGH", "3", "draft", 0.9, 0.0, 0, 0, False, {}),
        ],
        ops.STORE_SCHEMA,
    )
    asked = spark.createDataFrame([(i, s) for i, s in enumerate(["a:HIGH", "b:HIGH", "c:HIGH", "", "a:HIGH"])], "path int, signature string")
    found = ops.lookup(asked, store)
    assert {r.path for r in found.filter("hit").collect()} == {0, 4}
    counts = {r.signature: r.times_retrieved for r in ops.count_retrievals(store, found).collect()}
    assert counts == {"a:HIGH": 2, "b:HIGH": 0, "c:HIGH": 0}
    stats = ops.store_stats(store, found).first()
    assert (stats.entries, stats.served_entries, stats.hits, stats.misses, stats.hit_rate) == (3, 1, 2, 3, 0.4)
    assert stats.avg_confidence == 0.6


def test_parse_is_the_inverse_of_serialize(spark):
    df = spark.createDataFrame([("b:HIGH|a:LOW",), ("",), ("a:weird|a:weird",)], "k string")
    got = [[tuple(p) for p in r.p] for r in df.select(ops.parse_signature(df.k).alias("p")).collect()]
    assert got == [[("a", "LOW"), ("b", "HIGH")], [], [("a", "UNKNOWN")]]


def test_damaged_store_rows_are_skipped(spark, tmp_path):
    rows = [
        ("a:HIGH", "", "fix", "0.5", "", "2", "", "", '{"k": "v"}'),
        ("b:HIGH", "", "fix", "broken", "", "", "", "1", "{}"),
        ("", "", "fix", "0.5", "", "", "", "1", "{}"),
        ("c:HIGH", "", "fix", "0.5", "", "", "", "0", "{broken"),
        ("d:HIGH", "id", None, None, None, None, None, "0", "[1]"),
    ]
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    path = str(tmp_path / "s")
    spark.createDataFrame(rows, schema).write.option("header", "true").option("escape", '"').csv(path)
    got = {r.signature: r for r in load_store(spark, path).collect()}
    assert set(got) == {"a:HIGH", "d:HIGH"}
    assert got["a:HIGH"].verified and got["a:HIGH"].metadata == {"k": "v"} and len(got["a:HIGH"].sig_id) == 16
    assert not got["d:HIGH"].verified and got["d:HIGH"].metadata == {} and got["d:HIGH"].verified_fix == ""
