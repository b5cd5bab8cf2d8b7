"""The pipeline against a plain version of its stages, and the registered queries against their SQL."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from check import compare, duck
from test_dedup import LOW, classes
from test_mixing import shared_out

import corpus_pipeline
from rivulant.llm.registry import ORACLES, QUERIES
from rivulant.llm.sentencepiece_codec import DEFAULT_MODEL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"word{x}" for x in rng.integers(0, 9000, n))
    rows = [(i, text(int(rng.integers(60, 200)))) for i in range(60)]
    rows += [(100 + i, rows[i][1].upper()) for i in range(10)] + [(200 + i, rows[20][1]) for i in range(5)]
    rows += [(300 + i, rows[30 + i][1] + " tail") for i in range(8)]
    rows += [(400 + i, " ".join(f"w{x}#$%" for x in rng.integers(0, 9000, 90))) for i in range(9)]
    rows += [(500, None), (501, ""), (502, "too short"), (503, "on and " * 60), (10, rows[10][1])]
    docs = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "extra") for i, t in rows]
    path = str(tmp_path_factory.mktemp("tables"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    return path, [(d[0], d[1], d[3]) for d in docs]


def plain(docs):
    """Rejects what was planted as bad, then groups, mixes and tokenises in loops."""
    docs = [d for d in docs if d[0] < 400]
    groups = defaultdict(list)
    for d in docs:
        groups[d[1].translate(LOW)].append(d)
    docs = [max(g, key=lambda d: d[0]) for g in groups.values()]
    least = classes([(d[0], d[1]) for d in docs])
    docs = [d for d, (_, _, first) in zip(docs, least) if d[0] == first]
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[2]] += len(d[1].split())
    goals, out = shared_out(sizes), []
    for source, goal in goals.items():
        own = sorted((d for d in docs if d[2] == source), key=lambda d: hashlib.md5(f"mix:{d[0]}".encode()).hexdigest())
        left = int(goal + 0.5)
        for d in own + own:
            words = d[1].split()[:left]
            left -= len(words)
            if words:
                out.append((d[0], source, " ".join(words)))
    library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    return Counter((i, s, str(library.encode(t))) for i, s, t in out)


def test_pipeline(spark, folder):
    path, docs = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
    assert Counter((r.doc_id, r.source, str(r.token_ids)) for r in got) == plain(docs)


def test_training_order_reaches_the_end(spark, folder):
    """position is the place in the mix's order, pass counts a document's turns in that order."""
    from pyspark.sql import functions as F

    from rivulant.llm.mixing import mix
    from rivulant.plans.scratch import scratch_path

    path, docs = folder, spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = scratch_path(spark, "stage")
        stage(spark, docs, path[0]).write.parquet(out)
        docs = spark.read.parquet(out)
    takes = mix(docs).select("doc_id", F.explode("positions").alias("p")).select("doc_id", "p.position", "p.pass").collect()
    want = [(r.doc_id, r["pass"]) for r in sorted(takes, key=lambda r: (r.position, r.doc_id))]
    rows = sorted(corpus_pipeline.run(spark, path[0]).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.doc_id, r["pass"]) for r in rows] == want and max(r["pass"] for r in rows) == 2


def test_rows_without_files_have_no_place(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    row = corpus_pipeline.tokens(spark, df, "").first()
    assert row.position is None and row["pass"] is None and row.round_trip


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), folder[0])
        assert empty.columns == docs.columns and empty.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    _, issues = compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name])
    assert not issues


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_row_per_document(spark, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
