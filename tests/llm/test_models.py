"""Quality rules, toxicity and quality classifier: measures by brute force, verdicts by held-out labels."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulant.llm.quality_classifier import _KIND, FEATURES, KINDS, Network, fit as fit_network, passages, quality_classifier, spread
from rivulant.llm.quality_rules import MEASURES, fit_accuracies, measure, quality_filter, quality_rules
from rivulant.llm.toxicity import bucket_counts, evidence, fit, grams, toxicity

SF = "/root/testdata/sf0.1"
LINES = ["", "a", "a b c", "a b c a b c", "x\nx\n \n\x0b\nx", "É ü\tÉ ü é #$%&|<>*", "one two three four " * 3, "AB!! C1!", "x " * 400]


def slow(text):
    words = text.encode().split()
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {p for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    chars = b"".join(words).decode()
    return {
        "n_words": len(words), "word_chars": len(chars), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_lines": len(lines),
        "n_upper": sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in chars), "n_bangs": chars.count("!"), "n_distinct": len(set(words)),
    }


def test_measures():
    rng = np.random.default_rng(1)
    for text in LINES + [" ".join(rng.choice(["a", "b", "c", "d\n"], 60)) for _ in range(50)]:
        got = dict(zip(MEASURES, measure(text.encode())))
        for name, value in slow(text).items():
            assert got[name] == value, (name, text)


def test_accuracies_are_found():
    rng = np.random.default_rng(4)
    good = rng.random(20000) < 0.9
    votes = np.stack([np.where(good, np.where(rng.random(20000) < 0.01, -1, 1), np.where(rng.random(20000) < hit, -1, 1))
                      for hit in (0.9, 0.8, 0.7)] + [np.zeros(20000, int)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, chances = fit_accuracies(patterns, counts)
    assert prior == pytest.approx(0.9, abs=0.02)
    assert chances[:3, 0, 0] == pytest.approx([0.9, 0.8, 0.7], abs=0.05)
    assert fit_accuracies(np.zeros((0, 4), int), np.zeros(0, int))[0] == 0.9


def odd(spark):
    rows = [(1, None, "p", 1), (2, "", "q", 2), (None, "x " * 60, "r", 3), (4, " ".join(f"word{i}" for i in range(120)), "s", 4)]
    return spark.createDataFrame(rows * 2, "doc_id long, text string, posterior string, n_words int")


def test_rules_on_odd_rows(spark):
    df = odd(spark)
    rows = quality_rules(df).collect()
    assert Counter((r.doc_id, r.base_failed) for r in rows) == Counter({(1, True): 2, (2, True): 2, (None, True): 2, (4, False): 2})
    kept = quality_filter(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 4]
    assert quality_rules(df.limit(0)).count() == 0 and quality_filter(df.limit(0)).count() == 0


def test_rules_reject_the_bad_and_keep_the_clean(spark):
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    by = quality_rules(docs).filter("NOT base_failed").join(marks, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")))
    shares = dict(by.collect())
    assert shares[1] > 0.99 and shares[0] < 0.05


def test_grams_are_distinct_and_bounded():
    text = ("Some TEXT\twith\nblanks é " * 300).encode()
    whole = grams(text)
    assert (np.diff(whole.astype(np.int64)) > 0).all()
    assert grams(text, block=64).tolist() == whole.tolist()
    assert grams(b"A\nb").tolist() == grams(b"a b").tolist()
    wanted = np.zeros(1 << 20, bool)
    wanted[whole[::2]] = True
    assert grams(text, wanted=wanted).tolist() == whole[::2].tolist()


def test_one_class_only():
    assert 0 < fit([grams(b"a")], np.array([1]), np.ones(1)).score(b"b") < 1
    assert 0 < fit([], np.zeros(0, int), np.zeros(0)).score(b"") < 1
    assert 0 < fit_network([], np.zeros(0, int), np.zeros(0)).score(b"")[0] < 1


def scored(df, marks, label):
    rows = df.join(marks, "doc_id").filter("held_out").select(F.col(label).alias("y"), "score", "predicted").collect()
    y, s, p = (np.array([r[i] for r in rows]) for i in range(3))
    order = np.argsort(np.argsort(s))
    ones = y.sum()
    auc = (order[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))
    return auc, p[y == 1].mean(), p[y == 0].mean()


def test_toxicity_held_out(spark):
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    auc, caught, wrong = scored(toxicity(docs, marks), marks, "toxic")
    assert auc > 0.95 and caught > 0.75 and wrong < 0.03


def test_quality_held_out(spark):
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    auc, kept, passed = scored(quality_classifier(docs, marks), marks, "quality")
    assert auc > 0.98 and kept > 0.99 and passed < 0.1


@pytest.mark.parametrize("model, parts, part", [(toxicity, 4, 2), (quality_classifier, 5, 0)])
def test_classifiers_on_odd_rows(spark, model, parts, part):
    df = odd(spark)
    marks = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (2, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    rows = model(df, marks).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == part)
    assert model(df.limit(0), marks).count() == 0
    assert model(df, marks.limit(0)).count() == 8


def test_labels_of_the_held_out_part_are_not_learned(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity(docs, m).orderBy("doc_id").collect() for m in (marks, turned))
    assert a == b


def test_gradient():
    rng = np.random.default_rng(0)
    rows = [rng.normal(size=(n, 5)) for n in (1, 3, 2)]
    net = Network(np.zeros(5), np.ones(5))
    net.p = {"w": rng.normal(size=(5, 4)), "wb": rng.normal(size=4), "v": rng.normal(size=(4, 3)), "vb": rng.normal(size=3),
             "u": rng.normal(size=(4, 3)), "ub": rng.normal(size=3), "a": rng.normal(size=3), "c": rng.normal(size=4), "cb": np.zeros(1)}
    x, bag, y = np.concatenate(rows), np.array([0, 1, 1, 1, 2, 2]), np.array([1, 0, 1])

    def loss():
        s = net.forward(x, bag, 3)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum()

    f = net.forward(x, bag, 3)
    for k, g in net.gradient(x, bag, f, f["score"] - y).items():
        flat, got = net.p[k].reshape(-1), np.asarray(g).reshape(-1)
        for i in range(len(flat)):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            assert (up - loss()) / 2e-6 == pytest.approx(got[i], abs=1e-4)
            flat[i] = old


def test_long_text_goes_through_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abc DE|!\n"), 3000).tolist()) for _ in range(6)]
    net = fit_network([passages(t) for t in texts], np.array([0, 1] * 3), np.ones(6), epochs=1)
    whole = [net.score(t) for t in texts]
    monkeypatch.setattr("rivulant.llm.quality_classifier.BLOCK_PASSAGES", 2)
    for (a, _, n), (b, _, m) in zip(whole, map(net.score, texts)):
        assert n == m and a == pytest.approx(b, abs=1e-6)


def slow_grams(text, sizes=(4, 5, 6), bits=20):
    """Every n-gram of characters on its own."""
    low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else " " if c in "\t\n\x0b\x0c\r" else c for c in f" {text} ")
    out = set()
    for size in sizes:
        for i in range(len(low) - size + 1):
            h = 0
            for step, c in enumerate(low[i : i + size], 1):
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (ord(c) + step & 0xFFFFFFFF)
            h = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
            h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
            out.add(h >> 32 - bits)
    return sorted(out)


@pytest.mark.parametrize("text", ["", "a", "Ab\tC d", "naïve Größe ÄÖÜ", "токсичный текст и ещё", "有毒的文本也是如此", "mixed 😀 emoji 😀 text", "x" * 50])
def test_grams_of_characters(text):
    want = slow_grams(text)
    assert grams(text.encode()).tolist() == want
    for block in (1, 3, 7):
        assert grams(text.encode(), block=block).tolist() == want


def test_counts_in_tasks_choose_the_same_buckets(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["good", "nice", "vile", "é", "bad"], 30)) for _ in range(60)]
    target = np.array([int("vile bad" in t) for t in texts])
    df = spark.createDataFrame(list(zip(target.tolist(), texts)), "target int, text string")
    seen, toxic = bucket_counts(df, (4, 5, 6), 16)
    want = np.zeros((2, 1 << 16), int)
    for t, y in zip(texts, target):
        want[0][slow_grams(t, bits=16)] += 1
        want[1][slow_grams(t, bits=16)] += y
    assert (seen == want[0]).all() and (toxic == want[1]).all()
    rows = [grams(t.encode(), bits=16) for t in texts]
    whole = fit(rows, target, np.ones(60), bits=16, features=50)
    assert whole.buckets.tolist() == evidence(seen, toxic, 60, int(target.sum()), 50, 1.0).kept.tolist()


def slow_passages(data, size=512):
    """The features of each passage, counted byte by byte."""
    out = []
    for lo in range(0, max(1, len(data)), size):
        part = data[lo : lo + size]
        n, row = max(1, len(part)), [0.0] * FEATURES
        kinds = [int(_KIND[b]) for b in part]
        for a, b in zip(kinds, kinds[1:]):
            row[a * KINDS + b] += 1 / n
        for k in kinds:
            row[KINDS * KINDS + k] += 1 / n
        blanks = sum(k in (3, 4, 5) for k in kinds)
        quads = [part[i : i + 4] for i in range(len(part) - 3)]
        row[-4:] = n / size, (n - blanks) / (blanks + 1) / 16, (len(quads) - len(set(quads))) / n, len(data) / (len(data) + 2000)
        out.append(row)
    return np.sqrt(np.array(out))


def test_passages_by_hand():
    rng = np.random.default_rng(7)
    for n in (0, 1, 3, 4, 511, 512, 513, 1500):
        data = bytes(rng.choice(list("aZ5 .\n|é#".encode()), n).astype(np.uint8))
        assert passages(data) == pytest.approx(slow_passages(data), abs=2e-3)
    rows = np.arange(100)[:, None]
    assert spread(rows, 5).ravel().tolist() == [0, 25, 50, 74, 99] and len(spread(rows, 200)) == 100


def test_posterior_in_spark_equals_plain_votes(spark):
    """kept and posterior of every row, worked out from the measures by hand with a plain EM over all texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = quality_rules(docs).collect()

    def cast(r):
        w, letters = r.n_words, r.word_chars
        v = lambda good, bad: -1 if bad else 1 if good else 0
        return {
            "symbols": v(w > 0 and r.n_symbols * 100 <= w, w > 0 and r.n_symbols * 10 > w),
            "repetition": v(w >= 50 and r.n_repeat_words * 10 <= w, w > 0 and r.n_repeat_words * 10 > w * 3),
            "symbol_density": v(w > 0 and r.n_symbols * 200 <= letters, w > 0 and r.n_symbols * 50 > letters),
        }

    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.posterior >= 0.5)
    passing = [r for r in rows if not r.base_failed]
    worse = [r for r in passing if any(x < 0 for x in cast(r).values())]
    better = [r for r in passing if all(x > 0 for x in cast(r).values())]
    assert better and np.mean([r.posterior for r in better]) > 0.9
    if worse:
        assert np.mean([r.posterior for r in worse]) < np.mean([r.posterior for r in better])


def test_posterior_follows_bayes():
    rng = np.random.default_rng(11)
    patterns = rng.integers(-1, 2, (40, 3))
    counts = rng.integers(1, 50, 40)
    prior, chances = fit_accuracies(patterns, counts)
    for row in patterns:
        bad, good = 1 - prior, prior
        for rule, vote in enumerate(row):
            bad, good = bad * chances[rule, 0, vote + 1], good * chances[rule, 1, vote + 1]
        logit = np.log(prior / (1 - prior)) + sum(np.log(chances[i, 1, v + 1] / chances[i, 0, v + 1]) for i, v in enumerate(row))
        assert 1 / (1 + np.exp(-logit)) == pytest.approx(good / (good + bad))
