"""The dedup operators against plain Python over small tables with odd rows."""

import hashlib
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rivulant.llm.common import restrict, text_hash
from rivulant.llm.components import components
import rivulant.llm.exact_dedup as module
from rivulant.llm.exact_dedup import build_filter, digest_of, exact_dedup, load_snapshot, meet, probe_filter, save_snapshot
from rivulant.llm.line_dedup import line_dedup
from rivulant.llm.simhash import representatives, simhash, simhash_groups
import rivulant.llm.substring_dedup as substring
from rivulant.llm.substring_dedup import substring_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, pairs):
    """Documents with further columns whose names the operators use themselves."""
    rows = [(i, t, "s", 1, True, "b") for i, t in pairs]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n int, kept boolean, batch string")


ODD = [(None, None), (1, ""), (2, None), (3, "A b"), (4, "a B"), (4, "a B"), (5, "É a"), (6, "é a"), (7, "x " * 5000), (None, "x " * 5000)]


def test_filter_has_all_keys_and_few_others():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 1000, 60000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        built = build_filter(keys)
        assert probe_filter(keys, *built).all()
        others = rng.integers(0, 2**63, 20000).astype(np.uint64)
        assert probe_filter(others, *built).mean() < 0.002


@pytest.mark.parametrize("bucket_keys", [3, 200_000])
def test_exact(spark, bucket_keys):
    pairs = ODD + [(100 + i, f"T{i % 37} same".upper() if i % 2 else f"t{i % 37} same") for i in range(200)]
    got = exact_dedup(table(spark, pairs), bucket_keys=bucket_keys).collect()
    groups = defaultdict(list)
    for i, t in pairs:
        groups[(t or "").translate(LOW)].append(i)
    want = []
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).digest()
        first = True
        for i in sorted(ids, key=lambda i: i is None):
            want.append((i, top, len(ids), i == top and first, sha))
            first = first and i != top
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in got) == Counter(want)


def test_exact_empty_and_one_batch(spark):
    assert exact_dedup(table(spark, [])).count() == 0
    for batch in (0, 1):
        rows = exact_dedup(table(spark, [(1, "a"), (2, "A")]), batch=F.lit(batch)).collect()
        assert sorted((r.doc_id, r.kept) for r in rows) == [(1, False), (2, True)]


def test_the_filter_decides_who_meets_the_snapshot(spark, monkeypatch):
    """Without positives no new text finds its stored copy; with all as positives the answer is the same as with the filter."""
    pairs = [(i, f"text {i % 20}") for i in range(80)] + [(200 + i, f"own {i}") for i in range(300)]
    df, late = table(spark, pairs), F.when(F.col("doc_id") % 80 < 20, 0).otherwise(1)
    sizes = lambda: {r.doc_id: r.group_size for r in exact_dedup(df, batch=late).collect()}
    right = sizes()
    assert right[0] == right[79] == 4 and right[200] == 1
    real, reached = module.screen, []

    def counted(entries, filters):
        out = real(entries, filters)
        reached.append((entries.count(), out.count()))
        return out

    monkeypatch.setattr(module, "screen", counted)
    assert sizes() == right
    arrived, passed = reached[0]
    assert passed < arrived / 2  # own texts of the new batch never reach the bucket join
    monkeypatch.setattr(module, "screen", lambda entries, filters: entries.select("bucket", "digest"))
    assert sizes() == right
    monkeypatch.setattr(module, "screen", lambda entries, filters: entries.select("bucket", "digest").filter("false"))
    apart = sizes()
    assert apart[0] == 1 and apart[79] == 3 and apart[200] == 1


def test_a_snapshot_serves_later_batches(spark, tmp_path):
    docs = table(spark, [(1, "a"), (2, "A"), (3, "b"), (10, "a"), (11, "c"), (12, "C"), (13, "B")])
    rows = docs.select("doc_id", digest_of(F.col("text")).alias("digest"))
    groups = lambda some: rows.filter(some).groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    save_snapshot(groups("doc_id < 10"), f"{tmp_path}/s", bucket_keys=1)
    snapshot = load_snapshot(spark, f"{tmp_path}/s")
    assert snapshot.buckets == 2 and snapshot.filters.count() <= 2
    for some, want in (("doc_id = 10", {(2, 2, 10, 1)}), ("doc_id > 10", {(3, 1, 13, 1)}), ("doc_id = 11", set())):
        found = meet(groups(some), snapshot, docs).collect()
        assert {(r.old_id, r.old_n, r.new_id, r.new_n) for r in found} == want


def test_restrict_keeps_one_of_equal_rows(spark):
    df = table(spark, ODD)
    kept = exact_dedup(df).filter("kept").select("doc_id", "digest")
    out = restrict(df, kept, {"doc_id": F.col("doc_id"), "digest": digest_of(F.col("text"))})
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 6, 7]


def lines_of(pairs, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holds = defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            holds[key(line)].add(i)
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(holds[key(x)]) >= min_docs)]
        yield i, "\n".join(kept), len(lines), len(lines) - len(kept)


def test_lines(spark):
    pairs = ODD + [(50 + i, f"Common Line\n \tcommon line\x0b\n\nown {i}\n{'rare' if i < 9 else 'x'}\n") for i in range(12)]
    got = line_dedup(table(spark, pairs)).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == Counter(lines_of(pairs, 10))
    assert line_dedup(table(spark, [])).count() == 0


def windows_of(pairs, window):
    words = [(t or "").encode().split() for _, t in pairs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for (i, _), w in zip(pairs, words):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        yield i, b" ".join(x for x, g in zip(w, gone) if not g).decode(), len(w), sum(gone)


@pytest.mark.parametrize("shard_bytes", [500, 1 << 22])
def test_substrings(spark, shard_bytes):
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared, longer = fresh(60), fresh(200)
    pairs = ODD[:6] + [(20 + i, f"{fresh(30)}  {shared}\n{fresh(int(rng.integers(0, 40)))}") for i in range(12)]
    pairs += [(40, longer), (41, longer), (42, longer.replace("w", "v", 1)), (43, "la " * 90), (44, longer[:400]), (45, fresh(34))]
    pairs += [(46, " ".join(longer.split()[:34])), (47, " ".join(longer.split()[20:56])), (48, "é ü " * 40), (49, f"{shared} {shared}")]
    got = substring_dedup(table(spark, pairs), shard_bytes=shard_bytes).collect()
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in got) == Counter(windows_of(pairs, 35))


def test_positions_come_from_the_automaton(spark, monkeypatch):
    """Documents in which the automaton finds nothing keep all their words; with half the phrases some are found."""
    from pyspark import cloudpickle

    rng = np.random.default_rng(12)
    shared = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(6)]
    df = table(spark, [(i, f"own{i} {shared[i % 6]} end{i}") for i in range(12)])
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    real = substring.locate
    removed = lambda: substring_dedup(df).agg(F.sum("n_removed")).first()[0]
    assert removed() == 12 * 40
    monkeypatch.setattr(substring, "locate", lambda docs, phrases, w, p: real(docs, phrases.slice(0, 0), w, p))
    assert removed() == 0
    monkeypatch.setattr(substring, "locate", lambda docs, phrases, w, p: real(docs, phrases.filter([x % 3 > 0 for x in phrases["anchor"].to_pylist()]), w, p))
    assert 0 < removed() <= 12 * 40
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def test_automaton_matches_whole_words():
    words = [b"a", b"b", b"c", *(b"x%d" % i for i in range(200))]
    known = np.unique(substring.word_hashes(words))
    automaton = substring.compile_phrases([b"a b", b"b c", b"nowhere a", b"x70 x3"], known, 2)
    ids = np.searchsorted(known, substring.word_hashes(b"a b c x70 x3 x3 a b".split()))
    at, which = substring.occurrences(automaton, substring._spell(ids, 2), 2, 2)
    assert list(zip(at.tolist(), which.tolist())) == [(0, 0), (1, 1), (3, 3), (6, 0)]


def test_a_very_long_text(spark):
    rng = np.random.default_rng(13)
    words = [f"w{x}" for x in rng.integers(0, 10**7, 320_000)]  # over two blocks of a MB
    words[300_000:300_050] = words[100:150]
    pairs = [(1, " ".join(words)), (2, " ".join(words[200_000:200_060])), (3, None)]
    got = substring_dedup(table(spark, pairs)).collect()
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in got) == Counter(windows_of(pairs, 35))


def test_substrings_empty(spark):
    assert substring_dedup(table(spark, [])).count() == 0


def fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, distance=4):
    prints = [fingerprint(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(pairs):
        least[find(i)].append(doc)
    return [(d, p, min((x for x in least[find(i)] if x is not None), default=None)) for i, ((d, _), p) in enumerate(zip(pairs, prints))]


@pytest.mark.parametrize("group_rows", [4, 1 << 22])
def test_simhash(spark, group_rows):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    pairs = ODD[:8] + [(30, "one"), (31, "One"), (32, "one two three"), (33, "\x0b")]
    for i in range(150):  # a crowd of near copies, each with some words changed
        words = list(base)
        for p in rng.integers(0, 400, int(rng.integers(0, 6))):
            words[p] = f"z{rng.integers(0, 10**6)}"
        pairs.append((200 + i, " ".join(words)))
    pairs += [(400 + i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 50))) for i in range(100)]
    got = simhash_groups(table(spark, pairs), group_rows=group_rows).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter(classes(pairs))


def test_simhash_blocks_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(200_000)).encode()
    assert simhash(text) % 2**64 == fingerprint(text.decode())
    assert simhash_groups(table(spark, [])).count() == 0


def test_one_row_of_each_class_stays(spark):
    df = table(spark, [(3, "a b c d"), (2, "a b c d"), (2, "A b c d"), (None, "a b c d"), (9, "other text here now")])
    kept = representatives(simhash_groups(df))
    out = restrict(df, kept, {"doc_id": F.col("doc_id"), "text_hash": text_hash(F.col("text"))})
    assert sorted(r.doc_id for r in out.collect()) == [2, 9]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(70)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in near:
        if start not in want:
            todo, seen = [start], {start}
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            want |= {x: min(seen) for x in seen}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
