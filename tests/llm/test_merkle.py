"""Merkle manifest against a plain recursive tree."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rivulant.llm.merkle_manifest import merkle_manifest, proof_digest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g long, n string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def fold(nodes):
    """(top, proof of every node as (left, right) per level) by the definition."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(places):
            mate = place ^ 1
            other = nodes[mate] if mate < len(nodes) else ""
            proofs[i].append((other, "") if mate < place else ("", other))
            places[i] = place // 2
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return (nodes[0] if nodes else None), proofs


def slow(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    folded = []
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        folded.append(fold([x[2] for x in groups[name]]))
    root, crown = fold([top for top, _ in folded])
    out = []
    for name, (top, proofs), above in zip(names, folded, crown):
        for (_, _, own, row), proof in zip(groups[name], proofs):
            steps = proof + above
            shown = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                shown[3] += 1
            acc = leaf(shown)
            for left, right in steps:
                acc = h(left, acc, right)
            digest = h("".join(a + b for a, b in steps))
            out.append((row[0], own, top, root, digest, acc, acc == root))
    return Counter(out)


def fast(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = merkle_manifest(docs, presented={"n_chars": changed}, **more)
    out = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("p"), "folded_root", "verified")
    return Counter(tuple(r) for r in out.collect())


def rows_of(n, langs):
    return [(i * 3 % n, f"s{i % 3}" if i % 4 else None, langs[i % len(langs)], i if i % 5 else None, "é\n" * (i % 9)) for i in range(n)]


@pytest.mark.parametrize("n,langs,bits", [(1, ["en"], 6), (2, ["en"], 1), (77, ["en", "ü", None, "", "de"], 2), (263, ["en"] * 9 + ["de"], 3)])
def test_against_the_definition(spark, n, langs, bits):
    rows = rows_of(n, langs)
    assert fast(spark, rows, bits=bits) == slow(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "a", None, 1, ""), (5, "a", "x", 2, "t" * 3_000_000), (5, "a", "x", 2, "u")]
    rows += [(7, "b", "x", 1, "same")] * 70 + [(i, "c", f"l{i}", i, "one language each") for i in range(90)]
    got = fast(spark, rows)
    assert got == slow(rows) and sum(got.values()) == len(rows)


def test_empty_table(spark):
    assert not fast(spark, [])


def test_only_changed_rows_fail(spark):
    rows = [(i, "s", "en", 10, f"text {i}") for i in range(200)]
    bad = {r[0] for r in fast(spark, rows) if not r[-1]}
    assert bad == {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0}
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    assert merkle_manifest(docs).filter("NOT verified").count() == 0
    lied = merkle_manifest(docs, presented={"text": F.when(F.col("doc_id") == 9, "other").otherwise(F.col("text"))})
    assert [r.doc_id for r in lied.filter("NOT verified").collect()] == [9]
