"""Language identification: the network against a plain one, its gradient against differences, held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest

from rivulant.llm.language_id import blank_network, fit, gradient, language_id, segments

SF = "/root/testdata/sf0.1"


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain(net, data):
    """Mean label probabilities by one step after the other, segment by segment."""
    data = bytes(data).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    total, k = np.zeros(len(net.names)), net.size
    for lo in range(0, len(data), 128):
        part, states = data[lo : lo + 128], {}
        for way, codes in (("f", part), ("b", part[::-1])):
            h, seen = np.zeros(k), []
            for c in codes:
                x, pre = net.p["w" + way][c], h @ net.p["u" + way]
                z, r = sigmoid(x[:k] + pre[:k]), sigmoid(x[k : 2 * k] + pre[k : 2 * k])
                n = np.tanh(x[2 * k :] + r * (pre[2 * k :] + net.p["c" + way]))
                h = (1 - z) * n + z * h
                seen.append(h)
            states[way] = seen if way == "f" else seen[::-1]
        for f, b in zip(states["f"], states["b"]):
            e = np.exp(f @ net.p["vf"] + b @ net.p["vb"] + net.p["b"])
            total += e / e.sum()
    return total / max(1, len(data))


def test_every_byte_is_in_one_segment():
    lengths = np.array([0, 1, 128, 129, 0, 1000, 256])
    text, start, length = segments(lengths)
    seen = np.concatenate([np.arange(s, s + n) for s, n in zip(start, length)])
    assert sorted(seen) == list(range(lengths.sum())) and (np.diff(length) <= 0).all()
    assert (np.bincount(text, weights=length, minlength=7) == lengths).all()


def test_batched_equals_plain():
    net = blank_network(["a", "b", "c"], 5, 1)
    rng = np.random.default_rng(2)
    texts = [b"", b"x", b"A b\n", bytes(rng.integers(0, 256, 500, dtype=np.uint8)), "é ü ß ñ".encode() * 90]
    got = net.pooled(texts)
    for row, text in zip(got, texts):
        assert row == pytest.approx(plain(net, text), abs=1e-5)
    assert net.pooled([texts[3]] * 3)[1] == pytest.approx(got[3], abs=1e-6)


def test_gradient_through_time():
    net = blank_network(["a", "b", "c"], 3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(5)
    codes, target, weight = rng.integers(97, 103, (7, 4)), np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 0.5, 1.0])
    _, g = gradient(net, codes, target, weight)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        for at in rng.choice(len(flat), min(12, len(flat)), replace=False):
            kept, eps = flat[at], 1e-2
            flat[at] = kept + eps
            up, _ = gradient(net, codes, target, weight)
            flat[at] = kept - eps
            down, _ = gradient(net, codes, target, weight)
            flat[at] = kept
            assert g[name].reshape(-1)[at] == pytest.approx((up - down) / (2 * eps), abs=2e-3), name


def test_fit_tells_two_alphabets():
    rng = np.random.default_rng(1)
    draw = lambda letters: bytes(rng.choice(list(letters), 64).astype(np.uint8))
    pieces = [draw(b"abcde ") for _ in range(200)] + [draw(b"abcxyz ") for _ in range(100)]
    net = fit(pieces, np.array([0] * 200 + [1] * 100), ["p", "q"], 4, epochs=4)
    assert net.pooled([draw(b"abcde ") * 3, draw(b"abcxyz ") * 3]).argmax(axis=1).tolist() == [0, 1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    apart = [r for r in rows if r.held_out]
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in apart]) > 0.99
    for lang in {r.lang for r in apart}:
        assert np.mean([r.lang_pred == lang for r in apart if r.lang == lang]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


SCHEMA = "doc_id long, text string, lang string, score string, piece int"


def test_odd_rows(spark):
    rows = [(i, "the and thing " * 9, "en", "x", 1) for i in range(40)] + [(100 + i, "der die äöü " * 9, "de", "x", 1) for i in range(40)]
    rows += [(None, "the and thing", "en", "x", 1), (300, None, "en", "x", 1), (301, "", None, "x", 1), (302, "12 ;; 7\n", "de", "x", 1),
             (303, "the and thing " * 60000, None, "x", 1), (304, "der die äöü", "de", "x", 1), (304, "der die äöü", "de", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = language_id(df, per_class=20).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert [by_id[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and by_id[300].score == 0
    assert by_id[None].lang_pred == "en" and by_id[303].lang_pred == "en" and by_id[304].lang_pred == "de"
    assert Counter(r.doc_id for r in out)[304] == 2 and not by_id[None].held_out


def test_nothing_learned(spark):
    rows = [(1, "abc", None, "x", 1), (2, "", None, "x", 1)]
    assert {r.lang_pred for r in language_id(spark.createDataFrame(rows, SCHEMA)).collect()} == {"und"}
    assert language_id(spark.createDataFrame([], SCHEMA)).count() == 0
    one = language_id(spark.createDataFrame([(i, "abc", "en", "x", 1) for i in range(9)], SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}
