"""The codec against the reference library, and its path search against all paths."""

import itertools
import random

import numpy as np
import pytest
import sentencepiece

from rivulant.llm.sentencepiece_codec import DEFAULT_MODEL, Codec, PieceTable, decode, encode, read_pieces, round_trip


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)


@pytest.fixture(scope="module")
def codec():
    return Codec(PieceTable(read_pieces(DEFAULT_MODEL)))


def texts():
    rnd = random.Random(4)
    parts = ["a", "b", "aa", "ab", " ", "  ", "\n", "é", "日", "the", "ing", "▁", "𝔘", "<s>", "0", "==", "    ", "in", "\x00", "er"]
    out = ["", " ", "  a  b ", "▁", "a\x00b", "ab" * 300 + " " * 37 + "x", "日本語" * 40]
    out += ["".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(1500)]
    out += ["".join(rnd.choices("ea nst", k=rnd.randint(0, 90))) for _ in range(1500)]
    return out + ["".join(rnd.choices("ab", k=rnd.randint(0, 60))) for _ in range(500)]


def test_ids_are_the_library_s(codec, library):
    cases = texts()
    ids, sizes = codec.encode([t.encode() for t in cases])
    at = np.append(0, np.cumsum(sizes))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library.encode(cases)
    assert [t.decode() for t in codec.decode(ids, sizes)] == [t.replace("▁", " ") for t in cases]


def test_long_words_go_in_batches(codec, library, monkeypatch):
    """Texts without blanks and long runs: cut where no piece reaches, ids as the library's, no word by itself."""
    rnd = random.Random(9)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 900)] + list("，。、")
    cases = ["".join(rnd.choices(signs, k=n)) for n in (60, 800, 5000)]
    cases += ["-" * 700 + "=" * 333, "ab" * 400, "https://x.org/" + "".join(rnd.choices("abcdef0123456789/%", k=1500)), "é" * 90, "\x00" * 60]
    cases += ["".join(rnd.choices(["the", "ing", "日", "xyz", "--", "\t"], k=rnd.randint(20, 300))) for _ in range(60)]
    calls, real = [], codec.table.encode_equal
    monkeypatch.setattr(codec.table, "encode_equal", lambda words: calls.append(len(words)) or real(words))
    codec._forget()
    ids, sizes = codec.encode([t.encode() for t in cases])
    at = np.append(0, np.cumsum(sizes))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library.encode(cases)
    assert sum(calls) > 10 * len(calls)
    for word in cases:
        parts = codec.table.cut(word)
        assert "".join(parts) == word and all(parts)
        assert not any(a[-1] + b[0] in piece for a, b in zip(parts[:20], parts[1:20]) for piece in codec.table.token)


def test_runs_of_blanks_go_in_batches(codec, library, monkeypatch):
    """Runs of any length, before letters, signs without a piece and at the end: the library's ids, no word by itself."""
    rests = ["foo", "", "日本", "𝔘x", "\n", "\t\tx", "x" * 70, "éé", "=", "\x00", "語" * 60]
    cases = [" " * n + rest for n in [*range(0, 70), 255, 256, 1000, 5003] for rest in rests]
    cases += [(" " * n).join(rests) + " " * (n + 1) for n in range(1, 40)]
    monkeypatch.setattr("rivulant.llm.sentencepiece_codec.merge_word", None)
    codec._forget()
    ids, sizes = codec.encode([t.encode() for t in cases])
    at = np.append(0, np.cumsum(sizes))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library.encode(cases)


def test_other_blank_ranks_merge_by_themselves(monkeypatch):
    """Where blanks outrank letters, or a piece holds blanks and letters, words keep the defined order of merges."""
    base = read_pieces(DEFAULT_MODEL)
    first = base | {"scores": [0.0 if p == "▁▁" else s for p, s in zip(base["pieces"], base["scores"])]}
    mixed = base | {"pieces": ["▁▁in" if p == "▁▁" * 8 else p for p in base["pieces"]]}
    for model in (first, mixed):
        codec = Codec(PieceTable(model))
        assert not codec.table.blanks_last
        ids, _ = codec.encode([b"   in  the"])
        assert codec.decode(ids, np.array([len(ids)])) == [b"   in  the"]


def test_indented_source(codec, library):
    lines = ["    " * (i % 7) + f"if value_{i} > {i % 13}:" + "\t" * (i % 3) + " " * (i % 11) + "return x" for i in range(2000)]
    text = "\n".join(lines)
    ids, _ = codec.encode([text.encode()])
    assert ids.tolist() == library.encode(text)


def test_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr("rivulant.llm.sentencepiece_codec.CACHE_WORDS", 5)
    monkeypatch.setattr("rivulant.llm.sentencepiece_codec.BLOCK_BYTES", 40)
    cases = texts()[:200]
    ids, sizes = Codec(PieceTable(read_pieces(DEFAULT_MODEL))).encode([t.encode() for t in cases])
    assert ids.tolist() == [i for t in library.encode(cases) for i in t]


@pytest.mark.parametrize("long_word", [48, 2])
def test_unigram_takes_the_best_path(monkeypatch, long_word):
    monkeypatch.setattr("rivulant.llm.sentencepiece_codec.LONG_WORD", long_word)
    pieces = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "ca", "▁ab"]
    scores = [0.0] * 257 + [-2.0, -3.1, -3.2, -3.3, -4.5, -5.1, -3.9, -8.2, -6.05, -7.7]
    model = {"pieces": pieces, "scores": scores, "special": [i == 0 for i in range(len(pieces))],
             "byte": [0 < i < 257 for i in range(len(pieces))], "bpe": False}
    value = dict(zip(pieces[257:], scores[257:]))

    def best(word):
        cuts = (itertools.combinations(range(1, len(word)), k) for k in range(len(word)))
        paths = ([word[a:b] for a, b in zip((0, *c), (*c, len(word)))] for group in cuts for c in group)
        return max(sum(value[p] for p in path) for path in paths if all(p in value for p in path))

    codec = Codec(PieceTable(model))
    for word in ("".join(w) for n in range(1, 6) for w in itertools.product("abc", repeat=n)):
        ids, _ = codec.encode([word.encode()])
        assert sum(scores[i] for i in ids) == pytest.approx(best("▁" + word))


def test_over_spark(spark, library):
    rows = [(1, "Hello  World\n"), (2, None), (3, ""), (None, "日本 𝔘"), (5, "x" * 5000), (5, "x" * 5000)]
    df = spark.createDataFrame([(i, t, "q", 3) for i, t in rows], "doc_id long, text string, n_tokens string, token_ids int")
    coded = encode(df, ["doc_id"])
    assert sorted(map(str, (r.token_ids for r in coded.collect()))) == sorted(str(library.encode(t or "")) for _, t in rows)
    back = decode(coded, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert all(r.same and r.n_tokens == len(r.token_ids) for r in round_trip(df, ["doc_id"]).collect())
    assert round_trip(df.limit(0), ["doc_id"]).count() == 0
