"""Substring dedup with repeated-phrase automata: words in passages that recur are removed everywhere.

1. Every window of `window` words has an anchor: of the short phrases in it the one
   with the least hash, the leftmost of equals.  Equal windows have equal anchors.
   Phrases that are anchors at two places or more are confirmed, with their text.
2. Documents are dealt to shards of a few MB.  A shard gets the confirmed phrases that
   are anchors in it, compiles them (spelled in word numbers, so matching is exact) into
   an Aho-Corasick automaton and streams its documents through it.  The matches alone say
   where phrases are: no text is hashed again and no position comes from step 1.
3. Of the phrases matched inside a window the least is its anchor; a window without a
   match cannot recur.  Neighbouring windows with one anchor form a span; spans of equal
   text are settled by one count, and only the windows of spans that occur once are
   counted one by one.
4. Recurring window starts go back to the shards, which cut the words they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulant.llm.common import map_texts, text_hash, word_blocks, written

PHRASE = 8
SHARD_BYTES = 4 << 20
NO_PHRASE = np.uint64(2**64 - 1)
#: odd multipliers of the two halves of a span's hash
SPAN_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Where a text's words are and, if asked for, their 64-bit hashes."""

    def __init__(self, data: bytes, hashed: bool = True):
        hashes, starts, ends, parts, at = [], [], [], [], 0
        for block in word_blocks(data):
            if not block:
                continue
            if hashed:
                hashes.append(word_hashes(block))
            size = np.fromiter(map(len, block), np.int64, len(block))
            end = at + np.cumsum(size + 1) - 1
            ends.append(end)
            starts.append(end - size)
            parts.append(b" ".join(block))
            at = int(end[-1]) + 1
        empty = np.zeros(0, np.int64)
        self.starts, self.ends = (np.concatenate(x) if x else empty for x in (starts, ends))
        self.hashes = np.concatenate(hashes) if hashes else empty.astype(np.uint64)
        self.joined = b" ".join(parts)

    def text(self, first: int, after: int) -> bytes:
        return self.joined[self.starts[first] : self.ends[after - 1]]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same words, for the second half of a span's hash."""
    with np.errstate(over="ignore"):
        value = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        return value ^ (value >> np.uint64(29))


class Sums:
    """Polynomial hashes of any range of words from prefix sums, all modulo 2 ** 64."""

    def __init__(self, multiplier: int, longest: int):
        steps = lambda x: np.cumprod(np.append(np.uint64(1), np.full(longest, x, np.uint64)))
        with np.errstate(over="ignore"):
            self.up, self.down = steps(multiplier), steps(pow(multiplier, -1, 2**64))

    def ranges(self, hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            before = np.append(np.uint64(0), np.cumsum(hashes * self.up[: len(hashes)]))
            return ((before[hi] - before[lo]) * self.down[lo]).view(np.int64)


def phrase_values(hashes: np.ndarray, phrase: int) -> np.ndarray:
    """The hash of the phrase that starts at each word, from the words' hashes."""
    size = len(hashes) - phrase + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(phrase):
            value = value * _MULTIPLIER + hashes[i : i + size]
        value ^= value >> np.uint64(31)
        value *= _MULTIPLIER
    return value


def anchors(value: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, windows) of each anchor, in order, from the values of the phrases."""
    reach = window - phrase + 1
    count = len(value) - reach + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    best, place, wide = value, np.arange(len(value)), 1
    while wide < reach:  # least of `wide` neighbours, leftmost of equals, doubling
        step = min(wide, reach - wide)
        less = best[step:] < best[:-step]
        place = np.where(less, place[step:], place[:-step])
        best = np.where(less, best[step:], best[:-step])
        wide += step
    first = np.append(0, np.flatnonzero(np.diff(place)) + 1)
    return place[first], first, np.diff(np.append(first, count))


def _anchor_lists(texts: list[bytes], window: int, phrase: int) -> list[pa.Array]:
    """The anchors of each text: hash and words."""
    hashes, words, sizes = [], [], [0]
    for t in map(Words, texts):
        value = phrase_values(t.hashes, phrase)
        places = anchors(value, window, phrase)[0]
        hashes.append(value[places])
        joined = t.joined
        lo, hi = t.starts[places].tolist(), t.ends[places + (phrase - 1)].tolist()
        words += [joined[a:b] for a, b in zip(lo, hi)]
        sizes.append(sizes[-1] + len(places))
    flat = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
    rows = pa.StructArray.from_arrays([pa.array(flat), pa.array(words, pa.binary())], names=["anchor", "words"])
    return [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)]


def _packed(texts: list[bytes]) -> list[pa.Array]:
    pack = zstandard.ZstdCompressor(level=3)
    return [pa.array([pack.compress(t) for t in texts], pa.binary())]


def _unpacked(column: pa.ChunkedArray) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return (unpack.decompress(p) for p in column.to_pylist())


def _spell(ids: np.ndarray, digits: int) -> str:
    """Word numbers as strings over 64 signs, `digits` for each: automaton nodes have few branches."""
    places = np.stack([(ids >> (6 * i)) & 63 for i in range(digits)], axis=1)
    return (places + 48).astype(np.uint8).tobytes().decode("ascii")


def compile_phrases(phrases: list[bytes], known: np.ndarray, digits: int) -> ahocorasick.Automaton:
    """The automaton of the phrases, each spelled in word numbers and yielding its place in the list.

    A word's number is its hash's place in the sorted `known`.  A phrase with a word that no
    document of the shard has cannot occur and is left out.
    """
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    if phrases and len(known):
        hashes = word_hashes(b" ".join(phrases).split(b" "))
        ids = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        there = (known[ids] == hashes).reshape(len(phrases), -1).all(axis=1)
        ids = ids.reshape(len(phrases), -1)
        here = np.flatnonzero(there)
        spelled, step = _spell(ids[here].ravel(), digits), ids.shape[1] * digits
        for at, i in enumerate(here.tolist()):
            automaton.add_word(spelled[at * step : (at + 1) * step], i)
    if len(automaton):
        automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton, text: str, digits: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(word position, phrase) of every match in a spelled text."""
    if not len(automaton):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)
    after = found[:, 0] + 1
    whole = after % digits == 0  # else it straddles the spellings of two words
    return after[whole] // digits - phrase, found[whole, 1]


def locate(docs: pa.Table, phrases: pa.Table, window: int, phrase: int) -> pa.Table:
    """The candidate spans of one shard: a row for each anchor among the phrases that the automaton matched.

    d1 and d2 tell spans apart by their words.  Of the spans of a shard that are equal the first one lists its windows.
    """
    texts = [Words(t) for t in _unpacked(docs["packed"])]
    every = np.concatenate([t.hashes for t in texts]) if texts else np.zeros(0, np.uint64)
    known, ids = np.unique(every, return_inverse=True)
    starts = np.cumsum([0] + [len(t.hashes) for t in texts])
    digits = 1
    while 64**digits < max(2, len(known)):
        digits += 1
    automaton = compile_phrases(phrases["words"].to_pylist(), known, digits)
    rank = np.asarray(phrases["anchor"], np.int64).view(np.uint64)
    longest = max((len(t.hashes) for t in texts), default=0)
    first_half, second_half = (Sums(multiplier, longest) for multiplier in SPAN_MULTIPLIERS)
    none = np.zeros(0, np.int64)
    out = {name: [none] for name in ("row", "d1", "d2", "anchor", "start", "n")}
    all_windows = [none]
    for row, t in enumerate(texts):
        if len(t.hashes) < window:
            continue
        at, which = occurrences(automaton, _spell(ids[starts[row] : starts[row + 1]], digits), digits, phrase)
        if not len(at):
            continue
        value = np.full(len(t.hashes) - phrase + 1, NO_PHRASE)
        value[at] = np.minimum(rank[which], NO_PHRASE - np.uint64(1))
        places, first, count = anchors(value, window, phrase)
        held = value[places] != NO_PHRASE
        lo, n = first[held], count[held]
        after = lo + n + window - 1
        out["d1"].append(first_half.ranges(t.hashes, lo, after))
        out["d2"].append(second_half.ranges(mixed(t.hashes), lo, after))
        out["row"].append(np.full(len(lo), row))
        out["anchor"].append(value[places[held]].view(np.int64))
        out["start"].append(lo)
        out["n"].append(n)
        begin = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        all_windows.append(first_half.ranges(t.hashes, begin, begin + window))
    row, d1, d2, anchor, start, n = (np.concatenate(out[name]) for name in ("row", "d1", "d2", "anchor", "start", "n"))
    windows = np.concatenate(all_windows)
    # the windows of equal spans are equal; one list a shard is enough
    order = np.lexsort((np.arange(len(n)), n, d2, d1))
    key = np.stack([d1, d2, n])[:, order]
    lists = np.zeros(len(n), bool)
    lists[order] = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))[: len(n)]
    windows = windows[np.repeat(lists, n)]
    rows = pa.array(row, pa.int64())
    sizes = np.append(0, np.cumsum(np.where(lists, n, 0))).astype(np.int32)
    return pa.table({
        "doc_id": docs["doc_id"].take(rows), "text_hash": docs["text_hash"].take(rows), "shard": docs["shard"].take(rows),
        "anchor": pa.array(anchor), "d1": pa.array(d1), "d2": pa.array(d2),
        "start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32()),
        "windows": pa.ListArray.from_arrays(pa.array(sizes), pa.array(windows)),
    })


def cut(docs: pa.Table, ranges: pa.Table, window: int) -> pa.Table:
    """The texts of one shard without the words that recurring windows cover."""
    by_row: dict[tuple, list[tuple[int, int]]] = {}
    for doc, text_hash, start, n in zip(*(ranges[c].to_pylist() for c in ("doc_id", "text_hash", "start", "n"))):
        by_row.setdefault((doc, text_hash), []).append((start, n))
    kept, n_words, n_removed = [], [], []
    keys = zip(docs["doc_id"].to_pylist(), docs["text_hash"].to_pylist())
    for key, data in zip(keys, _unpacked(docs["packed"])):
        t = Words(data, hashed=False)
        edges = np.zeros(len(t.starts) + 1, np.int64)
        for start, n in by_row.get(key, ()):
            edges[start] += 1
            edges[start + n + window - 1] -= 1
        stays = np.cumsum(edges[:-1]) == 0
        turns = np.flatnonzero(np.diff(np.concatenate(([False], stays, [False])).astype(np.int8)))
        kept.append(b" ".join(t.text(a, b) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist())))
        n_words.append(len(stays))
        n_removed.append(int((~stays).sum()))
    return pa.table({
        "doc_id": docs["doc_id"], "text": pa.array(kept, pa.binary()).cast(pa.string()),
        "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
    })


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 35,
    phrase: int = PHRASE,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Per row: doc_id, text (kept words joined by one space), n_words, n_removed.

    A word goes if a window of `window` consecutive words of its text covers it whose
    word sequence also starts at another place, in this text or another; windows are
    judged on the input.  Words are taken unchanged; a null text has none.  Repeated
    rows are documents of their own, so their windows recur.  Other columns are not read.

    Shuffled are the anchors (about two phrases in thirty words) with their words, the
    texts twice in packed form, and rows for candidates only.  Copies and hot passages are
    counted with partial aggregation and never meet in one task.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    source = source.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(shards)).cast("int"))
    keys = ["doc_id", "text_hash", "shard"]
    packed = map_texts(source, keys, "text", _packed, "packed binary")

    lists = map_texts(
        source, ["shard"], "text", lambda t: _anchor_lists(t, window, phrase), "anchors array<struct<anchor:bigint,words:binary>>"
    )
    chosen = written(lists.select("shard", F.inline("anchors")), "anchors")
    # equal hashes of different phrases are told apart by their words
    confirmed = chosen.groupBy("anchor", "words").count().filter("count > 1").select("anchor", "words")
    confirmed = written(confirmed, "confirmed")
    # distinct first: a phrase of a third of all documents is then one row per shard
    mine = chosen.select("shard", "anchor").distinct()
    phrases = mine.join(confirmed, "anchor").select("shard", "anchor", "words")

    def find(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        return locate(mine, theirs, window, phrase)

    kind = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text_hash long, shard int, anchor long, d1 long, d2 long, start int, n int, windows array<long>"
    spans = written(packed.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(find, schema), "spans")

    digest = ["d1", "d2"]
    where = ["shard", "doc_id", "text_hash", "start", "n"]
    classes = spans.groupBy(*digest).agg(F.count("*").alias("spans"), F.min("anchor").alias("anchor"))
    classes = written(classes, "classes")
    often = classes.filter("spans > 1")
    settled = written(spans.select(*where, *digest).join(often, digest, "left_semi").select(*where), "settled")
    # Windows are counted one by one where a span occurs once; repeated spans of the same anchor
    # lend one list of theirs to that count.
    listed = spans.filter(F.size("windows") > 0)
    once = listed.join(often, digest, "left_anti").select(*where[:3], "anchor", "start", "windows")
    once = written(once, "once")
    open_windows = once.select(*where[:3], "anchor", "start", F.posexplode("windows").alias("offset", "w"))
    lent = often.join(classes.filter("spans = 1").select("anchor"), "anchor", "left_semi").select(*digest)
    stand = listed.select("anchor", *digest, "windows").join(lent, digest, "left_semi").dropDuplicates(digest)
    known = written(stand.select("anchor", F.explode("windows").alias("w")), "known")
    again = (
        open_windows.select("anchor", "w").unionAll(known)
        .groupBy("anchor", "w").count().filter("count > 1").select("anchor", "w")
    )
    single = open_windows.join(again, ["anchor", "w"], "left_semi").select(
        *where[:3], (F.col("start") + F.col("offset")).cast("int").alias("start"), F.lit(1).alias("n")
    )
    ranges = written(settled.unionAll(single), "ranges")

    def drop(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        return cut(mine, theirs, window)

    schema = f"doc_id {kind}, text string, n_words long, n_removed long"
    return packed.groupBy("shard").cogroup(ranges.groupBy("shard")).applyInArrow(drop, schema)
