"""Licence scan by sentence rules: sentences become identifiers, identifier sequences become licences."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulant.llm.common import map_texts
from rivulant.llm.license_pack import RULES, SENTENCES

BETWEEN = 4
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_STEP = re.compile(rb"[a-z0-9\x80-\xff]+|\n|[.!?:;](?=[ \t\r\n]|\Z)")
_END = re.compile(rb"\n|[.!?:;](?=[ \t\r\n]|\Z)")


def normal_words(sentence: bytes) -> list[bytes]:
    """A sentence as it is compared: A-Z lower-cased, letters and digits only."""
    return _WORD.findall(sentence.lower())


class Scanner:
    """Known sentences as a tree of words, and the ordered rules."""

    def __init__(
        self, sentences: Sequence[tuple[str, str]] = SENTENCES, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES,
        between: int | None = BETWEEN,
    ):
        self.tree: dict = {}
        self.between = between
        for name, sentence in sentences:
            node = self.tree
            for word in normal_words(sentence.encode()):
                node = node.setdefault(word, {})
            node[None] = name
        self.rules = list(rules)
        openings = b"|".join(sorted(map(re.escape, self.tree), key=len, reverse=True)) or rb"(?!)"
        # a sentence can begin where the text, a line or, after a sentence's end, the next one begins
        self.opening = re.compile(
            rb"(?:\A|\n|[.!?:;][ \t\r\n]+)[^a-z0-9\n\x80-\xff]*(" + openings + rb")(?![a-z0-9\x80-\xff])"
        )

    def _sentence_at(self, text: bytes, at: int) -> tuple[str, int] | None:
        """The longest known sentence whose words start at `at` and that ends where a line or sentence ends."""
        node, found, name, end = self.tree, None, None, at
        for step in _STEP.finditer(text, at):
            token = step.group()
            if token[:1].isalnum() or token[0] >= 0x80:
                node, name = node.get(token), None
                if node is None:
                    return found
                name, end = node.get(None), step.end()
            elif name is not None:
                found, name = (name, end), None
        return (name, end) if name is not None else found

    def sentences(self, text: bytes) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of the known sentences of a text, in order, none inside another."""
        text, out, free = text.lower(), [], 0
        for m in self.opening.finditer(text):
            if m.start(1) < free:
                continue
            hit = self._sentence_at(text, m.start(1))
            if hit:
                free = hit[1]
                out.append((hit[0], m.start(1), hit[1]))
        return out

    def _ends(self, text: bytes, start: int, after: int) -> int:
        """Line and sentence ends between two places, counted up to one more than are allowed."""
        return sum(1 for _ in itertools.islice(_END.finditer(text, start, after), self.between + 1))

    def licences(self, text: bytes, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """(licence, start, end) by the rules, from left to right; more than `between` line or sentence ends part a sequence."""
        out, i = [], 0
        near = [self.between is None or self._ends(text, a[2], b[1]) <= self.between for a, b in zip(found, found[1:])]
        while i < len(found):
            step = 1
            for licence, wanted in self.rules:
                n = len(wanted)
                if tuple(f[0] for f in found[i : i + n]) == wanted and all(near[i : i + n - 1]):
                    out.append((licence, found[i][1], found[i + n - 1][2]))
                    step = n
                    break
            i += step
        return out


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: Sequence[tuple[str, str]] = SENTENCES,
    rules: Sequence[tuple[str, tuple[str, ...]]] = RULES,
    between: int | None = BETWEEN,
) -> DataFrame:
    """Per row: doc_id, n_sentences (known ones), sentences (their identifiers) and licences, in order.

    `licences` has one struct (licence, start, end) per match, with byte offsets of the
    whole text.  A sentence may run over line ends.  The sentences of one rule may have up to
    `between` other line or sentence ends between one and the next, any number if None.  Null and empty texts have none;
    repeated rows give equal results; other columns are not read.  One pass, no shuffle:
    the pack is a few kB and travels with the function.
    """
    scanner = Scanner(sentences, rules, between)

    def run(texts: list[bytes]) -> list[pa.Array]:
        found = [scanner.sentences(t) for t in texts]
        matched = [scanner.licences(t, f) for t, f in zip(texts, found)]
        kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return [
            pa.array([len(f) for f in found], pa.int64()),
            pa.array([[s[0] for s in f] for f in found], pa.list_(pa.string())),
            pa.array([[dict(zip(("licence", "start", "end"), x)) for x in m] for m in matched], kind),
        ]

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = "n_sentences long; sentences array<string>; licences array<struct<licence:string,start:bigint,end:bigint>>"
    return map_texts(base, ["doc_id"], "text", run, schema)
