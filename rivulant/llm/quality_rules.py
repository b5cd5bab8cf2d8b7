"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulant.llm.common import map_texts, word_blocks
from rivulant.plans.scratch import settle

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_CONTINUES = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_digits", "n_bangs", "n_distinct",
)


def _repeat_words(data: bytes) -> tuple[int, int, int]:
    """(words, words in 3-word windows found twice or more, distinct words)."""
    ids: dict[bytes, int] = {}
    codes = [
        np.fromiter((ids.setdefault(w, len(ids)) for w in block), np.int64, len(block)) for block in word_blocks(data)
    ]
    words = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    n = len(words)
    if n < 3:
        return n, 0, len(ids)
    if len(ids) < 1 << 21:
        window = (words[:-2] << 42) | (words[1:-1] << 21) | words[2:]
    else:  # pairs are numbered first, so that a window still fits one number
        _, pair = np.unique((words[:-1] << 31) | words[1:], return_inverse=True)
        window = (pair[:-1].astype(np.int64) << 31) | words[2:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    twice = np.zeros(n - 2, bool)
    twice[order] = np.append(same, False) | np.append(False, same)
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= twice
    return n, int(inside.sum()), len(ids)


def measure(data: bytes) -> tuple[int, ...]:
    """The values of MEASURES for one text."""
    n, repeated, distinct = _repeat_words(data)
    bare = b"".join(data.split()) if len(data) < 1 << 24 else b"".join(b"".join(b) for b in word_blocks(data))
    lines = Counter(line for line in data.split(b"\n") if line.strip())
    n_lines = sum(lines.values())
    upper = len(bare) - len(bare.translate(None, _UPPER))
    lower = len(bare) - len(bare.translate(None, _LOWER))
    return (
        n,
        len(bare.translate(None, _CONTINUES)),
        len(_SYMBOLS.findall(bare)),
        n_lines - len(lines),
        repeated,
        n_lines,
        upper,
        upper + lower,
        len(bare) - len(bare.translate(None, _DIGITS)),
        bare.count(b"!"),
        distinct,
    )


def measures(docs: DataFrame, keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    def run(texts: list[bytes]) -> list[pa.Array]:
        values = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
        return [pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(MEASURES))]

    return map_texts(docs, keep, text_col, run, "; ".join(f"{prefix}{m} long" for m in MEASURES))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(prefix: str = "") -> dict[str, Column]:
    """Each rule votes 1 (keep), -1 (reject) or 0 (abstains); all abstain on a text without words."""

    def c(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    words, letters = c("n_words"), c("n_letters")
    some = words > 0
    return {
        "symbol_density": _vote(some & (c("n_symbols") * 200 <= c("word_chars")), some & (c("n_symbols") * 50 > c("word_chars"))),
        "variety": _vote((words >= 50) & (c("n_distinct") * 10 >= words * 3), some & (c("n_distinct") * 10 < words)),
        "word_length": _vote(some & c("word_chars").between(words * 3, words * 9), some & ~c("word_chars").between(words * 2, words * 14)),
        "symbols": _vote(some & (c("n_symbols") * 100 <= words), some & (c("n_symbols") * 10 > words)),
        "dup_lines": _vote((c("n_lines") >= 4) & (c("n_dup_lines") == 0), (c("n_lines") > 0) & (c("n_dup_lines") * 10 > c("n_lines") * 3)),
        "repetition": _vote((words >= 50) & (c("n_repeat_words") * 10 <= words), some & (c("n_repeat_words") * 10 > words * 3)),
        "shouting": _vote((letters > 0) & (c("n_upper") * 5 <= letters), (letters > 0) & (c("n_upper") * 2 > letters)),
        "digits": _vote(some & (c("n_digits") * 20 <= c("word_chars")), some & (c("n_digits") * 3 > c("word_chars"))),
        "exclaiming": _vote(some & (c("n_bangs") * 50 <= words), some & (c("n_bangs") * 5 > words)),
    }


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Prior of a good text, and for each rule the chances of its votes, by expectation-maximisation.

    `patterns` (k, rules) holds the distinct vote vectors, `counts` how many texts
    cast them.  The second result is (rules, 2, 3): class bad or good, vote -1, 0 or
    1.  A rule sees one kind of fault, so how often it is right differs by class: it
    passes most texts that are bad for another reason, and seldom rejects a good one.
    EM starts from "bad if any rule rejects"; smoothing counts as a few texts per rule
    and rejections stay likelier, by a factor of two, in the bad class, so that the
    classes cannot change places.
    """
    k, rules = patterns.shape
    cast = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # (k, rules, 3)
    good = np.where((patterns == -1).any(axis=1), 0.1, 0.97)
    chances, prior = np.tile(np.array([[0.3, 0.35, 0.35], [0.02, 0.28, 0.7]]), (rules, 1, 1)), 0.9
    if not k or not counts.sum():
        return prior, chances
    start = chances.copy()
    for _ in range(rounds):
        before = chances
        weight = np.stack([(1 - good) * counts, good * counts])  # (2, k)
        chances = np.einsum("ck,krv->rcv", weight, cast) + 4 * start
        chances /= chances.sum(axis=2, keepdims=True)
        chances[:, 0, 0] = np.maximum(chances[:, 0, 0], np.minimum(2 * chances[:, 1, 0], 0.9))
        chances /= chances.sum(axis=2, keepdims=True)
        prior = float(np.clip((weight[1].sum() + 9) / (counts.sum() + 10), 0.5, 0.99))
        logit = np.log(prior / (1 - prior)) + np.einsum("krv,rv->k", cast, np.log(chances[:, 1] / chances[:, 0]))
        good = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        if np.abs(chances - before).max() < 1e-9:
            break
    return prior, chances


def base_failed(prefix: str = "") -> Column:
    """Under 50 words, or over half of the words in repeated 3-word windows."""
    words, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 50) | (repeated * 100 > words * 50)


def fit(seen: DataFrame, prefix: str = "") -> tuple[float, np.ndarray]:
    """`fit_accuracies` over the rows of `seen` that pass the base rules.

    What leaves Spark is the number of texts per vote vector, 3^9 = 19683 numbers at
    most, counted over all of these texts.
    """
    rules = votes(prefix)
    cast = seen.filter(~base_failed(prefix)).select(*[v.alias(k) for k, v in rules.items()])
    table = cast.groupBy(*rules).count().collect()
    patterns = np.array([[r[k] for k in rules] for r in table], np.int64).reshape(-1, len(rules))
    return fit_accuracies(patterns, np.array([r["count"] for r in table], np.int64))


def posterior(model: tuple[float, np.ndarray], prefix: str = "") -> Column:
    """Probability that a text is good, by its votes."""
    prior, chances = model
    logit = F.lit(float(np.log(prior / (1 - prior))))
    for vote, by_class in zip(votes(prefix).values(), chances):
        bad, none, good = (float(w) for w in np.log(by_class[1] / by_class[0]))
        logit = logit + F.when(vote == -1, bad).when(vote == 1, good).otherwise(none)
    return 1 / (1 + F.exp(-logit))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
) -> DataFrame:
    """Per row: doc_id, the measures, base_failed, posterior of a good text, kept.

    A null text has no words and fails.  Texts that fail the base rules are not kept;
    the others are when the posterior is at least `threshold`.  An empty table gives an
    empty result.  Other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen = settle(measures(base, ["doc_id"], "text"))
    good = posterior(fit(seen))
    return seen.withColumns({"base_failed": base_failed(), "posterior": good}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )


def quality_filter(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that `quality_rules` keeps, all their columns.

    The texts are read twice, once to fit and once to filter, and never shuffled.
    """
    prefix = "_measure_"
    model = fit(measures(docs, [], text_col, prefix), prefix)
    seen = measures(docs, docs.columns, text_col, prefix)
    return seen.filter(~base_failed(prefix) & (posterior(model, prefix) >= threshold)).select(*docs.columns)
