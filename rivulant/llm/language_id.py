"""Language of a text by a bidirectional gated recurrent network over its bytes.

Two recurrent passes, one in each direction, give every byte a state; the states label the
byte with a language, and the labels' probabilities are averaged over the whole text.
The network is trained here, in numpy, by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulant.llm.common import map_texts
from rivulant.llm.toxicity import held_out

SEGMENT = 128
ROWS = 1024
UNKNOWN = "und"
SALTS = 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def segments(lengths: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in the joined texts, length) of the segments that cover every byte, longest first."""
    count = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), count)
    first = np.cumsum(count) - count
    inside = (np.arange(len(text)) - first[text]) * size
    start = (np.cumsum(lengths) - lengths)[text] + inside
    length = np.minimum(lengths[text] - inside, size)
    order = np.argsort(-length, kind="stable")
    return text[order], start[order], length[order]


@dataclass
class Network:
    """Weights per direction (byte table w, recurrence u, candidate bias c) and the labelling layer."""

    names: list[str]
    size: int
    p: dict[str, np.ndarray]

    def states(self, codes: np.ndarray, active: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """(steps, rows, size) states of `codes` (steps, rows); step t has its first active[t] rows only.

        Rows are sorted by length, so a row enters the backward pass at its last byte with a zero state.
        """
        size, half = self.size, np.float32(0.5)
        # a gate's weights on their own: its arrays are then contiguous; update and reset halved for tanh
        (wz, wr, wn), (uz, ur, un) = (
            [np.ascontiguousarray(self.p[k + way][:, i * size : (i + 1) * size]) * (half if i < 2 else np.float32(1)) for i in range(3)]
            for k in "wu"
        )
        h = np.zeros((codes.shape[1], size), wz.dtype)
        out = np.zeros((*codes.shape, size), wz.dtype)
        for t in range(len(codes)) if way == "f" else range(len(codes) - 1, -1, -1):
            a = active[t]
            code, before = codes[t, :a], h[:a]
            gates = []
            for w, u in ((wz, uz), (wr, ur)):  # a logistic function is half a tanh of half the value, plus a half
                gate = before @ u
                gate += w.take(code, axis=0)
                np.tanh(gate, out=gate)
                gate += 1
                gate *= half
                gates.append(gate)
            z, r = gates
            inner = before @ un
            inner += self.p["c" + way]
            n = r * inner
            n += wn.take(code, axis=0)
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, before.copy(), z, r, n, inner))
            new = before - n
            new *= z
            new += n
            h[:a] = new
            out[t, :a] = new
        return out

    def labels(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """(languages, steps, rows) probabilities at every position."""
        flat = lambda x: x.reshape(-1, self.size).T
        logit = self.p["vf"].T @ flat(forward)
        logit += self.p["vb"].T @ flat(backward)
        logit += self.p["b"][:, None]
        logit -= logit.max(axis=0)
        np.exp(logit, out=logit)
        logit /= logit.sum(axis=0)
        return logit.reshape(len(self.names), *forward.shape[:2])

    def pooled(self, texts: Sequence[bytes]) -> np.ndarray:
        """Mean probabilities over the positions of each text; zeros for an empty one."""
        total = np.zeros((len(texts), len(self.names)))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = np.append(_FOLD[np.frombuffer(b"".join(texts), np.uint8)], np.zeros(SEGMENT, np.uint8))
        text, start, length = segments(lengths)
        for lo in range(0, len(text), ROWS):
            t, s, n = text[lo : lo + ROWS], start[lo : lo + ROWS], length[lo : lo + ROWS]
            steps = np.arange(n[0])
            codes = np.ascontiguousarray(joined[s[None, :] + steps[:, None]])
            active = np.searchsorted(-n, -steps, side="left")
            probability = self.labels(self.states(codes, active, "f"), self.states(codes, active, "b"))
            probability[:, np.arange(len(t))[None, :] >= active[:, None]] = 0
            np.add.at(total, t, probability.sum(axis=1).T)
        return total / np.maximum(lengths, 1)[:, None]


def gradient(net: Network, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over positions of (steps, rows) codes of full length and its gradient, back through all steps."""
    p, size, (steps, rows) = net.p, net.size, codes.shape
    active, g, saved, outs = np.full(steps, rows), {}, {}, {}
    for way in "fb":
        saved[way] = []
        outs[way] = net.states(codes, active, way, saved[way])
    probability = np.moveaxis(net.labels(outs["f"], outs["b"]), 0, 2)
    picked = np.maximum(probability[:, np.arange(rows), target], 1e-12)
    loss = float(-(np.log(picked) * weight).sum() / weight.sum() / steps)
    error = probability.copy()
    error[:, np.arange(rows), target] -= 1
    error *= (weight / weight.sum() / steps)[None, :, None].astype(np.float32)
    g["b"] = error.sum(axis=(0, 1))
    for way in "fb":
        out, v, u = outs[way], p["v" + way], p["u" + way]
        g["v" + way] = out.reshape(-1, size).T @ error.reshape(-1, error.shape[2])
        d_u, d_c = np.zeros_like(u), np.zeros_like(p["c" + way])
        d_x = np.zeros((steps, rows, 3 * size), np.float32)
        carry = np.zeros((rows, size), np.float32)
        for t, before, z, r, n, inner in reversed(saved[way]):
            d_h = carry + error[t] @ v.T
            d_n = d_h * (1 - z) * (1 - n * n)
            d_inner = d_n * r
            d_z = d_h * (before - n) * z * (1 - z)
            d_r = d_n * inner * r * (1 - r)
            d_x[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_pre = np.concatenate([d_z, d_r, d_inner], axis=1)
            d_u += before.T @ d_pre
            d_c += d_inner.sum(axis=0)
            carry = d_h * z + d_pre @ u.T
        g["u" + way], g["c" + way] = d_u, d_c
        order = np.argsort(codes, axis=None, kind="stable")
        sorted_codes = codes.ravel()[order]
        first = np.flatnonzero(np.append(True, sorted_codes[1:] != sorted_codes[:-1]))
        d_w = np.zeros_like(p["w" + way])
        d_w[sorted_codes[first]] = np.add.reduceat(d_x.reshape(-1, 3 * size)[order], first, axis=0)
        g["w" + way] = d_w
    return loss, g


def blank_network(names: list[str], size: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda spread, *shape: rng.normal(0, spread, shape).astype(np.float32)
    p = {"b": np.zeros(len(names), np.float32)}
    for way in "fb":
        p["w" + way] = draw(0.3, 256, 3 * size)
        p["u" + way] = draw(size**-0.5, size, 3 * size)
        p["c" + way] = np.zeros(size, np.float32)
        p["v" + way] = draw(size**-0.5, size, len(names))
    return Network(names, size, p)


def fit(
    pieces: Sequence[bytes],
    target: np.ndarray,
    names: list[str],
    size: int = 16,
    steps: int = 64,
    epochs: int = 6,
    batch: int = 256,
    rate: float = 0.02,
    seed: int = 11,
) -> Network:
    """A network trained on byte pieces and their language (an index into `names`).

    A piece is cut to `steps` bytes or repeated up to them, so all rows of a batch have one length.  Languages
    weigh the same, however many pieces each has.  Adam with a falling rate.
    """
    net = blank_network(names, size, seed)
    used = [i for i, piece in enumerate(pieces) if piece]
    if len(names) < 2 or not used:
        return net
    codes = np.stack([_FOLD[np.resize(np.frombuffer(pieces[i], np.uint8), steps)] for i in used], axis=1)
    target = target[used]
    weight = (len(target) / np.maximum(np.bincount(target, minlength=len(names)), 1))[target]
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    done, total = 0, epochs * -(-len(target) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            _, g = gradient(net, codes[:, some], target[some], weight[some])
            norm = float(np.sqrt(sum((v.astype(np.float64) ** 2).sum() for v in g.values())))
            done += 1
            pace = rate * (1 - 0.95 * done / total)
            for k, v in g.items():
                v = v * np.float32(min(1.0, 1.0 / (norm + 1e-12)))
                m[k] = np.float32(0.9) * m[k] + np.float32(0.1) * v
                s[k] = np.float32(0.99) * s[k] + np.float32(0.01) * v * v
                step = m[k] / (1 - 0.9**done) / (np.sqrt(s[k] / (1 - 0.99**done)) + 1e-8)
                net.p[k] = net.p[k] - np.float32(pace) * step.astype(np.float32)
    return net


def training_pieces(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, parts: int, part: int, per_class: int, per_text: int, size: int
) -> DataFrame:
    """(lang, piece): at most `per_text` pieces of `size` bytes, evenly spaced, from each of at most `per_class` texts a language.

    Texts are chosen by the least hash of the id, so reruns agree.  Rows without id, language
    or a letter are not learned from.  The chosen ids, per_class for each language, are what is broadcast.
    """
    learned = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learned = learned.filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(~held_out(F.col("doc_id"), parts, part))
    ids = learned.select("doc_id", "lang", F.xxhash64(F.lit("language"), "doc_id").alias("_key"))
    for parts_of in ([F.col("lang"), F.pmod("_key", F.lit(SALTS))], [F.col("lang")]):  # the last window meets SALTS * per_class rows at most
        order = Window.partitionBy(*parts_of).orderBy("_key", "doc_id")
        ids = ids.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_class)
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    held = learned.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    held = held.filter(F.col("text").rlike(r"\p{L}"))

    def cut(texts: list[bytes]) -> list[pa.Array]:
        out = []
        for text in texts:
            room = len(text) - size
            places = sorted({room * k // max(1, per_text - 1) for k in range(per_text)}) if room > 0 else [0]
            out.append([text[at : at + size] for at in places])
        return [pa.array(out, pa.list_(pa.binary()))]

    made = map_texts(held, ["lang", "doc_id"], "text", cut, "pieces array<binary>")
    return made.select("lang", "doc_id", F.explode("pieces").alias("piece"))


def language_id(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    parts: int = 3,
    part: int = 1,
    per_class: int = 500,
    per_text: int = 4,
    size: int = 16,
) -> DataFrame:
    """Language of every row: doc_id, held_out, lang_pred, score (0 to 1).

    Learned from text and language of rows whose crc32(id as text) modulo `parts` is not
    `part`: at most `per_text` pieces of 64 bytes from each of at most `per_class` texts a
    language; these pieces are all that reaches the driver.  A prediction reads the text
    alone: every byte of it, in segments of 128 bytes that are labelled side by side, so a
    very long text needs no more memory than its bytes.  The language with the largest mean
    probability wins (ties: the first by name) and that mean is the score.

    A null text and one without a letter give `und` and score 0, as does everything if no
    language was learned.  A null id is never held out and never learned from.  Repeated rows
    are scored each; an empty table gives no rows.  Other columns are not read.
    """
    pieces = training_pieces(docs, id_col, text_col, lang_col, parts, part, per_class, per_text, 64)
    found = pieces.orderBy("lang", "doc_id", "piece").collect()  # per_class * per_text pieces a language
    names = sorted({r["lang"] for r in found})
    place = {name: i for i, name in enumerate(names)}
    target = np.array([place[r["lang"]] for r in found], np.int64)
    net = fit([bytes(r["piece"]) for r in found], target, names, size)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(texts: list[bytes]) -> list[pa.Array]:
        model = shared.value
        if not model.names:
            return [pa.array([UNKNOWN] * len(texts)), pa.array([0.0] * len(texts))]
        mean = model.pooled(texts)
        best = mean.argmax(axis=1)
        top = np.clip(mean[np.arange(len(texts)), best], 0, 1)
        return [pa.array([model.names[b] for b in best], pa.string()), pa.array(top, pa.float64())]

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumns({"held_out": held_out(F.col("doc_id"), parts, part), "lettered": F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))})
    scored = map_texts(base, ["doc_id", "held_out", "lettered"], "text", run, "lang_pred string; score double")
    return scored.select(
        "doc_id", "held_out",
        F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(F.lit(0.0)).alias("score"),
    )
