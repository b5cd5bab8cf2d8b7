"""Quality score by attention-based multiple-instance learning over the passages of a text."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulant.llm.common import map_texts
from rivulant.llm.toxicity import class_shares, held_out, importances, training_rows

PASSAGE_BYTES = 512
KINDS = 16
FEATURES = KINDS * KINDS + KINDS + 4
BLOCK_PASSAGES = 4096


def _kinds() -> np.ndarray:
    """The kind of each byte: letters, digits, blanks, single marks, other punctuation, UTF-8 continuation and lead."""
    table = np.full(256, 13, np.uint8)
    table[0x80:0xC0], table[0xC0:] = 14, 15
    groups = [range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"\t\x0b\x0c\r", b".", b",", b"!?", b"|", b"#$%&*", b"<>{}[]=\\/_", b"'\"()-:;"]
    for kind, members in enumerate(groups):
        table[list(members)] = kind
    return table


_KIND = _kinds()


def passages(data: bytes, size: int = PASSAGE_BYTES) -> np.ndarray:
    """One feature row per passage of `size` bytes, the last one shorter; an empty text is one empty passage.

    Shares of the pairs of neighbouring character kinds and of the kinds, the length
    against a full passage, mean word length, and how much of the passage's words and
    four-byte sequences repeat in it.
    """
    raw = np.frombuffer(data, np.uint8)
    count = max(1, -(-len(raw) // size))
    kind = _KIND[raw].astype(np.int64)
    where = np.arange(len(raw)) // size
    out = np.zeros((count, FEATURES), np.float32)
    length = np.maximum(np.bincount(where, minlength=count), 1)[:, None]
    if len(raw) > 1:
        inside = where[1:] == where[:-1]
        pair = (where[:-1] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:])[inside]
        out[:, : KINDS * KINDS] = np.bincount(pair, minlength=count * KINDS * KINDS).reshape(count, -1) / length
    single = np.bincount(where * KINDS + kind, minlength=count * KINDS).reshape(count, -1)
    out[:, KINDS * KINDS : KINDS * KINDS + KINDS] = single / length
    blanks = single[:, 3:6].sum(axis=1)
    out[:, -4] = length[:, 0] / size
    out[:, -3] = (length[:, 0] - blanks) / (blanks + 1) / 16
    if len(raw) > 3:
        quad = raw[:-3].astype(np.uint64) | raw[1:-2].astype(np.uint64) << np.uint64(8)
        quad |= raw[2:-1].astype(np.uint64) << np.uint64(16) | raw[3:].astype(np.uint64) << np.uint64(24)
        inside = where[3:] == where[:-3]
        keyed = np.sort((quad | where[:-3].astype(np.uint64) << np.uint64(32))[inside])
        same = keyed[1:] == keyed[:-1]
        out[:, -2] = np.bincount((keyed[1:][same] >> np.uint64(32)).astype(np.int64), minlength=count) / length[:, 0]
    out[:, -1] = len(raw) / (len(raw) + 2000.0)
    return np.sqrt(np.maximum(out, 0))


def spread(rows: np.ndarray, count: int) -> np.ndarray:
    """At most `count` of the rows, evenly spaced, the first and the last among them."""
    if len(rows) <= count:
        return rows
    return rows[np.linspace(0, len(rows) - 1, count).round().astype(np.int64)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Network:
    """Encoder, gated attention and classifier; `mean` and `spread` scale the features."""

    mean: np.ndarray
    spread: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        """x: (passages, features); bag: the text of each passage, in order; bags: how many texts."""
        p = self.p
        h = np.tanh(x @ p["w"] + p["wb"])
        t, u = np.tanh(h @ p["v"] + p["vb"]), _sigmoid(h @ p["u"] + p["ub"])
        logit = (t * u) @ p["a"]
        first = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
        weight = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
        weight /= np.bincount(bag, weights=weight, minlength=bags)[bag]
        z = np.add.reduceat(h * weight[:, None], first, axis=0)
        return {"h": h, "t": t, "u": u, "weight": weight, "z": z, "score": _sigmoid(z @ p["c"] + p["cb"])}

    def gradient(self, x: np.ndarray, bag: np.ndarray, f: dict, error: np.ndarray) -> dict[str, np.ndarray]:
        """Of the summed loss, given its derivative by each text's logit."""
        p, dz = self.p, error[:, None] * self.p["c"][None, :]
        at = dz[bag]
        value = (f["h"] * at).sum(axis=1)
        mean = np.bincount(bag, weights=value * f["weight"], minlength=len(error))
        dlogit = f["weight"] * (value - mean[bag])
        gate = dlogit[:, None] * p["a"][None, :]
        dt, du = gate * f["u"] * (1 - f["t"] ** 2), gate * f["t"] * f["u"] * (1 - f["u"])
        dh = (f["weight"][:, None] * at + dt @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
        return {
            "c": f["z"].T @ error, "cb": error.sum(keepdims=True), "a": (f["t"] * f["u"]).T @ dlogit,
            "v": f["h"].T @ dt, "vb": dt.sum(axis=0), "u": f["h"].T @ du, "ub": du.sum(axis=0),
            "w": x.T @ dh, "wb": dh.sum(axis=0),
        }

    def score(self, data: bytes) -> tuple[float, float, int]:
        """(score, largest attention weight, passages); a long text goes through in blocks of passages."""
        p, top, mass, total, n = self.p, -np.inf, 0.0, np.zeros(len(self.p["c"])), 0
        step = PASSAGE_BYTES * BLOCK_PASSAGES
        for lo in range(0, max(1, len(data)), step):
            x = passages(data[lo : lo + step])
            x[:, -1] = np.sqrt(len(data) / (len(data) + 2000.0))
            x = (x - self.mean) / self.spread
            h = np.tanh(x @ p["w"] + p["wb"])
            logit = (np.tanh(h @ p["v"] + p["vb"]) * _sigmoid(h @ p["u"] + p["ub"])) @ p["a"]
            peak = max(top, float(logit.max()))
            weight = np.exp(logit - peak)
            shrink = np.exp(top - peak)
            mass, total = mass * shrink + weight.sum(), total * shrink + weight @ h
            top, n = peak, n + len(x)
        score = float(_sigmoid(total / mass @ p["c"] + p["cb"])[0])
        return score, float(1 / mass), n


def fit(
    rows: list[np.ndarray],
    target: np.ndarray,
    importance: np.ndarray,
    hidden: int = 24,
    attention: int = 12,
    epochs: int = 30,
    batch: int = 64,
    decay: float = 1e-4,
    seed: int = 7,
) -> Network:
    """Gated attention trained from the texts' labels alone, by Adam on mini-batches of texts.

    With one class only the constant alone is set, from the share of that class.
    """
    rng = np.random.default_rng(seed)
    stacked = np.concatenate(rows) if rows else np.zeros((1, FEATURES), np.float32)
    net = Network(stacked.mean(axis=0), stacked.std(axis=0) + 0.02)
    scale = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    net.p = {
        "w": scale(FEATURES, hidden), "wb": np.zeros(hidden), "v": scale(hidden, attention), "vb": np.zeros(attention),
        "u": scale(hidden, attention), "ub": np.zeros(attention), "a": rng.normal(0, 0.3, attention),
        "c": rng.normal(0, 0.3, hidden), "cb": np.zeros(1),
    }
    if not rows or not 0 < target.sum() < len(target):
        share = float(target.mean()) if len(target) else 0.5
        net.p["c"][:] = 0
        net.p["cb"][:] = np.log((share + 0.01) / (1.01 - share))
        return net
    rows = [((r - net.mean) / net.spread).astype(np.float32) for r in rows]
    importance = importance / importance.mean()
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            x = np.concatenate([rows[i] for i in some])
            bag = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
            f = net.forward(x, bag, len(some))
            error = (f["score"] - target[some]) * importance[some] / len(some)
            step += 1
            rate = 0.005 * (1 - 0.9 * epoch / epochs)
            for k, g in net.gradient(x, bag, f, error).items():
                g = g + decay * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return net


def quality_classifier(
    docs: DataFrame,
    marks: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "quality",
    threshold: float = 0.3,
    per_class: int = 1000,
    parts: int = 5,
    part: int = 0,
    per_text: int = 64,
) -> DataFrame:
    """Score every row: doc_id, held_out, score (0 to 1), predicted, top_attention, n_passages.

    Every passage of a text is encoded; learned gated attention weighs the codes and
    the weighted mean is scored.  Only rows of `marks` whose crc32(doc_id as text)
    modulo `parts` is not `part` are learned from, at most `per_class` texts of each
    class and of each text at most `per_text` evenly spaced passages, whose features go to
    the driver.  Scores come from the text alone.
    A null text scores as an empty one, which is one empty passage.
    """
    sample = training_rows(docs, marks, label, id_col, text_col, parts, part, per_class)
    found = map_texts(
        sample, ["target"], "text",
        lambda texts: [pa.array([spread(passages(t), per_text).astype("<f2").tobytes() for t in texts], pa.binary())], "rows binary",
    ).collect()
    target = np.array([r["target"] for r in found], np.int64)
    rows = [np.frombuffer(bytes(r["rows"]), "<f2").reshape(-1, FEATURES).astype(np.float32) for r in found]
    net = fit(rows, target, importances(target, class_shares(marks, label, parts, part)))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(texts: list[bytes]) -> list[pa.Array]:
        scored = [shared.value.score(t) for t in texts]
        kinds = (pa.float64(), pa.float64(), pa.int32())
        return [pa.array([s[i] for s in scored], kind) for i, kind in enumerate(kinds)]

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumn("held_out", held_out(F.col("doc_id"), parts, part))
    scored = map_texts(
        base, ["doc_id", "held_out"], "text", run, "score double; top_attention double; n_passages int"
    )
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "top_attention", "n_passages",
    )
