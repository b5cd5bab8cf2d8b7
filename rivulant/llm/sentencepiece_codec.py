"""SentencePiece encoding and decoding with a batched numpy Viterbi.

A text becomes words: the blanks before it and what follows up to the next blank
(no piece reaches from a letter into a blank).  Distinct words of equal length are
encoded together, one character position at a time: hashes of the substrings that end
there probe the sorted hashes of all pieces, and a vectorised maximum keeps the best
score and a backpointer.

A unigram model takes the path of highest score.  A BPE model replays merges instead,
and the best-scoring path is not its result; there a piece may only follow one that
BPE itself could put before it (`PieceTable.compatible`), which leaves exactly one
path, the model's own.  Characters without a piece become their UTF-8 bytes.

Runs of blanks share one score in such a model, the worst of all: letters merge first,
then each blank joins the run before it while a piece allows.  The last piece of a run
of n blanks is thus one more backpointer, by n alone, and words that begin with several
blanks go with the others.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulant.llm.common import map_texts

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG_WORD = 48  # longer words are cut where no piece reaches across, longer parts are filled up to share a batch
CACHE_WORDS = 300_000
BLOCK_BYTES = 4 << 20
_WORDS = re.compile(rb" +[^ ]*")
_SIEVE = np.uint64((1 << 20) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(path: str) -> dict:
    """Pieces, scores, kinds and model type of a .model file; a few hundred kB, read on the driver."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
        raise ValueError("only models with identity normalisation and a leading blank are supported")
    ids = range(sp.vocab_size())
    return {
        "pieces": [sp.id_to_piece(i) for i in ids],
        "scores": [sp.get_score(i) for i in ids],
        "special": [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in ids],
        "byte": [sp.is_byte(i) for i in ids],
        "bpe": model.trainer_spec.model_type == pb.TrainerSpec.BPE,
    }


def merge_word(word: str, rank: dict[str, tuple]) -> list[str]:
    """BPE as defined: the best-ranked pair merges first, the leftmost of equals."""
    part, nxt, prev = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = []

    def offer(i: int) -> None:
        j = nxt[i]
        if i >= 0 and j < len(word):
            both = part[i] + part[j]
            if both in rank:
                heapq.heappush(heap, (rank[both], i, both))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = nxt[i] if part[i] else len(word)
        if j >= len(word) or part[i] + part[j] != both:
            continue
        part[i], part[j], nxt[i] = both, "", nxt[j]
        if nxt[j] < len(word):
            prev[nxt[j]] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    return [p for p in part if p]


class PieceTable:
    """A model as arrays: sorted substring hashes, scores, and the last merge of every piece.

    Tokens are renumbered: single characters first, then longer pieces, best first.
    """

    def __init__(self, model: dict):
        self.bpe = model["bpe"]
        self.byte_ids = np.zeros(256, np.int32)
        normal = []
        for i, piece in enumerate(model["pieces"]):
            if model["byte"][i]:
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not model["special"][i]:
                normal.append(i)
        rank = {model["pieces"][i]: (-model["scores"][i],) for i in normal if len(model["pieces"][i]) > 1}
        normal.sort(key=lambda i: (len(model["pieces"][i]) > 1, -model["scores"][i], i))
        self.rank = rank
        texts = [model["pieces"][i] for i in normal]
        own = list(range(len(texts)))
        token = {t: i for i, t in enumerate(texts)}
        left, right, usable = own[:], own[:], [True] * len(texts)
        if self.bpe:
            for i, text in enumerate(texts):
                if len(text) > 1:
                    split = self._last_merge(text, rank)
                    usable[i] = split is not None and split[0] in token and split[1] in token
                    if usable[i]:
                        left[i], right[i] = token[split[0]], token[split[1]]
        self.token = {t: i for t, i in token.items() if usable[i]}
        self.left, self.right = np.array(left), np.array(right)
        self.size = max(1, len(texts))
        merged = [i for i in own if usable[i] and left[i] != i]
        pairs = np.array([left[i] * self.size + right[i] for i in merged], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.made = pairs[order], np.array(merged, np.int64)[order]
        self.ids = np.array(normal, np.int32)
        self.scores = np.array([model["scores"][i] for i in normal], np.float64)
        self.unknown = (self.scores.min() if len(normal) else 0.0) - 10.0
        self.longest = max((len(t) for t in self.token), default=1)
        joints = {ord(x) << 32 | ord(y) for t in self.token for x, y in zip(t, t[1:])}
        self.joints = np.array(sorted(joints), np.uint64)
        keys = {int(_prefix(_codes([t]))[0, -1]) ^ len(t): i for t, i in self.token.items()}
        self.keys = np.array(sorted(keys), np.uint64)
        self.likely = np.zeros(int(_SIEVE) + 1, bool)
        self.likely[self.keys & _SIEVE] = True
        self.key_token = np.array([keys[int(k)] for k in self.keys], np.int64)
        spelled = [
            bytes([int(p[3:5], 16)]) if model["byte"][i] else b"" if model["special"][i] else p.replace(SPACE, " ").encode()
            for i, p in enumerate(model["pieces"])
        ]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_len = np.array([len(s) for s in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len
        self._find_blanks(model, rank)

    def _find_blanks(self, model: dict, rank: dict[str, tuple]) -> None:
        """Pieces of blanks only, and whether they merge after all others and hold no letter (`blanks_last`)."""
        runs = {len(t): i for t, i in self.token.items() if not t.strip(SPACE)}
        self.run_ids = np.zeros(max(runs, default=0) + 1, np.int32)
        for size, i in runs.items():
            self.run_ids[size] = self.ids[i]
        self.run_sizes = frozenset(runs)
        worst = max((r for t, r in rank.items() if t.strip(SPACE)), default=(-np.inf,))
        shared = {r for t, r in rank.items() if not t.strip(SPACE)}
        apart = not any(SPACE in t[1:] and t.strip(SPACE) for t in self.token)
        self.blanks_last = self.bpe and 1 in runs and apart and len(shared) <= 1 and all(r > worst for r in shared)
        self.run_back = bytearray(1) if max(runs, default=0) < 256 else [0]  # size of the last piece of n blanks

    def runs(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids per run) of runs of so many blanks, walked back together.

        Of equal ranks the leftmost pair merges first, so right of the place at work lie single blanks: the next
        one joins the piece before it if both are a piece, and what comes of it the piece before that.
        """
        back, known = self.run_back, self.run_sizes
        for n in range(len(back), int(lengths.max()) + 1):
            size = 1
            while size < n and size + back[n - size] in known:
                size += back[n - size]
            back.append(size)
        steps, at, table = [], lengths.copy(), np.array(back, np.int64)
        while at.any():
            steps.append(table[at])
            at -= steps[-1]
        sizes = np.stack(steps[::-1], axis=1)
        used = sizes > 0
        return self.run_ids[sizes[used]], used.sum(axis=1)

    @staticmethod
    def _last_merge(text: str, rank: dict[str, tuple]) -> tuple[str, str] | None:
        """The two parts BPE joins last to make `text`, or none if it stops before."""
        rest = dict.fromkeys(text[i:j] for i in range(len(text)) for j in range(i + 2, len(text) + 1))
        known = {t: rank[t] for t in rest if t in rank and t != text}
        parts = merge_word(text, known)
        whole = merge_word(text, known | {text: rank[text]})
        if whole != [text]:
            return None
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Token of each hash, -1 where no piece has it."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.key_token[at], -1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves a and b side by side: undoing their merges from the latest on, none across is better."""
        good = np.ones(len(a), bool)
        alive = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[alive], b[alive]
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(alive):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            across = (self.pairs[at] == key) & (self.made[at] < limit)
            good[alive[across]] = False
            undo_a = a > b
            na, nb = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            go = ~across & ((na != a) | (nb != b))
            limit = np.where(undo_a, a, b + 1)[go]
            alive, a, b = alive[go], na[go], nb[go]
        return good

    def cut(self, word: str) -> list[str]:
        """The word in parts between which no piece reaches: no piece holds the two signs side by side.

        Merges and paths of one part then do not depend on the others.
        """
        codes = _codes([word])[0]
        pair = codes[:-1] << np.uint64(32) | codes[1:]
        at = np.minimum(np.searchsorted(self.joints, pair), max(0, len(self.joints) - 1))
        apart = np.flatnonzero(self.joints[at] != pair) + 1 if len(self.joints) else np.arange(1, len(word))
        edges = [0, *apart.tolist(), len(word)]
        return [word[i:j] for i, j in zip(edges, edges[1:])]

    def encode_equal(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids per word) of sorted words of about one length, advancing together.

        Shorter words are filled up at the end, which their own paths never reach.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(lengths.max())
        codes = _codes(words if (lengths == longest).all() else [w.ljust(longest, "\x00") for w in words])
        count, n = codes.shape
        prefix = _prefix(codes)
        power = np.ones(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                power[i + 1] = power[i] * _BASE
        # Words come sorted, so those that share a prefix are neighbours and one of them computes its state for all.
        differs = codes[1:] != codes[:-1]
        first = np.append(0, np.where(differs.any(axis=1), differs.argmax(axis=1), n))
        best = np.zeros((n + 1, count))
        last = np.full((n + 1, count), -1, np.int64)
        back = np.zeros((n + 1, count), np.int64)
        for end in range(1, n + 1):
            fresh = first < end
            lead, owner = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            sizes = np.arange(1, min(self.longest, end) + 1)
            with np.errstate(over="ignore"):
                hashes = prefix[lead, end, None] - prefix[lead[:, None], end - sizes] * power[sizes]
            hashes ^= sizes.astype(np.uint64)
            rows, which = np.nonzero(self.likely[hashes & _SIEVE])
            token = self.find(hashes[rows, which])
            hit = np.flatnonzero(token >= 0)
            rows, size, token = rows[hit], sizes[which[hit]], token[hit]
            top = best[end - 1, lead] + self.unknown  # the character by itself, should it be no piece
            top[rows[size == 1]] = -np.inf
            begin, whole = end - size, lead[rows]
            if self.bpe:
                ok = np.flatnonzero(self.compatible(last[begin, whole], token))
                rows, size, token, begin, whole = rows[ok], size[ok], token[ok], begin[ok], whole[ok]
            value = best[begin, whole] + self.scores[token]
            order = np.argsort(value, kind="stable")  # of the candidates of one word the best is written last
            order = order[value[order] > top[rows[order]]]
            rows = rows[order]
            piece, step = np.full(len(lead), -1, np.int64), np.ones(len(lead), np.int64)
            top[rows], piece[rows], step[rows] = value[order], token[order], size[order]
            best[end], last[end], back[end] = top[owner], piece[owner], step[owner]
        at = lengths.copy()
        steps, rows = [], np.arange(count)
        while at.any():
            live = at > 0
            token = np.where(live, last[at, rows], -2)
            char = np.where(token == -1, codes[rows, at - 1], 0)
            steps.append((token, char))
            at = at - np.where(live, back[at, rows], 0)
        tokens = np.stack([s[0] for s in reversed(steps)], axis=1)
        chars = np.stack([s[1] for s in reversed(steps)], axis=1)
        if (tokens == -1).any():
            out = [
                [i for t, c in zip(ts, cs) if t > -2 for i in ([int(self.ids[t])] if t >= 0 else self.byte_ids[list(chr(c).encode())].tolist())]
                for ts, cs in zip(tokens.tolist(), chars.tolist())
            ]
            return np.array([i for w in out for i in w], np.int32), np.array([len(w) for w in out])
        used = tokens >= 0
        return self.ids[tokens[used]], used.sum(axis=1)


def _codes(words: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _prefix(codes: np.ndarray) -> np.ndarray:
    """Rolling hashes of all prefixes."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + (codes[:, i] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return out


class Codec:
    """Encodes and decodes batches; remembers recent distinct words."""

    def __init__(self, table: PieceTable):
        self.table = table
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.pool, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Encode words not seen so far, those of equal length together."""
        texts = b"\x00".join(words).decode("utf-8", "replace").replace(" ", SPACE).split("\x00")
        if len(texts) != len(words):  # a word with a zero byte
            texts = [w.decode("utf-8", "replace").replace(" ", SPACE) for w in words]
        parts, held = [], np.ones(len(texts), np.int64)  # the parts of all words in a row, and how many each has
        runs: dict[int, int] = {}  # parts that are blanks before a word's last one, and how many
        by_itself = self.table.bpe and not self.table.blanks_last
        for i, text in enumerate(texts):
            start = len(parts)
            if self.table.blanks_last and text.startswith(SPACE * 2):
                blanks = len(text) - len(text.lstrip(SPACE))
                runs[start] = blanks - 1
                parts.append("")
                text = text[blanks - 1 :]
            if len(text) <= LONG_WORD or by_itself and text.startswith(SPACE * 2):
                parts.append(text)
            else:
                parts += self.table.cut(text)
            held[i] = len(parts) - start
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        long = np.flatnonzero(sizes > LONG_WORD)
        sizes[long] = 1 << np.ceil(np.log2(sizes[long])).astype(np.int64)  # long parts advance with those up to twice as long
        if by_itself:  # blanks merge before some letters: merges in their defined order
            sizes[[t.startswith(SPACE * 2) for t in parts]] = -1
        order = np.argsort(sizes, kind="stable")
        kinds, begins = np.unique(sizes[order], return_index=True)
        found, total = [np.zeros(0, np.int32)], 0
        begin, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)

        def place(group: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
            nonlocal total
            begin[group], size[group] = total + np.cumsum(count) - count, count
            found.append(ids)
            total += len(ids)

        for kind, group in zip(kinds.tolist(), np.split(order, begins[1:])):
            group = sorted(group.tolist(), key=parts.__getitem__)
            of_kind = [parts[i] for i in group]
            if kind > 0:
                place(group, *self.table.encode_equal(of_kind))
            elif kind < 0:
                coded = [self._merged(t) for t in of_kind]
                place(group, np.array([i for c in coded for i in c], np.int32), np.array([len(c) for c in coded]))
        if runs:
            self._lead(np.array(list(runs)), np.array(list(runs.values())), begin, size, np.concatenate(found), place)
        ids = np.concatenate(found)
        ids = ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        self.seen.update(zip(words, range(len(self.seen), len(self.seen) + len(words))))
        self.pool = np.concatenate([self.pool, ids])
        self.lengths = np.concatenate([self.lengths, np.add.reduceat(size, np.cumsum(held) - held)])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _lead(self, at: np.ndarray, blanks: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray, place) -> None:
        """Runs of blanks before words: where a word's own blank stayed alone it belongs to the run."""
        alone = ids[begin[at + 1]] == self.table.run_ids[1]
        begin[at[alone] + 1] += 1
        size[at[alone] + 1] -= 1
        blanks = blanks + alone
        spread = np.ceil(np.log2(blanks)).astype(np.int64)  # those of about one length together
        for kind in np.unique(spread).tolist():
            some = np.flatnonzero(spread == kind)
            place(at[some], *self.table.runs(blanks[some]))

    def _merged(self, text: str) -> list[int]:
        out = []
        for part in merge_word(text, self.table.rank):
            t = self.table.token.get(part, -1)
            out += [int(self.table.ids[t])] if t >= 0 else self.table.byte_ids[list(part.encode())].tolist()
        return out

    def _block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, counts = [], []
        for text in texts:
            found = _WORDS.findall(b" " + text.replace(SPACE.encode(), b" ")) if text else []
            words += found
            counts.append(len(found))
        if len(self.seen) > CACHE_WORDS:
            self._forget()
        seen = self.seen
        new = [w for w in dict.fromkeys(words) if w not in seen]
        if new:
            self._learn(new)
        index = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        size = self.lengths[index]
        begin = np.cumsum(size) - size
        total = int(size.sum())
        ids = self.pool[np.repeat(self.starts[index] - begin, size) + np.arange(total)]
        ends = np.cumsum(counts)
        upto = np.append(0, np.cumsum(size))
        per_text = upto[ends] - upto[ends - counts] if len(texts) else np.zeros(0, np.int64)
        return ids, per_text

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text)."""
        ids, sizes, held, weight = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], 0
        for text in texts:
            held.append(text)
            weight += len(text)
            if weight >= BLOCK_BYTES:
                one, size = self._block(held)
                ids.append(one)
                sizes.append(size)
                held, weight = [], 0
        if held:
            one, size = self._block(held)
            ids.append(one)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts; the blank that encoding puts before a text is taken off."""
        out, at = [], np.append(0, np.cumsum(sizes))
        step = max(1, BLOCK_BYTES // 4)
        lengths = self.table.spelled_len
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            parts = []
            for a in range(lo, hi, step):
                some = ids[a : min(hi, a + step)]
                size = lengths[some]
                begin = np.cumsum(size) - size
                where = np.repeat(self.table.spelled_at[some] - begin, size) + np.arange(int(size.sum()))
                parts.append(self.table.spelled[where].tobytes())
            text = b"".join(parts)
            out.append(text[1:] if text[:1] == b" " else text)
        return out


_CODECS: dict[str, Codec] = {}


def _codec(name: str, model) -> Codec:
    """One codec per worker and model."""
    if name not in _CODECS:
        _CODECS[name] = Codec(PieceTable(model.value))
    return _CODECS[name]


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """The columns `keep` and token_ids of every row; null and empty texts have no tokens."""
    model = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))
    return map_texts(
        docs, keep, text_col, lambda texts: [_lists(*_codec(model_path, model).encode(texts))], "token_ids array<int>"
    )


def decode(coded: DataFrame, keep: list[str], ids_col: str = "token_ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """The columns `keep` and the text of every row's ids (null ids: null; bytes that are no UTF-8 are replaced)."""
    model = coded.sparkSession.sparkContext.broadcast(read_pieces(model_path))
    kinds = dict(coded.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            flat = np.asarray(lists.flatten(), np.int64)
            sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            made = _codec(model_path, model).decode(flat, sizes)
            valid = lists.is_valid().to_pylist()
            texts = [t.decode("utf-8", "replace") if v else None for t, v in zip(made, valid)]
            columns = [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text"])

    return coded.select(*keep, F.col(ids_col)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, keep: list[str], text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Encode and decode in one pass: `keep`, n_tokens, token_ids, decoded_sha256 and whether the text came back.

    A null text counts as empty.  Texts that hold the model's own blank sign U+2581
    come back with a blank in its place, as the model defines; only these differ.
    """
    import hashlib

    model = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))

    def run(texts: list[bytes]) -> list[pa.Array]:
        codec = _codec(model_path, model)
        ids, sizes = codec.encode(texts)
        back = codec.decode(ids, sizes)
        return [
            pa.array(sizes, pa.int64()),
            _lists(ids, sizes),
            pa.array([hashlib.sha256(b).hexdigest() for b in back]),
            pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
        ]

    return map_texts(
        docs, keep, text_col, run, "n_tokens long; token_ids array<int>; decoded_sha256 string; same boolean"
    )
