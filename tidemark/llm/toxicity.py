"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own features (label odds of the word in the sample, a hashed embedding) beside
features of its characters (mean embedding of its bytes and of its byte pairs). Windows of ``WINDOW``
words that overlap by half cover the whole text; both directions run over each window, an attention
weights the states, and a logistic output scores the window. A document's score is a logistic
function of its highest window and of the log of its number of windows.

Windows have no labels, so the network learns in two rounds: in the first, the windows with the most
odds stand for toxic documents, in the second those that the network itself scores highest.

Defined cases: a null or empty text is one window without a word; shorter texts are one padded window,
longer ones end with a window that closes at the last word; rows that repeat get equal scores; with
one label or none in the sample, every score is the share of toxic documents (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.blocks import LOWER, MARKS, SortedHashes, U64, Words, column, mix, slices, text_buffer
from tidemark.llm.samples import labelled_texts

#: Words of a window and between windows; sizes of the state, of the attention and of the embeddings; rows of the hashed tables.
WINDOW, STRIDE = 16, 8
STATE, ATTEND, WORD_DIM, CHAR_DIM = 8, 8, 4, 4
WORD_ROWS, PAIR_ROWS = 1 << 12, 1 << 10
#: Labelled documents at most; epochs a round; windows a batch; step; documents that a word must be in to have odds.
MOST_DOCS, EPOCHS, BATCH, STEP, LEAST_DOCS = 4000, 6, 256, 0.01, 3
LIMIT = 0.3

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Vocabulary:
    """Different words of a block: their hashes, byte statistics and the word number at each place."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        low = LOWER[data]
        words = Words(low, at, MARKS)
        self.first, self.counts = words.first, words.counts
        every = words.hashes(low)
        self.hash, index, self.at = np.unique(every, return_index=True, return_inverse=True)
        start, end = words.start[index], words.end[index]
        n = end - start
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        self.byte = low[place] if len(low) else np.zeros(0, np.uint8)
        last = np.zeros(len(owner), dtype=bool)
        last[np.cumsum(n) - 1] = True
        nxt = np.where(last, 0, low[np.minimum(place + 1, max(len(low) - 1, 0))]) if len(low) else np.zeros(0, np.int64)
        self.pair = (mix((self.byte.astype(U64) << U64(8)) + nxt.astype(U64)) % U64(PAIR_ROWS)).astype(np.int64)
        self.owner, self.begin, self.size = owner, np.cumsum(n) - n, n.astype(np.float32)
        self.row = (self.hash % U64(WORD_ROWS)).astype(np.int64)

    def mean(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.begin, axis=0) / self.size[:, None] if len(self.begin) else np.zeros((0, values.shape[1]), np.float32)


def windows(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places (-1: padding) of all windows, the text of each and the n + 1 positions of each text's windows."""
    per = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(counts)), per)
    begin = np.concatenate([[0], np.cumsum(per)])
    start = (np.arange(len(doc)) - begin[:-1][doc]) * STRIDE
    start = np.minimum(start, np.maximum(counts[doc] - WINDOW, 0))
    step = np.arange(WINDOW)
    place = np.where(step < (counts[doc] - start)[:, None], (first[:-1][doc] + start)[:, None] + step, -1)
    return place, doc, begin


class GatedNetwork:
    """Parameters and the forward and backward passes."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        inputs = 2 + WORD_DIM + 2 * CHAR_DIM
        init = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p: Params = {
            "word": init(WORD_ROWS, WORD_DIM, scale=0.05), "byte": init(256, CHAR_DIM, scale=0.2), "pair": init(PAIR_ROWS, CHAR_DIM, scale=0.2),
            **{f"w{d}": init(inputs, 3 * STATE, scale=0.3) for d in "fb"}, **{f"b{d}": np.zeros(3 * STATE, np.float32) for d in "fb"},
            **{f"u{d}": init(STATE, 3 * STATE, scale=0.3) for d in "fb"},
            "a": init(2 * STATE, ATTEND, scale=0.3), "v": init(ATTEND, 1, scale=0.3), "o": init(2 * STATE, 1, scale=0.3), "c": np.zeros(1, np.float32),
        }
        self.odds_keys, self.odds = SortedHashes(np.zeros(0, U64)), np.zeros(0, np.float32)
        self.curve = np.array([0.0, 1.0, 0.0])
        self.share: float | None = 0.5

    def inputs(self, vocabulary: Vocabulary) -> np.ndarray:
        """Features of each different word; the last row stands for padding."""
        at = self.odds_keys.find(vocabulary.hash)
        known = at >= 0
        odds = np.where(known, self.odds[np.maximum(at, 0)], 0).astype(np.float32) if len(self.odds) else np.zeros(len(at), np.float32)
        x = np.column_stack([odds, known.astype(np.float32), self.p["word"][vocabulary.row], vocabulary.mean(self.p["byte"][vocabulary.byte]), vocabulary.mean(self.p["pair"][vocabulary.pair])])
        return np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)]).astype(np.float32)

    def _run(self, x: np.ndarray, u: np.ndarray, mask: np.ndarray, order: range, keep: list | None) -> np.ndarray:
        """States of one direction: x holds the projected inputs (window, step, 3 * STATE)."""
        h = np.zeros((len(x), STATE), np.float32)
        out = np.empty((len(x), WINDOW, STATE), np.float32)
        gates, new = u[:, : 2 * STATE], u[:, 2 * STATE :]
        for t in order:
            zr = _sigmoid(x[:, t, : 2 * STATE] + h @ gates)
            z, r = zr[:, :STATE], zr[:, STATE:]
            n = np.tanh(x[:, t, 2 * STATE :] + (r * h) @ new)
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, n, m))
            h = h + m * (1 - z) * (n - h)
            out[:, t] = h
        return out

    def forward(self, table: np.ndarray, place: np.ndarray, train: bool = False) -> tuple[np.ndarray, dict]:
        """Logit of each window; ``table``: features of the different words, ``place``: their numbers (-1: padding)."""
        p = self.p
        mask = (place >= 0).astype(np.float32)
        tape: dict = {"keep": {}}
        states = []
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            keep: list | None = [] if train else None
            projected = (table @ p[f"w{d}"] + p[f"b{d}"])[place]
            states.append(self._run(projected, p[f"u{d}"], mask, order, keep))
            tape["keep"][d] = keep
        h = np.concatenate(states, axis=2)
        e = np.tanh(h @ p["a"])
        s = (e @ p["v"])[:, :, 0]
        s = np.where(mask > 0, s, np.float32(-30))
        w = np.exp(s - s.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        pooled = np.einsum("ij,ijk->ik", w, h)
        logit = (pooled @ p["o"])[:, 0] + p["c"][0]
        if train:
            tape |= {"mask": mask, "h": h, "e": e, "w": w, "pooled": pooled}
        return logit, tape

    def backward(self, vocabulary: Vocabulary, table: np.ndarray, place: np.ndarray, tape: dict, slope: np.ndarray) -> Params:
        """Gradient of the loss; ``slope``: its derivative by each logit."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        h, e, w = tape["h"], tape["e"], tape["w"]
        g["o"] = tape["pooled"].T @ slope[:, None]
        g["c"] = np.array([slope.sum()], np.float32)
        dpool = slope[:, None] * p["o"][:, 0]
        dh = w[:, :, None] * dpool[:, None, :]
        dw = np.einsum("ijk,ik->ij", h, dpool)
        ds = w * (dw - (w * dw).sum(axis=1, keepdims=True)) * tape["mask"]
        g["v"] = np.einsum("ijk,ij->k", e, ds)[:, None]
        de = ds[:, :, None] * p["v"][:, 0] * (1 - e * e)
        g["a"] = np.einsum("ijk,ijl->kl", h, de)
        dh = dh + de @ p["a"].T
        dtable = np.zeros_like(table)
        for d, part in (("f", dh[:, :, :STATE]), ("b", dh[:, :, STATE:])):
            u = p[f"u{d}"]
            carry = np.zeros((len(place), STATE), np.float32)
            dx = np.zeros((*place.shape, 3 * STATE), np.float32)
            for t, before, z, r, n, m in reversed(tape["keep"][d]):
                total = carry + part[:, t]
                dn = total * m * (1 - z)
                dz = total * m * (before - n)
                carry = total * (1 - m * (1 - z))
                dan = dn * (1 - n * n)
                drh = dan @ u[:, 2 * STATE :].T
                g[f"u{d}"][:, 2 * STATE :] += (r * before).T @ dan
                dgate = np.concatenate([dz * z * (1 - z), drh * before * r * (1 - r)], axis=1)
                g[f"u{d}"][:, : 2 * STATE] += before.T @ dgate
                carry = carry + drh * r + dgate @ u[:, : 2 * STATE].T
                dx[:, t] = np.concatenate([dgate, dan], axis=1)
            flat = np.zeros((len(table), 3 * STATE), np.float32)
            np.add.at(flat, place.ravel(), dx.reshape(-1, 3 * STATE))  # -1 goes to the padding row
            g[f"b{d}"] = flat.sum(axis=0)
            g[f"w{d}"] = table.T @ flat
            dtable += flat @ p[f"w{d}"].T
        dword = dtable[:-1]
        np.add.at(g["word"], vocabulary.row, dword[:, 2 : 2 + WORD_DIM])
        dchar = dword / np.maximum(vocabulary.size, 1)[:, None]
        np.add.at(g["byte"], vocabulary.byte, dchar[vocabulary.owner, 2 + WORD_DIM : 2 + WORD_DIM + CHAR_DIM])
        np.add.at(g["pair"], vocabulary.pair, dchar[vocabulary.owner, 2 + WORD_DIM + CHAR_DIM :])
        return g

    # --- fitting -------------------------------------------------------------------------------------------

    def _set_odds(self, vocabulary: Vocabulary, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Odds of the words that are in LEAST_DOCS documents or more; the counts behind them."""
        doc = np.repeat(np.arange(len(y)), vocabulary.counts)
        pairs = np.unique(vocabulary.at.astype(np.int64) * len(y) + doc)
        word, of = pairs // len(y), pairs % len(y)
        n, toxic = np.bincount(word, minlength=len(vocabulary.hash)), np.bincount(word, y[of], len(vocabulary.hash))
        keep = n >= LEAST_DOCS
        self.odds_keys = SortedHashes(vocabulary.hash[keep])
        self.odds = self._odds(n[keep], toxic[keep], len(y), y.sum())
        return n, toxic

    @staticmethod
    def _odds(n: np.ndarray, toxic: np.ndarray, total: float, positive: float) -> np.ndarray:
        with_, without = (toxic + 0.5) / (positive + 1), (n - toxic + 0.5) / (total - positive + 1)
        with np.errstate(invalid="ignore", divide="ignore"):  # counts below zero, where a word is left out anyway
            return np.clip(np.log(with_ / without), -4, 4).astype(np.float32)

    @classmethod
    def fit(cls, texts: list[tuple[str, int, int]], seed: int = 11) -> GatedNetwork:
        net = cls(seed)
        y = np.array([v > 0 for _, v, _ in texts], dtype=np.float64)
        if not len(y) or y.min() == y.max():
            net.share = float(y.mean()) if len(y) else 0.5
            return net
        net.share = None
        rng = np.random.default_rng(seed)
        vocabulary = Vocabulary(*text_buffer(pa.array([t for t, _, _ in texts], pa.string())))
        n, toxic = net._set_odds(vocabulary, y)
        place, doc, begin = windows(vocabulary.first, vocabulary.counts)
        at = np.where(place >= 0, vocabulary.at[np.maximum(place, 0)], -1) if len(vocabulary.at) else place
        # odds that leave out a word's own document, so that a rare word does not give away its label
        own = y[doc][:, None]
        left = np.where((at >= 0) & (n[at] - 1 >= LEAST_DOCS), net._odds(n[at] - 1, toxic[at] - own, len(y) - 1, y.sum() - own), 0) if len(n) else np.zeros(at.shape)
        rank = left.max(axis=1) + 0.01 * left.sum(axis=1)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
        steps = 0
        for _ in range(2):
            order = np.lexsort([-rank, doc])
            best = order[begin[:-1]]
            second = order[np.minimum(begin[:-1] + 1, begin[1:] - 1)]
            others = rng.integers(begin[:-1], begin[1:])
            clean = y == 0
            chosen = np.concatenate([best, second[clean], others[clean]])
            gold = y[doc[chosen]]
            heavy = np.where(gold > 0, len(gold) / (2 * gold.sum()), len(gold) / (2 * (len(gold) - gold.sum())))
            for _ in range(EPOCHS):
                shuffled = rng.permutation(len(chosen))
                for k in range(0, len(shuffled), BATCH):
                    pick = shuffled[k : k + BATCH]
                    steps += 1
                    net._step(vocabulary, at[chosen[pick]], left[chosen[pick]], gold[pick], heavy[pick], state, steps)
            table = net.inputs(vocabulary)
            rank = np.concatenate([net.forward(table, at[k : k + 4096])[0] for k in range(0, len(at), 4096)])
        top = np.maximum.reduceat(rank, begin[:-1])
        net.curve = _fit_curve(np.column_stack([np.ones(len(y)), top, np.log(np.diff(begin))]), y)
        return net

    def _step(self, vocabulary: Vocabulary, at: np.ndarray, odds: np.ndarray, gold: np.ndarray, heavy: np.ndarray, state: dict, k: int) -> None:
        """An Adam step on a batch; each place of the batch is a word of its own, since its odds are."""
        words, inverse = np.unique(at[at >= 0], return_inverse=True)
        part = _Part(vocabulary, words)
        base = self.inputs(part)
        table = np.vstack([base[:-1][inverse], base[-1:]]) if len(words) else base
        table[:-1, 0] = odds[at >= 0]
        place = np.full(at.shape, -1)
        place[at >= 0] = np.arange(len(inverse))
        logit, tape = self.forward(table, place, train=True)
        slope = ((_sigmoid(logit) - gold) * heavy / len(gold)).astype(np.float32)
        grads = self.backward(_Places(part, inverse), table, place, tape, slope)
        for name, grad in grads.items():
            m, v = state[name]
            grad = np.clip(grad, -1, 1) + np.float32(1e-5) * self.p[name]
            m *= 0.9
            m += 0.1 * grad
            v *= 0.999
            v += 0.001 * grad * grad
            self.p[name] -= (STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)).astype(np.float32)

    # --- scoring -------------------------------------------------------------------------------------------

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows = len(at) - 1
        if self.share is not None:
            return np.full(rows, self.share)
        vocabulary = Vocabulary(data, at)
        table = self.inputs(vocabulary)
        place, _, begin = windows(vocabulary.first, vocabulary.counts)
        number = np.where(place >= 0, vocabulary.at[np.maximum(place, 0)], -1) if len(vocabulary.at) else place
        logit = np.concatenate([self.forward(table, number[k : k + 4096])[0] for k in range(0, len(number), 4096)])
        top = np.maximum.reduceat(logit, begin[:-1])
        z = np.column_stack([np.ones(rows), top, np.log(np.diff(begin))]) @ self.curve
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Part:
    """Some words of a vocabulary, as a vocabulary."""

    def __init__(self, whole: Vocabulary, words: np.ndarray) -> None:
        n = whole.size[words].astype(np.int64)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(whole.begin[words], n)
        self.hash, self.row = whole.hash[words], whole.row[words]
        self.byte, self.pair = whole.byte[place], whole.pair[place]
        self.owner, self.begin, self.size = np.repeat(np.arange(len(words)), n), np.cumsum(n) - n, n.astype(np.float32)

    mean = Vocabulary.mean


class _Places:
    """Words at the places of a batch, with the bytes of each."""

    def __init__(self, part: _Part, inverse: np.ndarray) -> None:
        n = part.size[inverse].astype(np.int64)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(part.begin[inverse], n)
        self.row, self.byte, self.pair = part.row[inverse], part.byte[place], part.pair[place]
        self.owner, self.size = np.repeat(np.arange(len(inverse)), n), part.size[inverse]


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by damped Newton steps, with a small ridge."""
    b = np.array([0.0, 1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(3)
        b = b + np.clip(np.linalg.solve(h, x.T @ (y - p) - 1e-2 * b), -1, 1)
    return b


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCS) -> GatedNetwork:
    """Fits on about ``most`` labelled rows, none of the held-out fold (CRC-32 remainder 2 of 4)."""
    return GatedNetwork.fit(labelled_texts(docs, labels, "toxic", 4, 2, most))


def score_toxicity(docs: DataFrame, network: GatedNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, score and prediction of each text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, "t"):
            score = net.score(*text_buffer(column(batch, "t")))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(score), pa.array((score >= LIMIT).astype(np.int32))], ["id", "score", "predicted"])

    narrow = docs.selectExpr(f"`{id_col}` AS id", f"cast(`{text_col}` AS string) AS t")
    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)
