"""Quality classifier: a linear-chain conditional random field labels every line of a text good or bad.

A line is described by the make-up of its bytes, its length, whether it repeats in the text, and the
same of its neighbours. Forward-backward marginals of the two labels are averaged over the lines,
weighted by length, and a logistic curve turns the average into the probability that the document is
good. Lines take the label of their document when the field is fitted, on a bounded sample.

Defined cases: a null or empty text is one empty line; line ends are line feeds; rows that repeat get
equal scores; with one label or none in the sample the score is the share of good documents (0.5
without any). Texts of any length are scored whole; only the id and the text are read for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.blocks import U64, Words, column, mix, slices, text_buffer
from tidemark.llm.samples import labelled_texts

#: Labelled documents at most; rounds and step of the fit; weight of the squared weights.
MOST_DOCS, ROUNDS, STEP, RIDGE = 2000, 200, 0.05, 1e-3
#: Score from which a document is predicted good.
LIMIT = 0.3

# Classes of bytes.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[0x20, 9, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in "#$%&*@^~_+=<>\\/{}[]`"]] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[0x80:] = 8
_N = 9


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line of a block of texts, the n + 1 positions of the texts' first lines, and line lengths."""
    breaks = np.flatnonzero(data == 10)
    # a text has a line more than it has line feeds
    per = np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(per)])
    n = int(first[-1])
    start = np.empty(n, dtype=np.int64)
    start[first[:-1]] = at[:-1]
    rest = np.ones(n, dtype=bool)
    rest[first[:-1]] = False
    start[rest] = breaks + 1
    end = np.empty(n, dtype=np.int64)
    end[first[1:] - 1] = at[1:]
    rest[:] = True
    rest[first[1:] - 1] = False
    end[rest] = breaks
    length = end - start
    line = np.repeat(np.arange(n), np.diff(np.append(start, len(data)))) if len(data) else np.zeros(0, np.int64)
    counts = np.bincount(line * _N + _CLASS[data], minlength=n * _N).reshape(n, _N).astype(np.float64)
    counts[rest, 0] -= 1  # the line feed itself
    share = counts / np.maximum(length, 1)[:, None]
    letters = counts[:, 1] + counts[:, 2] + counts[:, 8]
    # lines that repeat within their text
    mark = np.zeros(n, U64)
    if len(data):
        place = (np.arange(len(data)) - start[line]).astype(U64)
        with np.errstate(over="ignore"):
            value = mix(data.astype(U64) + (place << U64(8)) + U64(1))
        value[data == 10] = 0
        full = np.flatnonzero(np.diff(np.append(start, len(data))) > 0)
        mark[full] = np.add.reduceat(value, start[full])
    doc = np.repeat(np.arange(len(per)), per)
    order = np.lexsort([mark, doc])
    same = np.zeros(n, dtype=bool)
    pair = (mark[order][1:] == mark[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    same[order[1:]] |= pair
    same[order[:-1]] |= pair
    same &= length > 0
    words = counts[:, 4] + 1
    run = Words(data, at)
    hashed = run.hashes(data)
    stutter = np.zeros(n)
    if len(hashed) > 1:
        of = line[run.start]
        again = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
        stutter = np.bincount(of[1:][again], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)
    own = np.column_stack(
        [
            np.sqrt(share[:, [0, 3, 4, 5, 6, 7, 8]]),
            np.sqrt(counts[:, 2] / np.maximum(letters, 1)),
            np.log1p(length) / 5,
            np.minimum(letters / words, 12) / 5,
            same,
            length == 0,
            np.sqrt(stutter),
            stutter > 0.3,
            share[:, 5] > 0.04,
            share[:, 7] > 0.02,
            share[:, 6] > 0.02,
            counts[:, 2] > 0.5 * np.maximum(letters, 1),
        ]
    )
    lead, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    lead[first[:-1]], last[first[1:] - 1] = True, True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[lead], after[last] = own[lead], own[last]
    near = [1, 3, 5, 7, 10, 12]
    size = np.log1p(per)[doc] / 3
    x = np.column_stack([np.ones(n), own, before[:, near], after[:, near], lead, last, size])
    return x, first, length


class LineField:
    """Weights of the label good against bad, and of the pairs of neighbouring labels (0 bad, 1 good)."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray) -> None:
        self.weights, self.pairs = weights, pairs
        self.curve = (0.0, 1.0)

    def marginals(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and P(both labels) of each line and the one before it (rows without one are 0).

        Forward-backward over all texts at once: step t handles line t of every text that has one.
        """
        good = x @ self.weights
        per = np.diff(first)
        order = np.argsort(-per, kind="stable")
        many, begin = per[order], first[:-1][order]
        alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        alpha[begin, 1] = good[begin]
        move = np.exp(self.pairs)
        alive = [begin[: np.searchsorted(-many, -t, side="left")] + t for t in range(int(many[0]) if len(many) else 0)]
        for at in alive[1:]:
            top = alpha[at - 1].max(axis=1)
            step = np.log(np.exp(alpha[at - 1] - top[:, None]) @ move) + top[:, None]
            step[:, 1] += good[at]
            alpha[at] = step
        for at in alive[:0:-1]:
            ahead = beta[at].copy()
            ahead[:, 1] += good[at]
            top = ahead.max(axis=1)
            beta[at - 1] = np.log(np.exp(ahead - top[:, None]) @ move.T) + top[:, None]
        both = alpha + beta
        total = np.logaddexp(both[:, 0], both[:, 1])
        p = np.exp(both[:, 1] - total)
        joint = np.zeros((len(x), 2, 2))
        later = np.ones(len(x), dtype=bool)
        later[first[:-1]] = False
        at = np.flatnonzero(later)
        here = beta[at].copy()
        here[:, 1] += good[at]
        joint[at] = np.exp(alpha[at - 1][:, :, None] + self.pairs + here[:, None, :] - total[at][:, None, None])
        return p, joint

    def average(self, x: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Mean marginal of each text, weighted by line length."""
        p, _ = self.marginals(x, first)
        weight = length + 1.0
        return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        mean = np.clip(self.average(*line_features(data, at)), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * np.log(mean / (1 - mean)))))

    @classmethod
    def fit(cls, texts: list[tuple[str, int, int]]) -> LineField:
        """Adam on the conditional likelihood of the lines, each text counting as one line or a few."""
        y = np.array([v for _, v, _ in texts], dtype=np.float64)
        parts = [line_features(*text_buffer(pa.array([t for t, _, _ in texts[i : i + 64]], pa.string()))) for i in range(0, len(texts), 64)]
        if not parts:
            parts = [line_features(np.zeros(0, np.uint8), np.zeros(1, np.int64))]
        x, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
        field = cls(np.zeros(x.shape[1]), np.zeros((2, 2)))
        share = y.mean() if len(y) else 0.5
        if share in (0.0, 1.0) or not len(y):
            field.curve = (float(np.log((share + 0.01) / (1.01 - share))), 0.0)
            return field
        per = np.diff(first)
        weight = np.repeat(np.sqrt(per) / per * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)), per) / len(y)
        gold = np.repeat(y, per)
        later = np.ones(len(x), dtype=bool)
        later[first[:-1]] = False
        theta = np.concatenate([field.weights, field.pairs.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, ROUNDS + 1):
            p, joint = field.marginals(x, first)
            g = x.T @ (weight * (gold - p))
            seen = np.array([[((gold == 0) & later) @ weight, 0.0], [0.0, ((gold == 1) & later) @ weight]])
            gp = seen - np.einsum("i,ijk->jk", weight, joint)
            grad = np.concatenate([g, gp.ravel()]) - RIDGE * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta + STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            field.weights, field.pairs = theta[: x.shape[1]], theta[x.shape[1] :].reshape(2, 2)
        mean = np.clip(field.average(x, first, length), 1e-6, 1 - 1e-6)
        field.curve = logistic_curve(np.log(mean / (1 - mean)), y)
        return field


def logistic_curve(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope of a one-variable logistic regression, by damped Newton steps."""
    a, b = 0.0, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * z).sum() - 1e-3 * (b - 1)])
        h = np.array([[w.sum() + 1e-3, (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCS) -> LineField:
    """Fits on about ``most`` labelled rows, none of the held-out fold (CRC-32 remainder 0 of 5)."""
    return LineField.fit(labelled_texts(docs, labels, "quality", 5, 0, most))


def score_quality(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, score and prediction of each text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "t", 1 << 19):
            score = model.score(*text_buffer(column(batch, "t")))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(score), pa.array((score >= LIMIT).astype(np.int32))], ["id", "score", "predicted"])

    narrow = docs.selectExpr(f"`{id_col}` AS id", f"cast(`{text_col}` AS string) AS t")
    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)
