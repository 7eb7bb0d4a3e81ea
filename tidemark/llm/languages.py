"""Language identification with interpolated Kneser-Ney character models.

One model a language, all orders from 1 to ``ORDER``. The grams of all languages are kept in one
sorted array of 64-bit hashes an order, beside a matrix with a column of log-probabilities for
each language; an index over the leading hash bits replaces the binary search. A text goes to
the language with the lowest cross-entropy a character. It is rejected when it has no letter, or
when that entropy is above what texts of its length reach in the training sample.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows that repeat
get equal results; texts of any length are scored whole; of equal entropies the language first
by code point wins; with no labelled row at all every text is ``und``. Only the id, the text and,
for fitting, the language column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.blocks import SortedHashes, U64, column, mix, slices, text_buffer
from tidemark.llm.samples import by_class

#: Length of the longest gram, texts a language at most that a model is fitted on.
ORDER = 4
MOST_TEXTS = 144
#: Every so many texts of a language calibrate the rejection and are not fitted on; a text is rejected beyond so many standard errors, and so many nats, over the mean entropy of these.
CALIBRATE, REJECT_ERRORS, REJECT_SLACK = 6, 8.0, 0.5

_SALTS = [U64(((0xD6E8FEB86659FD93 * (2 * j + 3)) ^ (0x9E3779B97F4A7C15 << j)) % (1 << 64) | 1) for j in range(16)]
_TABLES: dict[str, np.ndarray] = {}
_LOW = 0x3000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Folded symbol of each code point below 0x3000, and whether a code point is a letter."""
    if not _TABLES:
        fold = np.arange(_LOW, dtype=np.uint32)
        for i in range(_LOW):
            c = chr(i)
            low = c.lower()
            fold[i] = ord(low) if c.isalpha() and len(low) == 1 else i if c.isalpha() else 0x20 if c.isspace() else 0x30 if c.isdigit() else 0x2E
        _TABLES["fold"] = fold
        _TABLES["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _TABLES["fold"], _TABLES["letter"]


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded symbols of a block, each text led by ORDER - 1 spaces; offsets; letters a text."""
    fold, letter = _tables()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    if starts[-1] != len(points):  # malformed bytes: decode text by text
        parts = [np.frombuffer(data[s:e].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32) for s, e in zip(at[:-1], at[1:], strict=True)]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        points = np.concatenate(parts)
    n, lead = np.diff(starts), ORDER - 1
    before = np.concatenate([[0], np.cumsum(letter[points])])
    letters = before[starts[1:]] - before[starts[:-1]]
    folded = fold[np.minimum(points, _LOW - 1)] if len(points) else points
    high = points >= _LOW
    if high.any():
        folded = np.where(high, points, folded)
    out = np.full(len(points) + lead * len(n), 0x20, dtype=np.uint32)
    out[np.arange(len(points)) + np.repeat(lead * np.arange(1, len(n) + 1), n)] = folded
    return out, starts + lead * np.arange(len(n) + 1), letters


def grams(symbol: np.ndarray) -> list[np.ndarray]:
    """Hashes of the gram of each length 0 to ORDER that ends at each position (the first ones wrap and are not used)."""
    wide = symbol.astype(U64) + U64(1)
    out = [np.zeros(len(symbol), U64)]
    for j in range(ORDER):
        back = np.zeros_like(wide)
        back[j:] = wide[: len(wide) - j] if j else wide
        out.append(out[-1] + mix(back * _SALTS[j]))
    return out


class LanguageModels:
    """Fitted models: per order the sorted hashes, log-probabilities and back-off weights."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.tables: list[tuple[SortedHashes, np.ndarray]] = []  # order 1 .. ORDER: log p of a gram
        self.backs: list[tuple[SortedHashes, np.ndarray]] = []  # order 1 .. ORDER: log weight of its context
        self.floor = np.zeros(len(names))
        self.mean, self.spread = 0.0, 1.0

    @classmethod
    def fit(cls, texts: list[tuple[str, str]]) -> LanguageModels:
        names = sorted({name for _, name in texts})
        model = cls(names)
        number: dict[str, int] = {}
        kept, apart = [], []
        for t, name in texts:
            number[name] = number.get(name, 0) + 1
            (apart if number[name] % CALIBRATE == 0 else kept).append((t, name))
        texts = kept
        if not names:
            return model
        parts = []
        for name in names:
            own = pa.array([t for t, n in texts if n == name], pa.string())
            symbol, starts, _ = symbols(*text_buffer(own))
            real = np.ones(len(symbol), dtype=bool)
            for j in range(ORDER - 1):
                real[starts[:-1] + j] = False
            parts.append((grams(symbol), real))
        vocabulary = len(np.unique(np.concatenate([g[1][real] for g, real in parts]))) + 1
        model.floor = np.full(len(names), -np.log(vocabulary))
        below: tuple[SortedHashes, np.ndarray] | None = None
        for k in range(1, ORDER + 1):
            union, index = np.unique(np.concatenate([g[k][real] for g, real in parts]), return_index=True)
            suffix = np.concatenate([g[k - 1][real] for g, real in parts])[index]
            context = np.concatenate([np.concatenate([[U64(0)], g[k - 1][:-1]])[real] for g, real in parts])[index] if k > 1 else np.zeros(len(union), U64)
            contexts = np.unique(context)
            p, back = np.zeros((len(union), len(names))), np.zeros((len(contexts), len(names)))
            for i, (g, real) in enumerate(parts):
                if k == ORDER:
                    seen, count = np.unique(g[k][real], return_counts=True)
                else:  # continuation counts: different symbols to the left
                    longer, first = np.unique(g[k + 1][real], return_index=True)
                    seen, count = np.unique(g[k][real][first], return_counts=True)
                here = np.searchsorted(union, seen)
                n1, n2 = int((count == 1).sum()), int((count == 2).sum())
                off = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                where = np.searchsorted(contexts, context[here])
                total = np.bincount(where, count, len(contexts))
                kinds = np.bincount(where, minlength=len(contexts))
                back[:, i] = np.where(total > 0, off * kinds / np.maximum(total, 1), 1.0)
                p[here, i] = (count - off) / total[where]
            if below is None:
                lower = np.full((len(union), len(names)), 1 / vocabulary)
            else:
                lower = np.exp(below[1][below[0].find(suffix)])
            p += back[np.searchsorted(contexts, context)] * lower
            below = (SortedHashes(union), np.log(p).astype(np.float32))
            model.tables.append(below)
            model.backs.append((SortedHashes(contexts), np.log(back).astype(np.float32)))
        sample = [model.entropies(*text_buffer(pa.array([t for t, _ in apart[i : i + 32]], pa.string()))) for i in range(0, len(apart), 32)]
        if not sample:  # too few texts to set any apart: those of the fit
            sample = [model.entropies(*text_buffer(pa.array([t for t, _ in texts[i : i + 32]], pa.string()))) for i in range(0, len(texts), 32)]
        best, n = np.concatenate([e.min(axis=1) for e, _, _ in sample]), np.concatenate([c for _, c, _ in sample])
        long = n >= 20
        if long.any():
            model.mean = float(np.average(best[long], weights=n[long]))
            model.spread = float(np.sqrt(np.average((best[long] - model.mean) ** 2 * n[long])) + 0.1)
        return model

    def entropies(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a character of each text in each language, its characters and its letters."""
        symbol, starts, letters = symbols(data, at)
        n = np.diff(starts) - (ORDER - 1)
        gram = grams(symbol)
        real = np.ones(len(symbol), dtype=bool)
        for j in range(ORDER - 1):
            real[starts[:-1] + j] = False
        logs = np.zeros((len(symbol), len(self.names)), dtype=np.float32)
        todo = np.flatnonzero(real)
        for k in range(ORDER, 0, -1):
            table, value = self.tables[k - 1]
            found = table.find(gram[k][todo])
            hit = found >= 0
            logs[todo[hit]] += value[found[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            contexts, weight = self.backs[k - 1]
            place = contexts.find(gram[k - 1][todo - 1] if k > 1 else np.zeros(len(todo), U64))
            known = place >= 0
            logs[todo[known]] += weight[place[known]]
        logs[todo] += self.floor.astype(np.float32)
        total = np.zeros((len(n), len(self.names)))
        full = np.flatnonzero(n > 0)
        if len(full):  # the lead of each text counts nothing, so sums from one start to the next are right
            total = np.add.reduceat(logs, starts[:-1], axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n, letters

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, entropy and rejection of each text."""
        rows = len(at) - 1
        if not self.names:
            return ["und"] * rows, np.zeros(rows), np.zeros(rows), np.ones(rows, dtype=bool)
        entropy, n, letters = self.entropies(data, at)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(rows), best]
        score = 1 / np.exp(-np.clip((entropy - lowest[:, None]) * n[:, None], 0, 700)).sum(axis=1)
        empty = letters == 0
        score[empty] = 0
        limit = self.mean + REJECT_SLACK + REJECT_ERRORS * self.spread / np.sqrt(np.maximum(n, 1))
        name = [("und" if e else self.names[b]) for b, e in zip(best.tolist(), empty.tolist(), strict=True)]
        return name, score, lowest, empty | (lowest > limit)


def fit_languages(docs: DataFrame, label: str = "lang", modulus: int = 4, held_out: int = 2, most: int = MOST_TEXTS) -> LanguageModels:
    """Fits on about ``most`` texts a language, out of the rows whose CRC-32 remainder is not held out."""
    return LanguageModels.fit(by_class(docs, label, modulus, held_out, most))


def identify_languages(docs: DataFrame, models: LanguageModels, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds language, score, entropy and rejection to the id and the ``keep`` columns; one pass, no shuffle.

    A kept column whose name is the name of a result comes back as ``carried_`` and its name.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)
    kept = [c for c in docs.columns if c in keep and c != id_col]
    names = ["lang_pred", "score", "entropy", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text_col):
            name, score, entropy, rejected = model.predict(*text_buffer(column(batch, text_col)))
            own = [column(batch, c) for c in [id_col, *kept]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(name, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], [*[f"c{i}" for i in range(len(own))], *names])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    narrow = docs.select(*dict.fromkeys([id_col, *kept, text_col]))
    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate([id_col, *kept])), "lang_pred string, score double, entropy double, rejected boolean"])
    out = narrow.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(f"carried_{c}" if c in names else c) for i, c in enumerate([id_col, *kept])), *names)
