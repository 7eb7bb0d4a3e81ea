"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the least hash of its inner s-mers stands at its
first or last place; whether it is chosen depends on the k-mer alone, so equal passages choose equal
anchors wherever they stand. A text is led by k - 1 padding symbols, so short texts have anchors
too. The fingerprint keeps every anchor, repeated ones too, each with a hash of 24 bits and its
position: base64 of their number, the hashes in order of position, the distances to the anchor before
in a byte each, and those of 255 and more in four. Likeness is the share of the anchors of both, counted
with repeats, that match on the commonest diagonal (difference of positions). ``thin`` keeps one anchor
in so many, chosen by its hash alone, where a smaller fingerprint is worth a rougher likeness.

Defined cases: null texts are empty; an empty text has an empty fingerprint, like another empty one
by 1 and any other by 0; a text without an anchor has one made of its whole; equal texts have equal
fingerprints; in the order by id a null id comes after every other, and repeated ids follow in order
of their texts; a single row follows itself. Only the id and the text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import U64, column, mix, partitions, slices

#: Code points of a k-mer and of its inner s-mers; bits of an anchor's hash.
K, S, BITS = 15, 6, 24
#: Pairs of places that are listed at once; a hash with more than ``DENSE`` pairs a place is correlated by FFT instead.
PAIRS, DENSE = 1 << 20, 16
_FIRST = -(1 << 63)
_SALT = U64(0xC2B2AE3D27D4EB4F)
_PAD = np.arange(0x110000, 0x110000 + K - 1, dtype=np.uint32)


def _windows_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values, by doubling."""
    reach, out = 1, x
    while reach * 2 <= width:
        out = np.minimum(out[: len(out) - reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _polynomial(x: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values, by doubling."""
    spans, reach = [(1, x)], 1
    power = {1: _SALT}
    while reach * 2 <= width:
        h = spans[-1][1]
        spans.append((reach * 2, h[: len(h) - reach] * power[reach] + h[reach:]))
        with np.errstate(over="ignore"):
            power[reach * 2] = power[reach] * power[reach]
        reach *= 2
    total, done = spans[-1][1], spans[-1][0]
    for size, h in reversed(spans[:-1]):
        if done + size <= width:
            n = len(x) - done - size + 1
            total = total[:n] * power[size] + h[done : done + n]
            done += size
    return total


def sketches(texts: list[str], thin: int = 1) -> list[np.ndarray]:
    """Anchors of each text: a (hash, position) row each, in rising order of hash, then of position; with ``thin``, one in so many by a threshold of the hash."""
    n = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    lead = K - 1
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbol = np.empty(len(points) + lead * len(texts), dtype=np.uint32)
    start = np.concatenate([[0], np.cumsum(n + lead)])
    symbol[np.arange(len(points)) + np.repeat(lead * np.arange(1, len(texts) + 1), n)] = points
    symbol[(start[:-1, None] + np.arange(lead)).ravel()] = np.tile(_PAD, len(texts))
    if len(symbol) < K:
        return [np.zeros((0, 2), np.uint32) for _ in texts]
    with np.errstate(over="ignore"):
        wide = mix(symbol.astype(U64))
        inner = mix(_polynomial(wide, S))
        least = _windows_min(inner, K - S + 1)
        chosen = np.flatnonzero((inner[: len(least)] == least) | (inner[K - S :] == least))
        doc = np.searchsorted(start, chosen, side="right") - 1
        inside = chosen + K <= start[doc + 1]
        chosen, doc = chosen[inside], doc[inside]
        value = mix(_polynomial(wide, K)[chosen])
        kept = (value & U64(0xFFFFFFFF)) < U64((1 << 32) // thin)
        chosen, doc, value = chosen[kept], doc[kept], value[kept] >> U64(64 - BITS)
    place = chosen - start[doc]
    order = np.lexsort((place, value, doc))
    value, doc, place = value[order], doc[order], place[order]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    rows = np.stack([value, place.astype(U64)], axis=1).astype(np.uint32)
    out = [rows[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    for i in np.flatnonzero((np.diff(first) == 0) & (n > 0)).tolist():
        out[i] = np.array([[int.from_bytes(hashlib.sha256(texts[i].encode("utf-8", "surrogatepass")).digest()[: BITS // 8], "little"), 0]], dtype=np.uint32)
    return out


def to_string(sketch: np.ndarray) -> str:
    if not len(sketch):
        return ""
    rows = sketch[np.lexsort((sketch[:, 0], sketch[:, 1]))].astype("<u4")
    hashes = np.ascontiguousarray(rows[:, 0]).view(np.uint8).reshape(-1, 4)[:, : BITS // 8]
    apart = np.diff(rows[:, 1], prepend=np.uint32(0)).astype("<u4")
    raw = len(rows).to_bytes(4, "little") + hashes.tobytes() + np.minimum(apart, 255).astype(np.uint8).tobytes() + apart[apart >= 255].tobytes()
    return base64.b64encode(raw).decode()


def from_string(fingerprint: str) -> np.ndarray:
    raw = base64.b64decode(fingerprint)
    if not raw:
        return np.zeros((0, 2), np.uint32)
    n, wide = int.from_bytes(raw[:4], "little"), BITS // 8
    hashes = np.zeros((n, 4), np.uint8)
    hashes[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, 4).reshape(n, wide)
    apart = np.frombuffer(raw, np.uint8, n, 4 + n * wide).astype(np.uint32)
    apart[apart == 255] = np.frombuffer(raw, "<u4", -1, 4 + n * (wide + 1)) if len(raw) > 4 + n * (wide + 1) else 0
    rows = np.stack([hashes.view("<u4").ravel(), np.cumsum(apart, dtype=np.uint32)], axis=1)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _diagonals(a: np.ndarray, b: np.ndarray, fa: np.ndarray, ca: np.ndarray, fb: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """Matches on each difference of positions; ``f`` and ``c`` are first rows and counts of the common hashes."""
    x, y = a[:, 1].astype(np.int64), b[:, 1].astype(np.int64)
    back = int(y.max())
    total = np.zeros(int(x.max()) + back + 1, dtype=np.int64)
    pairs = ca * cb
    dense = pairs > DENSE * len(total)
    if dense.any():
        size = 1 << len(total).bit_length()
        spectrum = np.zeros(size // 2 + 1, dtype=complex)
        for p, m, q, n in zip(fa[dense], ca[dense], fb[dense], cb[dense], strict=True):
            u, v = np.zeros(size), np.zeros(size)
            u[x[p : p + m]], v[back - y[q : q + n]] = 1, 1
            spectrum += np.fft.rfft(u) * np.fft.rfft(v)
        total += np.rint(np.fft.irfft(spectrum, size)[: len(total)]).astype(np.int64)
    fa, fb, cb, pairs = fa[~dense], fb[~dense], cb[~dense], pairs[~dense]
    upto, row = np.cumsum(pairs), 0
    while row < len(pairs):
        done = upto[row] - pairs[row]
        end = max(row + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        g = np.repeat(np.arange(row, end), pairs[row:end])
        k = np.arange(len(g)) - (upto[g] - pairs[g] - done)
        total += np.bincount(x[fa[g] + k // cb[g]] - y[fb[g] + k % cb[g]] + back, minlength=len(total))
        row = end
    return total


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the anchors of both sketches, counted with repeats, that match on the commonest diagonal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    (ha, fa, ca), (hb, fb, cb) = (np.unique(x[:, 0], return_index=True, return_counts=True) for x in (a, b))
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    union = len(a) + len(b) - int(np.minimum(ca[i], cb[j]).sum())
    return int(_diagonals(a, b, fa[i], ca[i], fb[j], cb[j]).max()) / union


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thin: int = 1) -> DataFrame:
    """Id and fingerprint of each document; one pass, no shuffle. ``thin``: one anchor in so many is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([to_string(s) for s in sketches(texts, thin)])], ["id", "fingerprint"])

    narrow = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return narrow.mapInArrow(run, f"id {dict(narrow.dtypes)['id']}, fingerprint string").withColumnRenamed("id", id_col)


_ROW = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket and falling id; the last of each bucket (``tail``) is the row that follows it."""
    held: tuple | None = None  # bucket, id, text, sketch: waits for the row after it
    for batch in slices(batches, "text"):
        texts = [t or "" for t in column(batch, "text").to_pylist()]
        buckets, ids, tails = (column(batch, c).to_pylist() for c in ("bucket", "id", "tail"))
        own = sketches(texts)
        pairs: list[tuple] = []
        for row in zip(buckets, ids, texts, own, tails, strict=True):
            if held is not None and held[0] == row[0]:
                pairs.append((held, row))
            held = None if row[4] else row[:4]
        if not pairs:
            continue
        edits = []
        for (_, _, text, _), nxt in pairs:
            cut = len(text) // 3
            edits.append(text[: len(text) - cut] + nxt[2][:cut])
        marks = sketches(edits)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p[0][1] for p in pairs], pa.int64()),
                pa.array([len(p[0][2]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]),
                pa.array([to_string(p[0][3]) for p in pairs]),
                pa.array([to_string(m) for m in marks]),
                pa.array([likeness(p[0][3], m) for p, m in zip(pairs, marks, strict=True)]),
                pa.array([likeness(p[0][3], p[1][3]) for p in pairs]),
            ],
            [f.split(" ")[0] for f in _ROW.split(", ")],
        )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to that and to the next document.

    The next document is the one after it by falling id. Ids are cut into ranges at values that occur,
    found over all ids; the first row of each range is also sent to the range above it, where it follows
    that range's last row. So one shuffle of the texts is enough and a task holds two texts at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    n = 4 * partitions(spark)
    found = rows.agg(F.percentile_approx("key", [(i + 1) / n for i in range(n - 1)], F.lit(100 * n)).alias("at"), F.max("key").alias("top")).first()
    bounds = np.unique(np.array([b for b in (found.at or []) if b < found.top], dtype=np.int64)) if found.top is not None else np.zeros(0, np.int64)
    top = found.top if found.top is not None else 0

    @F.pandas_udf("array<int>")
    def ranges(keys: pd.Series) -> pd.Series:
        key = keys.to_numpy(dtype=np.int64)
        own = np.searchsorted(bounds, key, side="left")
        out = [[int(b)] for b in own]
        for i in np.flatnonzero(np.isin(key, bounds)).tolist():
            out[i].append(int(own[i]) + 1)
        for i in np.flatnonzero(key == top).tolist():
            out[i].append(0)
        return pd.Series(out)

    dealt = rows.select("key", "id", "text", F.posexplode(ranges("key")).alias("pos", "bucket"))
    dealt = dealt.select("bucket", (F.col("pos") > 0).alias("tail"), "key", "id", "text")
    dealt = dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "tail", F.col("key").desc(), F.col("text").asc_nulls_first())
    return dealt.mapInArrow(_edited, _ROW).withColumnRenamed("id", "doc_id")
