"""Segment encoder: selective-kernel filter bank, convolution blocks, unit-length vectors, in NumPy.

Weights are a plain dictionary, so that any trained set can be plugged in; ``seeded_weights`` makes one
for tests. The margin head used in training is given as a scoring form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.etl import places

# Kernel lengths, channels and groups of the filter bank; widths and strides of the blocks; scale and margin of the head.
KERNELS, CHANNELS, GROUPS = (127, 511, 2047, 8191), 64, 16
WIDTHS, STRIDES = (64, 128, 256, 512, 512), ((1, 1), (1, 4), (1, 4), (2, 2), (2, 2))
SCALE, MARGIN = 30.0, 0.3

Weights = dict[str, np.ndarray]


def seeded_weights(seed: int = 0, channels: int = CHANNELS, widths: tuple[int, ...] = WIDTHS, kernels: tuple[int, ...] = KERNELS) -> Weights:
    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(np.prod(shape[1:]))).astype(np.float32)
    w: Weights = {f"bank{i}": make(channels, k) for i, k in enumerate(kernels)}
    w |= {f"bank{i}_scale": np.ones(channels, np.float32) for i in range(len(kernels))} | {f"bank{i}_shift": np.zeros(channels, np.float32) for i in range(len(kernels))}
    w |= {"squeeze": make(4, channels)} | {f"excite{i}": make(channels, 4) for i in range(len(kernels))}
    before = 1
    for i, n in enumerate(widths):
        w |= {f"block{i}": make(n, before, 3, 3), f"block{i}_scale": np.ones(n, np.float32), f"block{i}_shift": np.zeros(n, np.float32)}
        before = n
    return w


#: Bytes of activations, and of the columns of one matrix product, that a task holds at once.
HELD, SLAB = 1 << 27, 1 << 25
#: Segments of a batch that are stacked at once.
ROWS = 16


def group_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Of a batch (segments by channels by more), each group of channels of each segment by its own mean and variance; in place where it can be."""
    g = x.reshape(len(x), min(groups, x.shape[1]), -1)
    mean = g.mean(axis=2, keepdims=True, dtype=np.float64).astype(x.dtype)
    g -= mean
    g /= np.sqrt(np.square(g).mean(axis=2, keepdims=True, dtype=np.float64) + 1e-5).astype(x.dtype)
    shape = (1, x.shape[1]) + (1,) * (x.ndim - 2)
    x = g.reshape(x.shape)
    x *= scale.reshape(shape).astype(x.dtype)
    x += shift.reshape(shape).astype(x.dtype)
    return x


def filter_bank(x: np.ndarray, w: Weights) -> np.ndarray:
    """Segments by channels by time: each branch convolves with one kernel length; a softmax over branches weighs them.

    The batch is transformed once, for all branches and channels.
    """
    n = x.shape[1]
    taps = [w[f"bank{i}"] for i in range(sum(k.startswith("excite") for k in w))]
    size = 1 << int(n + max(t.shape[1] for t in taps)).bit_length()
    wave, branches = np.fft.rfft(x, size), []
    for i, t in enumerate(taps):
        out = np.empty((len(x), len(t), n), np.float32)
        at = t.shape[1] // 2
        for c in range(0, len(t), 8):  # a few channels' transforms at a time
            out[:, c : c + 8] = np.fft.irfft(wave[:, None] * np.fft.rfft(t[c : c + 8, ::-1], size)[None], size)[:, :, at : at + n]
        branches.append(np.maximum(group_norm(out, w[f"bank{i}_scale"], w[f"bank{i}_shift"]), 0))
    z = np.maximum(sum(b.mean(axis=2, dtype=np.float64) for b in branches) @ w["squeeze"].T, 0)
    logits = np.stack([z @ w[f"excite{i}"].T for i in range(len(branches))])
    share = np.exp(logits - logits.max(axis=0))
    share /= share.sum(axis=0)
    total = branches[0]
    total *= share[0][:, :, None].astype(np.float32)
    for s, b in zip(share[1:], branches[1:], strict=True):
        b *= s[:, :, None].astype(np.float32)
        total += b
    return total


def block(x: np.ndarray, taps: np.ndarray, scale: np.ndarray, shift: np.ndarray, stride: tuple[int, int]) -> np.ndarray:
    """3 by 3 convolution with padding 1, group norm, rectifier, of a batch (segments by channels by rows by time).

    The convolution is one matrix product of the taps with the neighbourhoods of all segments, in slabs of rows of bounded size.
    """
    many, channels, rows, cols = x.shape
    high, wide = -(-rows // stride[0]), -(-cols // stride[1])
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    view = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(2, 3))[:, :, :: stride[0], :: stride[1]]
    flat = np.ascontiguousarray(taps.reshape(len(taps), -1), dtype=np.float32)
    out = np.empty((many, len(taps), high, wide), np.float32)
    step = max(1, SLAB // (channels * 9 * 4 * many * wide))
    part = max(1, SLAB // (channels * 9 * 4 * many)) if step == 1 else wide
    for r in range(0, high, step):
        for c in range(0, wide, part):
            piece = view[:, :, r : r + step, c : c + part]
            near = np.ascontiguousarray(piece.transpose(1, 4, 5, 0, 2, 3), dtype=np.float32)
            out[:, :, r : r + step, c : c + part] = (flat @ near.reshape(channels * 9, -1)).reshape(len(taps), *near.shape[3:]).transpose(1, 0, 2, 3)
    out = group_norm(out, scale, shift)
    return np.maximum(out, 0, out=out)


def held_bytes(n: int, w: Weights) -> int:
    """Bytes of the largest activations that one segment of n samples has at once: those of a block and of the one before it."""
    banks = sum(k.startswith("excite") for k in w)
    rows, cols, before, most = len(w["bank0"]), n, 1, 4 * (banks + 1) * len(w["bank0"]) * n
    for i, (a, b) in enumerate(STRIDES[: sum(k.startswith("block") and k[5:].isdigit() for k in w)]):
        held = before * rows * cols
        rows, cols, before = -(-rows // a), -(-cols // b), len(w[f"block{i}"])
        most = max(most, 4 * (held + before * rows * cols))
    return most


def encode_batch(x: np.ndarray, w: Weights) -> np.ndarray:
    """Unit vectors of segments of one length (a row each), as many at once as ``HELD`` bytes of activations allow."""
    x = np.asarray(x, dtype=np.float64)
    step, out = max(1, HELD // max(1, held_bytes(x.shape[1], w))), []
    for i in range(0, len(x), step):
        y = filter_bank(x[i : i + step], w)[:, None]
        for k, stride in enumerate(STRIDES[: sum(k.startswith("block") and k[5:].isdigit() for k in w)]):
            y = block(y, w[f"block{k}"], w[f"block{k}_scale"], w[f"block{k}_shift"], stride)
        v = y.mean(axis=(2, 3), dtype=np.float64)
        out.append((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32))
    return np.concatenate(out)


def encode(x: np.ndarray, w: Weights) -> np.ndarray:
    return encode_batch(np.asarray(x)[None], w)[0]


def embed(segments: DataFrame, weights: Weights) -> DataFrame:
    """A unit vector for each segment row (clip, seg_idx, samples); the weights are broadcast once. Segments of one length are encoded together."""
    shared = segments.sparkSession.sparkContext.broadcast(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby(frame["samples"].map(len)):
                for i in range(0, len(part), ROWS):
                    some = part.iloc[i : i + ROWS]
                    yield pd.DataFrame({"clip": some["clip"], "seg_idx": some["seg_idx"], "embedding": list(encode_batch(np.stack(some["samples"].to_list()), shared.value))})

    return segments.mapInPandas(run, "clip string, seg_idx int, embedding array<float>")


def load_weights(found: Weights, wanted: list[str], prefix: str = "encoder.") -> Weights:
    """Weights by name, with the prefix as a second try; an error names what is missing."""
    missing = [k for k in wanted if k not in found and prefix + k not in found]
    if missing:
        raise KeyError(f"missing weights: {missing[:5]}")
    return {k: found[k] if k in found else found[prefix + k] for k in wanted}


def grown_head(head: DataFrame, means: DataFrame) -> DataFrame:
    """A margin head (vessel, class, vec) with a row for each further vessel of ``means`` (vessel, vec): old classes keep number and row, new ones follow by vessel and begin at their mean."""
    new = places(means.join(head.select("vessel"), "vessel", "left_anti"), "vessel")
    first = head.agg(F.coalesce(F.max("class") + 1, F.lit(0)).cast("long").alias("_first"))
    grown = new.crossJoin(F.broadcast(first)).select("vessel", (F.col("_first") + F.col("place") - 1).alias("class"), "vec")  # one row is broadcast
    return head.select("vessel", F.col("class").cast("long").alias("class"), "vec").unionByName(grown)


def margin_logit(cosine: Column, own: Column) -> Column:
    """Logit of the margin head: the angle of the own class grows by the margin."""
    angle = F.acos(F.greatest(F.lit(-1 + 1e-7), F.least(F.lit(1 - 1e-7), cosine)))
    return SCALE * F.cos(angle + F.when(own, MARGIN).otherwise(0.0))
