"""WAV files read by ranges of frames: no task holds a whole clip, whatever its length.

Files are listed by Spark with their lengths; a first pass walks each file's chunk headers and gives a row a file. What is wanted of a
clip (its segments, windows of a manifest, stretches of its spectrum) becomes a row a range by expressions, and the ranges are dealt
out by number, so that an hour of sound is the work of many tasks. A task reads the frames of its range with the margin that the
resampling filter and the transform's window need; the result is that of a reading in one piece.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import signal
from tidemark.operators.etl import places
from tidemark.sources.readers import decoded, find_files

#: Frames of the spectrum that one range has; tasks a core that ranges are dealt to; rows that a task gives out at once.
FRAMES, TASKS, ROWS = 256, 16, 16
_HEADER = "path string, clip string, rate int, channels int, bits int, kind int, start long, frames long, error string"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it of a path as Spark names it."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def _reader(path: str):
    system, own = located(path)
    return system.open_input_file(own)


def layout(f, length: int) -> dict[str, int]:
    """Format of a WAV file and place of its samples, from the chunk headers alone; raises ValueError if it is none."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, out = 12, {}
    while at + 8 <= length:
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            raw = f.read(min(size, 40))
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            if kind == 0xFFFE and len(raw) >= 26:
                kind = struct.unpack("<H", raw[24:26])[0]
            out = {"rate": rate, "channels": channels, "bits": bits, "kind": kind}
        if name == b"data":
            if not out or not out["rate"] or out["channels"] * out["bits"] < 8:
                raise ValueError("no format before the samples")
            return out | {"start": at + 8, "frames": min(size, length - at - 8) // (out["channels"] * out["bits"] // 8)}
        at += 8 + size + size % 2
    raise ValueError("no samples")


def headers(files: DataFrame) -> DataFrame:
    """A row a file (path, stem, length): its format; a file that is no WAV keeps its row, with no frames and the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, stem, length in zip(frame["path"], frame["stem"], frame["length"], strict=True):
                try:
                    with _reader(path) as f:
                        rows.append({"path": path, "clip": stem, **layout(f, int(length)), "error": None})
                except (ValueError, OSError, struct.error) as e:
                    rows.append({"path": path, "clip": stem, "rate": 0, "channels": 0, "bits": 0, "kind": 0, "start": 0, "frames": 0, "error": str(e)})
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _HEADER.split(", ")])

    return files.select("path", "stem", "length").mapInPandas(run, _HEADER)


def wave_headers(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """``headers`` of the files below a folder; contents are not read."""
    return headers(find_files(spark, path, pattern))


def read_frames(path: str, h: dict[str, int], first: int, last: int) -> np.ndarray:
    """The frames ``first`` to ``last`` - 1 of a file as mono float32."""
    width = h["channels"] * h["bits"] // 8
    with _reader(path) as f:
        f.seek(int(h["start"]) + first * width)
        raw = f.read((last - first) * width)
    return signal.mono(decoded(raw, h))


def read_range(path: str, h: dict[str, int], first: int, last: int, target: int) -> np.ndarray:
    """The samples ``first`` to ``last`` - 1 of the resampled clip, from the frames that the filter reaches."""
    g = gcd(int(h["rate"]), target)
    up, down = target // g, int(h["rate"]) // g
    low, high = signal.reached(first, last, int(h["frames"]), up, down)
    x = read_frames(path, h, low, high)
    if up == down:
        return x
    skip = low // down * up
    return signal.polyphase(x, up, down)[first - skip : last - skip]


def _length(target: int) -> Column:
    """Samples of a clip at the target rate: frames times the ratio, rounded up."""
    return F.when(F.col("rate") > 0, F.floor((F.col("frames") * target + F.col("rate") - 1) / F.col("rate"))).otherwise(0).cast("long")


def _dealt(ranges: DataFrame) -> DataFrame:
    """Rows a range, dealt out over all tasks: they are small, but each stands for much reading. A task reads its ranges one after the other, so their number asks for no more tasks."""
    spark = ranges.sparkSession
    return ranges.repartition(TASKS * spark.sparkContext.defaultParallelism, "path", "first")


def _each(ranges: DataFrame, work: Callable[[np.ndarray], dict], columns: list[str], made: str, target: int) -> DataFrame:
    """A row of ``work`` for the samples of each range (first, last), beside ``columns``."""
    kept = ", ".join(f"`{c}` {ranges.schema[c].dataType.simpleString()}" for c in columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), ROWS):
                part = frame.iloc[i : i + ROWS]
                got = [work(read_range(r["path"], r, int(r["first"]), int(r["last"]), target)) for r in part.to_dict("records")]
                yield pd.concat([part[columns].reset_index(drop=True), pd.DataFrame(got)], axis=1)

    return _dealt(ranges).mapInPandas(run, f"{kept}, {made}")


def cut_windows(heads: DataFrame, windows: DataFrame | None, target: int = signal.RATE) -> DataFrame:
    """The headers with ``n`` (samples at the target rate) and the window (``from``, ``to``) of each row of ``windows`` (clip, start_s, end_s and more).

    Seconds are rounded to samples, halves to even, and kept inside the clip. Without ``windows`` each clip is one window.
    """
    h = heads.withColumn("n", _length(target))
    if windows is None:
        return h.withColumns({"from": F.lit(0).cast("long"), "to": F.col("n")})
    w = h.join(windows, "clip").withColumn("w", signal.window_frames(F.col("start_s"), F.col("end_s"), F.col("n"), target))
    return w.withColumns({"from": F.col("w.first"), "to": F.greatest("w.first", "w.end")}).drop("w")


def read_segments(spark: SparkSession, path: str, windows: DataFrame | None = None, target: int = signal.RATE, size: int = signal.SEGMENT, tail: int = signal.TAIL, pattern: str = "*.wav") -> DataFrame:
    """Normalised segments of the clips below a folder, or of their windows: clip, the windows' other columns, seg_idx, first, samples.

    Segments do not overlap; a tail of ``tail`` samples or more adds the last ``size`` samples. Each is read by its own range.
    Files that are no WAV give no segment (``wave_headers`` tells why).
    """
    w = cut_windows(wave_headers(spark, path, pattern), windows, target)
    more = [c for c in (windows.columns if windows is not None else []) if c != "clip"]
    starts = F.posexplode(signal.segment_start_column(F.col("to") - F.col("from"), size, tail)).alias("seg_idx", "at")
    ranges = w.where("frames > 0").select("path", "clip", *more, "rate", "channels", "bits", "kind", "start", "frames", "from", starts)
    ranges = ranges.withColumn("first", F.col("from") + F.col("at")).withColumn("last", F.col("first") + size)
    return _each(ranges, lambda x: {"samples": signal.z_norm(x)}, ["clip", *more, "seg_idx", "first"], "samples array<float>", target)


def read_lines(spark: SparkSession, path: str, windows: DataFrame | None = None, target: int = signal.RATE, frames: int = FRAMES, pattern: str = "*.wav") -> DataFrame:
    """Tonal lines of the clips, or of their windows: clip, the windows' other columns, lines, error.

    Spectrum, whitening and bands are made by ranges of frames; the ranges of a clip then meet as one level a band and frame, a quarter of
    the clip's own size, for the runs. A clip without lines, or whose file is no WAV, keeps its row.
    """
    size = int(signal.WINDOW_SEC * target)
    hop = size - int(size * signal.OVERLAP)
    w = cut_windows(wave_headers(spark, path, pattern), windows, target)
    more = [c for c in (windows.columns if windows is not None else []) if c != "clip"]
    keys = ["clip", *more]
    n = F.when(F.col("to") - F.col("from") >= size, F.floor((F.col("to") - F.col("from") - size) / hop) + 1).otherwise(0).cast("long")
    whole = w.withColumn("all", n)
    parts = whole.where("all > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1, F.lit(frames).cast("long"))))
    parts = parts.withColumn("first", F.col("from") + F.col("at") * hop).withColumn("last", F.col("from") + (F.least(F.col("at") + frames, F.col("all")) - 1) * hop + size)

    def bands(x: np.ndarray) -> dict:
        freqs, _, power = signal.spectrum(x, target)
        top, total, _ = signal.band_levels(signal.whiten(freqs, power), freqs)
        return {"top": top.ravel(), "total": total.ravel()}

    made = _each(parts, bands, [*keys, "at"], "top array<double>, total array<double>", target)
    types = {f.name: f.dataType.simpleString() for f in whole.schema.fields}
    shape = ", ".join(f"`{c}` {types[c]}" for c in keys)
    freqs = np.fft.rfftfreq(size * signal.NFFT_MULT, 1 / target)

    def runs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        grid = signal.band_grid(freqs)
        top = np.concatenate([np.asarray(t).reshape(len(grid), -1) for t in rows["top"]], axis=1)
        total = np.sum([np.asarray(t).reshape(grid.shape) for t in rows["total"]], axis=0)
        found = signal.strongest(signal.band_runs(top, total, grid, hop / target))
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in keys}, "lines": [[{"freq_hz": f, "mean_db": d} for f, d in found]]})

    lines = "array<struct<freq_hz:double,mean_db:double>>"
    found = made.groupBy(*keys).applyInPandas(runs, f"{shape}, lines {lines}").select(F.struct(*keys).alias("k"), "lines")
    return whole.withColumn("k", F.struct(*keys)).join(found, "k", "left").select(*keys, F.coalesce("lines", F.array().cast(lines)).alias("lines"), "error")


def noise_draws(keys: DataFrame, key: str, pool: DataFrame, n: int, seed: int, target: int = signal.RATE) -> DataFrame:
    """A stretch of ambient sound for each row: the drawn clip of the pool (``wave_headers``) and the place of its first sample.

    Clips are numbered by path among those with samples; which clip and which place follows from the seed and the row's key alone. A clip that is
    too short begins at 0 and goes round. The pool is an index, a row a file: no sound is held to draw from it.
    """
    index = pool.where("frames > 0").withColumn("n", _length(target))
    index = places(index, "path").withColumn("_i", F.col("place") - 1).drop("place")
    draw = lambda s: F.conv(F.substr(F.md5(F.concat(F.lit(f"{s}|"), F.col(key).cast("string"))), F.lit(1), F.lit(12)), 16, 10).cast("long")
    total = index.agg(F.count("*").alias("_total"))
    drawn = keys.crossJoin(F.broadcast(total)).where("_total > 0").withColumn("_i", draw(seed) % F.col("_total")).join(index, "_i")  # one row is broadcast
    room = F.greatest(F.col("n") - n + 1, F.lit(1))
    return drawn.withColumn("first", draw(seed + 1) % room).withColumn("last", F.least(F.col("first") + n, F.col("n"))).drop("_i", "_total")


def read_noise(spark: SparkSession, keys: DataFrame, key: str, path: str, n: int, seed: int, target: int = signal.RATE, pattern: str = "*.wav") -> DataFrame:
    """``n`` samples of ambient sound for each row of ``keys``: key, clip, first, noise. Each stretch is read by its own range; an empty pool gives silence."""
    drawn = noise_draws(keys.select(key), key, wave_headers(spark, path, pattern), n, seed, target)
    made = _each(drawn, lambda x: {"noise": np.resize(x, n) if len(x) else np.zeros(n, np.float32)}, [key, "clip", "first"], "noise array<float>", target)
    silence = F.array_repeat(F.lit(0.0).cast("float"), n)
    return keys.select(key).join(made, key, "left").select(key, "clip", "first", F.coalesce("noise", silence).alias("noise"))


def concatenated(pieces: DataFrame, key: str, name: str = "name") -> DataFrame:
    """The samples of each key's pieces, joined in order of their names."""
    held = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("_n"), "samples"))).alias("_p"))
    return held.select(key, F.flatten(F.transform("_p", lambda p: p["samples"])).alias("samples"))


def write_waves(waves: DataFrame, path: str, rate: int = signal.RATE) -> None:
    """A 16-bit mono WAV file a row (clip, samples in -1 to 1): ``<path>/<clip>.wav``. A file is written aside and then moved, so a task may run again."""
    from tidemark.sources.writers import wav_bytes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for clip, x in zip(frame["clip"], frame["samples"], strict=True):
                system, own = located(f"{path}/{clip}.wav")
                system.create_dir(os.path.dirname(own), recursive=True)
                aside = f"{own}.{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as f:
                    f.write(wav_bytes(np.asarray(x), rate))
                system.move(aside, own)
            yield frame[["clip"]]

    waves.select(F.col("clip").cast("string").alias("clip"), "samples").mapInPandas(run, "clip string").write.format("noop").mode("overwrite").save()
