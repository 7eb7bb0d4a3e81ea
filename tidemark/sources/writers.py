"""Sinks: CSV, JSON, Parquet segments, WAV bytes, archives with digests, skip-if-there."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, **about: str) -> None:
    """A JSON document a row, with what made it (normaliser, model) beside it."""
    marked = df.select("*", *(F.lit(v).alias(k) for k, v in about.items()))
    marked.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_segments(segments: DataFrame, path: str, by: tuple[str, ...] = ("source", "split")) -> None:
    segments.repartition(*by).write.mode("append").partitionBy(*by).parquet(path)


def only_new(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not written yet; appending them makes a rerun harmless."""
    return rows.join(there.select(key), key, "left_anti")


def file_digests(df: DataFrame) -> DataFrame:
    """SHA-256 of binary files."""
    return df.select("path", F.sha2("content", 256).alias("sha256"))


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono WAV file."""
    data = (np.clip(np.asarray(samples, np.float64), -1, 1 - 2**-15) * 32768).round().astype("<i2").tobytes()
    head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16)
    return head + b"data" + struct.pack("<I", len(data)) + data


def archive(index_name: str, index: bytes, members: dict[str, bytes]) -> tuple[bytes, str]:
    """An uncompressed archive of an index and its members, and its SHA-256; repeated names are an error."""
    if index_name in members:
        raise ValueError(f"repeated member {index_name}")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, content in {index_name: index, **members}.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    raw = out.getvalue()
    return raw, hashlib.sha256(raw).hexdigest()


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small report table; an error where it has more than ``most`` rows, so that none is lost unseen."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows])
