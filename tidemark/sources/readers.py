"""Sources: workbooks, CSV, JSON, WAV and NumPy files."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.signal import mono, resample

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def workbook(content: bytes) -> dict[str, list[list[str | None]]]:
    """Rows of each sheet of an .xlsx file, as text."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    strings = []
    if "xl/sharedStrings.xml" in names:
        strings = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
        rows = []
        for row in ElementTree.fromstring(book.read(f"xl/{targets[sheet.get(f'{_REL}id')].removeprefix('/xl/')}")).iter(f"{_SHEET}row"):
            cells: dict[int, str | None] = {}
            for cell in row:
                at = 0
                for c in re.match(r"[A-Z]+", cell.get("r", "A"))[0]:
                    at = at * 26 + ord(c) - 64
                value = cell.find(f"{_SHEET}v")
                text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) if cell.get("t") == "inlineStr" else None if value is None else value.text
                cells[at - 1] = strings[int(text)] if cell.get("t") == "s" and text is not None else text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        out[sheet.get("name")] = rows
    return out


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet with a header row, all columns as text, names trimmed. Workbooks are small metadata files."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    rows = workbook(bytes(content))[sheet]
    header = [str(c).strip() for c in rows[0]]
    body = [[*r, *[None] * (len(header) - len(r))][: len(header)] for r in rows[1:]]
    return spark.createDataFrame(body, ", ".join(f"`{h}` string" for h in header))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8", comment: str | None = None) -> DataFrame:
    """CSV with a header; all text without a schema; lines that start with ``comment`` are skipped."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    if comment:
        reader = reader.option("comment", comment)
    return (reader.schema(schema) if schema else reader).csv(path)


def comment_lines(spark: SparkSession, path: str, mark: str = "#") -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith(mark)).select(F.trim(F.substr("value", F.lit(len(mark) + 1))).alias("comment"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file with one nested document."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def find_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths below a folder with their stems; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("stem"), "length")


def passage_segments(files: DataFrame) -> DataFrame:
    """Segment files of each passage folder in order of name, without catalogue and listening copies."""
    own = files.where(~F.col("stem").rlike("__(cat|listen)$"))
    folder = F.element_at(F.split("path", "/"), -2)
    return own.groupBy(folder.alias("passage")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


# --- RIFF ----------------------------------------------------------------------------------------------------


def wav_header(content: bytes) -> dict[str, int]:
    """Rate, channels, bits, frames and the place of the samples of a WAV file; raises ValueError if it is none."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, out = 12, {}
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
            if kind == 0xFFFE and size >= 26:
                kind = struct.unpack("<H", content[at + 32 : at + 34])[0]
            out |= {"kind": kind, "channels": channels, "rate": rate, "bits": bits}
        if name == b"data":
            size = min(size, len(content) - at - 8) if len(content) > at + 8 else size
            return out | {"start": at + 8, "frames": size // max(1, out["channels"] * out["bits"] // 8)}
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decoded(raw: bytes, h: dict[str, int]) -> np.ndarray:
    """Frames by channels as float32 in -1 to 1."""
    if h["kind"] == 3:
        x = np.frombuffer(raw, f"<f{h['bits'] // 8}").astype(np.float32)
    elif h["bits"] == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif h["bits"] == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{h['bits'] // 8}").astype(np.float32) / (1 << (h["bits"] - 1))
    return x.reshape(-1, h["channels"])


def wav_samples(content: bytes, start: int = 0, frames: int | None = None) -> tuple[np.ndarray, int]:
    """Frames by channels as float32 in -1 to 1, from ``start`` on, and the rate."""
    h = wav_header(content)
    width = h["channels"] * h["bits"] // 8
    start = max(0, min(start, h["frames"]))
    n = h["frames"] - start if frames is None else max(0, min(frames, h["frames"] - start))
    return decoded(content[h["start"] + start * width : h["start"] + (start + n) * width], h), h["rate"]


def read_waves(spark: SparkSession, path: str, rate: int = 8000, pattern: str = "*.wav") -> DataFrame:
    """Mono samples at the rate, a row a file: clip, path, samples, error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, content in zip(frame["path"], frame["content"], strict=True):
                name = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    x, own = wav_samples(bytes(content))
                    rows.append((name, p, resample(mono(x), own, rate), None))
                except (ValueError, KeyError, struct.error) as e:
                    rows.append((name, p, np.zeros(0, np.float32), str(e)))
            yield pd.DataFrame(rows, columns=["clip", "path", "samples", "error"])

    return files.mapInPandas(run, "clip string, path string, samples array<float>, error string")


def probe_waves(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """Rate, channels, frames and duration of each file, from its header."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    head = files.select("path", F.substring("content", 1, 4096).alias("head"), "length")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, content, length in zip(frame["path"], frame["head"], frame["length"], strict=True):
                try:
                    h = wav_header(bytes(content))
                    n = max(0, int(length) - h["start"]) // max(1, h["channels"] * h["bits"] // 8) if length > len(content) else h["frames"]
                    rows.append((p, h["rate"], h["channels"], n, n / h["rate"] if h["rate"] else 0.0))
                except (ValueError, KeyError, struct.error):
                    rows.append((p, 0, 0, 0, 0.0))
            yield pd.DataFrame(rows, columns=["path", "sr", "channels", "frames", "dur"])

    return head.mapInPandas(run, "path string, sr int, channels int, frames long, dur double")


def read_arrays(spark: SparkSession, path: str, header_only: bool = False) -> DataFrame:
    """.npy files: shape, type and values (flat, as float), or the header alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    part = F.substring("content", 1, 4096) if header_only else F.col("content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, content in zip(frame["path"], frame["content"], strict=True):
                f = io.BytesIO(bytes(content))
                major = np.lib.format.read_magic(f)
                shape, _, dtype = (np.lib.format.read_array_header_1_0 if major == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                values = None if header_only else np.load(io.BytesIO(bytes(content)), allow_pickle=False).ravel().astype(np.float32)
                rows.append((p, list(shape), str(dtype), values))
            yield pd.DataFrame(rows, columns=["path", "shape", "dtype", "values"])

    return files.select("path", part.alias("content")).mapInPandas(run, "path string, shape array<int>, dtype string, values array<float>")


def read_gallery(spark: SparkSession, path: str) -> DataFrame:
    """Passages of an .npz store: uid, vessel, role, cohort, vector. A store is one bounded file."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    z = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
    rows = [(str(u), int(m), str(r), str(c), [float(x) for x in e]) for u, m, r, c, e in zip(z["uids"], z["mmsi"], z["role"], z["cohort"], z["emb"], strict=True)]
    return spark.createDataFrame(rows, "uid string, vessel long, role string, cohort string, vec array<double>")
