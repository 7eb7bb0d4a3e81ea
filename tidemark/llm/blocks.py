"""Byte-level helpers that the text operators share.

Texts reach Python as Arrow batches; the helpers here work on the UTF-8 buffer of
a whole block of texts at once, so that no per-row Python object is made on the hot path.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)

#: ASCII white space that separates words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: All ASCII but letters and digits separates words: punctuation does not tell words apart.
MARKS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

#: Value of each byte in a word's hash; separators count nothing.
_VALUE = np.arange(1, 257).astype(U64)

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(column: str, modulus: int) -> Column:
    """Remainder of the CRC-32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the session names; where it names none, one beside the shared warehouse, or for a local master a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not where:
            one_machine = sc.master == "local" or sc.master.startswith("local[")
            where = tempfile.mkdtemp(prefix="spark-") if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        sc.setCheckpointDir(where)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table in the shared folder: for loops, whose plans would carry properties of all rounds along."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``written`` made and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; nulls count as empty texts."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cuts batches into pieces of about ``most`` text bytes (one text is never cut)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        _, at = text_buffer(col)
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class SortedHashes:
    """Rising 64-bit hashes with an index over their leading bits; ``find`` gives positions, -1 where absent."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(8, int(len(keys)).bit_length() + 2)
        edges = np.arange((1 << self.bits) + 1, dtype=np.float64)
        self.first = np.searchsorted(keys >> U64(64 - self.bits), edges.astype(U64)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        if len(self.keys) == 0:
            return np.full(len(wanted), -1, dtype=np.int32)
        at = self.first[(wanted >> U64(64 - self.bits)).astype(np.int64)]
        np.minimum(at, len(self.keys) - 1, out=at)
        miss = np.flatnonzero(self.keys[at] != wanted)
        for step in range(1, self.deepest + 1):
            if not len(miss):
                break
            if step == self.deepest:
                at[miss] = -1
                break
            there = np.minimum(at[miss] + 1, len(self.keys) - 1)
            at[miss] = there
            miss = miss[self.keys[there] != wanted[miss]]
        return at


class Words:
    """Maximal runs of non-white-space bytes of a block of texts, in order.

    ``start`` and ``end`` are byte positions in the block, ``doc`` the text of each
    word and ``first`` the n + 1 positions in the word list at which each text's words begin.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, separators: np.ndarray = _SPACE) -> None:
        n = len(data)
        word = np.zeros(n + 1, dtype=bool)
        word[:n] = ~separators[data]
        self.separators = separators
        begins = word[:n].copy()
        begins[1:] &= ~word[: n - 1]
        edge = at[(at > 0) & (at < n)]
        begins[edge] = word[edge]
        ends = word[:n].copy()
        ends &= ~word[1:]
        ends[edge - 1] = word[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(at) - 1), self.counts)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """One 64-bit hash a word."""
        if len(self.start) == 0:
            return np.zeros(0, U64)
        length = self.end - self.start
        longest = int(length.max())
        if longest > 1 << 16:
            return _long_hashes(data, self.start, self.end)
        powers = np.empty(longest, U64)
        powers[0] = 1
        if longest > 1:
            powers[1:] = BASE
            powers = np.multiply.accumulate(powers)
        total = np.zeros(len(data), U64)
        begins = np.repeat(self.start.astype(np.int32), np.diff(np.append(self.start, len(data))))
        lead = int(self.start[0])
        inside = np.arange(lead, len(data), dtype=np.int32) - begins
        np.minimum(inside, longest - 1, out=inside)
        total[lead:] = powers[inside]
        total *= np.where(self.separators, U64(0), _VALUE)[data]
        return mix(np.add.reduceat(total, self.start) + length.astype(U64))


def _long_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same hashes for blocks that hold very long words, one word at a time for those."""
    out = np.empty(len(start), U64)
    for i, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        value, power = U64(0), U64(1)
        with np.errstate(over="ignore"):
            for j in range(s, e, 1 << 16):
                piece = data[j : min(e, j + (1 << 16))].astype(U64) + U64(1)
                powers = np.full(len(piece), BASE, U64)
                powers[0] = 1
                powers = np.multiply.accumulate(powers)
                value += power * U64((piece * powers).sum())
                power = power * powers[-1] * BASE
        out[i] = value + U64(e - s)
    return mix(out)


def shingles(words: Words, hashed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the text of each.

    A text with fewer words, but at least one, gives its whole sequence as one shingle.
    """
    n = len(hashed)
    salt = [U64((0xA24BAED4963EE407 + 0x9FB21C651E98DF25 * (2 * j + 1)) % (1 << 64) | 1) for j in range(size)]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if n >= size:
        total = hashed[: n - size + 1] * salt[0]
        for j in range(1, size):
            total = total + hashed[j : n - size + 1 + j] * salt[j]
        keep = words.doc[: n - size + 1] == words.doc[size - 1 :]
        values, docs = mix(total[keep]), words.doc[: n - size + 1][keep]
    else:
        values, docs = np.zeros(0, U64), np.zeros(0, np.int64)
    if len(short):
        extra = np.zeros(len(short), U64)
        for j in range(size - 1):
            has = words.counts[short] > j
            extra[has] += hashed[words.first[short[has]] + j] * salt[j]
        extra = mix(extra + words.counts[short].astype(U64))
        values, docs = np.concatenate([values, extra]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        values, docs = values[order], docs[order]
    return values, docs


def sorted_sets(values: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text in rising order, and the n + 1 offsets of the texts."""
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(docs[order], kind="stable")]
    values, docs = values[order], docs[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    values, docs = values[new], docs[new]
    return values, np.searchsorted(docs, np.arange(n + 1))


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each byte of a block: entry i counts those that start before byte i."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
