"""Groups of maximal repeats of any length, each with all its places.

A string of at least ``length`` bytes is a maximal repeat if it stands at two places or more and no byte
before or after it is the same at all of them; the edges of a text differ from everything. The work goes
in levels: level j takes the repeats of ``length * 2^j`` bytes up to twice as many. A text's string starts
are cut into runs with one minimiser (of the level's length), a piece is such a run with as many bytes as
its last start may need, and pieces meet by minimiser, equal ones once. Each part sorts the starts of its
pieces by prefix doubling, takes common prefixes from the same ranks and scans the common-prefix interval
tree for intervals that are left-diverse. Only texts that share a string of twice the level's length go on.

Hot strings: equal pieces are combined before they meet, their places are joined afterwards; the pieces of
a minimiser that has more than ``PART_BYTES`` of different ones are dealt out by single string. The different
continuations of one string (twice the level's length each) meet in one task.

Equal texts are one class that stands for its smallest id; ``copies`` tells how many documents it has. Defined
cases: null texts are empty; texts shorter than ``length`` are in no group; a class whose ids are all null has a
null id; rows that repeat are copies; the empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import column, shared_folder, slices, written
from tidemark.llm.repeats import LENGTH, SuffixIntervals, minimiser_runs

#: Bytes of different pieces in a part, in the mean, and of one minimiser before it is dealt out by string.
PART_BYTES = 2 << 20

_ROWS = "group string, length int, doc_id long, copies long, start int"


class PieceIntervals(SuffixIntervals):
    """The given number of first suffixes of each piece, at most ``most`` bytes of each, sorted, with common prefixes."""

    def __init__(self, pieces: list[bytes], starts: np.ndarray, before: np.ndarray, length: int, most: int) -> None:
        self.length = length
        sizes = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(sizes + 1) - 1  # a place of its own after each piece
        symbol = np.empty(int(ends[-1]) + 1 if len(pieces) else 0, dtype=np.int32)
        inside = np.ones(len(symbol), dtype=bool)
        inside[ends] = False
        symbol[inside] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        symbol[inside] += len(pieces)
        symbol[ends] = np.arange(len(pieces))  # the end of a piece comes before every byte
        ranks, width = [symbol], 1
        while width < most:
            key = ranks[-1].astype(np.int64) * (int(ranks[-1].max(initial=0)) + 1)
            key[: max(0, len(key) - width)] += ranks[-1][width:]
            ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
            width *= 2
        self.piece = np.repeat(np.arange(len(pieces)), starts)
        self.offset = np.arange(len(self.piece)) - np.repeat(np.cumsum(starts) - starts, starts)
        begin = (ends - sizes)[self.piece] + self.offset
        order = np.argsort(ranks[-1][begin], kind="stable")
        self.piece, self.offset, begin = self.piece[order], self.offset[order], begin[order]
        self.left = np.minimum(sizes[self.piece] - self.offset, most)
        self.before = np.where(self.offset > 0, symbol[begin - 1] - len(pieces), before[self.piece])
        a, b, common = begin[1:].copy(), begin[:-1].copy(), np.zeros(max(0, len(begin) - 1), np.int64)
        for rank in ranks[::-1]:  # a stretch of each width at most is equal
            same = np.flatnonzero((np.maximum(a, b) < len(symbol)) & (rank[np.minimum(a, len(symbol) - 1)] == rank[np.minimum(b, len(symbol) - 1)]))
            common[same] += width
            a[same] += width
            b[same] += width
            width //= 2
        self.common = np.minimum(common, np.minimum(self.left[1:], self.left[:-1]))


def _runs(length: int):
    """Runs of string starts with one minimiser; the copies of a text count while it can be a repeat of this level itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 20):
            keys, texts, copies = column(batch, "key").to_pylist(), [np.frombuffer(t, np.uint8) for t in column(batch, "bytes").to_pylist()], column(batch, "copies").to_numpy()
            which, start, end, least = minimiser_runs(texts, length)
            weight = np.where([len(t) < 2 * length for t in texts], copies, 1)[which]
            yield pa.RecordBatch.from_arrays([pa.array(least.astype(np.int64)), pa.array([keys[i] for i in which.tolist()], pa.binary()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(weight.astype(np.int64))], ["mini", "key", "s", "e", "weight"])

    return run


def _pieces(length: int):
    """The pieces of the shared runs of each text."""
    kinds = [("mini", pa.int64()), ("pid", pa.binary()), ("before", pa.int32()), ("piece", pa.binary()), ("starts", pa.int32()), ("copies", pa.int64()), ("id", pa.int64()), ("key", pa.binary()), ("s", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 20):
            for row in batch.to_pylist():
                text, out = row["bytes"], []
                for r in row["runs"]:
                    s, e = r["s"], r["e"]
                    piece, before = text[s : e - 1 + 2 * length], text[s - 1] if s else -1
                    pid = hashlib.sha256(f"{before}:{e - s}:{row['key'] if not s and len(text) < 2 * length else ''}:".encode() + piece).digest()[:16]
                    out.append((r["mini"], pid, before, piece, e - s, row["copies"], row["id"], row["key"], s))
                    if len(out) == 1 << 12:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return run


def _dealt(length: int, parts: int):
    """The part of each piece; those of hot minimisers fall into single strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("part", pa.int32()), ("pid", pa.binary()), ("base", pa.int32()), ("before", pa.int32()), ("piece", pa.binary()), ("starts", pa.int32()), ("copies", pa.int64()), ("places", pa.int64())]
        for batch in slices(batches, "piece", 1 << 16):
            out = []
            for r in batch.to_pylist():
                if not r["hot"]:
                    out.append((r["mini"] % parts, r["pid"], 0, r["before"], r["piece"], r["starts"], r["copies"], r["places"]))
                    continue
                for o in range(r["starts"]):
                    string = r["piece"][o : o + 2 * length]
                    part = int.from_bytes(hashlib.blake2b(string[:length], digest_size=6).digest(), "little") % parts
                    out.append((part, r["pid"], o, r["piece"][o - 1] if o else r["before"], string, 1, r["copies"], r["places"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return run


def _tree(length: int):
    """Maximal repeats of a part by piece and offset; length 0 marks pieces that take part in a repeat of the next level."""

    def run(table: pa.Table) -> pa.Table:
        pieces, pid, base = (table.column(c).to_pylist() for c in ("piece", "pid", "base"))
        starts, before, copies, places = (table.column(c).to_numpy() for c in ("starts", "before", "copies", "places"))
        array = PieceIntervals(pieces, starts, before, length, 2 * length)
        piece, offset, out = array.piece.tolist(), array.offset.tolist(), {"group": [], "length": [], "pid": [], "offset": []}
        goes_on = {pid[i] for i in np.flatnonzero(places > 1).tolist() if len(pieces[i]) >= 2 * length}
        for a, b, n in array.maximal_repeats((copies > 1) & (before < 0)):
            if n >= 2 * length:
                goes_on.update(pid[p] for p in piece[a:b])
                continue
            name = hashlib.sha256(pieces[piece[a]][offset[a] : offset[a] + n]).hexdigest()[:32]
            for p, o in zip(piece[a:b], offset[a:b], strict=True):
                for c, v in zip(out, (name, n, pid[p], base[p] + o), strict=True):
                    out[c].append(v)
        for p in goes_on:
            for c, v in zip(out, ("", 0, p, 0), strict=True):
                out[c].append(v)
        kinds = {"group": pa.string(), "length": pa.int32(), "pid": pa.binary(), "offset": pa.int32()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return run


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """A row a place of each maximal repeat: group (128 bits of the string's SHA-256), length, class and copies, first byte.

    The steps of each level are tables in the shared folder, which the result reads; their number is at most the
    logarithm of the longest repeat over ``length``.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t")).where(F.octet_length("t") >= length)
    texts = written(rows.groupBy(F.unhex(F.substring(F.sha2("t", 256), 1, 32)).alias("key")).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("t").alias("bytes")), f"{folder}/texts")
    result = spark.createDataFrame([], _ROWS.replace("group ", "`group` "))
    while not texts.isEmpty():
        keep = lambda df, name: written(df, f"{folder}/{name}{length}")  # noqa: B023, E731
        runs = keep(texts.mapInArrow(_runs(length), "mini long, key binary, s int, e int, weight long"), "runs")
        shared = runs.groupBy("mini").agg(F.sum("weight").alias("weight")).where("weight > 1").select("mini")
        own = runs.join(shared, "mini", "leftsemi").groupBy("key").agg(F.collect_list(F.struct("mini", "s", "e")).alias("runs"))
        pieces = keep(texts.join(own, "key").mapInArrow(_pieces(length), "mini long, pid binary, before int, piece binary, starts int, copies long, id long, key binary, s int"), "pieces")
        one = [F.first(c).alias(c) for c in ("mini", "before", "piece", "starts")]
        different = keep(pieces.groupBy("pid").agg(*one, F.max("copies").alias("copies"), F.count("*").alias("places")), "different")
        size = F.sum(F.octet_length("piece").cast("long"))
        parts = max(1, int(different.agg(F.coalesce(size, F.lit(0))).first()[0]) // PART_BYTES)
        hot = different.groupBy("mini").agg(size.alias("size")).where(F.col("size") > PART_BYTES).select("mini", F.lit(True).alias("hot"))
        dealt = different.join(hot, "mini", "left").mapInArrow(_dealt(length, parts), "part int, pid binary, base int, before int, piece binary, starts int, copies long, places long")
        tree = keep(dealt.groupBy("part").applyInArrow(_tree(length), "`group` string, length int, pid binary, offset int"), "tree")
        places = pieces.select("pid", "id", "copies", "key", "s")
        result = result.union(tree.where("length > 0").join(places, "pid").select("group", "length", "id", "copies", (F.col("s") + F.col("offset")).cast("int")))
        longer = tree.where("length = 0").select("pid").distinct().join(places, "pid").select("key")
        longer = longer.union(texts.where((F.col("copies") > 1) & (F.octet_length("bytes") >= 2 * length)).select("key"))
        texts = keep(texts.join(longer.distinct(), "key", "leftsemi"), "texts")
        length *= 2
    return result.withColumnRenamed("doc_id", id_col)
