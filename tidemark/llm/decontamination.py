"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For an item of m words, every window of m words of a document is compared with it (a document with
fewer words is one window). Words are runs of letters, digits and non-ASCII bytes after A-Z are
lower-cased; shingles are five words (all m for an item with fewer), weighted by how often they occur. A window as similar as
0.8 lacks a fifth of an item's shingles at most, so it holds one of the rarest ones that make up more than
that: windows without any of these are left out, exactly, before anything is computed for them. The others get a SimHash of 128
bits, which is looked up in the multi-index of the items of their size: a table for each of eight blocks of 16 bits. Two
fingerprints that differ in at most ``RADIUS`` bits differ in at most ``NEAR`` bits of some block, so the
entries whose block value is that near, in any block, are all that can be within the radius. The tables alone name the
candidates; the weighted Jaccard similarity of the shingles decides on those within the radius.

At similarity 0.8 bits differ with probability 0.15 where shingles do not repeat, so more than 39 of 128 differ about four times in
a million; a smaller radius would lose true pairs. Random fingerprints are candidates with probability 0.27 and within the
radius with probability 6e-6. A window that differs by one shingle many times over differs in more bits (11 of 100
shingles that are all the same one: 0.36), and may be missed at similarities near 0.8.

Defined cases: null and empty texts, on either side, match nothing; an item with fewer than five words is found wherever a
window of exactly its words stands (any other has similarity 0), a text with fewer than five words holds such items only;
repeated rows are each reported; of windows with equal similarity the first is reported; no item, no document: an
empty result; extra columns are ignored. Items are taken in blocks of bounded size, one pass over the documents a
block, so the benchmark may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import LOWER, MARKS, U64, SortedHashes, Words, column, cut, mix, shingles, slices, text_buffer
from tidemark.llm.filters import row_key, without

#: Words of a shingle; least similarity; Hamming radius; bytes of item text a pass.
SIZE, LEAST, RADIUS = 5, 0.8, 39
BLOCK_BYTES = 8 << 20

#: Pairs of a fingerprint and an entry looked at at once.
CELLS = 1 << 18

#: 64-bit words and 16-bit blocks of a fingerprint; bits that differ at most in the best block of two fingerprints within the radius.
WIDE, BLOCKS = 2, 8
NEAR = RADIUS // BLOCKS

#: What a block value is changed by to reach every value within ``NEAR`` bits.
_every = np.arange(1 << 16, dtype=np.uint16)
BALL = _every[np.bitwise_count(_every) <= NEAR]


def block_shingles(col: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of a block of texts in order, offsets of the texts, words of each text."""
    data, at = text_buffer(col)
    data = LOWER[data]
    words = Words(data, at, MARKS)
    values, docs = shingles(words, words.hashes(data), size)
    return values, np.searchsorted(docs, np.arange(len(at))), words.counts


def signs(values: np.ndarray) -> np.ndarray:
    """A row of 128 signs (+1, -1) a hash."""
    both = np.stack([values, mix(values ^ U64(0x9E3779B97F4A7C15))], axis=1)
    bits = np.unpackbits(both.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int16) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """SimHash: the bits of the positive sums, a row of ``WIDE`` words each."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1, WIDE)


def simhash(values: np.ndarray) -> np.ndarray:
    return pack(signs(values).sum(axis=0, dtype=np.int64)[None, :])[0]


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over the sum of the larger multiplicities."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


class HammingBlocks:
    """Multi-index over fingerprints: for each block of bits a sorted table of its values and of the entries that have them."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.tables = []
        for value in prints.view("<u2").T:
            order = np.argsort(value, kind="stable")
            keys, first = np.unique(value[order], return_index=True)
            self.tables.append((keys, np.append(first, len(order)), order))

    def candidates(self, prints: np.ndarray) -> np.ndarray:
        """Flags (print, entry): the entry is met in the table of some block.

        A table is probed with every value of the ball, or, where it has fewer values than the ball, read through.
        """
        met = np.zeros((len(prints), len(self.prints)), dtype=bool)
        for value, (keys, first, entries) in zip(prints.view("<u2").T, self.tables, strict=True):
            if len(keys) <= len(BALL):
                which, key = np.nonzero(np.bitwise_count(value[:, None] ^ keys[None, :]) <= NEAR)
            else:
                probe = value[:, None] ^ BALL[None, :]
                at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                which, place = np.nonzero(keys[at] == probe)
                key = at[which, place]
            n = first[key + 1] - first[key]
            met[np.repeat(which, n), entries[np.arange(n.sum()) + np.repeat(first[key] - np.cumsum(n) + n, n)]] = True
        return met

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in ``prints``, entry) within the radius; ``CELLS`` cells at a time."""
        which, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, CELLS // max(1, len(self.prints)))
        for k in range(0, len(prints), step):
            w, entry = np.nonzero(self.candidates(prints[k : k + step]))
            inside = np.bitwise_count(prints[k + w] ^ self.prints[entry]).sum(axis=1) <= RADIUS
            which.append(k + w[inside])
            found.append(entry[inside])
        return np.concatenate(which), np.concatenate(found)


class ItemIndex:
    """Items of one pass: their shingles, the rarest ones with the sizes that these name, and a multi-index for each size."""

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        values, first, words = block_shingles(pa.array(texts, pa.string()))
        # items below a shingle's size, by size: hashes in order, ids of the items of each
        self.short: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for m in range(1, SIZE):
            own = [i for i in range(len(ids)) if words[i] == m]
            if own:
                keys, of = np.unique(block_shingles(pa.array([texts[i] for i in own], pa.string()), m)[0], return_inverse=True)
                self.short[m] = keys, [[ids[own[j]] for j in np.flatnonzero(of == k)] for k in range(len(keys))]
        used = [i for i in range(len(ids)) if words[i] >= SIZE]
        self.ids = [ids[i] for i in used]
        self.words = np.array([words[i] for i in used], dtype=np.int64)
        self.values = [values[first[i] : first[i + 1]] for i in used]
        prints = np.array([simhash(v) for v in self.values], dtype="<u8").reshape(-1, WIDE)
        self.of_size = {m: np.flatnonzero(self.words == m) for m in np.unique(self.words).tolist()}
        self.blocks = {m: HammingBlocks(np.ascontiguousarray(prints[own])) for m, own in self.of_size.items()}
        shingle, item = self._rarest()
        named = np.unique(np.rec.fromarrays([shingle, self.words[item]], names="shingle,size"))  # a shingle and a size once
        keys, first = np.unique(named["shingle"], return_index=True)
        self.known = SortedHashes(keys)
        self.size_of, self.size_first = named["size"], np.append(first, len(named))

    def _rarest(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingles and items: of each item the shingles in fewest items, enough of them that a similar window must hold one."""
        pairs = [np.unique(v, return_counts=True) for v in self.values]
        if not pairs:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        every, items = np.unique(np.concatenate([v for v, _ in pairs]), return_counts=True)
        out = []
        for i, (v, times) in enumerate(pairs):
            order = np.lexsort([v, items[np.searchsorted(every, v)]])
            may_lack = int((1 - LEAST) * len(self.values[i]) + 1e-9)
            out.append(v[order[: int(np.searchsorted(np.cumsum(times[order]), may_lack, side="right")) + 1]])
        return np.concatenate(out), np.repeat(np.arange(len(out)), [len(v) for v in out])

    def search_short(self, col: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(row, item id, 1.0, first word, words) of each short item that a text holds, its first window."""
        out = []
        for m, (keys, items) in self.short.items():
            values, first, _ = block_shingles(col, m)
            place = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
            at = np.flatnonzero(keys[place] == values)
            row = np.searchsorted(first, at, side="right") - 1
            _, new = np.unique(row * len(keys) + place[at], return_index=True)
            out += [(int(row[k]), item, 1.0, int(at[k] - first[row[k]]), m) for k in new.tolist() for item in items[place[at[k]]]]
        return out

    def search(self, values: np.ndarray, n_words: int) -> dict[int, tuple[float, int, int]]:
        """Best window of a document for each item that it contains: item -> (similarity, first word, words)."""
        place = self.known.find(values)
        hits = np.flatnonzero(place >= 0)
        best: dict[int, tuple[float, int, int]] = {}
        n = self.size_first[place[hits] + 1] - self.size_first[place[hits]]
        at = np.repeat(hits, n)
        sizes = self.size_of[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.size_first[place[hits]], n)]
        for m in np.unique(sizes).tolist():
            span = m - SIZE + 1
            last = max(0, len(values) - span)
            own = at[sizes == m]
            mark = np.zeros(last + 2, dtype=np.int32)  # windows that hold a hit: those that start up to span - 1 before it
            np.add.at(mark, np.minimum(np.maximum(own - span + 1, 0), last), 1)
            np.add.at(mark, np.minimum(own, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark)[: last + 1] > 0)
            for piece in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
                for k in range(0, len(piece), 4096):  # bounds the sums held for one very long document
                    self._verify(values, piece[k : k + 4096], span, m, n_words, best)
        return best

    def _verify(self, values: np.ndarray, starts: np.ndarray, span: int, m: int, n_words: int, best: dict[int, tuple[float, int, int]]) -> None:
        low, high = int(starts[0]), min(int(starts[-1]) + span, len(values))
        sums = np.concatenate([np.zeros((1, 64 * WIDE), np.int32), np.cumsum(signs(values[low:high]), axis=0, dtype=np.int32)])
        prints = pack(sums[np.minimum(starts + span, high) - low] - sums[starts - low])
        which, entries = self.blocks[m].within(prints)
        for w, item in zip(which.tolist(), self.of_size[m][entries].tolist(), strict=True):
            start = int(starts[w])
            like = weighted_jaccard(values[start : start + span], self.values[item])
            old = best.get(item, (0.0, 0, 0))
            if like >= LEAST and (like > old[0] or like == old[0] and start < old[1]):
                best[item] = (like, start, min(m, n_words))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (document, item) with a window of similarity 0.8 or more: the best one of each pair.

    No shuffle: documents stream past an index of the items, block by block of items.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("t")).where("t IS NOT NULL AND id IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    narrow = docs.selectExpr(f"`{id_col}` AS id", f"cast(`{text_col}` AS string) AS t")
    kind = dict(narrow.dtypes)["id"]

    def one(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(ItemIndex([r.id for r in rows], [r.t for r in rows]))  # built once, not by each task

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches, "t"):
                values, first, words = block_shingles(column(batch, "t"))
                place = index.known.find(values) >= 0
                hit = np.concatenate([[0], np.cumsum(place)])
                some = np.flatnonzero(hit[first[1:]] > hit[first[:-1]])
                found = [(i, index.ids[item], *what) for i in some.tolist() for item, what in sorted(index.search(values[first[i] : first[i + 1]], int(words[i])).items())]
                found += index.search_short(column(batch, "t"))
                if found:
                    at, item, like, start, n = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([column(batch, "id").take(pa.array(at)), pa.array(item, pa.int64()), pa.array(like, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())], ["id", item_col, "similarity", "first_word", "n_words"])

        return narrow.mapInArrow(run, f"id {kind}, {item_col} long, similarity double, first_word long, n_words long")

    parts = []
    for b in range(blocks):  # each block is bounded by bytes, the number of passes grows with the benchmark
        parts.append(one(items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id", "t").collect()))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without those that hold an item, whatever their id."""
    key = row_key(id_col, text_col)
    bad = find_contamination(docs.select(key.alias("k"), F.col(text_col).alias("t")), benchmark, id_col="k", text_col="t").select("k").distinct()
    return without(docs, key, cut(bad))
