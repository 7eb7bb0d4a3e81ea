"""SimHash near duplicates: a binary trie of fingerprints joined with itself.

The trie is never stored: sorted fingerprints are its leaves, a node is a range of them, and its children part where
the next bit turns to 1. Pairs of nodes are met together from the root; a pair adds a differing bit whenever its
two sides take different children, and is left as soon as the differing bits exceed the budget.

Spread over tasks, two fingerprints within the budget agree in one of (budget + 1) blocks of bits at least, so each
fingerprint is sent to that many tries, one for its value in each block. A trie with more leaves than a task should
hold is dealt out again in the same way by the bits that its leaves need not share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import LOWER, U64, Words, _SPACE, column, partitions, remove, shared_folder, slices, text_buffer, written
from tidemark.llm.graph import Forest, components

#: Words of a shingle, differing bits of a link, seed of the hash.
SHINGLE, BUDGET, SEED = 3, 3, 42
#: Shingles hashed at once; leaves of a trie that is not dealt out again; leaves of a task; pairs of nodes and of leaves held at once.
AT_ONCE, MOST, TASK, FRONTIER, CELLS = 1 << 16, 1 << 16, 1 << 18, 1 << 17, 1 << 20
#: Tries whose leaves may differ in so many bits at most are not dealt out again: 2 to their number bounds the leaves.
FREE = 16
#: A pair of nodes with so many pairs of leaves at most is compared leaf by leaf.
FEW = 48

# The five primes of XXH64.
P1, P2, P3, P4, P5 = map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each stretch of the bytes ``data``; ``data`` goes on for 8 bytes or more after the last end."""
    with np.errstate(over="ignore"):
        lanes = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        n, at = end - start, start.copy()
        h = np.full(len(n), U64(seed) + P5)
        wide = np.flatnonzero(n >= 32)
        if len(wide):
            acc = [np.full(len(wide), U64(seed) + x) for x in (P1 + P2, P2, U64(0), U64(0) - P1)]
            left = n[wide] // 32
            on = np.arange(len(wide))
            while len(on):
                for i in range(4):
                    acc[i][on] = _round(acc[i][on], lanes[at[wide[on]] + 8 * i])
                at[wide[on]] += 32
                left[on] -= 1
                on = on[left[on] > 0]
            total = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for x in acc:
                total = (total ^ _round(np.zeros_like(x), x)) * P1 + P4
            h[wide] = total
        h += n.astype(U64)
        for _ in range(3):
            on = np.flatnonzero(end - at >= 8)
            h[on] = _turn(h[on] ^ _round(np.zeros(len(on), U64), lanes[at[on]]), 27) * P1 + P4
            at[on] += 8
        on = np.flatnonzero(end - at >= 4)
        h[on] = _turn(h[on] ^ ((lanes[at[on]] & U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[on] += 4
        for _ in range(3):
            on = np.flatnonzero(end > at)
            h[on] = _turn(h[on] ^ (data[at[on]].astype(U64) * P5), 11) * P1
            at[on] += 1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        return h ^ (h >> U64(32))


def fingerprints(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: a bit is 1 if over half of the hashes of its shingles, repeats included, have it.

    Shingles are ``size`` words, lower-cased and joined by one blank; a text of fewer words is one shingle,
    one without words has the fingerprint 0.
    """
    data, at = text_buffer(texts)
    out = np.zeros(len(at) - 1, U64)
    words = Words(data, at)
    if not len(words.start):
        return out
    # the words of all texts with one blank after each, so that every shingle is a stretch of bytes
    keep = ~_SPACE[data]
    after = words.end[words.end < len(data)]
    keep[after] = True
    place = np.cumsum(keep) - 1
    joined = np.where(_SPACE[data], np.uint8(0x20), LOWER[data])[keep]
    start, end = place[words.start], place[words.end - 1] + 1
    joined = np.concatenate([joined, np.zeros(8, np.uint8)])
    n = len(start)
    last = np.minimum(np.arange(n) + size, words.first[1:][words.doc]) - 1
    own = np.flatnonzero((np.arange(n) + size <= words.first[1:][words.doc]) | (np.arange(n) == words.first[:-1][words.doc]))
    doc, start, end = words.doc[own], start[own], end[last[own]]
    ones = np.zeros((len(out), 64), dtype=np.int64)
    for i in range(0, len(doc), AT_ONCE):
        d = doc[i : i + AT_ONCE]
        bits = np.unpackbits(xxh64(joined, start[i : i + AT_ONCE], end[i : i + AT_ONCE]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        ones[d[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    times = np.bincount(doc, minlength=len(out))
    return np.packbits(2 * ones > times[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(U64)


class TrieJoin:
    """Pairs within the budget of sorted fingerprints, each group of which (``first``: n + 1 places) is a trie of its own."""

    def __init__(self, prints: np.ndarray, first: np.ndarray, budget: int = BUDGET) -> None:
        self.prints, self.first, self.budget, self.ones = prints, first, budget, {}

    def _parts(self, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
        """Where the leaves of each node turn from 0 to 1 in the bit: leaves of a node agree in all bits above it."""
        if bit not in self.ones:
            self.ones[bit] = np.concatenate([np.zeros(1, np.int32), np.cumsum((self.prints >> U64(bit)) & U64(1)).astype(np.int32)])
        return high - (self.ones[bit][high] - self.ones[bit][low])

    def _leaves(self, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves of small nodes within the budget."""
        total = np.cumsum(m * n)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + CELLS, side="right")))
            own = np.repeat(np.arange(i, j), (m * n)[i:j])
            k = np.arange(len(own)) - np.repeat(total[i:j] - (m * n)[i:j], (m * n)[i:j]) + (total[i - 1] if i else 0)
            x, y = a[own] + k // n[own], b[own] + k % n[own]
            near = (np.bitwise_count(self.prints[x] ^ self.prints[y]) <= self.budget) & (~same[own] | (x < y))
            yield x[near], y[near]
            i = j

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of both, in portions."""
        low, high = self.first[:-1], self.first[1:]
        some = np.flatnonzero(high - low > 1)
        low, high = low[some], high[some]
        stack = [(63, low, high, low, high, np.zeros(len(low), np.int8))]
        while stack:
            bit, a, ae, b, be, differ = stack.pop()
            if len(a) > FRONTIER:
                for i in range(0, len(a), FRONTIER):
                    stack.append((bit, *(x[i : i + FRONTIER] for x in (a, ae, b, be, differ))))
                continue
            same = a == b
            few = ((ae - a) * (be - b) <= FEW) | (bit < 0)
            if few.any():
                yield from self._leaves(a[few], (ae - a)[few], b[few], (be - b)[few], same[few])
                a, ae, b, be, differ, same = (x[~few] for x in (a, ae, b, be, differ, same))
            if not len(a):
                continue
            p, q = self._parts(a, ae, bit), self._parts(b, be, bit)
            cross = ~same
            met = [(a, p, b, q, differ, None), (p, ae, q, be, differ, None), (a, p, q, be, differ + 1, None), (p, ae, b, q, differ + 1, cross)]
            kept = []
            for x, xe, y, ye, d, where in met:
                ok = (xe > x) & (ye > y) & (d <= self.budget) & ((x != y) | (xe - x > 1))
                if where is not None:
                    ok &= where  # of a node with itself the two children meet once
                kept.append([v[ok] for v in (x, xe, y, ye, d)])
            if sum(len(k[0]) for k in kept):
                stack.append((bit - 1, *(np.concatenate(v) for v in zip(*kept, strict=True))))


def _search(budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (mask, key, print), sorted: what the tries of a task connect, a row a fingerprint at most."""

    def join(mask: np.ndarray, key: np.ndarray, prints: np.ndarray, found: Forest) -> None:
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        first = np.concatenate([[0], new, [len(key)]])
        # fingerprints rise as unsigned numbers inside a trie
        values = prints.view(U64)
        order = np.lexsort((values, np.repeat(np.arange(len(first) - 1), np.diff(first))))
        values = values[order]
        for x, y in TrieJoin(values, first, budget).pairs():
            found.add(values[x].view(np.int64), values[y].view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Forest()
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, column(batch, c).to_numpy()]) for h, c in zip(held, ("mask", "key", "print"), strict=True)]
            new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(held[0]) >= TASK and len(new):
                end = int(new[-1]) + 1
                join(*(h[:end] for h in held), found)
                held = [h[end:] for h in held]
        if len(held[0]):
            join(*held, found)
        yield from found.rows()

    return run


def _blocks(mask: int, number: int) -> list[int]:
    """The mask with each of ``number`` blocks of the bits that are not in it."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    edges = [round(i * len(free) / number) for i in range(number + 1)]
    return [mask | sum(1 << b for b in free[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def connect_prints(prints: DataFrame, budget: int = BUDGET, most: int | None = None) -> DataFrame:
    """(node, label) of the different fingerprints (column ``print``) that a link within the budget connects with another.

    Each fingerprint goes to the tries of its value in each of budget + 1 blocks of bits. Tries with more than ``most``
    leaves are dealt out by blocks of their other bits, and so on while there are some and enough bits are left: the leaves of a
    trie agree in the bits of its mask, so after a few rounds there are at most 2 to the number of the others.
    """
    spark, most = prints.sparkSession, MOST if most is None else most
    where = shared_folder(spark)
    number = max(partitions(spark), -(-(budget + 1) * prints.count() // TASK))
    masks, rounds, edges = [0], 0, None
    rows = prints.select("print", F.lit(0).cast("long").alias("mask"))
    while True:
        deeper = {m: _blocks(m, budget + 1) for m in masks}
        pick = F.create_map(*(x for m, ms in deeper.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(s)) for s in ms)))))
        dealt = rows.select("print", F.explode(pick[F.col("mask")]).alias("mask")).withColumn("key", F.col("print").bitwiseAND(F.col("mask")))
        masks = sorted({m for ms in deeper.values() for m in ms})
        last = max(64 - m.bit_count() for m in masks) <= FREE
        hot = written(dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mask", "key"), f"{where}/hot-{rounds}")
        last = last or hot.isEmpty()
        calm = dealt if last else dealt.join(hot, ["mask", "key"], "left_anti")
        searched = calm.select("mask", "key", "print").repartition(number, "mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_search(budget), "a long, b long")
        edges = searched if edges is None else edges.unionByName(searched)
        if last:
            break
        rows = dealt.join(hot, ["mask", "key"], "left_semi").select("print", "mask")
        rounds += 1
    found = components(edges)
    remove(spark, where)
    return found


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, print) of every whole text; ``print`` holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(fingerprints(column(batch, "t"), size).view(np.int64))], ["id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, print long")


def link_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, budget: int = BUDGET, most: int | None = None) -> DataFrame:
    """Each row's id, ``fingerprint`` (16 hex digits) and ``component_id``: the smallest id that links of ``budget`` bits or fewer reach.

    Texts of one fingerprint are one leaf, whatever their number. A null text is an empty one: fingerprint 0, which links
    like any other. A null id counts for no component id; a component of null ids alone has a null one. Repeated rows stay rows;
    an empty table gives none. Other columns are ignored.
    """
    spark = docs.sparkSession
    where = shared_folder(spark)
    rows = written(simhash(docs, id_col, text_col, size), f"{where}/prints")
    leaves = written(rows.groupBy("print").agg(F.min("id").alias("least")), f"{where}/leaves")
    linked = connect_prints(leaves.select("print"), budget, most)
    joined = written(leaves.join(linked, leaves["print"] == linked["node"], "left").select("print", F.coalesce("label", "print").alias("label"), "least"), f"{where}/labels")
    smallest = written(joined.groupBy("label").agg(F.min("least").alias("component_id")), f"{where}/smallest")
    found = written(joined.join(smallest, "label").select("print", "component_id"), f"{where}/found")
    return rows.join(found, "print").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
