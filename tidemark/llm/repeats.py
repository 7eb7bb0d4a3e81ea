"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of an enhanced suffix array.

Every string of ``length`` bytes holds ``length - K + 1`` k-mers; the least hash of these (its minimiser)
depends on the string alone, so equal strings share it wherever they stand. Consecutive strings of a
text with one minimiser form a piece. Pieces whose minimiser occurs in one text only cannot hold a
repeat and are left out; the others are dealt out by minimiser, and each part builds the enhanced
suffix array of its pieces: suffixes of at least ``length`` bytes in order, their common prefixes, a
stack scan for the intervals of the common-prefix tree, and the test of left-extension diversity that
keeps maximal repeats, with all their occurrences. Minimisers of very many buckets are dealt out by the
single string instead, so that the edges of a passage that a large share of all texts holds spread over
all parts.

Equal texts are one class, told apart by 128 bits of SHA-256; a class stands for its smallest id, and
its other documents are repeated in whole.

Defined cases: null texts are empty; texts shorter than ``length`` bytes keep all bytes; ids that
repeat are equally small, so rows with one id do not remove each other's bytes; a null id counts as
larger than every other; the empty table gives an empty result; long texts are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import U64, column, cut, mix, slices, text_buffer

#: Bytes of a repeat at least; bytes of a k-mer; text bytes of a bucket and, in the mean, of a part; buckets from which a minimiser is dealt out by string.
LENGTH, K = 50, 24
BUCKET_BYTES, PART_BYTES, HOT = 4 << 20, 8 << 20, 512
_LAST = (1 << 63) - 1
_SALT = U64(0x9E6C63D0876A9A47)
_STRING = U64(0xD1342543DE82EF95)


def _rolling(x: np.ndarray, width: int, salt: np.uint64) -> np.ndarray:
    """A hash of each run of ``width`` values, by doubling."""
    total, done, reach, h, power = None, 0, 1, x, salt
    while True:
        if width & reach:
            if total is None:
                total, done = h, reach
            else:  # the runs done so far come first
                n = len(x) - done - reach + 1
                total = total[:n] * power + h[done : done + n]
                done += reach
        reach *= 2
        if reach > width:
            return total
        h = h[: len(h) - reach // 2] * power + h[reach // 2 :]
        power = power * power


def _least(x: np.ndarray, width: int) -> np.ndarray:
    reach, out = 1, x
    while reach * 2 <= width:
        out = np.minimum(out[: len(out) - reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _minimisers(data: np.ndarray, length: int) -> np.ndarray:
    """Minimiser (48 bits) of the string of ``length`` bytes that starts at each place."""
    with np.errstate(over="ignore"):
        # mixed once more: least values crowd at the low end, parts are cut by leading bits
        return mix(_least(mix(_rolling(data.astype(U64) + U64(1), K, _SALT)), length - K + 1)) >> U64(16)


def minimiser_runs(texts: list[np.ndarray], length: int = LENGTH, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, end and minimiser of the runs of string starts with one minimiser, in order of text and start."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))]

    def add(which: np.ndarray, base: np.ndarray, least: np.ndarray, usable: np.ndarray) -> None:
        """``which``: text of each place, ``base``: place of the text's first byte."""
        new = np.ones(len(least), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (which[1:] != which[:-1]) | (usable[1:] != usable[:-1])
        cuts = np.flatnonzero(new)
        ends = np.append(cuts[1:], len(least))
        good = usable[cuts]
        cuts, ends = cuts[good], ends[good]
        out.append((which[cuts], cuts - base[cuts], ends - base[cuts], least[cuts]))

    i = 0
    while i < len(texts):
        if len(texts[i]) > step:  # long texts a step at a time
            for a in range(0, len(texts[i]) - length + 1, step):
                least = _minimisers(texts[i][a : a + step + length - 1], length)
                add(np.full(len(least), i), np.full(len(least), -a), least, np.ones(len(least), dtype=bool))
            i += 1
            continue
        j, total = i, 0
        while j < len(texts) and len(texts[j]) <= step and total + len(texts[j]) <= step:
            total += len(texts[j])
            j += 1
        if total >= length:
            sizes = np.fromiter((len(t) for t in texts[i:j]), dtype=np.int64, count=j - i)
            at = np.cumsum(sizes) - sizes
            least = _minimisers(np.concatenate(texts[i:j]), length)
            own = np.repeat(np.arange(j - i), sizes)[: len(least)]
            place = np.arange(len(least))
            add(own + i, at[own], least, place + length <= (at + sizes)[own])
        i = j
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _six(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


# --- the enhanced suffix array -----------------------------------------------------------------------------


class SuffixIntervals:
    """Suffixes of at least ``length`` bytes of some pieces, sorted, with common prefixes; pieces are short."""

    def __init__(self, pieces: list[bytes], length: int = LENGTH) -> None:
        self.length = length
        sizes = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=len(pieces))
        n = np.maximum(sizes - length + 1, 0)
        self.piece = np.repeat(np.arange(len(pieces)), n)
        self.offset = np.arange(len(self.piece)) - np.repeat(np.cumsum(n) - n, n)
        wide = -(-int(sizes.max(initial=0)) // 8)
        text = np.frombuffer(b"".join(pieces) + bytes(8 * wide + 8), dtype=np.uint8)
        begin = (np.cumsum(sizes) - sizes)[self.piece] + self.offset
        left = sizes[self.piece] - self.offset
        self.before = np.where(self.offset > 0, text[begin - 1].astype(np.int16), -1)
        eight = np.zeros(len(text) - 7, dtype=U64)  # eight bytes from each place, big-endian so that numbers sort as bytes do
        for b in range(8):
            eight |= text[b : len(text) - 7 + b].astype(U64) << U64(8 * (7 - b))
        keys = np.empty((wide, len(begin)), dtype=U64)
        for j in range(wide):
            keys[j] = eight[begin + 8 * j]
            over = np.clip(8 - (left - 8 * j), 0, 8)  # bytes beyond the end of the piece
            cut = over > 0
            keys[j][cut] = np.where(over[cut] == 8, U64(0), keys[j][cut] >> (U64(8) * (over[cut].astype(U64) % U64(8))) << (U64(8) * (over[cut].astype(U64) % U64(8))))
        order = self._sort(keys, left)
        self.piece, self.offset, self.before, left, keys = self.piece[order], self.offset[order], self.before[order], left[order], keys[:, order]
        common = np.zeros(max(0, len(order) - 1), dtype=np.int64)
        alive = np.ones(len(common), dtype=bool)
        for j in range(wide):
            apart = keys[j, 1:] ^ keys[j, :-1]
            same = (apart == 0).astype(np.int64)
            for b in range(1, 8):
                same += apart < U64(1 << (8 * b))
            common[alive] += same[alive]
            alive &= apart == 0
        self.common = np.minimum(common, np.minimum(left[1:], left[:-1]))
        self.left = left

    @staticmethod
    def _sort(keys: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Order by the keys, then by length; each further key only sorts what is still tied."""
        order, at, group = np.arange(len(left)), np.arange(len(left)), np.zeros(len(left), np.int64)
        for key in [*keys, left]:
            own = order[at]
            step = np.lexsort([key[own], group]) if len(at) < len(order) else np.argsort(key, kind="stable")
            own, group = own[step], group[step]
            order[at] = own
            value = key[own]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
            group = np.cumsum(new) - 1
            tied = np.bincount(group, minlength=1)[group] > 1 if len(group) else new
            at, group = at[tied], group[tied]
            if not len(at):
                break
        return order

    def maximal_repeats(self, several: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first, end, length) of each interval whose strings are not all led by the same byte.

        ``several`` marks the pieces that occur more than once: one suffix of such a piece is an interval too.
        """
        n = len(self.piece)
        lcp = np.concatenate([[0], self.common, [0]])[: n + 1]  # lcp[i]: of suffixes i - 1 and i
        whole = (self.offset == 0) & several[self.piece] & (self.left > np.maximum(lcp[:n], lcp[1:]))
        for i in np.flatnonzero(whole).tolist():
            yield i, i + 1, int(self.left[i])
        heads = np.flatnonzero((lcp[:n] < self.length) & (lcp[1:] >= self.length)).tolist()
        ahead, depths = self.before.tolist(), lcp.tolist()
        for head in heads:
            stack: list[list] = []  # intervals still open: depth, first suffix, byte before all (-1: they differ)
            i = head
            while True:
                i += 1
                depth, start, byte = depths[i], i - 1, ahead[i - 1]
                while stack and stack[-1][0] > depth:
                    inner = stack.pop()
                    byte = inner[2] if inner[2] == byte else -1
                    start = inner[1]
                    if byte < 0:
                        yield start, i, inner[0]
                if depth < self.length:
                    break
                if stack and stack[-1][0] == depth:
                    if stack[-1][2] != byte:
                        stack[-1][2] = -1
                else:
                    stack.append([depth, start, byte])


# --- stages ------------------------------------------------------------------------------------------------


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once a task: its key and bytes."""
    seen: set[bytes] = set()
    for batch in slices(batches, "t", 1 << 20):
        data, at = text_buffer(column(batch, "t"))
        raw, at = data.tobytes(), at.tolist()
        rows = []
        for s, e in zip(at[:-1], at[1:], strict=True):
            key = hashlib.sha256(raw[s:e]).digest()[:16]
            if key not in seen:
                seen.add(key)
                rows.append((key, raw[s:e]))
        if rows:
            keys, texts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], ["key", "bytes"])


def _bucket_texts(table: pa.Table) -> list[tuple[bytes, np.ndarray]]:
    """Different texts of a bucket, by key."""
    found: dict[bytes, np.ndarray] = {}
    for key, text in zip(table.column("key").to_pylist(), table.column("bytes"), strict=True):
        if key not in found:
            found[key] = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)
    return sorted(found.items(), key=lambda x: x[0])


def _bits(parts: int) -> int:
    return max(0, parts - 1).bit_length()


def _published(length: int, bits: int):
    """A bucket tells each part the different minimisers that it holds."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        texts = [t for _, t in _bucket_texts(table)]
        which, start, end, key = minimiser_runs(texts, length)
        every, at = np.unique(key, return_inverse=True)
        # a minimiser whose pieces differ within the bucket, by their ends and lengths, is marked
        whole = np.concatenate([*texts, np.zeros(8, np.uint8)])
        base = np.cumsum([0, *map(len, texts)])[which] if len(which) else which
        ends = np.zeros(len(key), U64)
        for b in range(8):
            ends = (ends * _SALT) ^ (whole[base + start + b].astype(U64) << U64(8)) ^ whole[base + end + length - 2 - b].astype(U64)
        ends ^= (end - start).astype(U64)
        low, high = np.full(len(every), np.iinfo(np.uint64).max, U64), np.zeros(len(every), U64)
        np.minimum.at(low, at, ends)
        np.maximum.at(high, at, ends)
        differ = low != high
        part = (every >> U64(48 - bits)).astype(np.int64) if bits else np.zeros(len(every), np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
        return pa.table({"part": pa.array(part[cuts[:-1]], pa.int32()), "bucket": pa.array(np.full(len(cuts) - 1, bucket), pa.int32()), "keys": pa.array([_six(every[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), "differ": pa.array([np.packbits(differ[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return run


def _shared(least_buckets: int):
    """Minimisers of two buckets or more, back to each of them, and whether they are hot: in very many buckets, most of which hold different pieces."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [_from_six(b) for b in table.column("keys").to_pylist()]
        marks = [np.unpackbits(np.frombuffer(d, np.uint8))[: len(b)] for b, d in zip(blobs, table.column("differ").to_pylist(), strict=True)]
        bucket = np.repeat(table.column("bucket").to_numpy(), [len(b) for b in blobs])
        key, differ = np.concatenate(blobs), np.concatenate(marks).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, bucket, differ = key[order], bucket[order], differ[order]
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        sizes = np.diff(np.append(cuts, len(key)))
        times, marked = np.repeat(sizes, sizes), np.repeat(np.add.reduceat(differ, cuts), sizes)
        keep = times >= 2
        key, bucket, hot = key[keep], bucket[keep], (times[keep] >= least_buckets) & (2 * marked[keep] >= times[keep])
        order = np.argsort(bucket, kind="stable")
        key, bucket, hot = key[order], bucket[order], hot[order]
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.table({"bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "key": pa.array([_six(key[a:b]) for a, b in spans], pa.binary()), "hot": pa.array([np.packbits(hot[a:b]).tobytes() for a, b in spans], pa.binary()), "rep": pa.nulls(len(spans), pa.int64())})

    return run


def _pieces(length: int, bits: int):
    """Pieces of a bucket's texts whose minimiser is shared, each different one once, with all its places."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _bucket_texts(left)
        bucket = left.column("bucket")[0].as_py() if left.num_rows else -1
        reps: dict[bytes, int] = {}
        keys, hots = [np.zeros(0, U64)], [np.zeros(0, dtype=bool)]
        for key, hot, rep in zip(right.column("key").to_pylist(), right.column("hot").to_pylist(), right.column("rep").to_pylist(), strict=True):
            if hot is None:
                reps[key] = rep
            else:
                keys.append(_from_six(key))
                hots.append(np.unpackbits(np.frombuffer(hot, np.uint8))[: len(keys[-1])].astype(bool))
        which, start, end, key = minimiser_runs([t for _, t in texts], length)
        order = np.lexsort([which, key])
        pair = np.ones(len(order), dtype=bool)  # a minimiser once a text
        pair[1:] = (key[order][1:] != key[order][:-1]) | (which[order][1:] != which[order][:-1])
        local, times = np.unique(key[order][pair], return_counts=True)
        shared, hot = np.concatenate(keys), np.concatenate(hots)
        scorching = np.sort(shared[hot])
        shared = np.unique(np.concatenate([shared, local[times >= 2]]))
        found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        use = np.flatnonzero(np.isin(key, shared))
        high = np.isin(key[use], scorching).tolist() if len(scorching) else [False] * len(use)
        raw, last = b"", -1
        for c, s, e, k, by_string in zip(which[use].tolist(), start[use].tolist(), end[use].tolist(), key[use].tolist(), high, strict=True):
            if c != last:
                raw, last = texts[c][1].tobytes(), c
            step = 1 if by_string else length - K + 1
            for a in range(s, e, step):
                piece = raw[a : min(e, a + step) + length - 1]
                where = int.from_bytes(hashlib.blake2b(piece, digest_size=6).digest(), "little") if by_string else k
                found.setdefault((where >> (48 - bits) if bits else 0, piece), []).append((c, a))
        by_part: dict[int, list[tuple[bytes, list[tuple[int, int]]]]] = {}
        for (part, piece), places in found.items():
            by_part.setdefault(part, []).append((piece, places))
        rep_of = [reps[k] for k, _ in texts]
        out: dict[str, list] = {k: [] for k in ("part", "pieces", "sizes", "counts", "places", "reps")}
        for part, rows in by_part.items():
            places = [p for _, own in rows for p in own]
            out["part"].append(part)
            out["pieces"].append(b"".join(p for p, _ in rows))
            out["sizes"].append(np.array([len(p) for p, _ in rows], "<i4").tobytes())
            out["counts"].append(np.array([len(o) for _, o in rows], "<i4").tobytes())
            out["places"].append(np.array(places, "<i4").tobytes())
            out["reps"].append(np.array([rep_of[c] for c, _ in places], "<i8").tobytes())
        n = len(out["part"])
        return pa.table({"part": pa.array(out["part"], pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), **{k: pa.array(out[k], pa.binary()) for k in ("pieces", "sizes", "counts", "places", "reps")}})

    return run


def _covered(length: int):
    """Maximal repeats of a part; for each place the bytes that a text with a smaller id repeats."""

    def run(table: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        entry, bucket, places, reps = [], [], [], []
        for row in table.to_pylist():
            sizes, counts = np.frombuffer(row["sizes"], "<i4"), np.frombuffer(row["counts"], "<i4")
            at, own = 0, []
            for n in sizes.tolist():
                own.append(index.setdefault(row["pieces"][at : at + n], len(index)))
                at += n
            entry.append(np.repeat(np.array(own, dtype=np.int64), counts))
            places.append(np.frombuffer(row["places"], "<i4").reshape(-1, 2).astype(np.int64))
            reps.append(np.frombuffer(row["reps"], "<i8"))
            bucket.append(np.full(len(places[-1]), row["bucket"], dtype=np.int64))
        entry, bucket, places, reps = np.concatenate(entry), np.concatenate(bucket), np.concatenate(places), np.concatenate(reps)
        smallest = np.full(len(index), _LAST)
        largest = np.full(len(index), -1 << 63)
        np.minimum.at(smallest, entry, reps)
        np.maximum.at(largest, entry, reps)
        array = SuffixIntervals(list(index), length)
        low, high = smallest[array.piece], largest[array.piece]
        cover: dict[int, list[tuple[int, int, int]]] = {}
        piece, offset = array.piece.tolist(), array.offset.tolist()
        for a, b, n in array.maximal_repeats(smallest < largest):
            least = int(low[a]) if b == a + 1 else int(low[a:b].min())
            for i in range(a, b):
                if high[i] > least:
                    cover.setdefault(piece[i], []).append((offset[i], offset[i] + n, least))
        order = np.argsort(entry, kind="stable")
        first = np.searchsorted(entry[order], np.arange(len(index) + 1))
        rows: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for e, spans in cover.items():
            for i in order[first[e] : first[e + 1]].tolist():
                own = sorted((s, t) for s, t, least in spans if least < reps[i])
                base, end = int(places[i, 1]), -1
                out = rows.setdefault((int(bucket[i]), int(places[i, 0])), []) if own else None
                for s, t in own:  # overlapping spans as one
                    if out and s <= end:
                        if t > end:
                            end = t
                            out[-1] = (out[-1][0], base + t)
                    else:
                        out.append((base + s, base + t))
                        end = t
        by_bucket: dict[int, list[tuple[int, int, int]]] = {}
        for (b, c), spans in rows.items():
            by_bucket.setdefault(b, []).extend((c, s, t) for s, t in spans)
        return pa.table({"bucket": pa.array(list(by_bucket), pa.int32()), "spans": pa.array([np.array(v, "<i4").tobytes() for v in by_bucket.values()], pa.binary())})

    return run


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Touching and overlapping spans as one; spans in order of start come out."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    cuts = np.flatnonzero(new)
    return start[cuts], end[np.append(cuts[1:], len(start)) - 1]


def _kept(detail: bool):
    """What is left of each text of a bucket; with ``detail`` also the removed spans and the bytes that stay."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _bucket_texts(left)
        rows = np.concatenate([np.zeros((0, 3), "<i4"), *(np.frombuffer(b, "<i4").reshape(-1, 3) for b in right.column("spans").to_pylist())]).astype(np.int64)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        first = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
        out: dict[str, list] = {"key": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": [], "kept": []}
        for c, (key, text) in enumerate(texts):
            start, end = merge_spans(rows[first[c] : first[c + 1], 1], rows[first[c] : first[c + 1], 2])
            raw, stays = text.tobytes(), np.ones(len(text), dtype=bool)
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                stays[s:e] = False
            rest = raw if len(start) == 0 else text[stays].tobytes()
            out["key"].append(key)
            out["n_removed"].append(int((end - start).sum()))
            out["n_spans"].append(len(start))
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            if detail:
                out["spans"].append(",".join(f"{s}:{e}" for s, e in zip(start.tolist(), end.tolist(), strict=True)))
                out["kept"].append(rest)
        kinds = {"key": pa.binary(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.string(), "kept": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items() if detail or k not in ("spans", "kept")})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, detail: bool = False) -> DataFrame:
    """Bytes of each document that an earlier one (by id) repeats, and the digest of what is left.

    With ``detail`` also ``spans`` (start:end of each removed run, comma-joined) and ``kept`` (the bytes that stay).

    The texts are shuffled once, by class; the three steps that read them share that shuffle.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    members = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"), F.octet_length(text).cast("long").alias("n_bytes")))
    reps = members.groupBy("key").agg(F.min(F.coalesce("id", F.lit(_LAST))).alias("rep"))
    total = members.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(1, int(total) // BUCKET_BYTES)
    bits = _bits(max(1, int(total) // PART_BYTES))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")

    texts = docs.select(text.alias("t")).mapInArrow(_classes, "key binary, bytes binary").select(bucket, "key", "bytes")
    held = texts.groupBy("bucket").applyInArrow(_published(length, bits), "part int, bucket int, keys binary, differ binary")
    shared = held.groupBy("part").applyInArrow(_shared(HOT), "bucket int, key binary, hot binary, rep long")
    known = shared.unionByName(reps.select(bucket, "key", F.lit(None).cast("binary").alias("hot"), "rep"))
    pieces = texts.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_pieces(length, bits), "part int, bucket int, pieces binary, sizes binary, counts binary, places binary, reps binary")
    spans = pieces.groupBy("part").applyInArrow(_covered(length), "bucket int, spans binary")
    kept = texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_kept(detail), "key binary, n_removed long, n_spans long, kept_sha256 string" + (", spans string, kept binary" if detail else ""))

    out = members.join(kept.join(reps, "key"), "key")
    whole = (F.coalesce("id", F.lit(_LAST)) > F.col("rep")) & (F.col("n_bytes") >= length)
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(whole, F.concat(F.lit("0:"), F.col("n_bytes").cast("string"))).otherwise(F.col("spans")).alias("spans"), F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if detail else []),
    )
