"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and the components of its links.

Words are lower-cased (A-Z) runs of non-white-space; a set holds the distinct shingles of three words.
Two sets link when 100 * common >= 90 * united. Documents with equal sets are one class, found by an
aggregation, and only classes are joined:

- light sets (below a boundary) enumerate their subsets of size n - d for all d <= n / 10, as hashes;
  two light sets that link have a common subset among these;
- heavy sets put the first n / 10 + 1 shingles of a global order (frequent shingles last) into inverted
  lists; two sets that link share one of them. Light sets near the boundary enter the lists as well.

The boundary is the size at which the whole cost is least: subsets written against list entries written
and read, with the numbers of sets of each size and the lengths of their lists as the corpus has them.

Lists are searched where they lie. A pair of a list is a candidate when its parity sketches pass: their
distance never exceeds the size of the symmetric difference, so no link is lost. A task names no pairs; it
tells only which classes its candidates connect, one row a class at most. Classes that candidates connect
are a group; each class of a group brings its whole set there once, and all pairs of a group are decided
exactly by counting common shingles (those that most members have are counted by their absence). Again
only the classes that links connect leave the task. Long lists and large groups are cut into tiles of
bounded size: first each tile is searched, then pairs of tiles, without those whose members are all of
one component.

Sets are told apart by 64-bit keys and shingles by 64 bits (48 in a group): among N different sets about
N * N / 2**65 pairs of keys fall together by chance, 0.03 for 10**9 sets.

Defined cases: null and empty texts, and texts of white space, have an empty set (size 0) and link with
nothing; a text with one or two words is one shingle; rows that repeat, or that repeat an id, are
documents of their own; a null id keeps its row, its component is the smallest id that it reaches (null
if there is none); the empty table gives an empty result; texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import LOWER, SortedHashes, U64, Words, column, cut, mix, partitions, shingles, slices, text_buffer
from tidemark.llm.filters import key_bitmap, row_key
from tidemark.llm.graph import Forest, components

#: Words of a shingle; similarity as 100 * common >= LEAST * united.
SIZE, LEAST = 3, 90
#: In units of one written subset or list entry: giving an entry its sketch, comparing it with another of its list.
ATTACH, COMPARE = 4.0, 0.05
#: Most subsets that a set may enumerate.
MOST_SUBSETS = 1 << 16
#: Classes and bytes of sets in a tile of a long list or a large group.
TILE, TILE_BYTES = 4096, 8 << 20
#: A shingle is frequent when it is in this share of all documents (and in FLOOR at least), as far as chunks of CHUNK documents show it.
FREQUENT, FLOOR, CHUNK = 1 / 500, 50, 2000
#: Least bits of the parity sketch.
SKETCH = 512

_SUBSET = U64(0x5851F42D4C957F2D)
_KEY = U64(0x2545F4914F6CDD1D)


def doc_sets(col: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, rising."""
    data, at = text_buffer(col)
    data = LOWER[data]
    words = Words(data, at)
    values, docs = shingles(words, words.hashes(data), size)
    first = np.searchsorted(docs, np.arange(len(at)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        v = np.sort(values[a:b])
        out.append(v if len(v) < 2 else v[np.concatenate([[True], v[1:] != v[:-1]])])
    return out


def set_key(values: np.ndarray) -> int:
    """One 64-bit key of a set (signed), without regard to order."""
    return int(mix(mix(values ^ _KEY).sum(keepdims=True) + U64(len(values))).view(np.int64)[0])


def missing(n: int, least: int = LEAST) -> int:
    """Most elements of a set of size n that are not in a set linked with it."""
    return n - -(-n * least // 100)


def subsets(n: int, least: int = LEAST) -> int:
    """How many subsets a set of size n enumerates."""
    return sum(comb(n, d) for d in range(missing(n, least) + 1))


def choose_boundary(sizes: dict[int, int], reads: dict[int, float], least: int = LEAST) -> int:
    """The size below which sets enumerate subsets, so that the whole cost is least.

    ``sizes``: how many sets have each size; ``reads``: for each size, how many other sets are in a list on average.
    A boundary pays the subsets of the smaller sets and the list entries of all that can link with a larger one.
    """

    def listed(n: int) -> float:
        others = reads.get(n, 0.0)
        return (missing(n, least) + 1) * (1 + ATTACH * min(1.0, others) + COMPARE * others)

    costs, boundary = {}, 1
    while boundary == 1 or subsets(boundary - 1, least) <= MOST_SUBSETS:
        costs[boundary] = sum(c * ((subsets(n, least) if n < boundary else 0) + (listed(n) if n * 100 >= boundary * least else 0)) for n, c in sizes.items())
        boundary += 1
    return min(costs, key=lambda b: (costs[b], b))


_PLACES: dict[tuple[int, int], np.ndarray] = {}


def _subset_hashes(values: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the set and of its subsets without one element, two, and so on up to the most that may be missing."""
    own = mix(values ^ _SUBSET)
    n, total = len(own), own.sum(keepdims=True)
    out = [total]
    for d in range(1, missing(n, least) + 1):
        if (n, d) not in _PLACES:
            _PLACES[n, d] = np.array(list(combinations(range(n), d)), dtype=np.int16)
        out.append(total - own[_PLACES[n, d]].sum(axis=1, dtype=U64))
    return mix(np.concatenate(out))


def set_tokens(values: np.ndarray, frequent: SortedHashes, boundary: int, least: int = LEAST) -> np.ndarray:
    """Subset hashes and list entries under which a set is found."""
    n = len(values)
    out = []
    if n < boundary:
        out.append(_subset_hashes(values, least))
    if n * 100 >= boundary * least:
        common = frequent.find(values) >= 0
        order = np.concatenate([values[~common], values[common]])
        out.append(order[: missing(n, least) + 1])
    return np.concatenate(out) if out else np.zeros(0, U64)


def sketch(values: np.ndarray, least: int = LEAST) -> bytes:
    """Parity of the number of elements at each place: SKETCH places, for large sets a power of two that two unlike sets of that size fill far beyond the most that linked ones differ in."""
    places = max(SKETCH, 1 << (int(5.2 * (100 - least) / (100 + least) * len(values)) - 1).bit_length())
    return np.packbits(np.bincount((values % U64(places)).astype(np.int64), minlength=places).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(marks: bytes, words: int) -> np.ndarray:
    """A sketch with fewer places (64 a word): those that are equal modulo the new number fall together."""
    return np.bitwise_xor.reduce(np.frombuffer(marks, np.uint64).reshape(-1, words), axis=0)


def most_apart(total: np.ndarray | int, least: int = LEAST):
    """Largest symmetric difference of two linked sets with so many elements in all."""
    return total - 2 * (-(-least * total // (100 + least)))


def sketches_pass(a: bytes, b: bytes, total: int, least: int = LEAST) -> bool:
    words = min(len(a), len(b)) // 8
    return int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum()) <= most_apart(total, least)


def links(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least * (len(a) + len(b) - both) and both > 0


# --- stages ----------------------------------------------------------------------------------------------

_SURVEY = "id long, row long, n long, k long, marks binary, token long, count long, reads double"


def _survey(docs: DataFrame, size: int, least: int) -> DataFrame:
    """One pass: a row a document (id, row, size, key, sketch), rows of shingles frequent in a chunk (token, count), and rows
    of the lists that a chunk makes likely (size, count of sets, and the sum of the share of documents that are in a list of theirs)."""
    names = [c.split()[0] for c in _SURVEY.split(", ")]
    types = {"marks": pa.binary(), "reads": pa.float64()}

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, types.get(c, pa.int64()))) for c in names], names)

    def chunk(held: dict[int, np.ndarray], docs_held: int) -> Iterator[pa.RecordBatch]:
        token, at, count = np.unique(np.concatenate([*held.values(), np.zeros(0, U64)]), return_inverse=True, return_counts=True)
        keep = count >= max(4, int(FREQUENT * len(held) * 2))
        yield rows(token=pa.array(token[keep].view(np.int64)), count=pa.array(count[keep]))
        rare = ~keep[at]
        with_others = np.where(rare, count[at] - 1, 0)
        ends = np.cumsum([len(s) for s in held.values()])
        sums, own = (np.diff(np.concatenate([[0], np.cumsum(x)[ends - 1]])) for x in (with_others, rare))
        n = np.diff(np.concatenate([[0], ends]))
        share = np.where(own > 0, sums / np.maximum(own, 1), 0.0) / docs_held
        some = n < 400
        if some.any():
            every, where = np.unique(n[some], return_inverse=True)
            yield rows(n=pa.array(every, pa.int64()), count=pa.array(np.bincount(where), pa.int64()), reads=pa.array(np.bincount(where, weights=share[some])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = docs_held = 0
        for batch in slices(batches, "t"):
            sets = doc_sets(column(batch, "t"), size)
            keys = [set_key(s) if len(s) else None for s in sets]
            yield rows(id=column(batch, "id"), row=column(batch, "row"), n=pa.array([len(s) for s in sets], pa.int64()), k=pa.array(keys, pa.int64()), marks=pa.array([sketch(s, least) if len(s) else None for s in sets], pa.binary()))
            for k, s in zip(keys, sets, strict=True):
                if k is not None and k not in held:
                    held[k] = s
                    total += len(s)
            docs_held += len(sets)
            if len(held) >= CHUNK or total > 4_000_000:
                yield from chunk(held, docs_held)
                held, total, docs_held = {}, 0, 0
        if held:
            yield from chunk(held, docs_held)

    return docs.mapInArrow(run, _SURVEY)


def _postings(docs: DataFrame, size: int, least: int, frequent: np.ndarray, boundary: int) -> DataFrame:
    """(token, salt, n, k) of each class, once a task however many copies the task reads; frequent shingles are salted."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = SortedHashes(shared.value)
        seen: set[int] = set()
        for batch in slices(batches, "t"):
            parts, sizes, keys = [], [], []
            for s in doc_sets(column(batch, "t"), size):
                if not len(s):
                    continue
                k = set_key(s)
                if k not in seen:
                    seen.add(k)
                    tokens = set_tokens(s, table, boundary, least)
                    parts.append(tokens)
                    sizes.append(np.full(len(tokens), len(s), np.int32))
                    keys.append(np.full(len(tokens), k, np.int64))
            if parts:
                token, k = np.concatenate(parts), np.concatenate(keys)
                salt = np.where(table.find(token) >= 0, 1 + k % 61, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt), pa.array(np.concatenate(sizes)), pa.array(k)], ["token", "salt", "n", "k"])

    return docs.mapInArrow(run, "token long, salt int, n int, k long")


def _lists(least: int):
    """Keeps each class once a list, and only next to one whose size lets them link: lists are in order of size, so neighbours tell.

    ``place`` counts the entries of a list so far. Lists of salted shingles lie apart, so all their classes stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)  # the last entry so far: its neighbour is not here yet
        held_near, last, count = np.zeros(0, dtype=bool), None, 0

        def entries(rows: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal last, count
            rows = rows[near | (rows[:, 1] > 0)]
            if not len(rows):
                return
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            first = np.flatnonzero(new)
            place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
            if last == (rows[0, 0], rows[0, 1]):
                place[: first[1] if len(first) > 1 else len(rows)] += count
            last, count = (rows[-1, 0], rows[-1, 1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3]), pa.array(place)], ["token", "salt", "n", "k", "place"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([column(batch, c).to_numpy().astype(np.int64) for c in ("token", "salt", "n", "k")], axis=1)])
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            rows = rows[new]
            near = np.zeros(len(rows) + 1, dtype=bool)
            near[1:-1] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1) & (100 * rows[:-1, 2] >= least * rows[1:, 2])
            near[0] = held_near[0] if len(held_near) else False
            yield from entries(rows[:-1], (near[:-1] | near[1:])[:-1])
            held, held_near = rows[-1:], near[-2:-1]
        yield from entries(held, held_near if len(held_near) else np.zeros(len(held), dtype=bool))

    return run


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a run of equal (g, tile) ends; the runs are bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        g, tile = column(batch, "g").to_numpy(), column(batch, "tile").to_numpy()
        if not len(g):
            continue
        other = np.flatnonzero((g != g[-1]) | (tile != tile[-1]))
        cut_at = int(other[-1]) + 1 if len(other) else 0
        if held and (cut_at or column(held[0], "g")[0].as_py() != g[0] or column(held[0], "tile")[0].as_py() != tile[0]):
            first = np.flatnonzero((g != column(held[0], "g")[0].as_py()) | (tile != column(held[0], "tile")[0].as_py()))
            yield pa.Table.from_batches([*held, batch.slice(0, int(first[0]))])
            batch, cut_at, held = batch.slice(int(first[0])), cut_at - int(first[0]), []
        if cut_at:
            yield pa.Table.from_batches([batch.slice(0, cut_at)])
        held.append(batch.slice(cut_at))
    if held:
        yield pa.Table.from_batches(held)


#: Lists up to this length are searched for all lists at once, longer ones one by one.
SHORT = 64


def _search_lists(least: int):
    """What the candidates of each list connect: sizes can link and sketches pass. ``w`` holds the sketches."""

    def passing(n: np.ndarray, bits: np.ndarray, long: np.ndarray, marks: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = 100 * np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j])
        at = np.flatnonzero(ok)
        total = n[i[at]] + n[j[at]]
        near = np.bitwise_count(bits[i[at]] ^ bits[j[at]]).sum(axis=1, dtype=np.int64) <= most_apart(total, least)
        for x in np.flatnonzero(near & long[i[at]] & long[j[at]]).tolist():
            near[x] = sketches_pass(marks[i[at[x]]], marks[j[at[x]]], int(total[x]), least)
        ok[at] = near
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Forest()
        for table in _whole_runs(batches):
            g, tile, n, k = (table.column(c).to_numpy() for c in ("g", "tile", "n", "k"))
            n = n.astype(np.int64)
            marks = table.column("w").to_pylist()
            long = np.array([len(m) > SKETCH // 8 for m in marks])
            bits = np.stack([fold(m, SKETCH // 64) if len(m) > SKETCH // 8 else np.frombuffer(m, np.uint64) for m in marks])
            cuts = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (tile[1:] != tile[:-1])) + 1, [len(g)]])
            which = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            short = np.repeat(np.diff(cuts) <= SHORT, np.diff(cuts))
            for apart in range(1, min(SHORT, int(np.diff(cuts).max()))):
                i = np.flatnonzero(short[apart:] & (which[apart:] == which[:-apart])) + apart
                i = i[passing(n, bits, long, marks, i, i - apart)]
                found.add(k[i], k[i - apart])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                unseen = np.arange(a, b) if b - a > SHORT else np.zeros(0, np.int64)
                while len(unseen):  # a component at a time: its classes are each compared with all that no other has reached
                    wave, unseen = unseen[:1], unseen[1:]
                    while len(wave) and len(unseen):
                        near = passing(n, bits, long, marks, np.full(len(unseen), wave[0]), unseen)
                        found.add(np.full(int(near.sum()), k[wave[0]]), k[unseen[near]])
                        wave, unseen = np.concatenate([wave[1:], unseen[near]]), unseen[~near]
        yield from found.rows()

    return run


def count_common(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set in turn, how many elements it shares with every other set (for itself, those that another has too).

    Elements of one set only are left out; those that more than half of the sets have are counted by their
    absence, so near copies cost what they differ in.
    """
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    owner = np.repeat(np.arange(m), size)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    most = count > max(1, m // 2)
    feature = np.where(count > 1, np.cumsum(~most & (count > 1)) - 1, -1)
    common = np.cumsum(most) - 1
    dense = int(most.sum())
    has = np.zeros((m, dense), dtype=bool)
    held = most[at]
    has[owner[held], common[at[held]]] = True
    lacks, lacked = np.nonzero(~has)
    own = ~held & (feature[at] >= 0)
    first_free = int((~most & (count > 1)).sum())
    member = np.concatenate([owner[own], lacks])
    of = np.concatenate([feature[at[own]], lacked + first_free])
    by_feature = np.argsort(of, kind="stable")
    posted = member[by_feature]
    starts = np.searchsorted(of[by_feature], np.arange(first_free + dense + 1)).tolist()
    by_member = np.argsort(member, kind="stable")
    features, first = of[by_member], np.searchsorted(member[by_member], np.arange(m + 1)).tolist()
    without = np.bincount(lacks, minlength=m)
    for x in range(m):
        parts = [posted[starts[f] : starts[f + 1]] for f in features[first[x] : first[x + 1]].tolist()]
        shared = np.bincount(np.concatenate(parts), minlength=m) if parts else np.zeros(m, np.int64)
        yield dense - without[x] - without + shared


def _search_groups(least: int, weighted: bool):
    """What the links of each tile connect, decided on whole sets (``w``); with ``weighted`` also rows (a, null, links) of each class.

    ``side`` of a tile made of two: links within one side were counted elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Forest()
        for table in _whole_runs(batches):
            g, tile, k, side = (table.column(c).to_numpy() for c in ("g", "tile", "k", "side"))
            w = table.column("w").combine_chunks()
            cuts = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (tile[1:] != tile[:-1])) + 1, [len(g)]])
            counts = np.zeros(len(g), np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sets = [unpack(w[i].as_buffer()) for i in range(a, b)]
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                for x, both in enumerate(count_common(sets)):
                    linked = (100 * both >= least * (size[x] + size - both)) & (both > 0)
                    linked[x] = False
                    if weighted:
                        counts[a + x] = int((linked & ((side[a:b] != side[a + x]) | (side[a + x] == 2))).sum())
                    linked[:x] = False
                    y = np.flatnonzero(linked)
                    if len(y):
                        found.add(np.full(len(y), k[a + x]), k[a:b][y])
            if weighted:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(len(k), pa.int64()), pa.array(counts)], ["a", "b", "links"])
        for batch in found.rows():
            yield batch.append_column("links", pa.nulls(batch.num_rows, pa.int64())) if weighted else batch

    return run


def _connect(rows: DataFrame, large: DataFrame, search: Callable, weighted: bool = False) -> DataFrame:
    """Edges (a, b) that connect the classes as the pairs found within each g do. ``rows``: (g, n, k, w).

    ``large`` names the g above a tile, their number of tiles and of classes: (g, tiles, m). These are searched tile by tile, then by
    pairs of tiles; classes of one component that fills tiles of its own lie in these, and such tiles are
    not paired with one another (unless pairs are counted: ``weighted``).
    """
    spark, shape = rows.sparkSession, "a long, b long, links long" if weighted else "a long, b long"

    def searched(dealt: DataFrame) -> DataFrame:
        return dealt.select("g", "tile", "n", "k", "side", "w").repartition(partitions(spark), "g", "tile").sortWithinPartitions("g", "tile", "n", "k").mapInArrow(search, shape)

    if large.isEmpty():
        return cut(searched(rows.withColumn("tile", F.lit(0).cast("long")).withColumn("side", F.lit(2))))
    own = F.pmod(F.xxhash64("k"), F.coalesce("tiles", F.lit(1)))
    first = cut(searched(rows.join(large, "g", "left").withColumn("tile", own).withColumn("side", F.lit(2))))
    placed = rows.join(large, "g")
    if weighted:
        placed = placed.withColumn("home", F.lit(None).cast("long")).withColumn("part", own)
    else:
        joined = components(first).withColumnRenamed("node", "k")
        placed = placed.join(joined, "k", "left").withColumn("home", F.coalesce("label", "k")).drop("label")
        homes = placed.groupBy("g", "home", "tiles", "m").agg((F.count("*") * F.col("tiles") / F.col("m")).alias("fills"))
        loose = homes.where("fills < 1").groupBy("g").agg(F.ceil(F.sum("fills")).alias("loose_tiles"))
        homes = homes.where("fills >= 1").select("g", "home", F.ceil("fills").alias("own_tiles"))
        placed = placed.join(homes, ["g", "home"], "left").join(loose, "g", "left").withColumn("home", F.when(F.col("own_tiles").isNotNull(), F.col("home")))
        placed = placed.withColumn("part", F.pmod(F.xxhash64("k"), F.coalesce("own_tiles", "loose_tiles")))
    tile = F.struct("home", "part")
    tiles = placed.select("g", tile.alias("t")).distinct()
    y = tiles.select("g", F.col("t").alias("u"))
    order = (F.col("t") < F.col("u")) if weighted else (F.col("t") < F.col("u")) | ((F.col("t") == F.col("u")) & F.col("t.home").isNull())
    pairs = tiles.join(y, "g").where(order & (F.col("t.home").isNull() | ~F.col("t.home").eqNullSafe(F.col("u.home"))))
    both = F.explode(F.array_distinct(F.array("t", "u"))).alias("own")
    dealt = pairs.select("g", F.xxhash64("t", "u").alias("tile"), F.col("t").alias("first"), both)
    dealt = dealt.select(F.col("g").alias("_g"), "tile", F.col("own.home").alias("_home"), F.col("own.part").alias("_part"), F.when(F.col("own") == F.col("first"), 0).otherwise(1).alias("side"))
    again = placed.join(dealt, (F.col("g") == F.col("_g")) & F.col("home").eqNullSafe(F.col("_home")) & (F.col("part") == F.col("_part"))).select("g", "tile", "side", "n", "k", "w")
    return cut(first.unionByName(searched(again)))


def _class_sets(docs: DataFrame, size: int, keys: DataFrame) -> DataFrame:
    """(k, n, w) of the classes in ``keys``: a bitmap of their keys, bounded in size, thins the pass over the texts."""
    spark = docs.sparkSession
    bitmap = key_bitmap(keys)
    shared, bits = spark.sparkContext.broadcast(bitmap), 8 * len(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = shared.value
        seen: set[int] = set()
        for batch in slices(batches, "t"):
            rows = []
            for s in doc_sets(column(batch, "t"), size):
                if len(s):
                    k = set_key(s)
                    at = k % bits
                    if has[at >> 3] >> (at & 7) & 1 and k not in seen:
                        seen.add(k)
                        rows.append((k, len(s), np.sort(s >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
            if rows:
                k, n, packed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int32()), pa.array(packed, pa.binary())], ["k", "n", "w"])

    found = docs.mapInArrow(run, "k long, n int, w binary")
    return found.repartition(partitions(spark), "k").dropDuplicates(["k"])


def unpack(packed: bytes) -> np.ndarray:
    """A packed set: 48-bit hashes."""
    raw = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def link_classes(docs: DataFrame, size: int = SIZE, least: int = LEAST, boundary: int | None = None, count_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """The members (id, row, size, k) of each class, and of each class that links with another (k, root[, links]).

    ``docs``: (id, row, t). ``root`` is the same for all classes of a component, ``links`` how many classes one links with.
    ``boundary`` overrides the one that costs least; the result does not depend on it.
    """
    spark = docs.sparkSession
    survey = cut(_survey(docs, size, least))
    members = survey.where("token IS NULL AND reads IS NULL").select("id", "row", F.col("n").alias("size"), "k", "marks")
    total = members.count()
    # at most (mean set size) / FREQUENT shingles can be this frequent, whatever the number of documents
    often = survey.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("c")).where(F.col("c") >= max(FLOOR, total * FREQUENT))
    frequent = np.sort(np.array([r.token for r in often.select("token").collect()], dtype=np.int64).view(U64))
    if boundary is None:
        seen = survey.where("reads IS NOT NULL").groupBy("n").agg(F.sum("count").alias("c"), F.sum("reads").alias("r")).collect()  # sizes below 400
        boundary = choose_boundary({int(r["n"]): r["c"] for r in seen}, {int(r["n"]): r["r"] / r["c"] * total * min(1.0, (missing(int(r["n"]), least) + 1) / r["n"]) for r in seen}, least)

    postings = _postings(docs, size, least, frequent, boundary).repartition(partitions(spark), "token", "salt").sortWithinPartitions("token", "salt", "n", "k")
    # a class has one sketch however many copies it has
    marks = members.where("k IS NOT NULL").groupBy("k").agg(F.max("marks").alias("w"))
    lists = cut(postings.mapInArrow(_lists(least), "token long, salt int, n int, k long, place long"))
    long = lists.where(f"salt > 0 OR place >= {TILE}").groupBy(F.col("token").alias("g")).agg(F.when(F.max("salt") > 0, F.count("*")).otherwise(F.max("place") + 1).alias("m"))
    long = long.where(F.col("m") > TILE).withColumn("tiles", F.ceil(F.col("m") / TILE))
    near = _connect(lists.select(F.col("token").alias("g"), "n", "k").join(marks, "k"), long, _search_lists(least))
    groups = components(near).withColumnRenamed("label", "g")

    keys = groups.select(F.col("node").alias("k"))
    sets = cut(_class_sets(docs, size, keys).join(groups, F.col("k") == F.col("node")).select("g", "n", "k", "w"))
    sizes = sets.groupBy("g").agg(F.count("*").alias("m"), F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") * 6 / TILE_BYTES)).alias("tiles")).where("tiles > 1")
    edges = _connect(sets, sizes, _search_groups(least, count_links), count_links)
    linked = components(edges.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("k"), F.col("label").alias("root"))
    if count_links:
        linked = linked.join(edges.where("b IS NULL").groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links")), "k")
    return members.select("id", "row", "size", "k"), linked


def _columns(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("row", row).select("id", "row", "t")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: int = LEAST, boundary: int | None = None, count_links: bool = False) -> DataFrame:
    """Each document with the size of its set and the smallest id of its component.

    With ``count_links`` also ``class_id`` (a number for each different set, null where it is empty) and ``n_links``
    (how many other classes the document's class links with).
    """
    members, linked = link_classes(_columns(docs, id_col, text_col, F.lit(0).cast("long")), size, least, boundary, count_links)
    classes = members.where("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("rep")).join(linked, "k", "left").withColumn("root", F.coalesce("root", "k"))
    smallest = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    more = [F.col("k").alias("class_id"), "n_links"] if count_links else []
    found = classes.join(smallest, "root").select("k", "component_id", *([F.coalesce("links", F.lit(0)).alias("n_links")] if count_links else []))
    out = members.where("k IS NOT NULL").join(found, "k")
    alone = members.where("k IS NULL").withColumn("component_id", F.col("id")).withColumn("n_links", F.lit(0).cast("long"))
    names = ["id", "size", "component_id", *(["k", "n_links"] if count_links else [])]
    return out.select(*names).unionByName(alone.select(*names)).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id", *more)


def repeated_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Row keys (see ``filters.row_key``) in column ``k``: of the rows that are near duplicates of a row that stays, and of rows that stand more than once and stay once.

    Of a component the row with the smallest id stays, null ids last, ties by row key; rows without a set stay.
    """
    members, linked = link_classes(_columns(docs, id_col, text_col, row_key("id", "t")), size, least)
    rows = members.where("k IS NOT NULL").select(F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("who"), "k")
    classes = rows.groupBy("k").agg(F.min("who").alias("who")).join(linked, "k", "left").withColumn("root", F.coalesce("root", "k"))
    stay = classes.groupBy("root").agg(F.min("who").alias("stay"))
    found = cut(rows.join(classes.join(stay, "root").select("k", "stay"), "k").select(F.col("who.row").alias("row"), (F.col("who") == F.col("stay")).alias("stays")))
    gone = found.where("NOT stays").select(F.col("row").alias("k")).distinct()
    again = found.where("stays").groupBy(F.col("row").alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k")
    return gone, again
