"""Exact nearest neighbours by inner product with cells that cannot matter left out.

The gallery's vectors are grouped round pivots. No vector of a cell can score more with a query than the pivot does plus the query's length
times the cell's radius. A first pass meets each query with the cell that promises most; what it finds there is a score to beat, and a second pass
meets it only with the cells whose bound reaches that. The result is that of all pairs, whatever the pivots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.retrieval import CELLS, MOST_TASKS

#: Pivots at most (all tasks hold them); vectors of the sample for each; vectors of a tile; decimals beyond which scores tie, since equal vectors' sums may differ in their last bits.
PIVOTS, SAMPLE, PLACES = 1024, 4, 10
#: Vectors of a bin of neighbouring cells at most, and of its queries: a query is dealt once a bin, whatever the number of cells that it must meet there.
TILE = 32768


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Of a sample the vectors that are farthest from those chosen before them, so that every cluster of some size gets one; fewer where the others are equal."""
    at, away = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(at) < wanted and away.max() > 0:
        at.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[at[-1]]) ** 2).sum(1))
    return sample[at]


def _homes(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nearest pivot of each vector, and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                home = ((pivots**2).sum(1) - 2 * x @ pivots.T).argmin(1)
                far = np.sqrt(((x - pivots[home]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home), pa.array(far)], ["id", "e", "cell", "far"])

    return run


def _bins(centre: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Bin of each cell: a cell joins the bin of the nearest cell that was put before it, if there is room; a bin has at most a 16th of the vectors."""
    room = min(TILE, -(-sum(counts.values()) // 16))
    left, out = set(range(len(centre))), np.zeros(len(centre), int)
    at, held, number = 0, 0, 0
    while left:
        left.discard(at)
        if held and held + counts[at] > room:
            number, held = number + 1, 0
        out[at], held = number, held + counts[at]
        if left:
            rest = np.fromiter(sorted(left), int)
            at = int(rest[((centre[rest] - centre[at]) ** 2).sum(1).argmin()])
    return out


def _met(pivots: np.ndarray, radius: np.ndarray, first: bool, bins: np.ndarray, counts: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, e[, seed, beat]) once for each bin that they must meet, and its vectors: that of the most promising cell, or all others with a cell whose bound reaches ``beat``."""
    size = np.bincount(bins, weights=[counts[i] for i in range(len(bins))]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _matrix(part.column(1))
                bound = x @ pivots.T + np.sqrt((x**2).sum(1))[:, None] * radius
                bound += 1e-9 * (1 + np.abs(bound))  # sums are rounded
                if first:
                    row, cell = np.arange(len(x)), bins[bound.argmax(1)]
                else:
                    meets = bound >= part.column(3).to_numpy(zero_copy_only=False)[:, None]
                    reach = np.zeros((len(x), len(size)), bool)
                    for c, b in enumerate(bins):
                        reach[:, b] |= meets[:, c]
                    reach[np.arange(len(x)), part.column(2).to_numpy()] = False
                    row, cell = np.nonzero(reach)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(cell), pa.array(size[cell])], ["id", "e", "cell", "n"])

    return run


def _top(x: np.ndarray, y: np.ndarray, asked: np.ndarray, ids: np.ndarray, most: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x``, of ``y`` (by rising id) and scores of the best entries of each query.

    Products of single precision say which pairs can be among the best; only those are scored in double precision.
    """
    narrow, wide = x.astype(np.float32), y.astype(np.float32)
    # bound of the error of a sum of single precision, by lengths
    slack = 4 * (x.shape[1] + 4) * 2.0**-24 * np.sqrt((x**2).sum(1)) * np.sqrt((y**2).sum(1).max()) + 10.0**-PLACES
    step, found = max(1, CELLS // len(y)), []
    block = max(1, min(64, len(y) // (4 * (most + 1))))  # the k-th best of the blocks' best is no more than the k-th best
    whole = len(y) // block * block
    for i in range(0, len(x), step):
        score = narrow[i : i + step] @ wide.T
        if skip_self:
            at = np.minimum(np.searchsorted(ids, asked[i : i + step]), len(ids) - 1)
            own = np.flatnonzero(ids[at] == asked[i : i + step])
            score[own, at[own]] = -np.inf
            if len(own) and len(np.unique(ids)) < len(ids):  # rows of one id
                score[asked[i : i + step, None] == ids[None, :]] = -np.inf
        heads = score[:, :whole].reshape(len(score), -1, block).max(2)
        k = min(most, heads.shape[1])
        floor = np.partition(heads, -k, axis=1)[:, -k] if k == most else np.full(len(score), -np.inf)
        least = np.where(np.isfinite(floor), floor - 2 * slack[i : i + step], -np.inf).astype(np.float64)
        row, col = np.nonzero((score >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]) & (score > -np.inf))
        exact = np.empty(len(row))
        for c in range(0, len(row), 1 << 16):  # copies can make very many candidates
            exact[c : c + (1 << 16)] = np.einsum("ij,ij->i", x[i + row[c : c + (1 << 16)]], y[col[c : c + (1 << 16)]])
        order = np.lexsort((ids[col], -np.round(exact, PLACES), row))
        row, col, exact = row[order], col[order], exact[order]
        keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(score)))[row] < most
        found.append((i + row[keep], col[keep], exact[keep]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _best(dealt: DataFrame, gallery: DataFrame, counts: dict[int, int], most: int, skip_self: bool) -> DataFrame:
    """The best entries of each dealt query in its bin: q, g, score. Bins and their queries are cut into tiles."""
    spark = dealt.sparkSession
    asked = {r.cell: int(r.n) for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a bin
    tiles = spark.createDataFrame([(c, -(-n // TILE), -(-counts[c] // TILE)) for c, n in asked.items()], "cell long, nq long, ng long")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = dealt.join(F.broadcast(tiles), "cell").withColumns({"qt": own("nq"), "side": F.lit(0)}).withColumn("gt", upto("ng"))
    g = gallery.select("id", "e", "cell").join(F.broadcast(tiles), "cell").withColumns({"gt": own("ng"), "side": F.lit(1)}).withColumn("qt", upto("nq"))
    groups = sum(-(-n // TILE) * -(-counts[c] // TILE) for c, n in asked.items())
    names = ["cell", "qt", "gt", "side", "id", "e"]
    both = q.select(names).unionByName(g.select(names)).repartition(max(1, min(groups, MOST_TASKS)), "cell", "qt", "gt")
    shape = pa.schema([("q", pa.int64()), ("g", pa.int64()), ("score", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        part = table.column("side").to_numpy()
        a, b = (table.filter(pa.array(part == s)).sort_by("id") for s in (0, 1))
        if not len(a) or not len(b):
            return shape.empty_table()
        x, y, ids, asked = _matrix(a.column("e")), _matrix(b.column("e")), b.column("id").to_numpy(), a.column("id").to_numpy()
        row, col, score = _top(x, y, asked, ids, most, skip_self)
        return pa.table([asked[row], ids[col], score], schema=shape)

    return both.groupBy("cell", "qt", "gt").applyInArrow(run, "q long, g long, score double")


def nearest_entries(queries: DataFrame, gallery: DataFrame, most: int = 1, skip_self: bool = True, pivots: int | None = None) -> DataFrame:
    """The ``most`` gallery entries with the highest inner product of each query, ties (scores that agree to ten decimals) by id: q, g, score, rank, met.

    Both sides have the columns of ``retrieval.side`` and one length of vector; a null vector is left out. With ``skip_self`` an entry of a
    query's own id does not count; a query without an entry gives no row. ``met`` is how many gallery vectors the query was compared with: less than all
    where bounds spare some. A cell with very many vectors, or queries, is cut into tiles; what leaves a tile is the best of each query.
    """
    queries, gallery = (s.where("e IS NOT NULL").select("id", "e") for s in (queries, gallery))
    n = gallery.count()
    if n == 0:
        return queries.sparkSession.createDataFrame([], "q long, g long, score double, rank int, met long")
    wanted = min(PIVOTS, n, 1 + int(2 * n**0.5) if pivots is None else pivots)
    chosen = _pivots(np.array([r.e for r in gallery.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * wanted).collect()]), wanted)
    placed = gallery.mapInArrow(_homes(chosen), "id long, e array<double>, cell long, far double").persist()
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).orderBy("cell").collect()  # a row a pivot at most
    used = [r.cell for r in cells]
    centre, radius, counts = chosen[used], np.array([r.r for r in cells]), {i: int(r.n) for i, r in enumerate(cells)}
    index = F.create_map(*(F.lit(x) for i, c in enumerate(used) for x in (c, i)))
    bins = _bins(centre, counts)
    placed = placed.select("id", "e", F.element_at(F.array(*(F.lit(int(b)) for b in bins)), (index[F.col("cell")] + 1).cast("int")).cast("long").alias("cell"))
    held = {int(b): sum(counts[i] for i in np.flatnonzero(bins == b)) for b in set(bins)}

    seeded = queries.mapInArrow(_met(centre, radius, True, bins, counts), "id long, e array<double>, cell long, n long").persist()
    first = _best(seeded.drop("n"), placed, held, most, skip_self).persist()
    falling = W.partitionBy("q").orderBy(F.round("score", PLACES).desc(), F.col("g"))
    rows = first.withColumn("rank", F.row_number().over(falling)).where(F.col("rank") == most).select(F.col("q").alias("id"), F.col("score").alias("beat"))
    open_ = seeded.withColumnRenamed("cell", "seed").join(rows, "id", "left").select("id", "e", "seed", F.coalesce("beat", F.lit(float("-inf"))).alias("beat"))
    rest = open_.mapInArrow(_met(centre, radius, False, bins, counts), "id long, e array<double>, cell long, n long").persist()
    found = first.unionByName(_best(rest.drop("n"), placed, held, most, skip_self))
    compared = seeded.select("id", "n").unionByName(rest.select("id", "n")).groupBy(F.col("id").alias("q")).agg(F.sum("n").alias("met"))
    best = found.withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= most)
    return best.join(compared, "q")
