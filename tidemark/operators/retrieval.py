"""Passage retrieval: pooling, similarity, ranks and trials.

A score table has a row a (query, gallery) pair: ``q``, ``g``, ``same`` (same vessel) and ``score``.
Ties: gallery entries of one query follow each other by falling score, then by rising gallery id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import metrics


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def pool(segments: DataFrame, keys: list[str], vector: str, dim: int, guard: float = 0.0) -> DataFrame:
    """Mean vector of each group, scaled to unit length; a zero vector stays as it is.

    One column a dimension is averaged, so partial sums are combined before the shuffle and no
    vector is exploded. With ``guard`` the length is divided by norm + guard instead.
    """
    mean = F.array(*(F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(dim)))
    out = segments.groupBy(*keys).agg(mean.alias("mean"), F.count("*").alias("n_segments")).withColumn("length", norm(F.col("mean")))
    by = F.col("length") + guard if guard else F.when(F.col("length") > 0, F.col("length")).otherwise(1.0)
    return out.withColumn("by", by).select(*keys, "n_segments", F.transform("mean", lambda x: x / F.col("by")).alias(vector))


def scorable(passages: DataFrame, vessel: str = "vessel") -> DataFrame:
    """Passages of vessels that have two or more."""
    return passages.withColumn("_n", F.count("*").over(W.partitionBy(vessel))).where("_n >= 2").drop("_n")


def leave_one_out(passages: DataFrame, uid: str = "uid", vessel: str = "vessel", vector: str = "vec", within: str | None = None) -> DataFrame:
    """Each scorable passage against all others, or against those of its own source (``within``)."""
    extra = [within] if within else []
    q = scorable(passages, vessel).select(F.col(uid).alias("q"), F.col(vessel).alias("qv"), F.col(vector).alias("a"), *(F.col(c).alias(f"q_{c}") for c in extra))
    g = passages.select(F.col(uid).alias("g"), F.col(vessel).alias("gv"), F.col(vector).alias("b"), *(F.col(c).alias(f"g_{c}") for c in extra))
    on = F.col("q") != F.col("g")
    for c in extra:
        on = (F.col(f"q_{c}") == F.col(f"g_{c}")) & on
    return q.join(g, on).select("q", "g", "qv", "gv", (F.col("qv") == F.col("gv")).alias("same"), dot("a", "b").alias("score"))


def trials(scores: DataFrame) -> DataFrame:
    """A row a query with a genuine entry: best genuine and impostor score, rank of the first genuine, best match.

    The rank counts the entries before the best genuine one, which an aggregation over the query's rows
    gives without sorting them.
    """
    best = F.max_by(F.struct("score", F.col("g")), F.struct(F.col("score"), -F.col("g")))
    genuine = F.max(F.when(F.col("same"), F.struct(F.col("score"), (-F.col("g")).alias("back"))))
    top = scores.groupBy("q").agg(genuine.alias("gen"), F.max(F.when(~F.col("same"), F.col("score"))).alias("best_imp"), best.alias("best"), F.first("qv").alias("vessel")).where("gen IS NOT NULL")
    ahead = (F.col("score") > F.col("gen.score")) | ((F.col("score") == F.col("gen.score")) & (-F.col("g") > F.col("gen.back")))
    before = scores.join(top.select("q", "gen"), "q").groupBy("q").agg(F.count_if(ahead).alias("before"))
    return top.join(before, "q").select("q", "vessel", F.col("gen.score").alias("gen_score"), "best_imp", (F.col("before") + 1).alias("rank"), F.col("best.g").alias("top_match"))


def retrieval_table(t: DataFrame) -> DataFrame:
    """One row: queries, rank-1, hits at 5 and 10, median rank."""
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return t.agg(F.count("*").alias("n_queries"), hit(1).alias("rank1"), hit(5).alias("hit5"), hit(10).alias("hit10"), F.median("rank").alias("median_rank"))


def macro_rank1(t: DataFrame) -> DataFrame:
    """Mean over vessels of their share of queries at rank 1."""
    return t.groupBy("vessel").agg(F.avg((F.col("rank") == 1).cast("double")).alias("r1")).agg(F.avg("r1").alias("rank1_macro_vessel"), F.count("*").alias("n_vessels"))


def nearest(t: DataFrame) -> DataFrame:
    """Best other passage of each query of the trials, and whether it is a hit."""
    return t.select("q", F.col("top_match").alias("match"), F.col("top_score").alias("score"), F.when(F.col("rank") == 1, "HIT").otherwise("MISS").alias("verdict"))


def identity_rank(best: DataFrame, own: Column) -> DataFrame:
    """Rank of a query's own identity among the identities, ties by name."""
    order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("identity"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("identity") == own).select("q", "score", "rank")


def row_z(scores: DataFrame, column: str = "score") -> Column:
    """Score less its query's mean over its standard deviation; a deviation of nearly 0 counts as 1."""
    own = W.partitionBy("q")
    sd = F.stddev_pop(column).over(own)
    return (F.col(column) - F.avg(column).over(own)) / F.when(sd > 1e-12, sd).otherwise(1.0)


# --- tiled search ------------------------------------------------------------------------------------------

#: Vectors of a tile, cells of a matrix of scores, groups dealt out at once.
TILE, CELLS, MOST_TASKS = 4096, 1 << 21, 4096
#: Tiles of a side, and vectors of a tile, that are not exceeded before the other is.
SIDES, MOST_TILE = 8, 1 << 16
#: Thresholds of a round of rate search; genuine scores that tasks hold at once; pairs that are gathered by value.
EDGES, MARKS, GATHER = 4096, 1 << 18, 1 << 16


class Side:
    """Some rows of a side: ids, vessels, codes of vessels (equal for equal ones), scope, a number ``x`` and a whole number ``k``."""

    def __init__(self, ids: np.ndarray, vessels: pa.Array, code: np.ndarray, scope: np.ndarray, x: np.ndarray, k: np.ndarray) -> None:
        self.ids, self.vessels, self.code, self.scope, self.x, self.k = ids, vessels, code, scope, x, k


def side(rows: DataFrame, uid: str = "uid", vessel: str = "vessel", vector: str = "vec", scope: Column | None = None, x: Column | None = None, k: Column | None = None) -> DataFrame:
    """The columns that the tiled search takes; a null scope or number counts as 0.

    A side is read once to be counted and once a pass, so it is kept (in memory, else on disk) until the
    session's cache is cleared.
    """
    number = lambda c, kind: F.coalesce(F.lit(0) if c is None else c, F.lit(0)).cast(kind)
    return rows.select(F.col(uid).cast("long").alias("id"), F.col(vessel).cast("string").alias("v"), F.col(vector).cast("array<double>").alias("e"), number(scope, "long").alias("scope"), number(x, "double").alias("x"), number(k, "long").alias("k")).persist()


def sizes(queries: DataFrame, gallery: DataFrame) -> tuple[int, int]:
    """Rows of both sides, counted once for all passes."""
    n = queries.count()
    return n, n if gallery is queries else gallery.count()


def tiles(n: int) -> int:
    """Tiles of a side of n vectors: SIDES at most as long as a tile then has no more than MOST_TILE, so that what is dealt grows as the side does."""
    return max(1, min(-(-n // TILE), max(SIDES, -(-n // MOST_TILE))))


def tiled(queries: DataFrame, gallery: DataFrame, work: Callable[..., pa.Table | None], schema: str, pairs: bool = False, within: bool = False, rows: tuple[int, int] | None = None) -> DataFrame:
    """Every query against every gallery vector in tiles of bounded size, without a row a pair.

    Both sides have the columns of ``side``. Each is dealt into tiles by id; a pair of tiles is a group of its own,
    and ``work(q, g, score)`` turns rows of its matrix of scores, ``CELLS`` at most, into a small table. With ``pairs``
    both sides are the same vectors and each unordered pair is met once; the other cells are NaN. With ``within`` groups are of one
    scope, so that other scopes' pairs are not computed. ``rows``: the sides' numbers of rows (or more), where they are known.
    """
    most, many = sizes(queries, gallery) if rows is None else rows
    nq = tiles(most)
    ng = nq if pairs else tiles(many)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    upto = lambda a, b: F.explode(F.sequence(a, b))
    left = queries.withColumns({"qt": own(nq), "side": F.lit(0)}).withColumn("gt", upto(F.col("qt") if pairs else F.lit(0), F.lit(ng - 1)))
    right = gallery.withColumns({"gt": own(ng), "side": F.lit(1)}).withColumn("qt", upto(F.lit(0), F.col("gt") if pairs else F.lit(nq - 1)))
    keys = ["qt", "gt", *(["scope"] if within else [])]
    dealt = left.unionByName(right).repartition(max(1, min(nq * ng, MOST_TASKS)), *keys)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    shape = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(table: pa.Table) -> pa.Table:
        part = table.column("side").to_numpy()
        q, g = (table.filter(pa.array(part == s)).sort_by("id").combine_chunks() for s in (0, 1))
        out = [shape.empty_table()]
        if len(q) and len(g):
            a, b = (t.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t in (q, g))
            codes = pc.dictionary_encode(pa.concat_arrays([t.column("v").combine_chunks() for t in (q, g)])).indices.to_numpy(zero_copy_only=False)
            of = lambda t, code: Side(t.column("id").to_numpy(), t.column("v").combine_chunks(), code, t.column("scope").to_numpy(), t.column("x").to_numpy(), t.column("k").to_numpy())
            whole, one_tile = of(g, codes[len(q) :]), table.column("qt")[0] == table.column("gt")[0]
            step = max(1, CELLS // len(g))
            for i in range(0, len(q), step):
                some = of(q.slice(i, step), codes[i : min(len(q), i + step)])
                score = a[i : i + step] @ b.T
                if pairs and one_tile:
                    score[some.ids[:, None] >= whole.ids[None, :]] = np.nan
                found = work(some, whole, score)
                if found is not None:
                    out.append(found.select(names).cast(shape))
        return pa.concat_tables(out)

    return dealt.groupBy(*keys).applyInArrow(run, schema)


def _part(q: Side, g: Side, score: np.ndarray, skip_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores with -inf where a pair takes no part, and which pairs are of one vessel."""
    if skip_self:
        score = np.where(q.ids[:, None] == g.ids[None, :], -np.inf, score)
    return score, q.code[:, None] == g.code[None, :]


def tiled_trials(queries: DataFrame, gallery: DataFrame, skip_self: bool = True, within: bool = False, rows: tuple[int, int] | None = None) -> DataFrame:
    """A row a query with a genuine entry: best genuine and impostor score, rank of the first genuine, best match and its score.

    One pass over the tiles gives the best entries, a second one counts what is ahead of the best genuine
    entry; the first pass's result, a row a query, is kept for it. With ``within`` a query meets only the gallery entries of its own scope.
    """
    rows = sizes(queries, gallery) if rows is None else rows

    def best(q: Side, g: Side, score: np.ndarray) -> pa.Table:
        score, same = _part(q, g, score, skip_self)
        gen, imp, rows = np.where(same, score, -np.inf), np.where(same, -np.inf, score), np.arange(len(q.ids))
        at, top = gen.argmax(1), score.argmax(1)
        return pa.table([pa.array(q.ids), q.vessels, pa.array(gen[rows, at]), pa.array(g.ids[at]), pa.array(imp.max(1)), pa.array(score[rows, top]), pa.array(g.ids[top])], ["q", "vessel", "gs", "gi", "best_imp", "ts", "ti"])

    def ahead(q: Side, g: Side, score: np.ndarray) -> pa.Table:
        score, _ = _part(q, g, score, skip_self)
        n = (score > q.x[:, None]) | ((score == q.x[:, None]) & (g.ids[None, :] < q.k[:, None]))
        return pa.table([pa.array(q.ids), pa.array(n.sum(1))], ["q", "n"])

    low = F.lit(float("-inf"))
    entry = lambda s, i: F.max(F.struct(s, (-F.col(i)).alias("back")))
    first = tiled(queries, gallery, best, "q long, vessel string, gs double, gi long, best_imp double, ts double, ti long", within=within, rows=rows)
    top = first.groupBy("q", "vessel").agg(entry("gs", "gi").alias("gen"), F.max("best_imp").alias("best_imp"), entry("ts", "ti").alias("best")).where(F.col("gen.gs") > low).persist()
    held = queries.join(top.select(F.col("q").alias("id"), F.col("gen.gs").alias("gs"), (-F.col("gen.back")).alias("gi")), "id").select("id", "v", "e", "scope", F.col("gs").alias("x"), F.col("gi").alias("k"))
    before = tiled(held, gallery, ahead, "q long, n long", within=within, rows=rows).groupBy("q").agg(F.sum("n").alias("n"))
    return top.join(before, "q").select("q", "vessel", F.col("gen.gs").alias("gen_score"), F.when(F.col("best_imp") > low, F.col("best_imp")).alias("best_imp"), (F.col("n") + 1).alias("rank"), (-F.col("best.back")).alias("top_match"), F.col("best.ts").alias("top_score"))


def trials_against(queries: DataFrame, gallery: DataFrame, uid: str = "uid", vessel: str = "vessel", vector: str = "vec", skip_self: bool = True, within: str | None = None) -> DataFrame:
    """``tiled_trials`` of passages; ``within`` names a column (whole numbers) that both of a pair must share."""
    scope = F.col(within) if within else None
    q = side(queries, uid, vessel, vector, scope)
    t = tiled_trials(q, q if gallery is queries else side(gallery, uid, vessel, vector, scope), skip_self, bool(within))
    return t.withColumn("vessel", F.col("vessel").cast(queries.schema[vessel].dataType))


# --- rates over pairs that are never rows ----------------------------------------------------------------------
#
# A round counts the scores that lie at and between a bounded number of thresholds, in one pass over the tiles. Where the miss and the
# false-alarm rates cross is in one of the gaps, which the next round divides again: the cost is rounds times pairs, and a task holds
# thresholds, never the scores.

#: A view is all queries (ALL) or those with one number ``k``.
ALL = -(1 << 62)
_COUNTS = "view long, slot long, p long, n long, wins long, total double"


def _slots(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    """2 i + 1 for a value at threshold i, 2 i for one between the thresholds i - 1 and i."""
    at = np.searchsorted(edges, values, "left")
    return 2 * at + (edges[np.minimum(at, len(edges) - 1)] == values) if len(edges) else 2 * at


def _summed(t: DataFrame) -> dict[int, dict[int, tuple[int, int, int, float]]]:
    """Counts by view and slot: a few rows a view."""
    rows = t.groupBy("view", "slot").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("wins").cast("decimal(38,0)")).alias("wins"), F.sum("total").alias("total")).collect()
    out: dict[int, dict[int, tuple[int, int, int, float]]] = {}
    for r in rows:
        out.setdefault(r.view, {})[r.slot] = (int(r.p), int(r.n), int(r.wins), float(r.total))
    return out


def impostor_slots(queries: DataFrame, gallery: DataFrame, edges: dict[int, np.ndarray], marks: dict[int, tuple[np.ndarray, np.ndarray]], skip_self: bool = True, within: bool = False, rows: tuple[int, int] | None = None) -> dict[int, dict[int, tuple[int, int, int, float]]]:
    """Impostor scores of each view by slots between its ``edges``; slot -1 has their number, their sum, and how often one of the ``marks`` (different values, rising, and how many are below each) beats one (twice, ties once)."""
    none = np.zeros(0), np.zeros(1, np.int64)

    def count(q: Side, g: Side, score: np.ndarray) -> pa.Table:
        score, same = _part(q, g, score, skip_self)
        use, found = ~same & (score > -np.inf), []
        for view in edges.keys() | marks.keys():
            values = score[use] if view == ALL else score[use & (q.k == view)[:, None]]
            m, below = marks.get(view, none)
            at = np.searchsorted(m, values, "left")
            tied = (m[np.minimum(at, len(m) - 1)] == values) if len(m) else np.zeros(len(values), dtype=bool)
            wins = 2 * int(below[-1]) * len(values) - int(below[at].sum()) - int(below[at + tied].sum())
            found.append((view, -1, 0, len(values), wins, float(values.sum())))
            if view in edges:
                every, n = np.unique(_slots(edges[view], values), return_counts=True)
                found += [(view, int(s), 0, int(c), 0, 0.0) for s, c in zip(every, n, strict=True)]
        return pa.table([pa.array(c) for c in zip(*found, strict=True)], ["view", "slot", "p", "n", "wins", "total"])

    return _summed(tiled(queries, gallery, count, _COUNTS, within=within, rows=rows))


def _first_least(states: list[tuple[int, int]], p: int, n: int, mean: bool) -> float:
    """Of states (accepted genuine, accepted impostor) in order of falling score the first with the least gap of both rates: their mean, or the false-alarm rate."""
    best, out = None, 0.0
    for i, j in states:
        fnr, fpr = 1 - i / p, j / n
        if best is None or abs(fnr - fpr) < best:
            best, out = abs(fnr - fpr), (fnr + fpr) / 2 if mean else fpr
    return out


def _crossed(rows: list[tuple[int, int]], p: int, n: int) -> tuple[int, int, int]:
    """Of (genuine, impostor) counts by falling score the first after which the miss rate is not above the false-alarm rate, and what is before it."""
    i = j = 0
    for at, (a, b) in enumerate(rows):
        if p * n - (i + a) * n - (j + b) * p <= 0:
            return at, i, j
        i, j = i + a, j + b
    return len(rows) - 1, i - rows[-1][0], j - rows[-1][1]


def _by_row(i: int, j: int, a: int, b: int, p: int, n: int) -> list[tuple[int, int]]:
    """States near the crossing inside a value that ``a`` genuine and then ``b`` impostor rows have, and the state before it."""
    near = lambda z, m: sorted({min(max(z + d, 1), m) for d in (-1, 0, 1, 2)} | {1, m}) if m else []
    genuine = [(i + x, j) for x in near((n - j) * p // n - i, a)]
    impostor = [(i + a, j + x) for x in near((p - i - a) * n // p - j, b)]
    return ([(i, j)] if i + j else []) + genuine + impostor


def rates(queries: DataFrame, gallery: DataFrame, trials: DataFrame, views: list[int] | None = None, skip_self: bool = True, within: bool = False, rows: tuple[int, int] | None = None) -> dict[int, dict[str, float | None]]:
    """AUC, equal error rate (row by row, as ``metrics.eer_sorted``) and mean impostor score of each view: best genuine score a query against all impostor pairs.

    The thresholds are genuine scores, since between two of them only the number of impostor scores counts. Up to ``EDGES`` of them one
    pass gives all; beyond, one pass for each ``MARKS`` of them gives the AUC and the first round, and each further round narrows the
    crossing's gap by ``EDGES``. ``views`` are numbers ``k`` of queries, beside all of them.
    """
    rows = sizes(queries, gallery) if rows is None else rows
    own = trials.select(F.col("q").alias("id"), "gen_score").join(queries.select("id", "k"), "id")
    own = own.select("gen_score", F.explode(F.array(F.lit(ALL), "k") if views else F.array(F.lit(ALL))).alias("view"))
    genuine = own.where(F.col("view").isin([ALL, *(views or [])])).groupBy("view", F.col("gen_score").alias("score")).agg(F.count("*").alias("p")).persist()
    asked = queries.join(trials.select(F.col("q").alias("id")), "id", "left_semi")
    known = genuine.groupBy("view").agg(F.count("*").alias("different"), F.sum("p").alias("p")).collect()
    total = {r.view: int(r.p) for r in known}
    chunks = max([1, *(-(-r.different // MARKS) for r in known)])
    bounds = [-np.inf, np.inf]
    if chunks > 1:
        cuts = genuine.agg(F.percentile_approx("score", [i / chunks for i in range(1, chunks)], 100 * chunks)).first()[0]
        bounds = [-np.inf, *sorted(set(cuts)), np.inf]
    wins, counts, impostors, sums = dict.fromkeys(total, 0), {}, {}, {}
    edges: dict[int, list[np.ndarray]] = {v: [] for v in total}
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = genuine.where((F.col("score") > low) & (F.col("score") <= high)).orderBy("view", "score").toArrow().to_pydict() if chunks > 1 else genuine.orderBy("view", "score").toArrow().to_pydict()
        view, score, p = (np.array(part[c]) for c in ("view", "score", "p"))
        marks = {v: (score[view == v], np.concatenate([[0], np.cumsum(p[view == v], dtype=np.int64)])) for v in total}
        for v in total:
            own_marks = score[view == v]
            edges[v].append(own_marks[:: max(1, -(-len(own_marks) * (len(bounds) - 1) // EDGES))])
        last = high == np.inf
        got = impostor_slots(asked, gallery, {v: np.concatenate(e) for v, e in edges.items()} if last else {}, marks, skip_self, within, rows)
        for v in total:
            _, impostors[v], w, sums[v] = got.get(v, {}).get(-1, (0, 0, 0, 0.0))
            wins[v] += w
        counts = got
    out = {}
    cut = {v: np.concatenate(e) for v, e in edges.items()}
    open_ = {v for v in total if impostors[v]}
    eer: dict[int, float] = {}
    while open_:
        for v in sorted(open_):
            e, p, n = cut[v], total[v], impostors[v]
            slot = F.pandas_udf(lambda x, e=e: pd.Series(_slots(e, x.to_numpy())), "long")
            own_p = {r.s: int(r.p) for r in genuine.where(F.col("view") == v).groupBy(slot("score").alias("s")).agg(F.sum("p").alias("p")).collect()}
            falling = [(own_p.get(s, 0), counts[v].get(s, (0, 0, 0, 0.0))[1]) for s in range(2 * len(e), -1, -1)]
            at, i, j = _crossed(falling, p, n)
            s = 2 * len(e) - at
            if s % 2 or not falling[at][0]:
                eer[v] = _first_least(_by_row(i, j, *falling[at], p, n), p, n, True)
                open_ = open_ - {v}
                continue
            low, high = (e[s // 2 - 1] if s else -np.inf), (e[s // 2] if s // 2 < len(e) else np.inf)
            inner = genuine.where((F.col("view") == v) & (F.col("score") > float(low)) & (F.col("score") < float(high))).select("score")
            many = inner.count()
            if many > MARKS:
                between = np.array(inner.agg(F.percentile_approx("score", [(i + 1) / EDGES for i in range(EDGES - 1)], 10 * EDGES)).first()[0])
            else:
                between = np.sort(inner.toArrow().column("score").to_numpy())[:: max(1, -(-many // EDGES))]
            cut[v] = np.unique(np.concatenate([[x for x in (low, high) if np.isfinite(x)], between]))
        if open_:
            counts = impostor_slots(asked, gallery, {v: cut[v] for v in open_}, {}, skip_self, within, rows)
    for v in total:
        n = impostors[v]
        out[v] = {"auc": wins[v] / 2 / total[v] / n if n else None, "eer": eer.get(v), "impostor_mean": sums[v] / n if n else None}
    genuine.unpersist()
    return out


def full_table(queries: DataFrame, gallery: DataFrame, skip_self: bool = True, within: bool = False) -> DataFrame:
    """One row: the retrieval table of all queries with the AUC and the equal error rate over all impostor pairs."""
    rows = sizes(queries, gallery)
    t = tiled_trials(queries, gallery, skip_self, within, rows).persist()  # a row a query, read by the table and by the rates
    found = rates(queries, gallery, t, None, skip_self, within, rows).get(ALL, {})
    return retrieval_table(t).withColumns({c: F.lit(found.get(c)).cast("double") for c in ("auc", "eer")})


def cohort_table(queries: DataFrame, gallery: DataFrame, skip_self: bool = False) -> DataFrame:
    """A row for all queries (null ``cohort``) and for each cohort (``k`` of the queries): queries, rank-1, its mean over vessels, median rank, AUC, equal error rate, mean genuine and impostor score.

    All cohorts are counted in the same passes; their number is that of rows here.
    """
    rows = sizes(queries, gallery)
    t = tiled_trials(queries, gallery, skip_self, rows=rows).persist()
    cohorts = [r.k for r in queries.select("k").distinct().collect()]
    found = rates(queries, gallery, t, cohorts, skip_self, rows=rows)
    own = t.join(queries.select(F.col("id").alias("q"), "k"), "q").withColumn("view", F.explode(F.array(F.lit(ALL), "k")))
    vessels = own.groupBy("view", "vessel").agg(F.avg((F.col("rank") == 1).cast("double")).alias("r")).groupBy("view").agg(F.avg("r").alias("rank1_macro_vessel"))
    table = own.groupBy("view").agg(F.count("*").alias("n_queries"), F.avg((F.col("rank") == 1).cast("double")).alias("rank1"), F.median("rank").alias("median_rank"), F.avg("gen_score").alias("genuine_mean"))
    more = queries.sparkSession.createDataFrame([(v, x["auc"], x["eer"], x["impostor_mean"]) for v, x in found.items()], "view long, auc double, eer double, impostor_mean double")
    every = table.join(vessels, "view").join(more, "view")
    return every.withColumn("cohort", F.nullif(F.col("view"), F.lit(ALL))).select("cohort", "n_queries", "rank1", "rank1_macro_vessel", "median_rank", "auc", "eer", "genuine_mean", "impostor_mean")


def _pair_slots(rows: DataFrame, edges: np.ndarray, n: int) -> dict[int, tuple[int, int]]:
    """Unordered pairs of one vessel and of two, by slots between the edges."""

    def count(q: Side, g: Side, score: np.ndarray) -> pa.Table:
        same, there = q.code[:, None] == g.code[None, :], ~np.isnan(score)
        every, at = np.unique(_slots(edges, score[there]), return_inverse=True)
        p = np.bincount(at, weights=same[there], minlength=len(every)).astype(np.int64)
        m = np.bincount(at, minlength=len(every)) - p
        return pa.table([pa.array(np.zeros(len(every), np.int64)), pa.array(every), pa.array(p), pa.array(m), pa.array(np.zeros(len(every), np.int64)), pa.array(np.zeros(len(every)))], ["view", "slot", "p", "n", "wins", "total"])

    return {s: c[:2] for s, c in _summed(tiled(rows, rows, count, _COUNTS, pairs=True, rows=(n, n))).get(0, {}).items()}


def _pair_values(rows: DataFrame, low: float, high: float, n: int) -> list[tuple[float, int, int]]:
    """The scores between two thresholds, counted by value, falling."""

    def take(q: Side, g: Side, score: np.ndarray) -> pa.Table | None:
        inside = (score > low) & (score < high)
        if not inside.any():
            return None
        every, at = np.unique(score[inside], return_inverse=True)
        p = np.bincount(at, weights=(q.code[:, None] == g.code[None, :])[inside], minlength=len(every)).astype(np.int64)
        return pa.table([pa.array(every), pa.array(p), pa.array(np.bincount(at, minlength=len(every)) - p)], ["score", "p", "n"])

    t = tiled(rows, rows, take, "score double, p long, n long", pairs=True, rows=(n, n)).groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return [(r.score, r.p, r.n) for r in t.orderBy(F.col("score").desc()).collect()]


def pair_eer(rows: DataFrame) -> float | None:
    """The false-alarm rate at the first least gap of both rates over the different scores of all unordered pairs, falling (as ``metrics.eer_roc``); None without pairs of both kinds.

    A gap with more than ``GATHER`` pairs is divided again, at most until its ends are neighbouring numbers; the pairs of a smaller one are counted by value.
    """
    n = rows.count()
    largest = rows.agg(F.max(norm(F.col("e")))).first()[0]
    if largest is None:
        return None
    reach = largest * largest * (1 + 1e-9) + 1e-9
    edges = np.linspace(-reach, reach, EDGES)
    while True:
        got = _pair_slots(rows, edges, n)
        falling = [got.get(s, (0, 0)) for s in range(2 * len(edges), -1, -1)]
        p, q = sum(x for x, _ in falling), sum(y for _, y in falling)
        if not p or not q:
            return None
        at, i, j = _crossed(falling, p, q)
        s = 2 * len(edges) - at
        if s % 2:
            return _first_least([(i, j), (i + falling[at][0], j + falling[at][1])], p, q, False)
        low, high = float(edges[s // 2 - 1]), float(edges[s // 2])
        if sum(falling[at]) <= GATHER:
            states = [(i, j)]
            for _, a, b in _pair_values(rows, low, high, n):
                states.append((states[-1][0] + a, states[-1][1] + b))
            return _first_least(states, p, q, False)
        edges = np.unique(np.linspace(low, high, EDGES))


def reid_report(passages: DataFrame, sampled: DataFrame) -> DataFrame:
    """One row: mean score of pairs of one vessel and of two, their gap, share of the latter below one half, equal error rate over all pairs, rank-1, and the means over ``sampled`` pairs of segments (same, score).

    ``passages`` has the columns of ``side``.
    """
    eer = pair_eer(passages)
    pairs = metrics.pair_summary(pair_profile(passages)).select("same", "diff", "gap", F.col("diff_below").alias("diff_lt05"))
    t = tiled_trials(passages, passages).agg(F.avg((F.col("rank") == 1).cast("double")).alias("rank1"))
    segments = sampled.agg(F.avg(F.when(F.col("same"), F.col("score"))).alias("seg_same"), F.avg(F.when(~F.col("same"), F.col("score"))).alias("seg_diff"))
    n = passages.agg(F.count("*").alias("n_pass"))
    return pairs.withColumn("eer", F.lit(eer).cast("double")).crossJoin(t).crossJoin(segments).crossJoin(n)  # a row each


def row_stats(queries: DataFrame, gallery: DataFrame, skip_self: bool = True, rows: tuple[int, int] | None = None) -> DataFrame:
    """Mean and deviation of each query's scores (a deviation of nearly 0 counts as 1), and the largest absolute score."""

    def sums(q: Side, g: Side, score: np.ndarray) -> pa.Table:
        used = np.ones(score.shape, dtype=bool) if not skip_self else q.ids[:, None] != g.ids[None, :]
        n = used.sum(1)
        mean = np.where(used, score, 0).sum(1) / np.maximum(n, 1)
        return pa.table([pa.array(q.ids), pa.array(n), pa.array(mean), pa.array((np.where(used, score - mean[:, None], 0) ** 2).sum(1)), pa.array(np.where(used, np.abs(score), 0).max(1))], ["q", "n", "mean", "m2", "largest"])

    s = tiled(queries, gallery, sums, "q long, n long, mean double, m2 double, largest double", rows=rows)
    total = s.groupBy("q").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("inner"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("square"), F.max("largest").alias("largest"))
    outer = F.greatest(F.col("square") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    deviation = F.sqrt((F.col("inner") + F.when(outer > 1e-12 * F.col("square"), outer).otherwise(0.0)) / F.col("n"))
    return total.select("q", "mean", F.when(deviation > 1e-12, deviation).otherwise(1.0).alias("deviation"), "largest")


def fused_trials(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leave-one-out trials under the mean of the row-z scores of two methods over the same passages.

    The fused score is one dot product of joined vectors, each half of a query scaled by its own deviation,
    less a number of the query's own.
    """
    rows = sizes(a, a)
    both = a.join(b.select("id", F.col("e").alias("f")), "id")
    sa = row_stats(a, a, rows=rows).select(F.col("q").alias("id"), F.col("mean").alias("ma"), F.col("deviation").alias("sa"))
    sb = row_stats(b, b, rows=rows).select(F.col("q").alias("id"), F.col("mean").alias("mb"), F.col("deviation").alias("sb"))
    held = both.join(sa, "id").join(sb, "id").persist()  # both passes' numbers, for the trials' two passes and what is taken off
    scaled = lambda v, s: F.transform(v, lambda x: x * 0.5 / F.col(s))
    queries = held.withColumn("e", F.concat(scaled("e", "sa"), scaled("f", "sb"))).select(*a.columns)
    t = tiled_trials(queries, both.withColumn("e", F.concat("e", "f")).select(*a.columns), rows=rows)
    off = held.select(F.col("id").alias("q"), (0.5 * (F.col("ma") / F.col("sa") + F.col("mb") / F.col("sb"))).alias("off"))
    return t.join(off, "q").select("q", "vessel", *((F.col(c) - F.col("off")).alias(c) for c in ("gen_score", "best_imp")), "rank", "top_match")


def identity_scores(queries: DataFrame, gallery: DataFrame, skip_self: bool = False, most: int | None = None) -> DataFrame:
    """Best score of each query and identity (``v``) of the gallery.

    With ``most`` a tile gives only so many identities a query, and ties of the last: an identity's best entry lies in one tile, where no
    more than ``most`` - 1 others are ahead of it if it is one of the best ``most``. So rows do not grow with the number of identities;
    identities beyond the best ``most`` of a query may be missing, or have a lower score than their best.
    """

    def best(q: Side, g: Side, score: np.ndarray) -> pa.Table:
        score, _ = _part(q, g, score, skip_self)
        order = np.argsort(g.code, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(g.code[order]) != 0]))
        top = np.maximum.reduceat(score[:, order], first, axis=1)
        keep = top > -np.inf
        if most is not None and most < top.shape[1]:
            keep &= top >= np.partition(top, -most, axis=1)[:, -most, None]
        row, col = np.nonzero(keep)
        return pa.table([pa.array(q.ids[row]), g.vessels.take(pa.array(order[first][col])), pa.array(top[row, col])], ["q", "identity", "score"])

    return tiled(queries, gallery, best, "q long, identity string, score double").groupBy("q", "identity").agg(F.max("score").alias("score"))


def pair_profile(rows: DataFrame, low: float = -0.2, high: float = 1.0, bins: int = 49, below: float = 0.5) -> DataFrame:
    """All unordered pairs by scopes of both, same vessel or not, and class of score: pairs, sum of scores, pairs under ``below``.

    ``a`` is the lesser scope; class -1 is outside of low to high, the last one holds its upper end.
    """

    def count(q: Side, g: Side, score: np.ndarray) -> pa.Table | None:
        i, j = np.nonzero(~np.isnan(score))
        if not len(i):
            return None
        s = score[i, j]
        x, y = q.scope[i], g.scope[j]
        at = np.minimum(np.floor((s - low) / ((high - low) / bins)), bins - 1).astype(np.int64)
        at[(s < low) | (s > high)] = -1
        keys = np.stack([np.minimum(x, y), np.maximum(x, y), (q.code[i] == g.code[j]).astype(np.int64), at])
        every, where = np.unique(keys, axis=1, return_inverse=True)
        where = where.ravel()
        return pa.table([pa.array(every[0]), pa.array(every[1]), pa.array(every[2] == 1), pa.array(every[3]), pa.array(np.bincount(where)), pa.array(np.bincount(where, weights=s)), pa.array(np.bincount(where, weights=s < below).astype(np.int64))], ["a", "b", "same", "bin", "n", "total", "under"])

    t = tiled(rows, rows, count, "a long, b long, same boolean, bin long, n long, total double, under long", pairs=True)
    return t.groupBy("a", "b", "same", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("under").alias("under"))


def top_pairs(rows: DataFrame, most: int) -> DataFrame:
    """The unordered pairs with the highest scores, ties by ids (a report of so many rows)."""

    def best(q: Side, g: Side, score: np.ndarray) -> pa.Table:
        s = np.where(np.isnan(score), -np.inf, score).ravel()
        at = np.flatnonzero(s >= max(np.partition(s, -min(most, len(s)))[-min(most, len(s))], np.finfo(float).min))
        x, y = q.ids[at // len(g.ids)], g.ids[at % len(g.ids)]
        x, y = np.minimum(x, y), np.maximum(x, y)
        first = np.lexsort([y, x, -s[at]])[:most]
        return pa.table([pa.array(x[first]), pa.array(y[first]), pa.array(s[at][first])], ["q", "g", "score"])

    return tiled(rows, rows, best, "q long, g long, score double", pairs=True).orderBy(F.col("score").desc(), "q", "g").limit(most)


def depth_trials(passages: DataFrame, gallery: DataFrame, dim: int, most: int = 5, vector: str = "vec") -> DataFrame:
    """Trials by gallery depth k: the first k other passages of the vessel in time order, pooled, against the others' standard passages."""
    q = scorable(passages).select(F.col("uid").alias("q"), F.col("vessel").alias("qv"), F.col(vector).alias("qe"))
    # the first most + 1 passages of a vessel hold the first ``most`` others of each of its passages
    early = passages.withColumn("_rn", F.row_number().over(W.partitionBy("vessel").orderBy("pid", "uid"))).where(F.col("_rn") <= most + 1)
    rest = q.select("q", "qv").join(early.select(F.col("uid").alias("r"), F.col("vessel").alias("rv"), "pid", F.col(vector).alias("re")), (F.col("qv") == F.col("rv")) & (F.col("q") != F.col("r")))
    order = W.partitionBy("q").orderBy("pid", "r")
    rest = rest.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    mean = F.array(*(F.avg(F.get("re", F.lit(i)).cast("double")).over(upto) for i in range(dim)))
    pooled = rest.select("q", "k", mean.alias("m")).withColumn("by", norm(F.col("m")) + 1e-12).select("q", "k", F.transform("m", lambda x: x / F.col("by")).alias("m"))
    gen = pooled.join(q, "q").select("q", "qv", "k", "qe", dot("m", "qe").alias("gen_score")).withColumn("id", F.col("q") * (most + 1) + F.col("k"))

    def ahead(q: Side, g: Side, score: np.ndarray) -> pa.Table:
        score = np.where(q.code[:, None] == g.code[None, :], -np.inf, score)
        return pa.table([pa.array(q.ids), pa.array(score.max(1)), pa.array((score > q.x[:, None]).sum(1)), pa.array((score > -np.inf).sum(1))], ["id", "imp", "above", "n"])

    t = tiled(side(gen, "id", "qv", "qe", x=F.col("gen_score")), side(gallery, vector=vector), ahead, "id long, imp double, above long, n long")
    t = t.groupBy("id").agg(F.max("imp").alias("best_imp"), (1 + F.sum("above")).alias("rank"), (1 + F.sum("n")).alias("n_gallery")).where("n_gallery > 1")
    return gen.select("id", "q", "qv", "k", "gen_score").join(t, "id").drop("id")
