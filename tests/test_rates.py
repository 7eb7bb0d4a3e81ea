"""Rates over pairs that are never rows, against plain loops over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import etl, metrics, retrieval
from tidemark.plans.roles import halves, passages


def vectors(seed, n, dim=4, grid=None):
    """Vectors of vessels with one to many passages; on a coarse grid many scores tie."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)) if grid is None else rng.integers(-grid, grid + 1, (n, dim)).astype(float)
    return [(i, int(rng.integers(0, n // 4)), i % 2, [float(x) for x in v[i]]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "uid long, vessel long, cohort long, vec array<double>")


def sweep(gen, imp):
    order = sorted([(-s, 0) for s in gen] + [(-s, 1) for s in imp])
    i = j = 0
    best = None
    for _, other in order:
        i, j = i + (not other), j + other
        fnr, fpr = 1 - i / len(gen), j / len(imp)
        if best is None or abs(fnr - fpr) < best[0]:
            best = (abs(fnr - fpr), (fnr + fpr) / 2)
    return best[1]


def plain_rates(rows, asked, skip_self):
    score = np.array([r[3] for r in rows]) @ np.array([r[3] for r in rows]).T
    gen, imp = [], []
    for a, q in enumerate(rows):
        if not asked(q):
            continue
        same = [score[a, b] for b, g in enumerate(rows) if g[1] == q[1] and not (skip_self and a == b)]
        if same:
            gen.append(max(same))
            imp += [score[a, b] for b, g in enumerate(rows) if g[1] != q[1]]
    auc = np.mean([(g > i) + 0.5 * (g == i) for g in gen for i in imp])
    return {"auc": pytest.approx(auc), "eer": pytest.approx(sweep(gen, imp)), "impostor_mean": pytest.approx(np.mean(imp)), "n": len(gen)}


@pytest.mark.parametrize("grid", [None, 2])
@pytest.mark.parametrize(("edges", "marks", "tile"), [(4096, 1 << 18, 4096), (3, 1 << 18, 16), (3, 7, 4096), (2, 1, 11)])
def test_cohorts_match_all_pairs_in_any_number_of_rounds(spark, monkeypatch, grid, edges, marks, tile):
    monkeypatch.setattr(retrieval, "EDGES", edges)
    monkeypatch.setattr(retrieval, "MARKS", marks)
    monkeypatch.setattr(retrieval, "TILE", tile)
    rows = vectors(edges + marks, 44, grid=grid)
    s = retrieval.side(frame(spark, rows), k=F.col("cohort"))
    got = {r.cohort: r for r in retrieval.cohort_table(s, s, skip_self=True).collect()}
    assert set(got) == {None, 0, 1}
    for cohort, r in got.items():
        want = plain_rates(rows, lambda q, c=cohort: c is None or q[2] == c, True)
        assert {"auc": r.auc, "eer": r.eer, "impostor_mean": r.impostor_mean, "n": r.n_queries} == want


@pytest.mark.parametrize("grid", [None, 2])
@pytest.mark.parametrize(("edges", "gather", "tile"), [(4096, 1 << 16, 4096), (5, 3, 9), (3, 0, 4096)])
def test_error_rate_of_all_pairs(spark, monkeypatch, grid, edges, gather, tile):
    monkeypatch.setattr(retrieval, "EDGES", edges)
    monkeypatch.setattr(retrieval, "GATHER", gather)
    monkeypatch.setattr(retrieval, "TILE", tile)
    rows = vectors(edges, 30, grid=grid)
    pairs = [(rows[a][1] == rows[b][1], float(np.dot(rows[a][3], rows[b][3]))) for a in range(30) for b in range(a)]
    want = metrics.eer_roc(metrics.sweep(spark.createDataFrame(pairs, "genuine boolean, score double"))).first()[0]
    assert retrieval.pair_eer(retrieval.side(frame(spark, rows))) == pytest.approx(want, abs=1e-12)


def test_rates_without_pairs_of_both_kinds(spark):
    rows = [(i, 1, 0, [1.0, float(i)]) for i in range(4)]
    s = retrieval.side(frame(spark, rows))
    r = retrieval.full_table(s, s).first()
    assert (r.n_queries, r.rank1, r.auc, r.eer) == (4, 1.0, None, None)
    assert retrieval.pair_eer(s) is None
    none = retrieval.side(frame(spark, rows).limit(0))
    assert retrieval.pair_eer(none) is None and retrieval.full_table(none, none).first().n_queries == 0
    assert retrieval.cohort_table(none, none).collect() == []


def test_groups_of_one_scope_alone(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 7)
    rows = vectors(3, 40)
    s = retrieval.side(frame(spark, rows), scope=F.col("cohort"))
    got = {r.q: (r.rank, r.top_match) for r in retrieval.tiled_trials(s, s, within=True).collect()}
    want = {}
    for c in (0, 1):
        own = retrieval.side(frame(spark, [r for r in rows if r[2] == c]))
        want |= {r.q: (r.rank, r.top_match) for r in retrieval.tiled_trials(own, own).collect()}
    assert got == want


def test_each_pass_runs_once(spark, sf_dir, monkeypatch):
    """Kernel calls at one tile: a pass is one call."""
    runs, real = spark.sparkContext.accumulator(0), retrieval.tiled

    def counting(q, g, work, *more, **how):
        def counted(*a):
            runs.add(1)
            return work(*a)

        return real(q, g, counted, *more, **how)

    monkeypatch.setattr(retrieval, "tiled", counting)
    p = retrieval.side(passages(spark, sf_dir))
    h = retrieval.side(halves(spark, sf_dir))

    def spent(make):
        spark.catalog.clearCache()  # else an equal pass before it is found again
        before = runs.value
        make().collect()
        return runs.value - before

    assert spent(lambda: retrieval.retrieval_table(retrieval.tiled_trials(p, p))) == 2
    assert spent(lambda: retrieval.full_table(p, p)) == 3
    assert spent(lambda: retrieval.fused_trials(p, h)) == 4
    monkeypatch.setattr("tidemark.plans.trials.retrieval", retrieval)
    from tidemark.plans import trials

    assert spent(lambda: trials.self_match(spark, sf_dir)) == 3
    sampled = etl.random_pairs(passages(spark, sf_dir), "uid", 50, 1).select((F.col("a") == F.col("b")).alias("same"), F.lit(0.0).alias("score"))
    assert spent(lambda: retrieval.reid_report(p, sampled)) == 5
