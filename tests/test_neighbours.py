"""Nearest entries with cells left out are those of all pairs."""

import numpy as np
import pytest

from tidemark.operators import neighbours, retrieval


def frame(spark, ids, x):
    return retrieval.side(spark.createDataFrame([(int(i), 0, None if v is None else [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "uid long, vessel long, vec array<double>"))


def plain(ids, x, others, y, most, skip):
    out = {}
    for i, v in zip(ids, x, strict=True):
        order = sorted((-float(np.dot(v, w)), int(o)) for o, w in zip(others, y, strict=True) if not (skip and o == i))[:most]
        if order:
            out[int(i)] = [(o, pytest.approx(-s, abs=1e-9)) for s, o in order]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.q, r["rank"])):
        out.setdefault(r.q, []).append((r.g, r.score))
    return out


def clustered(rng, n, groups, dim=8, spread=0.01):
    centre = rng.standard_normal((groups, dim))
    x = centre[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("tile", "pivots", "cells"), [(4096, None, 1 << 21), (7, 5, 30), (4096, 1, 1 << 21)])
@pytest.mark.parametrize("kind", ["clustered", "random", "hot"])
def test_same_rows_as_all_pairs(spark, monkeypatch, tile, pivots, cells, kind):
    monkeypatch.setattr(neighbours, "TILE", tile)
    monkeypatch.setattr(neighbours, "CELLS", cells)
    rng = np.random.default_rng(tile)
    x = clustered(rng, 120, 12) if kind == "clustered" else rng.standard_normal((120, 8))
    if kind == "hot":
        x[::2] = np.round(x[0], 1)  # half of all vectors are one
    ids = rng.permutation(200)[:120]
    s = frame(spark, ids, x)
    got = neighbours.nearest_entries(s, s, 3, pivots=pivots)
    assert result(got) == plain(ids, x, ids, x, 3, True)
    q = frame(spark, range(1000, 1030), x[:30] * 5)
    assert result(neighbours.nearest_entries(q, s, 1, skip_self=False, pivots=pivots)) == plain(range(1000, 1030), x[:30] * 5, ids, x, 1, False)


def test_most_of_a_clustered_gallery_is_left_out(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 1500, 30, dim=16)
    s = frame(spark, range(1500), x)
    got = neighbours.nearest_entries(s, s, 1)
    assert result(got) == plain(range(1500), x, range(1500), x, 1, True)
    met = [r.met for r in got.collect()]
    assert np.mean(met) < 0.2 * 1500  # four fifths of all pairs are spared


def test_awkward_sides(spark):
    s = frame(spark, [1, 2, 3], [[0.0, 0.0], None, [1.0, 0.0]])
    none = s.limit(0)
    assert result(neighbours.nearest_entries(s, s, 5)) == {1: [(3, 0.0)], 3: [(1, 0.0)]}
    assert neighbours.nearest_entries(none, s).collect() == [] == neighbours.nearest_entries(s, none).collect()
    assert result(neighbours.nearest_entries(s.where("id = 1"), s.where("id = 1"))) == {}
