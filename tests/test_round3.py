"""Findings of round 3: small cases that failed before."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")

from tidemark.operators import encoder, neighbours, retrieval, signal, tonal  # noqa: E402
from tidemark.plans import acoustic, catalog  # noqa: E402
from tidemark.sources import sliced  # noqa: E402


def test_product_meets_the_same_pairs_from_both_sides():
    rng = np.random.default_rng(0)
    f = np.concatenate([np.round(np.repeat(np.arange(0, 9, 0.01), 3), 2), np.round(np.repeat(np.arange(200, 209, 0.01), 3), 2)])
    clip = rng.integers(0, 700, len(f))
    side = (clip, f, np.ones(len(f)))
    pair, _ = tonal._product(side, side, 700)
    near = np.abs(f[:, None] - f[None, :]) <= tonal.TOLERANCE
    want = np.unique((clip[:, None] * 700 + clip[None, :])[near])
    assert (pair == want).all()
    assert set(pair) == set(pair % 700 * 700 + pair // 700)


def against_sql(spark, path, name, **tables):
    """Rows of a query and of its SQL over small tables."""
    for t, frame in tables.items():
        frame.to_parquet(path / f"{t}.parquet")
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, str(path)), c.sql(catalog.ORACLES[name])
    return sorted(map(tuple, got.select(*sorted(got.columns)).collect())), sorted(want.select(*map(duckdb.ColumnExpression, sorted(want.columns))).fetchall())


def test_path_names_of_long_numbers(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "path_names", pages=pd.DataFrame({"page_id": [7, 12345], "url": ["http://a/b.html", "http://a/c"]}))
    assert got == want and got[1][2] == "A/A-12345.wav"


def test_path_resolution_of_repeated_urls(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "path_resolution", pages=pd.DataFrame({"page_id": [1, 3, 4, 5, 7, 8], "url": ["a/x", "a/x", "b/y", "c/y", "b/y", "a/x"]}))
    assert got == want and [r[1] for r in got] == ["a/x", "a/x", "p:4", "n:4", "p:4", "a/x"]


def test_select_val_of_more_forced_vessels_than_places_and_of_level_types(spark, tmp_path):
    for forced in (45, 2):
        n = 97 * forced
        customer = pd.DataFrame({"c_custkey": range(1, n + 1), "c_mktsegment": [f"t{k % 53}" for k in range(n)]})
        orders = pd.DataFrame({"o_orderkey": range(2 * n), "o_custkey": [k // 2 + 1 for k in range(2 * n)], "o_orderpriority": ["1-URGENT" if k % 5 == 0 else "5-LOW" for k in range(2 * n)]})
        got, want = against_sql(spark, tmp_path, "select_val", customer=customer, orders=orders)
        assert got == want and sum(r[0] == "val" for r in got) == max(40, forced)


def test_a_query_is_dealt_once_a_bin_not_once_a_cell():
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((200, 8))
    counts = {i: 5 for i in range(200)}
    bins = neighbours._bins(centre, counts)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([centre[0].tolist()]), pa.array([bins[0]]), pa.array([-np.inf])], ["id", "e", "seed", "beat"])
    (got,) = neighbours._met(centre, np.ones(200), False, bins, counts)(iter([batch]))
    assert got.num_rows == bins.max() < 20
    assert sum(got.column(3).to_pylist()) == 1000 - 5 * int((bins == bins[0]).sum())


def test_ranges_ask_for_no_more_tasks_the_more_they_are(spark):
    ranges = spark.range(20000).select(F.lit("x").alias("path"), F.col("id").alias("first"))
    assert sliced._dealt(ranges).rdd.getNumPartitions() <= sliced.TASKS * spark.sparkContext.defaultParallelism


def test_segments_are_encoded_a_few_at_a_time(spark, monkeypatch):
    most = []
    monkeypatch.setattr(encoder, "encode_batch", lambda x, w: most.append(len(x)) or np.zeros((len(x), 3), np.float32))

    class Rows:
        sparkSession = spark

        def mapInPandas(self, run, shape):
            return run

    frame = pd.DataFrame({"clip": ["a"] * 50, "seg_idx": range(50), "samples": [np.zeros(8, np.float32)] * 50})
    assert sum(len(part) for part in encoder.embed(Rows(), {})(iter([frame]))) == 50
    assert max(most) <= 16


def test_copies_of_a_vector_that_are_dealt_do_not_grow_with_the_side():
    assert [retrieval.tiles(n) for n in (0, 1, 4097, 120_000, 500_000)] == [1, 1, 2, 8, 8]
    assert retrieval.tiles(1 << 20) == 16  # beyond that a tile stays bounded


def test_shares_of_blocks_are_those_of_all_lines():
    rng = np.random.default_rng(2)
    (f, g), (w, v) = np.round(rng.exponential(9, (2, 30, 6)), 2), rng.integers(0, 9, (2, 30, 6)).astype(float)
    f[::4, 4:], w[::4, 4:], w[0] = np.nan, 0, 0
    near = (np.abs(f[:, None, :, None] - g[None, :, None, :]) <= 1.0).any(3)
    total = w.sum(1)[:, None]
    want = np.where(total > 0, (near * w[:, None, :]).sum(2) / np.where(total > 0, total, 1), 0)
    assert np.allclose(tonal._shares(f, w, g), want, atol=1e-12)
    assert tonal._shares(f[:, :0], w[:, :0], g).shape == tonal._shares(f, w, g).shape


def test_waveform_lines_of_a_clip_whose_noise_alone_makes_a_line(spark, tmp_path):
    t = np.arange(14 * signal.RATE) / signal.RATE
    noise = np.random.default_rng(5368).standard_normal(len(t))
    assert [f for f, _ in signal.tonal_lines(noise.astype(np.float32))] == [42.75]  # right by the operator's rule, which stays
    got, want = against_sql(spark, tmp_path, "waveform_lines", supplier=pd.DataFrame({"s_suppkey": [5368, 7], "s_nationkey": [3, 24]}))
    assert got == want and len(got) == 6


def test_only_tones_come_near_the_threshold(spark, tmp_path):
    pd.DataFrame({"s_suppkey": [0, 5368, 10**12 + 1], "s_nationkey": [0, 7, 24]}).to_parquet(tmp_path / "supplier.parquet")
    for clip, samples in acoustic._tones(spark, str(tmp_path), 14).collect():
        freqs, times, power = signal.spectrum(np.array(samples))
        top, _, _ = signal.band_levels(signal.whiten(freqs, power), freqs)
        held = np.maximum(top[:, :10].min(axis=1), top[:, 1:].min(axis=1))  # the level a band keeps for ten frames of eleven
        assert len(times) == 11
        tones = [40 + int(clip) * 7 % 150, 250 + int(clip) * 13 % 200]
        assert (held[tones] > 15).all() and (held > 6).sum() == 3
