"""Operators on small fixtures with values worked out by hand or by plain Python."""

import math
import shutil

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import encoder, etl, metrics, retrieval, signal, tonal
from tidemark.sources import readers, writers
from tidemark.streaming import enrol


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def passages(spark):
    """Six vessels with one to four passages, 4-d vectors, exact ties and a zero vector."""
    data = [(0, 1, 0, [1.0, 0, 0, 0]), (1, 1, 1, [1.0, 0, 0, 0]), (2, 2, 0, [1.0, 0, 0, 0]), (3, 2, 1, [0, 1.0, 0, 0]), (4, 2, 2, [0, 0.6, 0.8, 0]), (5, 3, 0, [0.0, 0, 0, 0]), (6, 4, 0, [0, 0, 1.0, 0]), (7, 4, 1, [0, 0, 0, 1.0]), (8, 5, 0, [0.5, 0.5, 0.5, 0.5]), (9, 6, 0, [0, 0, 0.6, 0.8])]
    return spark.createDataFrame([(*r[:3], [float(x) for x in r[3]]) for r in data], "uid long, vessel long, pid long, vec array<double>")


@pytest.fixture(scope="module")
def pairs(spark):
    data = [(True, s) for s in (0.9, 0.8, 0.8, 0.3)] + [(False, s) for s in (0.8, 0.7, 0.3, 0.1)]
    return spark.createDataFrame(data, "genuine boolean, score double")


def brute_trials(rows, skip_self=True):
    out = {}
    for q, qv, _, a in rows:
        order = sorted(((sum(x * y for x, y in zip(a, b)), -g, gv) for g, gv, _, b in rows if g != q or not skip_self), reverse=True)
        hit = [i for i, (_, _, gv) in enumerate(order) if gv == qv]
        if hit:
            out[q] = (hit[0] + 1, -order[0][1])
    return out


def test_trials_match_plain_python_on_ties(passages, monkeypatch):
    rows = [tuple(r) for r in passages.collect()]
    want = brute_trials(rows)
    got = {r.q: (r.rank, r.top_match) for r in retrieval.trials(retrieval.leave_one_out(passages)).collect()}
    assert got == want
    tiles = {r.q: (r.rank, r.top_match) for r in retrieval.trials_against(passages, passages).collect()}
    assert tiles == want
    monkeypatch.setattr(retrieval, "TILE", 3)
    monkeypatch.setattr(retrieval, "CELLS", 2)
    assert {r.q: (r.rank, r.top_match) for r in retrieval.trials_against(passages, passages).collect()} == want


@pytest.mark.parametrize(("tile", "marks", "edges"), [(4096, 1 << 16, 4096), (3, 2, 2)])
def test_tables_do_not_depend_on_tiles(spark, passages, monkeypatch, tile, marks, edges):
    monkeypatch.setattr(retrieval, "TILE", tile)
    monkeypatch.setattr(retrieval, "MARKS", marks)
    monkeypatch.setattr(retrieval, "EDGES", edges)
    rows = [tuple(r) for r in passages.collect()]
    score = {(a[0], b[0]): sum(x * y for x, y in zip(a[3], b[3])) for a in rows for b in rows}
    vessel = {r[0]: r[1] for r in rows}
    gen = {q: max(score[q, g] for g in vessel if g != q and vessel[g] == v) for q, v in vessel.items() if sum(w == v for w in vessel.values()) > 1}
    imp = [score[q, g] for q in gen for g in vessel if vessel[g] != vessel[q]]
    s = retrieval.side(passages)
    got = one(retrieval.full_table(s, s))
    assert got.n_queries == len(gen)
    assert got.auc == pytest.approx(sum((g > i) + 0.5 * (g == i) for g in gen.values() for i in imp) / len(gen) / len(imp))
    assert got.eer == pytest.approx(sorted_sweep(list(gen.values()), imp))
    same = [score[a, b] for a in vessel for b in vessel if a < b and vessel[a] == vessel[b]]
    other = [score[a, b] for a in vessel for b in vessel if a < b and vessel[a] != vessel[b]]
    p = one(metrics.pair_summary(retrieval.pair_profile(s)))
    assert (p.same, p["diff"]) == (pytest.approx(np.mean(same)), pytest.approx(np.mean(other))) and p.diff_below == np.mean(np.array(other) < 0.5)
    top = sorted(((-v, a, b) for (a, b), v in score.items() if a < b))[:4]
    assert [(r.q, r.g) for r in retrieval.top_pairs(s, 4).collect()] == [(a, b) for _, a, b in top]
    stats = {r.q: (r["mean"], r.deviation) for r in retrieval.row_stats(s, s).collect()}
    for q in vessel:
        v = np.array([score[q, g] for g in vessel if g != q])
        assert stats[q] == (pytest.approx(v.mean()), pytest.approx(v.std() if v.std() > 1e-12 else 1.0))


def test_pooling_keeps_zero_vectors_and_scales_others(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 0.0]), (2, [0.0, 4.0])], "k int, v array<double>")
    got = {r.k: list(r.v) for r in retrieval.pool(df, ["k"], "v", 2).collect()}
    assert got[1] == [0.0, 0.0]
    assert np.allclose(got[2], [0.6, 0.8])


def test_row_z_of_constant_scores_is_zero(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0), (2, 3.0)], "q int, score double")
    got = sorted(r[0] for r in df.select(retrieval.row_z(df).alias("z")).collect())
    assert got == [-1.0, 0.0, 0.0, 1.0]


def test_auc_counts_ties_half(pairs):
    gen, imp = [0.9, 0.8, 0.8, 0.3], [0.8, 0.7, 0.3, 0.1]
    want = sum((g > i) + 0.5 * (g == i) for g in gen for i in imp) / 16
    assert one(metrics.auc(pairs)).auc == pytest.approx(want)


def sorted_sweep(gen, imp):
    order = sorted([(-s, 0) for s in gen] + [(-s, 1) for s in imp])
    p = n = 0
    best = None
    for pos, (_, other) in enumerate(order):
        p, n = p + (not other), n + other
        fnr, fpr = 1 - p / len(gen), n / len(imp)
        if best is None or abs(fnr - fpr) < best[0]:
            best = (abs(fnr - fpr), pos, (fnr + fpr) / 2)
    return best[2]


@settings(max_examples=6, deadline=None)
@example([0, 1], [0, 0, 0, 1, 1, 1, 1])
@given(st.lists(st.integers(0, 6), min_size=1, max_size=12), st.lists(st.integers(0, 6), min_size=1, max_size=12))
def test_metrics_match_plain_python(spark, gen, imp):
    df = spark.createDataFrame([(True, float(s)) for s in gen] + [(False, float(s)) for s in imp], "genuine boolean, score double")
    assert one(metrics.eer_sorted(df)).eer == pytest.approx(sorted_sweep(gen, imp))
    assert one(metrics.auc(df)).auc == pytest.approx(sum((g > i) + 0.5 * (g == i) for g in gen for i in imp) / len(gen) / len(imp))
    rows = {r.tau: r for r in metrics.sweep(df).collect()}
    for t in rows:
        assert (rows[t].tp, rows[t].fp) == (sum(g >= t for g in gen), sum(i >= t for i in imp))


def test_metrics_without_both_sides(spark):
    df = spark.createDataFrame([(True, 1.0)], "genuine boolean, score double")
    assert one(metrics.auc(df)).auc is None
    assert one(metrics.eer_sorted(df)).eer is None
    assert one(metrics.auc(df.limit(0))).auc is None


def test_f1_takes_the_lowest_threshold_of_equals(pairs):
    assert one(metrics.f1_optimum(metrics.sweep(pairs))).tau == pytest.approx(0.8)


def test_identity_tiers(spark):
    rows = [(1, "Motorboat", None), (2, 'Motorboat "Duda"', None), (3, "Tugboat 2 (arriving)", None), (4, "Motorboat", "x?MMSI=77"), (5, '"Mar de Onza" (leaving)', None), (6, "Pirata  de Salvora", None)]
    df = spark.createDataFrame(rows, "id int, name string, link string")
    c = (F.col("name"), F.col("link"))
    got = {r.id: (r.k, r.conf, r.s) for r in df.select("id", T.identity_key(*c, F.col("id")).alias("k"), T.identity_confidence(*c).alias("conf"), T.state(F.col("name")).alias("s")).collect()}
    assert got == {1: ("rec:1", "uncertain", ""), 2: ("rec:2", "uncertain", ""), 3: ("name:tugboat 2", "named", "arriving"), 4: ("rec:4", "mmsi", ""), 5: ("name:mar de onza", "named", "leaving"), 6: ("name:pirata de salvora", "named", "")}


def test_recording_number_fails_on_unknown_names(spark):
    df = spark.createDataFrame([("IARA", "A-0025"), ("SHIPSEAR", "10__x")], "s string, c string")
    assert [r[0] for r in df.select(T.recording_number(F.col("s"), F.col("c"))).collect()] == ["25", "10"]
    with pytest.raises(Exception, match="no recording number"):
        spark.createDataFrame([("IARA", "A-x")], "s string, c string").select(T.recording_number(F.col("s"), F.col("c"))).collect()


def test_allocation_reaches_the_total():
    assert etl.allocate({"a": 60, "b": 30, "c": 10}, 10) == {"a": 6, "b": 3, "c": 1}
    for wanted in range(0, 12):
        assert sum(etl.allocate({"a": 5, "b": 1, "c": 1, "d": 1}, wanted).values()) == wanted


def test_islands_of_least_length(spark):
    rows = [(c, i, True, 1.0) for c, n in (("a", 9), ("b", 10), ("c", 11)) for i in range(n)] + [("d", i, i != 10, float(i)) for i in range(21)]
    df = spark.createDataFrame(rows, "clip string, pos int, above boolean, v double")
    got = {(r.clip, r.start, r.length, r.mean_value) for r in etl.islands(df, ["clip"], "pos", "v", 10).collect()}
    assert got == {("b", 0, 10, 1.0), ("c", 0, 11, 1.0), ("d", 0, 10, 4.5), ("d", 11, 10, 15.5)}


def test_split_keeps_vessels_apart(spark):
    h = spark.createDataFrame([(f"v{i}", "ab"[i % 2], i % 4, i % 3 == 0, i % 9 == 0) for i in range(40)], "vessel_id string, type string, n_recordings int, has_cpa boolean, on_both_hardware boolean")
    s = etl.select_val(h, 10)
    assert s.where("split = 'val'").count() == 10
    assert etl.leaked(s.where("split = 'train'"), s.where("split = 'val'")).count() == 0


# --- tonal lines and waveforms -----------------------------------------------------------------------------


def python_score(a, b):
    def share(x, y):
        total = sum(d for _, d in x)
        return sum(d for f, d in x if any(abs(f - g) <= 1.0 for g, _ in y)) / total if total > 0 else 0.0

    return 0.5 * (share(a, b) + share(b, a)) if a and b else 0.0


line_sets = st.lists(st.tuples(st.integers(0, 12).map(lambda v: v / 2), st.integers(1, 9).map(float)), max_size=6, unique_by=lambda x: x[0])


@settings(max_examples=6, deadline=None)
@given(line_sets, line_sets)
def test_tonal_score(spark, a, b):
    df = spark.createDataFrame([(a, b)], f"x {tonal.LINES}, y {tonal.LINES}")
    s, t, own = df.select(tonal.score("x", "y"), tonal.score("y", "x"), tonal.score("x", "x")).first()
    assert s == pytest.approx(python_score(a, b)) and s == pytest.approx(t)
    assert own == (1.0 if a else 0.0)


def test_line_tolerance_is_inclusive(spark):
    df = spark.createDataFrame([([(100.0, 5.0)], [(101.0, 5.0)]), ([(100.0, 5.0)], [(101.0001, 5.0)])], f"x {tonal.LINES}, y {tonal.LINES}")
    assert [r[0] for r in df.select(tonal.score("x", "y")).collect()] == [1.0, 0.0]


@pytest.mark.parametrize(("tile", "step"), [(1024, 64), (7, 2), (1, 1)])
def test_sparse_matches_equal_all_pairs(spark, monkeypatch, tile, step):
    monkeypatch.setattr(tonal, "STEP", step)
    rng = np.random.default_rng(tile)
    sets = [(c, sorted({float(rng.integers(0, 60)) + [0.0, 0.5, 0.1][c % 3] + (c // 20) * 200: float(rng.integers(0, 6)) for _ in range(rng.integers(0, 6))}.items())) for c in range(60)]
    sets += [(100 + i, [(7.0, 3.0), (50.0, 2.0)]) for i in range(20)] + [(None, [(7.0, 1.0)]), (200, []), (201, [(7.0, 0.0)]), (202, [(9000.0, 4.0)])]
    frame = spark.createDataFrame(sets, f"clip long, lines {tonal.LINES}")
    got = {}
    for r in tonal.top_matches(frame, 4, tile=tile).collect():
        got.setdefault(r.clip, []).append((r["rank"], r.other, pytest.approx(r.score)))
    own, want = {c: x for c, x in sets if c is not None}, {}
    for c, x in own.items():
        pairs = [(o, python_score(x, y)) for o, y in own.items() if o != c and sum(d for _, d in x) > 0 and sum(d for _, d in y) > 0 and any(abs(f - g) <= 1.0 for f, _ in x for g, _ in y)]
        best = sorted(pairs, key=lambda p: (-round(p[1], 9), p[0]))[:4]
        if best:
            want[c] = [(i + 1, o, s) for i, (o, s) in enumerate(best)]
    assert {c: sorted(v, key=lambda x: x[0]) for c, v in got.items()} == want and len(want) > 50


def test_epoch_sets_fill_their_quota_in_turn(spark):
    counts = {1: (230, 10), 2: (20, 0), 3: (5, 15), 4: (12, 3), 5: (12, 40), 6: (4, 12), 7: (0, 9), 8: (20, 60), 9: (19, 57)}
    rows = [(f"{v}-{k}-{i}", v, k == "a") for v, (n, m) in counts.items() for k, c in (("o", n), ("a", m)) for i in range(c)]
    got = etl.epoch_sets(spark.createDataFrame(rows, "path string, vessel_id long, is_augmented boolean"), per_set=20, sets=7).collect()
    assert len(got) == len({(r.path, r.set_idx) for r in got})  # no row twice in a set
    for v, (n, m) in counts.items():
        kind = "heavy" if n >= 20 else "mid" if n >= 5 else "short"
        for s in range(1, 8):
            own = [r for r in got if r.vessel_id == v and r.set_idx == s]
            originals = sum(not r.is_augmented for r in own)
            assert {r.kind for r in own} == {kind}
            assert (originals, len(own)) == {"heavy": (20, 20), "mid": (n, min(20, n + m)), "short": (n, n + m)}[kind]
        times = [sum(r.path == f"{v}-{k}-{i}" for r in got) for k, c in (("o", n), ("a", m)) if (k == "o") == (kind == "heavy") for i in range(c)]
        assert max(times, default=0) - min(times, default=0) <= 1


def test_merge_keeps_the_strongest(spark):
    df = spark.createDataFrame([([(1.0, 3.0), (2.0, 5.0), (3.0, 4.0), (3.1, 1.0), (9.0, 2.0)],)], f"x {tonal.LINES}")
    got = [tuple(x) for x in df.select(tonal.merge(F.col("x"))).first()[0]]
    kept = []
    for f, d in sorted([(1.0, 3.0), (2.0, 5.0), (3.0, 4.0), (3.1, 1.0), (9.0, 2.0)], key=lambda v: (-v[1], v[0])):
        if all(abs(f - g) > 1 for g, _ in kept):
            kept.append((f, d))
    assert got == kept


@given(st.integers(0, 400000))
def test_segment_rule(n):
    starts = signal.segment_starts(n)
    assert len(starts) == (0 if n < 40000 else n // 40000 + (n % 40000 >= 8000))
    assert all(0 <= s <= n - 40000 for s in starts)


@settings(deadline=None)
@given(st.floats(0.1, 100), st.floats(-50, 50))
def test_z_norm_ignores_scale_and_offset(scale, offset):
    x = np.random.default_rng(1).standard_normal(500)
    assert np.allclose(signal.z_norm(x), signal.z_norm(x * scale + offset), atol=1e-4)
    assert np.allclose(signal.z_norm(np.full(10, offset)), 0, atol=1e-9)


def tone(hz, seconds, rate=8000, noise=1.0):
    t = np.arange(int(seconds * rate)) / rate
    return 0.5 * np.sin(2 * np.pi * hz * t) + noise * np.random.default_rng(5).standard_normal(len(t))


def test_lines_of_a_tone():
    got = signal.tonal_lines(tone(100, 20))
    assert got and abs(got[0][0] - 100) <= 0.125
    shifted = signal.tonal_lines(signal.speed_shift(tone(100, 22, noise=0.3), "approach"))
    assert shifted and abs(shifted[0][0] - 100 * 1040 / 1000) <= 0.25 or abs(shifted[0][0] - 100 * 1000 / 1040) <= 0.25
    assert signal.tonal_lines(tone(100, 3.9)) == []
    assert signal.tonal_lines(tone(100, 12.9)) == []  # fewer than ten frames


def test_spectrum_and_whitener_match_plain_sums():
    rate, rng = 40, np.random.default_rng(4)
    x = rng.standard_normal(1000) + 3
    freqs, times, power = signal.spectrum(x, rate)
    size = 160
    taper = [min(1, 0.5 * (1 - math.cos(2 * math.pi * min(i, size - i) / (0.25 * size)))) if min(i, size - i) < 20 else 1.0 for i in range(size)]
    for frame, k in ((0, 0), (1, 7), (3, 80), (5, 160)):
        part = x[frame * 40 : frame * 40 + size]
        part = (part - part.mean()) * taper
        own = abs(sum(v * np.exp(-2j * math.pi * k * i / 320) for i, v in enumerate(part))) ** 2 / (rate * sum(w * w for w in taper))
        assert power[k, frame] == pytest.approx(own * (1 if k in (0, 160) else 2), rel=1e-6, abs=1e-12)
        assert freqs[k] == pytest.approx(k * rate / 320) and times[frame] == pytest.approx((frame * 40 + 80) / rate)
    freqs = np.arange(200) * 0.5
    power = rng.random((200, 2)) + (np.arange(200) == 90)[:, None] * 50
    reach, guard = 19, 3

    def around(v, i):
        at = [i + d for d in range(-reach, reach + 1) if abs(d) > guard]
        return sum(v[-1 - j if j < 0 else j if j < 200 else 399 - j] for j in at) / 32

    for t in (0, 1):
        v = power[:, t]
        first = [around(v, i) for i in range(200)]
        clipped = [min(p, 3 * m) for p, m in zip(v, first)]
        want = [10 * math.log10(v[i] / around(clipped, i)) for i in range(200)]
        assert np.allclose(signal.whiten(freqs, power)[:, t], want)


def test_encoder_matches_plain_loops():
    w = encoder.seeded_weights(4, channels=4, widths=(3, 5), kernels=(3, 5))
    x = np.random.default_rng(1).standard_normal(40)

    def norm(v, groups):
        rows = v.reshape(groups, -1)
        return ((rows - rows.mean(1, keepdims=True)) / np.sqrt(rows.var(1, keepdims=True) + 1e-5)).reshape(v.shape)

    branches = []
    for i, size in enumerate((3, 5)):
        padded = np.pad(x, size // 2)
        branches.append(np.maximum(norm(np.array([[sum(taps[j] * padded[t + j] for j in range(size)) for t in range(40)] for taps in w[f"bank{i}"]]), 4), 0))
    z = np.maximum(w["squeeze"] @ (branches[0] + branches[1]).mean(1), 0)
    share = np.exp(np.stack([w[f"excite{i}"] @ z for i in (0, 1)]))
    share /= share.sum(0)
    y = sum(s[:, None] * b for s, b in zip(share, branches))[None]
    for i, (a, b) in enumerate(encoder.STRIDES[:2]):
        padded, taps = np.pad(y, ((0, 0), (1, 1), (1, 1))), w[f"block{i}"]
        rows, cols = range(0, y.shape[1], a), range(0, y.shape[2], b)
        y = np.maximum(norm(np.array([[[(padded[:, r : r + 3, c : c + 3] * t).sum() for c in cols] for r in rows] for t in taps]), len(taps)), 0)
    v = y.mean(axis=(1, 2))
    assert np.allclose(encoder.encode(x, w), v / np.linalg.norm(v), atol=1e-5)


def shifted_sums(x, w, blocks):
    """The encoder once more, each convolution as a sum over its taps of shifted inputs."""

    def norm(v):
        rows = v.reshape(min(16, len(v)), -1)
        return ((rows - rows.mean(1, keepdims=True)) / np.sqrt(rows.var(1, keepdims=True) + 1e-5)).reshape(v.shape)

    branches = []
    for i in range(4):
        taps = w[f"bank{i}"]
        padded = np.pad(x, taps.shape[1] // 2)
        branches.append(np.maximum(norm(sum(taps[:, j, None] * padded[j : j + len(x)] for j in range(taps.shape[1]))), 0))
    z = np.maximum(w["squeeze"] @ sum(b.mean(1) for b in branches), 0)
    share = np.exp(np.stack([w[f"excite{i}"] @ z for i in range(4)]))
    y = sum(s[:, None] * b for s, b in zip(share / share.sum(0), branches))[None]
    for i in range(blocks):
        a, b = encoder.STRIDES[i]
        p = np.pad(y, ((0, 0), (1, 1), (1, 1)))
        y = np.maximum(norm(sum(np.tensordot(w[f"block{i}"][:, :, j, k], p[:, j : j + y.shape[1], k : k + y.shape[2]], 1) for j in range(3) for k in range(3))[:, ::a, ::b]), 0)
    v = y.mean(axis=(1, 2))
    return v / np.linalg.norm(v)


@pytest.mark.parametrize(("held", "slab"), [(1 << 30, 1 << 27), (1, 1 << 27), (1 << 22, 20000)])
def test_batches_at_full_width_match_sums_over_taps(spark, monkeypatch, held, slab):
    monkeypatch.setattr(encoder, "HELD", held)
    monkeypatch.setattr(encoder, "SLAB", slab)
    w = encoder.seeded_weights(3) if slab > 20000 else encoder.seeded_weights(3, channels=16, widths=(8, 16, 16, 24, 32))
    x = np.random.default_rng(2).standard_normal((3, 96))
    got = encoder.encode_batch(x, w)
    assert np.allclose(got, [shifted_sums(v, w, 5) for v in x], atol=2e-5)
    assert got.shape[1] == (512 if slab > 20000 else 32)


def test_segments_of_several_lengths_are_embedded(spark):
    w = encoder.seeded_weights(1, channels=16, widths=(8, 32), kernels=(3, 5, 7, 9))
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", i, [float(v) for v in rng.standard_normal(50 + 7 * (i % 2))]) for i in range(9)]
    got = {r.clip: r.embedding for r in encoder.embed(spark.createDataFrame(rows, "clip string, seg_idx int, samples array<float>"), w).collect()}
    assert all(np.allclose(got[c], encoder.encode(np.array(x, np.float32), w), atol=1e-5) for c, _, x in rows) and len(got) == 9


def test_resampling_keeps_a_tone():
    x = tone(440, 2, rate=16000, noise=0.0)
    y = signal.resample(x, 16000, block=4000)
    assert len(y) == len(x) // 2
    assert np.allclose(y, signal.polyphase(x, 1, 2), atol=1e-6)
    assert np.allclose(y[200:-200], tone(440, 2, noise=0.0)[200:-200], atol=2e-2)


def test_mixing_reaches_the_ratio():
    rng = np.random.default_rng(0)
    y, noise = rng.standard_normal(8000), rng.standard_normal(8000) * 7
    added = signal.mix_at_snr(y, noise, 10) - y
    assert 10 * math.log10(np.mean(y**2) / np.mean(added**2)) == pytest.approx(10, abs=0.01)
    assert np.all(signal.noise_stretch([], 5, rng) == 0)
    assert len(signal.noise_stretch([np.ones(3)], 10, rng)) == 10


def test_waveform_expressions_match_the_kernels(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(v)) for v in rng.standard_normal(n) + 3], [float(np.float32(v)) for v in rng.standard_normal(n)], float(i)) for i, n in enumerate((0, 1, 2, 6, 30, 301))] + [(9, [2.0] * 5, [0.0] * 5, 3.0)]
    df = spark.createDataFrame(rows, "clip long, samples array<float>, noise array<float>, snr_db double").withColumn("channels", F.lit(2))
    mono = {r.clip: r.samples for r in signal.to_mono(df.where("size(samples) % 2 = 0")).collect()}
    norm = {r.clip: r.samples for r in signal.normalised(df).collect()}
    mixed = {r.clip: r.samples for r in signal.with_noise(df).collect()}
    for clip, x, noise, snr in rows:
        if len(x) % 2 == 0:
            assert np.allclose(mono[clip], signal.mono(np.array(x, np.float32).reshape(-1, 2)), atol=1e-6)
        if x:
            assert np.allclose(norm[clip], signal.z_norm(np.array(x)), atol=1e-5)
            assert np.allclose(mixed[clip], signal.mix_at_snr(np.array(x), np.array(noise), snr), rtol=1e-5, atol=1e-5)
        else:
            assert norm[clip] == mixed[clip] == []


def test_best_identities_of_tiles_are_enough(spark, passages, monkeypatch):
    want = {(r.q, r.vessel): (r.score, r["rank"]) for r in enrol.identify(passages, passages, 3).collect()}
    every = retrieval.identity_scores(retrieval.side(passages), retrieval.side(passages)).collect()
    for q in {r.q for r in every}:
        best = sorted((-r.score, int(r.identity)) for r in every if r.q == q)[:3]
        assert [want[q, v] for _, v in best] == [(-s, i + 1) for i, (s, _) in enumerate(best)]
    monkeypatch.setattr(retrieval, "TILE", 2)
    assert {(r.q, r.vessel): (r.score, r["rank"]) for r in enrol.identify(passages, passages, 3).collect()} == want


def test_augmentation_is_seeded():
    x = tone(50, 5)
    a, b = signal.augment(x, [tone(9, 6)], 3), signal.augment(x, [tone(9, 6)], 3)
    assert len(a) == 3 and all(np.array_equal(p, q) and len(p) == len(x) for p, q in zip(a, b))


def test_encoder_gives_unit_vectors():
    w = encoder.seeded_weights(2, channels=16, widths=(8, 16), kernels=(5, 9, 17, 33))
    x = tone(60, 0.1)
    v = encoder.encode(x, w)
    assert v.shape == (16,) and np.linalg.norm(v) == pytest.approx(1, abs=1e-5)
    assert np.array_equal(v, encoder.encode(x, w))
    names = list(w)
    assert set(encoder.load_weights({f"encoder.{k}": a for k, a in w.items()}, names)) == set(names)
    with pytest.raises(KeyError):
        encoder.load_weights({}, names)


# --- files and streams -------------------------------------------------------------------------------------


def test_wav_round_trip_and_reader(spark, tmp_path):
    x = tone(80, 1, noise=0.0).astype(np.float32)
    raw = writers.wav_bytes(x, 8000)
    h = readers.wav_header(raw)
    assert (h["rate"], h["channels"], h["frames"]) == (8000, 1, 8000)
    back, rate = readers.wav_samples(raw, 100, 50)
    assert rate == 8000 and np.allclose(back[:, 0], x[100:150], atol=1e-4)
    (tmp_path / "a.wav").write_bytes(raw)
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    got = {r.clip: r for r in readers.read_waves(spark, str(tmp_path)).collect()}
    assert len(got["a"].samples) == 8000 and got["a"].error is None and got["bad"].error
    assert {r.path.rsplit("/", 1)[-1]: r.frames for r in readers.probe_waves(spark, str(tmp_path)).collect()} == {"a.wav": 8000, "bad.wav": 0}


def test_npy_npz_csv_and_comments(spark, tmp_path):
    np.save(tmp_path / "t.npy", np.arange(6, dtype=np.float32).reshape(1, 2, 3))
    r = readers.read_arrays(spark, str(tmp_path)).first()
    assert list(r["shape"]) == [1, 2, 3] and list(r["values"]) == [0, 1, 2, 3, 4, 5]
    assert readers.read_arrays(spark, str(tmp_path), header_only=True).first()["dtype"] == "float32"
    np.savez(tmp_path / "g.npz", uids=np.array(["a_p1"]), mmsi=np.array([7]), role=np.array(["gallery"]), cohort=np.array(["core"]), emb=np.ones((1, 4)))
    assert readers.read_gallery(spark, str(tmp_path / "g.npz")).first().vessel == 7
    (tmp_path / "m.csv").write_text("# seed 42\npath,vessel_id\na,1\nb,2\n")
    assert readers.read_csv(spark, str(tmp_path / "m.csv"), comment="#").count() == 2
    assert readers.comment_lines(spark, str(tmp_path / "m.csv")).first()[0] == "seed 42"


def test_archive_digest():
    raw, digest = writers.archive("index.csv", b"path\n", {"a": b"1"})
    assert len(digest) == 64 and raw == writers.archive("index.csv", b"path\n", {"a": b"1"})[0]
    with pytest.raises(ValueError):
        writers.archive("a", b"", {"a": b"1"})


def test_stream_enrols_and_identifies(spark, passages, tmp_path):
    shape = "uid long, vessel long, pid long, vec array<double>"
    passages.where("uid < 6").write.parquet(str(tmp_path / "in"))
    stream = lambda folder: spark.readStream.schema(passages.schema).parquet(str(tmp_path / folder))
    there = lambda: enrol.gallery(spark, str(tmp_path / "gallery"), shape)
    run = lambda folder, check: enrol.enrol(stream(folder), str(tmp_path / "gallery"), str(tmp_path / check)).awaitTermination(120)
    run("in", "check")
    assert sorted(r.uid for r in there().collect()) == [0, 1, 2, 3, 4, 5]
    passages.write.mode("append").parquet(str(tmp_path / "in"))  # late copies and new passages, next batch of the same stream
    run("in", "check")
    passages.where("uid > 3").unionByName(passages.where("uid = 9").withColumn("uid", F.lit(77).cast("long"))).write.parquet(str(tmp_path / "other"))
    run("other", "second")  # another stream on the same gallery
    shutil.rmtree(tmp_path / "check")
    run("in", "check")  # a lost checkpoint: all files again, numbers from 0
    run("in", "check")  # a restart with nothing new
    rows = spark.read.parquet(str(tmp_path / "gallery"))
    assert sorted(r.uid for r in rows.collect()) == [*range(10), 77] == sorted(r.uid for r in there().collect())
    want = {r.uid: list(r.vec) for r in passages.collect()}
    assert all(list(r.vec) == want.get(r.uid, want[9]) for r in there().collect())
    rows.where("uid = 3").drop("run", "batch").write.parquet(str(tmp_path / "gallery" / "run=x" / "batch=0"))  # two streams at a time
    assert there().count() == 11
    best = enrol.identify(passages.where("uid = 6"), there(), 3).orderBy("rank").collect()
    assert [r.vessel for r in best][0] == 4 and len(best) == 3
