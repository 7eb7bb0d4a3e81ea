"""Files read by ranges give what a reading in one piece gives."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import signal
from tidemark.sources import readers, shared, sliced, writers


def wave(seconds, rate, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * rate)) / rate
    return (0.2 * np.sin(2 * np.pi * (90 + 20 * seed) * t) + 0.1 * rng.standard_normal(len(t))).astype(np.float32)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("waves")
    (path / "a.wav").write_bytes(writers.wav_bytes(wave(47, 8000, 1), 8000))
    (path / "b.wav").write_bytes(writers.wav_bytes(wave(31.3, 16000, 2), 16000))
    raw = writers.wav_bytes(wave(23.7, 44100, 3), 44100)
    (path / "c.wav").write_bytes(raw[:12] + b"LIST" + (6000).to_bytes(4, "little") + bytes(6000) + raw[12:])  # samples begin beyond any first page
    (path / "short.wav").write_bytes(writers.wav_bytes(wave(0.5, 8000, 4), 8000))
    (path / "none.wav").write_bytes(writers.wav_bytes(np.zeros(0), 8000))
    (path / "bad.wav").write_bytes(b"nothing")
    return str(path)


def whole(folder, clip):
    x, rate = readers.wav_samples(open(f"{folder}/{clip}.wav", "rb").read())
    return signal.resample(signal.mono(x), rate)


def test_headers_without_contents(spark, folder):
    got = {r.clip: (r.rate, r.frames, r.error) for r in sliced.wave_headers(spark, folder).collect()}
    assert got["c"][:2] == (44100, int(23.7 * 44100)) and got["none"] == (8000, 0, None) and got["bad"][1] == 0 and got["bad"][2]


@pytest.mark.parametrize(("rate", "target"), [(8000, 8000), (16000, 8000), (44100, 8000), (8000, 22050)])
def test_any_range_equals_the_whole(tmp_path, rate, target):
    (tmp_path / "x.wav").write_bytes(writers.wav_bytes(wave(2, rate, 5), rate))
    raw = (tmp_path / "x.wav").read_bytes()
    h = readers.wav_header(raw)
    want = signal.resample(signal.mono(readers.wav_samples(raw)[0]), rate, target)
    rng = np.random.default_rng(1)
    for a, b in [(0, len(want)), (0, 1), (len(want) - 1, len(want)), *(sorted(rng.integers(0, len(want) + 1, 2)) for _ in range(20))]:
        assert np.allclose(sliced.read_range(f"file:{tmp_path}/x.wav", h, int(a), int(b), target), want[a:b], atol=1e-6)


def test_segments_equal_those_of_one_piece(spark, folder):
    got = {(r.clip, r.seg_idx): r for r in sliced.read_segments(spark, folder).collect()}
    want = {(c, i): (s, signal.z_norm(x[s : s + signal.SEGMENT])) for c in "abc" for x in [whole(folder, c)] for i, s in enumerate(signal.segment_starts(len(x)))}
    assert set(got) == set(want) and len(want) > 15
    for k, (s, x) in want.items():
        assert got[k]["first"] == s and np.allclose(got[k].samples, x, atol=1e-4)


def test_windows_of_a_manifest(spark, folder):
    rows = [("a", "early", -5.0, 11.26), ("a", "late", 30.00006, 99.0), ("b", "mid", 7.77, 20.0), ("b", "gone", 50.0, 60.0), ("b", "turned", 9.0, 3.0), ("nowhere", "x", 0.0, 9.0)]
    windows = spark.createDataFrame(rows, "clip string, part string, start_s double, end_s double")
    got = {(r.clip, r.part, r.seg_idx): r for r in sliced.read_segments(spark, folder, windows).collect()}
    want = {}
    for clip, part, s, e in rows[:5]:
        x = whole(folder, clip)
        a, b = (min(max(round(v * 8000), 0), len(x)) for v in (s, e))
        want |= {(clip, part, i): (a + k, signal.z_norm(x[a:b][k : k + signal.SEGMENT])) for i, k in enumerate(signal.segment_starts(max(0, b - a)))}
    assert set(got) == set(want) and {k[1] for k in want} == {"early", "late", "mid"}
    for k, (first, x) in want.items():
        assert got[k]["first"] == first and np.allclose(got[k].samples, x, atol=1e-4)


@pytest.mark.parametrize("frames", [256, 7])
def test_lines_equal_those_of_one_piece(spark, folder, frames):
    got = {r.clip: r for r in sliced.read_lines(spark, folder, frames=frames).collect()}
    assert set(got) == {"a", "b", "c", "short", "none", "bad"} and got["bad"].error and got["short"].lines == []
    for c in "abc":
        assert np.allclose([tuple(x) for x in got[c].lines], signal.tonal_lines(whole(folder, c)), atol=1e-3)
    assert got["a"].lines and abs(got["a"].lines[0].freq_hz - 110) < 0.2


def test_an_hour_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "hour.wav").write_bytes(writers.wav_bytes(np.tile(wave(36, 1000, 6), 100), 1000))
    made = sliced.read_segments(spark, str(tmp_path), target=1000).withColumn("task", F.spark_partition_id())
    parts = made.groupBy("task").count().collect()
    assert sum(r["count"] for r in parts) == 90 and len(parts) > 8 and max(r["count"] for r in parts) < 30


def test_drawn_noise_is_read_from_its_place(spark, folder):
    keys = spark.createDataFrame([(i,) for i in range(40)], "id long")
    got = {r.id: r for r in sliced.read_noise(spark, keys, "id", folder, 6000, 3).collect()}
    assert len(got) == 40 and len({(r.clip, r["first"]) for r in got.values()}) > 20
    names = ["a", "b", "c", "short"]
    draw = lambda s, i: int(hashlib.md5(f"{s}|{i}".encode()).hexdigest()[:12], 16)
    for i, r in got.items():
        x = whole(folder, names[draw(3, i) % 4])
        at = draw(4, i) % max(1, len(x) - 6000 + 1)
        want = [x[(at + k) % len(x)] for k in range(6000)]
        assert (r.clip, r["first"]) == (names[draw(3, i) % 4], at) and np.allclose(r.noise, want, atol=1e-6)
    again = {r.id: r["first"] for r in sliced.read_noise(spark, keys.where("id < 5"), "id", folder, 6000, 3).collect()}
    assert again == {i: got[i]["first"] for i in range(5)}


def test_an_empty_pool_is_silent(spark, tmp_path):
    (tmp_path / "none.wav").write_bytes(writers.wav_bytes(np.zeros(0), 8000))
    got = sliced.read_noise(spark, spark.range(2), "id", str(tmp_path), 5, 1).collect()
    assert [list(r.noise) for r in got] == [[0.0] * 5] * 2 and got[0].clip is None


def test_augmentations_with_fixed_draws():
    x = wave(1, 8000, 7)
    late = [(3, 0.5), (40, -0.3), (9000, 0.7)]
    plain = np.array([x[i] + sum(a * x[i - d] for d, a in late if i >= d) for i in range(len(x))])
    plain *= np.sqrt((x.astype(float) ** 2).sum() / (plain**2).sum())
    assert np.allclose(signal.echoed(x, late), plain, atol=1e-6)
    t = np.arange(8000) / 8000
    for hz, db in ((0, 3.0), (75, 2.0), (150, 1.0), (1075, 0.0), (2000, -1.0), (3000, 1.5), (4000, 4.0)):
        tone = np.cos(2 * np.pi * hz * t)
        assert np.allclose(signal.equalised(tone, [3, 1, -1, 4]), tone * 10 ** (db / 20), atol=1e-4)
    noise = wave(0.1, 8000, 8)
    y = signal.filled(x, noise, 200)
    assert np.array_equal(y[:200], x[:200]) and np.array_equal(y[1000:], x[1000:]) and np.allclose(y[200:1000], noise * x.std() / noise.std(), atol=1e-5)


def test_shift_goes_round(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], k) for k in (0, 1, 3, 4, 9, -1)] + [([], 2)], "x array<double>, k long")
    got = [list(r.y) for r in df.select(signal.shifted(F.col("x"), F.col("k")).alias("y")).collect()]
    assert got == [list(np.roll([1.0, 2.0, 3.0, 4.0], k)) for k in (0, 1, 3, 4, 9, -1)] + [[]]


def test_pieces_are_joined_by_name(spark):
    rows = [("p", "s10", [3.0]), ("p", "s02", [1.0, 2.0]), ("q", "x", []), ("p", "s99", [4.0])]
    got = {r.k: list(r.samples) for r in sliced.concatenated(spark.createDataFrame(rows, "k string, name string, samples array<double>"), "k").collect()}
    assert got == {"p": [1.0, 2.0, 3.0, 4.0], "q": []}


def test_written_files_are_read_back(spark, tmp_path):
    waves = spark.createDataFrame([(f"c{i}", [float(v) for v in wave(6, 8000, i)]) for i in range(3)], "clip string, samples array<double>")
    sliced.write_waves(waves, f"file:{tmp_path}/out")
    sliced.write_waves(waves, f"file:{tmp_path}/out")  # a second run replaces
    got = {r.clip: r for r in sliced.read_segments(spark, f"{tmp_path}/out").collect()}
    assert len(got) == 3 and all(np.allclose(got[f"c{i}"].samples, signal.z_norm(wave(6, 8000, i)[-40000:] if got[f"c{i}"]["first"] else wave(6, 8000, i)[:40000]), atol=1e-3) for i in range(3))


def test_no_shared_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="share"):
        shared.shared_folder(Session())
