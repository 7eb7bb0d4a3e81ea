"""Queries that take whole tables, on fixtures larger than any subset by number."""

import datetime
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import encoder, etl, signal, tonal
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def event_dir(spark, tmp_path_factory):
    """1500 events of 75 clips, so clips beyond 60 and events beyond 200 are there."""
    rng = random.Random(4)
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=i), rng.randrange(75), "view", rng.randrange(400) / 4, '{"k": %d}' % rng.randrange(30)) for i in range(1500)]
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


def share(a, b):
    total = sum(w for _, w in a)
    return sum(w for f, w in a if any(abs(f - g) <= 1.0 for g, _ in b)) / total if total > 0 else 0.0


def test_all_pairs_of_clips_are_scored(spark, event_dir):
    sets = {r.clip: [tuple(x) for x in r.lines] for r in tonal.line_sets(tonal.top_lines(catalog.acoustic.lines(spark, event_dir))).collect()}
    want = {(a, b): 0.5 * (share(sets[a], sets[b]) + share(sets[b], sets[a])) for a, b in itertools.combinations(sorted(sets), 2)}
    assert max(sets) >= 60
    got = {(r.q, r.g): r.score for r in catalog.QUERIES["tonal_scores_all"](spark, event_dir).collect()}
    assert got == pytest.approx(want, abs=1e-7)


def test_scores_of_pairs_do_not_depend_on_blocks(spark):
    sets = [(c, [(float(c % 7), 1.0 + c)] * (c % 3)) for c in range(20)] + [(None, [(1.0, 1.0)])]
    frame = spark.createDataFrame(sets, f"clip long, lines {tonal.LINES}")
    one, many = (sorted(tonal.all_scores(frame, block=n).collect()) for n in (100, 3))
    assert one == many and len(one) == 190


def plain_best(values, patience):
    best, since, out = None, None, []
    for epoch, v in values:
        if best is None or (v is not None and v > best):
            since = epoch
        best = v if best is None else max(best, v) if v is not None else best
        out.append((epoch, best, epoch - since, epoch - since >= patience))
    return out


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_running_best_over_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(etl, "RANGES", ranges)
    rng = random.Random(ranges)
    for empty in (0, 90):
        values = [(e, None if e < empty or rng.random() < 0.1 else float(rng.randrange(e // 20 + 2))) for e in range(1, 300)]
        got = etl.best_so_far(spark.createDataFrame(values, "epoch long, m double"), "m", 10)
        assert sorted((r.epoch, r.best, r.waited, r.stop) for r in got.collect()) == plain_best(values, 10)


def test_history_has_every_epoch(spark, event_dir):
    epochs = sorted(r.epoch for r in catalog.QUERIES["best_so_far_all"](spark, event_dir).collect())
    assert epochs == list(range(1, 1501))
    assert sorted(r.epoch for r in catalog.QUERIES["last_history_all"](spark, event_dir).collect()) == list(range(1491, 1501))


def test_lines_match_the_whole_gallery(spark, event_dir):
    top = [(r.clip, r.freq_hz) for r in tonal.top_lines(catalog.acoustic.lines(spark, event_dir)).collect()]
    near = lambda f, of: any(abs(f - g) <= 1.0 for c, g in top if of(c))
    want = {(c, f) for c, f in top if c % 2 == 1 and near(f, lambda c: c % 2 == 0)}
    assert len(want) > len({(c, f) for c, f in top if c % 2 == 1 and near(f, lambda c: c == 2)})
    assert sorted(map(tuple, catalog.QUERIES["line_match_all"](spark, event_dir).collect())) == sorted(want)


def test_logits_against_every_label(spark, tmp_path):
    rng = random.Random(6)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    rows = [(i, i % 4, unit([rng.gauss(i % 4, 1) for _ in range(64)])) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    heads = {k: unit([sum(x) / len(x) for x in zip(*(v for _, l, v in rows if l == k))]) for k in range(4)}
    want = {(i, k): 30 * math.cos(math.acos(sum(x * y for x, y in zip(v, heads[k]))) + 0.3 * (l == k)) for i, l, v in rows for k in heads}
    got = {(r.q, r["class"]): r.logit for r in catalog.QUERIES["margin_logits_all"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize(("name", "module", "step"), [("segment_embeddings", encoder, "embed"), ("waveform_segments", signal, "segments")])
def test_samples_are_passed_whole(spark, sf_dir, monkeypatch, name, module, step):
    seen, work = [], getattr(module, step)

    def spy(frame, *more):
        seen.append(frame.select(F.size("samples").alias("n")))
        return work(frame, *more)

    monkeypatch.setattr(module, step, spy)
    catalog.QUERIES[name](spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().collect()
    whole = sorted(128 * r["count"] for r in lines)
    assert sorted(r.n for r in seen[0].collect()) == (whole if step == "segments" else sorted(40000 for n in whole for _ in signal.segment_starts(n)))
