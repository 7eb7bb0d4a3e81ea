import hashlib
import random

import numpy as np

from tests.llm.fixtures import corpus, empty, frame
from tidemark.llm import repeats


def brute(rows, length=50):
    least = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - length + 1):
            x, key = b[i : i + length], d if d is not None else repeats._LAST
            if key < least.get(x, key + 1):
                least[x] = key
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < (d if d is not None else repeats._LAST):
                gone[i : i + length] = True
        starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), starts, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_removed_bytes_match_brute_force_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 6000)
    monkeypatch.setattr(repeats, "PART_BYTES", 9000)
    rng = random.Random(2)
    rows = corpus()
    passage = " ".join(f"shared{rng.randrange(50)}" for _ in range(30))
    rows += [(2000 + i, f"{rng.random()} {passage} {rng.random()} é{i} {passage[: 40 + i]}") for i in range(40)]
    want = brute(rows)
    detail = repeats.remove_repeats(frame(spark, rows), detail=True).collect()
    for r in detail:
        spans = [tuple(map(int, x.split(":"))) for x in r.spans.split(",") if x]
        assert (len(spans), sum(e - s for s, e in spans)) == (r.n_spans, r.n_removed)
        assert len(r.kept) == r.n_bytes - r.n_removed and hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert result(repeats.remove_repeats(frame(spark, rows))) == want
    monkeypatch.setattr(repeats, "HOT", 2)  # minimisers of two buckets are dealt out by string
    assert result(repeats.remove_repeats(frame(spark, rows))) == want


def test_empty_table(spark):
    assert repeats.remove_repeats(empty(spark)).collect() == []


def test_intervals_are_the_maximal_repeats():
    rng = random.Random(3)
    for _ in range(200):
        least = rng.choice([3, 4, 6])
        pieces = list({bytes(rng.choice(b"ab") if rng.random() < 0.9 else 99 for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 9))})
        times = np.array([rng.randrange(1, 3) for _ in pieces])
        array = repeats.SuffixIntervals(pieces, least)
        assert [pieces[p][o:] for p, o in zip(array.piece, array.offset)] == sorted(p[o:] for p in pieces for o in range(len(p) - least + 1))
        got = {(n, tuple(sorted(zip(array.piece[a:b].tolist(), array.offset[a:b].tolist())))) for a, b, n in array.maximal_repeats(times > 1)}
        places = {}
        for p, t in enumerate(pieces):
            for i in range(len(t)):
                for j in range(i + least, len(t) + 1):
                    places.setdefault(t[i:j], []).append((p, i))
        want = set()
        for x, at in places.items():
            right = {pieces[p][i + len(x) : i + len(x) + 1] or (p, i) for p, i in at}
            left = {pieces[p][i - 1 : i] if i else p for p, i in at}
            diverse = lambda s: len(s) > 1 or not isinstance(next(iter(s)), bytes)
            if sum(times[p] for p, _ in at) > 1 and diverse(left) and diverse(right):
                want.add((len(x), tuple(sorted(at))))
        assert got == want
