import collections
import random

import numpy as np
import pytest

from tests.llm.fixtures import empty, frame
from tidemark.llm import groups


def brute(rows, least):
    """(string, places) of all maximal repeats, by every string of every different text."""
    ids, copies = {}, collections.Counter()
    for d, t in rows:
        b = (t or "").encode()
        copies[b] += 1
        ids[b] = min((x for x in (ids.get(b), d) if x is not None), default=None)
    places = collections.defaultdict(list)
    for b in copies:
        for i in range(len(b)):
            for j in range(i + least, len(b) + 1):
                places[b[i:j]].append((b, i))
    out = set()
    for x, at in places.items():
        if sum(copies[b] for b, _ in at) < 2:
            continue
        left = {b[i - 1 : i] for b, i in at}
        right = {b[i + len(x) : i + len(x) + 1] for b, i in at}
        if (len(left) > 1 or b"" in left) and (len(right) > 1 or b"" in right):
            out.add((len(x), tuple(sorted(((ids[b], copies[b], i) for b, i in at), key=str))))
    return out


def found(df):
    by = collections.defaultdict(list)
    for r in df.collect():
        by[r.group, r.length].append((r.doc_id, r.copies, r.start))
    return {(n, tuple(sorted(v, key=str))) for (_, n), v in by.items()}


@pytest.mark.parametrize("part_bytes", [1 << 21, 300])
def test_groups_match_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(groups, "PART_BYTES", part_bytes)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    long, short = word(500), word(70)
    rows = [(1, word(60) + long + word(30)), (2, long[:330] + word(20)), (3, word(9) + long + "é" + short), (4, short + word(40) + short), (5, short), (6, short), (7, long[100:260])]
    rows += [(8, word(120))] * 2 + [(9, None), (10, ""), (11, word(20)), (None, word(3) + short + "x"), (12, "ab" * 60), (13, "ba" * 50 + "c"), (14, rows[0][1]), (15, long)]
    want = brute(rows, 30)
    assert max(n for n, _ in want) >= 500 and len(want) > 30
    assert found(groups.repeat_groups(frame(spark, rows), length=30)) == want


def test_no_groups(spark):
    assert groups.repeat_groups(empty(spark)).collect() == []
    assert groups.repeat_groups(frame(spark, [(1, "a" * 49), (2, "a" * 49), (3, None)])).collect() == []


def test_suffixes_are_sorted_with_their_common_prefixes():
    rng = random.Random(5)
    for _ in range(100):
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 20))) for _ in range(rng.randrange(1, 8))]
        starts, most = np.array([rng.randrange(1, len(p) - 3) for p in pieces]), rng.randrange(4, 12)
        array = groups.PieceIntervals(pieces, starts, np.full(len(pieces), -1), 4, most)
        cut = [pieces[p][o : o + most] for p, o in zip(array.piece, array.offset)]
        assert cut == sorted(cut) and len(cut) == starts.sum()
        same = lambda x, y: next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert array.common.tolist() == [same(x, y) for x, y in zip(cut, cut[1:])]
