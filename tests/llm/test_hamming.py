import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.fixtures import corpus, empty, frame
from tidemark.llm import hamming


def plain_print(text, size=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, budget=3):
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def result(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_hashes_are_xxh64():
    rng = random.Random(1)
    texts = [rng.randbytes(n) for n in [*range(100), 127, 128, 1000, 4097]]
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    got = hamming.xxh64(data, end - np.array([len(t) for t in texts]), end)
    assert got.tolist() == [xxhash.xxh64_intdigest(t, seed=42) for t in texts]


def test_fingerprints_in_pieces(monkeypatch):
    texts = [t for _, t in corpus()] + ["A\tb\x0bC  d", "ÀB c", "a"]
    want = [plain_print(t) for t in texts]
    assert hamming.fingerprints(pa.array(texts, pa.string())).tolist() == want
    monkeypatch.setattr(hamming, "AT_ONCE", 7)
    assert hamming.fingerprints(pa.array(texts[:40], pa.string())).tolist() == want[:40]


def planted(rng, n):
    """Fingerprints with near ones at every distance from 0 to 6, some clusters dense."""
    out = {rng.getrandbits(64) for _ in range(n)}
    for base in rng.sample(sorted(out), n // 4):
        for differ in range(7):
            x = base
            for b in rng.sample(range(64), differ):
                x ^= 1 << b
            out.add(x)
    ball = rng.getrandbits(64)
    out |= {ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(n)}
    return sorted(out)


@pytest.mark.parametrize(("few", "frontier", "cells"), [(48, 1 << 17, 1 << 20), (1, 40, 60), (4, 500, 10)])
def test_trie_join_meets_exactly_the_near_pairs(monkeypatch, few, frontier, cells):
    monkeypatch.setattr(hamming, "FEW", few)
    monkeypatch.setattr(hamming, "FRONTIER", frontier)
    monkeypatch.setattr(hamming, "CELLS", cells)
    rng = random.Random(few)
    groups = [planted(rng, n) for n in (120, 1, 8)] + [[0, 1, (1 << 64) - 1], [7]]
    prints = np.array([p for g in groups for p in g], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    got = [(int(x), int(y)) for a, b in hamming.TrieJoin(prints, first).pairs() for x, y in zip(a, b, strict=True)]
    want = {(i, j) for s, e in zip(first[:-1], first[1:], strict=True) for i in range(s, e) for j in range(i + 1, e) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3}
    assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == want and len(want) > 500


@pytest.mark.parametrize("most", [None, 12])
def test_components_of_prints_whatever_is_dealt_again(spark, monkeypatch, most):
    monkeypatch.setattr(hamming, "TASK", 100)
    prints = planted(random.Random(9), 100)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print long")
    got = {}
    for r in hamming.connect_prints(frame, most=most).collect():
        got.setdefault(r.label, set()).add(r.node & (1 << 64) - 1)
    group = {p: {p} for p in prints}
    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3 and group[p] is not group[q]:
                both = group[p] | group[q]
                for x in both:
                    group[x] = both
    want = {frozenset(g) for g in group.values() if len(g) > 1}
    assert {frozenset(g) for g in got.values()} == want and len(want) > 10


def test_documents_match_brute_force(spark):
    rng = random.Random(3)
    rows = corpus()
    long = [f"w{rng.randrange(5000)}" for _ in range(900)]
    for i in range(30):  # a chain of near copies
        long[rng.randrange(len(long))] = f"new{i}"
        rows.append((3000 - i, " ".join(long)))
    assert result(hamming.link_fingerprints(frame(spark, rows))) == plain_components(rows)
    assert len({r[2] for r in plain_components(rows[-30:])}) < 20


def test_empty_table(spark):
    assert hamming.link_fingerprints(empty(spark)).collect() == []
