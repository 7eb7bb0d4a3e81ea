import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import corpus, empty, frame
from tidemark.llm import filters, graph, nearjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text, size=3):
    w = WORD.findall((text or "").translate(LOW))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def linked_rows(rows, size=3, least=90):
    """(size, number of the component) of each row, rows as nodes."""
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def brute(rows, size=3, least=90):
    """(id, size, component) of each row."""
    roots, smallest = linked_rows(rows, size, least), {}
    for (doc, _), (_, root) in zip(rows, roots):
        if doc is not None:
            smallest[root] = min(doc, smallest.get(root, doc))
    return sorted(((d, n, smallest.get(root)) for (d, _), (n, root) in zip(rows, roots)), key=str)


def near_copies(rng, n, length):
    base = [f"w{rng.randrange(3000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, max(2, length // 40))):
            w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
        if rng.random() < 0.3:
            w += ["end"]
        out.append(" ".join(w))
    return out


def test_components_match_brute_force(spark):
    rows = corpus()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nearjoin.link_documents(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize(("seed", "size", "least"), [(1, 3, 90), (2, 5, 80)])
def test_groups_of_near_copies_match_brute_force(spark, seed, size, least):
    rng = random.Random(seed)
    texts = []
    for length in (5, 6, 8, 9, 11, 12, 14, 20, 21, 22, 25, 31, 60, 130, 400):
        texts += near_copies(rng, 14, length)
    texts += near_copies(rng, 150, 200)  # longer than the lists that are searched together
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nearjoin.link_documents(frame(spark, rows), size=size, least=least).collect()), key=str)
    want = brute(rows, size, least)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 100


def test_empty_table(spark):
    assert nearjoin.link_documents(empty(spark)).collect() == []


def test_linked_sets_share_a_token():
    rng = random.Random(3)
    none = nearjoin.SortedHashes(np.zeros(0, np.uint64))
    for _ in range(300):
        n = rng.randrange(1, 60)
        a = np.array(sorted(rng.sample(range(1, 10**6), n)), dtype=np.uint64)
        b = np.array(sorted(set(rng.sample(a.tolist(), n - rng.randrange(0, min(3, n)))) | set(rng.sample(range(10**6, 10**7), rng.randrange(0, 3)))), dtype=np.uint64)
        if len(b) and nearjoin.links(a, b):
            assert np.intersect1d(nearjoin.set_tokens(a, none, 25), nearjoin.set_tokens(b, none, 25)).size


def test_boundary_follows_cost():
    few = {n: 100 for n in range(3, 60)}
    short, long = {n: 0.01 for n in few}, {n: 400.0 for n in few}
    assert nearjoin.choose_boundary({}, {}) == 1
    assert nearjoin.choose_boundary(few, short) < nearjoin.choose_boundary(few, long)
    assert nearjoin.choose_boundary({n: 100 for n in range(200, 400)}, long) == 1
    assert nearjoin.choose_boundary(few, {n: 1e6 for n in few}) > 25
    assert nearjoin.choose_boundary(few, long, 80) < nearjoin.choose_boundary(few, long, 90)


@pytest.mark.parametrize(("boundary", "size", "least"), [(1, 3, 90), (10, 3, 90), (20, 3, 90), (40, 3, 90), (1, 5, 80), (12, 5, 80), (22, 5, 80)])
def test_result_does_not_depend_on_the_boundary(spark, boundary, size, least):
    rng = random.Random(11)
    texts = [t for length in (3, 4, 7, 9, 12, 13, 16, 21, 24, 31, 33, 38, 45) for t in near_copies(rng, 9, length)]
    rows = list(enumerate(texts))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nearjoin.link_documents(frame(spark, rows), size=size, least=least, boundary=boundary).collect()), key=str)
    assert got == brute(rows, size, least)


def test_subsets_leave_out_one_and_more():
    a = np.arange(1, 21, dtype=np.uint64)
    assert len(nearjoin._subset_hashes(a, 90)) == nearjoin.subsets(20) == 1 + 20 + 190
    b = np.concatenate([a[:18], np.array([90], np.uint64)])
    assert np.intersect1d(nearjoin._subset_hashes(a, 90), nearjoin._subset_hashes(b, 90)).size


@pytest.mark.parametrize("tile", [4096, 40])
def test_groups_and_lists_above_a_tile(spark, monkeypatch, tile):
    monkeypatch.setattr(nearjoin, "TILE", tile)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(192)]
    texts = [" ".join(f"w{j}" for j in range(i * 10, i * 10 + 192)) for i in range(150)]  # a chain: 180 of 200 shingles
    for _ in range(150):  # copies of one text, most of them linked, some near the threshold only
        w = list(base)
        for j in rng.sample(range(192), rng.choice([1, 2, 3, 5])):
            w[j] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    got = nearjoin.link_documents(frame(spark, rows), count_links=True).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    sets = [shingle_set(t) for t in texts]
    near = lambda a, b: 100 * len(a & b) >= 90 * len(a | b)
    count = {s: sum(near(s, t) for t in set(sets)) - 1 for s in set(sets)}
    assert {r.doc_id: r.n_links for r in got} == {i: count[s] for i, s in enumerate(sets)}
    assert len({r.class_id for r in got}) == len(set(sets)) and len({c for _, _, c in want}) > 3
    plain = nearjoin.link_documents(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in plain), key=str) == want


def test_chain_of_3000_near_copies_at_exactly_the_threshold(spark):
    texts = [" ".join(f"w{j}" for j in range(i, i + 21)) for i in range(3000)]  # 19 shingles, 18 of 20 in common with the next one
    out = nearjoin.link_documents(frame(spark, list(enumerate(texts)))).collect()
    assert {r.component_id for r in out} == {0} and len(out) == 3000


def test_common_counts_match_plain_intersections():
    rng = random.Random(2)
    for m in (1, 2, 3, 30):
        base = rng.sample(range(500), 60)
        sets = [np.unique(np.array(rng.sample(base, rng.randrange(30, 60)) + rng.sample(range(500), 9), dtype=np.uint64)) for _ in range(m)]
        for i, row in enumerate(nearjoin.count_common(sets)):
            assert all(row[j] == len(np.intersect1d(sets[i], b)) for j, b in enumerate(sets) if j != i)


def test_forest_keeps_what_edges_connect():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
        x, y = graph.forest(a, b)
        root = {v: v for v in [*a, *b]}
        for _ in range(60):
            for p, q in zip(a.tolist(), b.tolist()):
                root[p] = root[q] = min(root[p], root[q])
        assert dict(zip(x.tolist(), y.tolist())) == root


def test_packed_sets_round_trip():
    sets = nearjoin.doc_sets(pa.array(["a b c d e", "", None, "q"]))
    assert [len(s) for s in sets] == [3, 0, 0, 1]


def test_sketches_never_part_linked_sets():
    rng = random.Random(4)
    told_apart = 0
    for _ in range(40):
        n = rng.randrange(1400, 9000)
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64))
        keep = rng.sample(a.tolist(), int(len(a) * rng.uniform(0.9, 1)))
        b = np.unique(np.array(keep + [rng.getrandbits(64) for _ in range(rng.randrange(0, n // 10))], dtype=np.uint64))
        c = np.unique(np.array([rng.getrandbits(64) for _ in range(len(a))], dtype=np.uint64))
        if nearjoin.links(a, b):
            assert nearjoin.sketches_pass(nearjoin.sketch(a), nearjoin.sketch(b), len(a) + len(b))
        told_apart += not nearjoin.sketches_pass(nearjoin.sketch(a), nearjoin.sketch(c), len(a) + len(c))
        assert not nearjoin.sketches_pass(nearjoin.sketch(a, 80), nearjoin.sketch(c, 80), len(a) + len(c), 80)
    assert told_apart == 40


@pytest.mark.parametrize("small", [1 << 20, 5])
def test_components_of_chains_stars_and_loops(spark, small):
    rng = random.Random(4)
    ids = rng.sample(range(-(10**9), 10**9), 400)
    edges = list(zip(ids[:150], ids[1:150])) + [(ids[150], x) for x in ids[151:250]] + [(rng.choice(ids[250:]), rng.choice(ids[250:])) for _ in range(120)] + [(7, 7)]
    out = graph.components(spark.createDataFrame(edges, "a long, b long"), small).collect()
    node, label = graph.forest(*np.array([e for e in edges if e[0] != e[1]]).T)
    want = dict(zip(node.tolist(), label.tolist()))
    got = {r.node: r.label for r in out}
    assert len(out) == len(got) and got.keys() == want.keys()
    assert len({(got[v], want[v]) for v in got}) == len(set(got.values())) == len(set(want.values()))
    assert all(want[got[v]] == want[v] for v in got)


def test_without_drops_the_named_rows_only(spark):
    rows = [(i, str(i)) for i in range(300)] + [(None, "x"), (7, "again"), (-5, "y"), (8, "8")]
    df, key = frame(spark, rows), filters.row_key("doc_id", "text")
    named = spark.createDataFrame([(7, "7"), (-5, "y"), (100, "100"), (None, "x"), (12, "none")], "doc_id long, text string").select(key.alias("k"))
    got = sorted(((r.doc_id, r.text) for r in filters.without(df, key, named).collect()), key=str)
    assert got == sorted([r for r in rows if r not in [(7, "7"), (100, "100"), (None, "x"), (-5, "y")]], key=str)
    twice = spark.createDataFrame([(8, "8"), (9, "9")], "doc_id long, text string").select(key.alias("k"))
    assert sorted((r.doc_id, r.text) for r in filters.only(df, key, twice).collect()) == [(8, "8"), (9, "9")]
