import hashlib
import random
import zlib

import pytest

from tests.llm.fixtures import words
from tidemark.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, n long"


def conversations(seed=2, n=70):
    rng = random.Random(seed)
    rows, starts = [], [["hi"], ["hi", "there é"], ["other", None, "x"]]
    for c in range(n):
        told = list(rng.choice(starts)) + words(rng, rng.randrange(0, 4), 3)
        rows += [(c if c % 13 else -c, t, ["user", "assistant", None][t % 3], x) for t, x in enumerate(told)]
    rows += [(500, None, "system", "first"), (500, 3, "user", None), (501, None, "system", "first"), (501, 3, "user", ""), (502, None, None, None)]
    rows += [(505, t, "user", f"turn {t}") for t in range(60)] + [(510, t, "user", f"turn {t}") for t in range(61)]
    rows += [(600, 1, "user", "tie"), (600, 1, "user", "tie"), (600, 1, "assistant", "tie"), (None, 1, "user", "lost"), (1 << 40, 0, "user", "hi"), (610, 0, "u", "long " * 40000)]
    return rows


def plain(rows, splice=True):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", turns_token(r, x), (r or "", x or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    base = lambda c: c - (c % 5 if c >= 0 else -(-c % 5))
    seqs = {c: tuple(own.get(base(c), [])[: h(c)] + v[h(c) :]) if splice else tuple(v) for c, v in own.items()}
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest([c for c in m if len(seqs[c]) == len(p)])) for p, m in nodes.items())


def turns_token(role, text):
    r, t = role or "", text or ""
    return hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16] + len(t.encode()).to_bytes(4, "big")






@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in conversations()], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize(("range_bytes", "batch"), [(turns.RANGE_BYTES, 10000), (900, 3), (100, 1)])
def test_nodes_match_brute_force_over_any_ranges_and_runs(spark, frame, monkeypatch, range_bytes, batch):
    monkeypatch.setattr(turns, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(turns, "BLOCK_BITS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in turns.trie_nodes(frame).collect()]
        own = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in turns.conversation_trie(frame).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sort = lambda rows: sorted(rows, key=str)
    assert sort(got) == sort(plain(conversations()))
    assert sort(own) == sort(plain(conversations(), splice=False))


def test_keys_and_turns_of_nodes(spark, frame):
    nodes = {bytes(r.key): r for r in turns.with_turns(turns.conversation_trie(frame), frame).collect()}
    assert len(nodes) == len(plain(conversations(), splice=False))
    path = lambda r: [] if r.parent is None else [*path(nodes[bytes(r.parent)]), (r.role, r.text)]
    assert [("user", f"turn {t}") for t in range(61)] in [path(r) for r in nodes.values()]
    assert all(len(path(r)) == r.depth for r in nodes.values())


def test_empty_table(spark):
    assert turns.trie_nodes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_loser_tree_merges_without_comparing_shared_turns():
    rng = random.Random(5)
    for _ in range(60):
        told = list({b"".join(rng.choice([b"a" * 20, b"b" * 20]) for _ in range(rng.randrange(0, 9))) for _ in range(40)})
        k = rng.randrange(1, 9)
        tree = turns.LoserTree([turns.Run([(s, 1) for s in told[i::k]]) for i in range(k)])
        got = list(tree)
        assert [row[0] for _, row in got] == sorted(told)
        assert [lcp for lcp, _ in got][1:] == [turns.shared(a, b) for a, b in zip(sorted(told)[:-1], sorted(told)[1:])]
    path = [bytes([1]) * 20 * 400 + bytes([i]) * 20 for i in range(64)]
    tree = turns.LoserTree([turns.Run([(s, 1) for s in path[i::8]]) for i in range(8)])
    assert len(list(tree)) == 64 and tree.compared < 7 * 401 + 64 * 3 * 2  # the shared turns once a run, not once a match
