"""Toxicity and quality: held-out accuracy, gradients, awkward rows; mixing and decontamination against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import corpus, empty, frame
from tidemark.llm import blocks, decontamination, mixing, quality, toxicity


def labelled(seed=1, n=500):
    """Documents with a few bad words, and documents with shouted lines."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 120))]
        toxic, bad = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), rng.choice(["scum", "idiot", "trash"]))
        lines = [" ".join(w[k : k + 12]) for k in range(0, len(w), 12)]
        if bad:
            lines = [x.upper() + "!!" for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


ODD = [(9000, None), (9001, ""), (9002, "\n\n"), (9003, "word"), (9004, "y " * 20000), (9005, "é" * 5000), (None, "scum scum")]


def auc(score, truth):
    good, rest = score[truth == 1], score[truth == 0]
    return float(((good[:, None] > rest).mean() + 0.5 * (good[:, None] == rest).mean()))


@pytest.mark.parametrize("what", ["quality", "toxic"])
def test_held_out_documents(spark, what):
    rows, labels = labelled()
    docs = frame(spark, rows + ODD)
    marks = spark.createDataFrame(labels + [(9001, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    if what == "quality":
        scored = quality.score_quality(docs, quality.fit_quality(docs, marks))
    else:
        scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, marks))
    import zlib

    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    modulus, held = (5, 0) if what == "quality" else (4, 2)
    out = [(got[i].score, q if what == "quality" else t) for i, q, t in labels if zlib.crc32(str(i).encode()) % modulus == held]
    score, truth = np.array([s for s, _ in out]), np.array([t for _, t in out])
    assert auc(score, truth) > 0.95


def test_classifiers_without_labels(spark):
    docs = frame(spark, corpus(n=10))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect()} == {0.5}
    assert quality.score_quality(empty(spark), quality.fit_quality(docs, none)).collect() == []


def test_gradient_of_the_network():
    net = toxicity.GatedNetwork(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vocabulary = toxicity.Vocabulary(*blocks.text_buffer(pa.array(["ab cd ef ab x", "hello world " * 12, ""])))
    place, _, begin = toxicity.windows(vocabulary.first, vocabulary.counts)
    assert begin.tolist() == [0, 1, 3, 4] and place[-1].max() == -1
    at = np.where(place >= 0, vocabulary.at[np.maximum(place, 0)], -1)
    y = np.array([1.0, 0, 1, 0])

    def loss():
        logit, _ = net.forward(net.inputs(vocabulary).astype(np.float64), at)
        return (np.logaddexp(0, logit) - y * logit).sum()

    table = net.inputs(vocabulary)
    logit, tape = net.forward(table, at, True)
    grads = net.backward(vocabulary, table, at, tape, 1 / (1 + np.exp(-logit)) - y)
    rng = np.random.default_rng(0)
    for name in net.p:
        i = (int(vocabulary.row[0]), 1) if name == "word" else (int(vocabulary.pair[0]), 1) if name == "pair" else (ord("l"), 1) if name == "byte" else tuple(int(rng.integers(0, s)) for s in net.p[name].shape)
        old = net.p[name][i]
        net.p[name][i] = old + 1e-3
        up = loss()
        net.p[name][i] = old - 1e-3
        down = loss()
        net.p[name][i] = old
        assert (up - down) / 2e-3 == pytest.approx(float(grads[name][i]), rel=2e-2, abs=2e-4)


def test_windows_and_forward_pass_match_a_plain_form():
    net = toxicity.GatedNetwork(5)
    W, stride, S = toxicity.WINDOW, toxicity.STRIDE, toxicity.STATE
    texts = ["", "ab", " ".join(f"v{i}" for i in range(16)), " ".join(f"v{i % 9}" for i in range(17)), " ".join(f"v{i % 7}x" for i in range(61))]
    vocabulary = toxicity.Vocabulary(*blocks.text_buffer(pa.array(texts)))
    place, doc, begin = toxicity.windows(vocabulary.first, vocabulary.counts)
    want = []
    for i, t in enumerate(texts):
        n, base = len(t.split()), sum(len(x.split()) for x in texts[:i])
        starts = [0]
        while starts[-1] + W < n:
            starts.append(min(starts[-1] + stride, n - W))
        want += [(i, [base + s + k if s + k < n else -1 for k in range(W)]) for s in starts]
    assert [(int(d), p.tolist()) for d, p in zip(doc, place)] == want and begin[-1] == len(want)
    at = np.where(place >= 0, vocabulary.at[np.maximum(place, 0)], -1)
    table = net.inputs(vocabulary)
    got, _ = net.forward(table, at)
    sig = lambda v: 1 / (1 + np.exp(-v))
    for row, logit in zip(at.tolist(), got.tolist()):
        states = np.zeros((W, 2 * S))
        for d, order, off in (("f", range(W), 0), ("b", range(W - 1, -1, -1), S)):
            h, (w, u, b) = np.zeros(S), (net.p[k + d] for k in "wub")
            for k in order:
                if row[k] >= 0:
                    x = table[row[k]] @ w + b
                    z, r = sig(x[:S] + h @ u[:, :S]), sig(x[S : 2 * S] + h @ u[:, S : 2 * S])
                    h = z * h + (1 - z) * np.tanh(x[2 * S :] + (r * h) @ u[:, 2 * S :])
                states[k, off : off + S] = h
        real = [k for k in range(W) if row[k] >= 0] or list(range(W))
        weight = np.exp([float((np.tanh(states[k] @ net.p["a"]) @ net.p["v"])[0]) for k in real])
        pooled = (weight / weight.sum()) @ states[real]
        assert logit == pytest.approx(float((pooled @ net.p["o"])[0] + net.p["c"][0]), abs=1e-4)


def test_line_marginals_match_all_labellings():
    rng = np.random.default_rng(2)
    x, first, _ = quality.line_features(*blocks.text_buffer(pa.array(["a b\nC!!\nd", "x", "", "q\n\nq"])))
    assert np.diff(first).tolist() == [3, 1, 1, 3]
    field = quality.LineField(rng.standard_normal(x.shape[1]), rng.standard_normal((2, 2)))
    p, joint = field.marginals(x, first)
    for a, b in zip(first[:-1], first[1:]):
        n, total, one = b - a, 0.0, np.zeros(b - a)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = math.exp(sum(v * float(x[a + i] @ field.weights) for i, v in enumerate(y)) + sum(field.pairs[u, v] for u, v in zip(y, y[1:])))
            total += w
            one += w * np.array(y)
        assert np.allclose(p[a:b], one / total)
    assert np.allclose(joint[1:3].sum(axis=(1, 2)), 1) and np.allclose(joint[first[:-1]], 0)


# --- mixing ------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Water filling, source by source, until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    left, out, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            break
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            full.add(s)
    return out


@pytest.mark.parametrize("bucket_rows", [200_000, 7])
def test_mixture_comes_near_its_targets(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(5)
    rows = corpus() + [(5000 + i, " ".join("w" for _ in range(rng.choice([1, 3, 3, 3, 10, 40])))) for i in range(200)]
    df = frame(spark, rows)
    source = {}
    sizes = Counter()
    for r in df.select("doc_id", "text", "source").collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = targets(dict(sizes))
    got = mixing.mix_documents(df, carry=("source",)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken % max(r["size"], 1) == 0 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        source[r.source] = max(source.get(r.source, 0), r["size"])
    # a document that is most of its source bounds how near its target the source can come
    assert all(abs(taken[s] - want[s]) <= (source[s] / 2 if source[s] > want[s] / 4 else max(2, 0.01 * want[s])) for s in want)
    again = mixing.mix_documents(df, carry=("source",)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixture_of_nothing(spark):
    assert mixing.mix_documents(empty(spark)).collect() == []
    r = mixing.mix_documents(frame(spark, [(1, None), (2, "")])).collect()
    assert {x.taken for x in r} == {0}


# --- decontamination ---------------------------------------------------------------------------------------

ALNUM = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def grams(words, n=5):
    return Counter([tuple(words)] if 0 < len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def brute_hits(docs, items):
    words = lambda t: ALNUM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for d, t in docs:
        w = words(t)
        for i, text in items:
            v = words(text)
            if not v or not w:
                continue
            size = min(5, len(v))
            want = grams(v, size)
            for s in range(max(1, len(w) - len(v) + 1)):
                own = grams(w[s : s + len(v)], size)
                both = sum((own & want).values())
                like = both / (sum(own.values()) + sum(want.values()) - both)
                if like >= 0.8 and like > out.get((d, i), (0, 0))[0]:
                    out[(d, i)] = (like, s)
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 50)))) for i in range(30)] + [(90, None), (91, ""), (92, "same " * 12)]
    docs = []
    for i in range(60):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 80))]
        if i % 2:
            v = (rng.choice(items[:30])[1]).split()
            if rng.random() < 0.5 and len(v) > 3:
                v[rng.choice([0, len(v) - 1, len(v) // 2])] = "changed"
            k = rng.randrange(len(w) + 1)
            w[k:k] = [x.upper() + rng.choice(["", ",", "."]) for x in v]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, items[3][1]), (103, "same " * 40), (104, "x" * 50000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontamination.find_contamination(frame(spark, docs), bench).collect()}
    want = brute_hits(docs, items)
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in want)
    more = [(None, "free row"), (None, items[1][1]), (3, "free row with a used id")]
    kept = sorted(((r.doc_id, r.text) for r in decontamination.drop_contaminated(frame(spark, docs + more), bench).collect()), key=str)
    assert kept == sorted([(d, t) for d, t in docs if d not in {d for d, _ in want}] + [more[0], more[2]], key=str)
    assert decontamination.find_contamination(empty(spark), bench).collect() == []
    assert decontamination.find_contamination(frame(spark, docs), bench.limit(0)).collect() == []


def test_short_items_are_found_inside_long_texts(spark):
    rng = random.Random(12)
    text = lambda n, of=9: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    items = [(i, text(1 + i % 4)) for i in range(20)] + [(50, text(20, 60)), (51, None), (52, "W1"), (53, "w1")]
    docs = [(i, text(rng.randrange(0, 40))) for i in range(40)] + [(90, items[20][1] + " end"), (91, None), (92, "w1"), (93, "x w1, w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in docs:
        w = (t or "").split()
        for i, v in ((i, (v or "").lower().split()) for i, v in items[:20] + items[21:]):
            for k in range(len(w) - len(v) + 1):
                if v and [x.strip(",") for x in w[k : k + len(v)]] == v:
                    want.setdefault((d, i), (1.0, k, len(v)))
    want[90, 50] = (1.0, 0, 20)
    rows = decontamination.find_contamination(frame(spark, docs), bench).collect()
    assert len(rows) == len(want)
    assert {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in rows} == want


def test_blocks_find_every_fingerprint_within_the_radius(monkeypatch):
    rng = np.random.default_rng(2)
    entries = rng.integers(0, 1 << 64, (300, 2), dtype=np.uint64)
    flips = np.zeros((600, 128), dtype=np.uint8)
    for i, row in enumerate(flips):
        row[rng.permutation(128)[: i % 45]] = 1
    prints = entries[np.arange(600) % 300] ^ np.packbits(flips, axis=1).view(np.uint64)
    apart = np.bitwise_count(prints[:, None, :] ^ entries[None, :, :]).sum(axis=2)
    want = set(zip(*(x.tolist() for x in np.nonzero(apart <= decontamination.RADIUS)), strict=True))
    index = decontamination.HammingBlocks(entries)
    read = index.candidates(prints)
    assert 0.25 < read.mean() < 0.29 and all(read[w, i] for w, i in want) and len(want) >= 520
    for cells in (1 << 18, 70):
        monkeypatch.setattr(decontamination, "CELLS", cells)
        found = list(zip(*(x.tolist() for x in index.within(prints)), strict=True))
        assert len(found) == len(want) and set(found) == want
    few = decontamination.BALL[:200]
    assert len(index.tables[0][0]) > len(few)
    near = np.isin(prints.view("<u2")[:, None, :] ^ entries.view("<u2")[None, :, :], few).any(axis=2)
    monkeypatch.setattr(decontamination, "BALL", few)  # tables above the ball are probed: only what the ball reaches is met
    assert (index.candidates(prints) == near).all()


def test_large_tables_are_probed():
    rng = np.random.default_rng(3)
    entries = rng.integers(0, 1 << 64, (4000, 2), dtype=np.uint64)
    index = decontamination.HammingBlocks(entries)
    assert all(len(keys) > len(decontamination.BALL) for keys, _, _ in index.tables)
    prints = rng.integers(0, 1 << 64, (40, 2), dtype=np.uint64)
    apart = np.bitwise_count(prints.view("<u2")[:, None, :] ^ entries.view("<u2")[None, :, :])
    assert (index.candidates(prints) == (apart <= decontamination.NEAR).any(axis=2)).all()


def test_items_are_found_by_the_tables_alone():
    rng = random.Random(4)
    items = [" ".join(f"w{rng.randrange(900)}" for _ in range(20)) for _ in range(50)]
    index = decontamination.ItemIndex(list(range(50)), items)
    values, _, words = decontamination.block_shingles(pa.array([" ".join(["x", *items[7].split(), "y"])]))
    assert set(index.search(values, int(words[0]))) == {7}
    for table in index.blocks.values():
        table.tables = [(keys[:0], first[:1], entries[:0]) for keys, first, entries in table.tables]
    assert index.search(values, int(words[0])) == {}


def test_recall_of_near_copies():
    """Every edited copy of an item that is 0.8 similar or more is found, one word less is not reported."""
    rng = random.Random(21)
    items = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([15, 40, 90]))] for _ in range(300)]
    index = decontamination.ItemIndex(list(range(300)), [" ".join(v) for v in items])
    near = found = 0
    for i, v in enumerate(items * 8):
        w = list(v)
        for j in rng.sample(range(len(w)), rng.randrange(0, 1 + len(w) // 12)):
            w[j] = "changed"
        text = " ".join([*(f"x{rng.randrange(99)}" for _ in range(30)), *w, *(f"y{rng.randrange(99)}" for _ in range(30))])
        values, first, words = decontamination.block_shingles(pa.array([text]))
        a, b = grams(v), grams(w)
        both = sum((a & b).values())
        like = both / (sum(a.values()) + sum(b.values()) - both)
        got = index.search(values, int(words[0]))
        near += like >= 0.8
        found += like >= 0.8 and i % 300 in got and got[i % 300][0] >= like - 1e-9
        assert like >= 0.8 or i % 300 not in got or got[i % 300][0] >= 0.8
    assert near > 500 and found == near


def test_many_items_of_one_size_take_bounded_memory():
    import tracemalloc

    rng = random.Random(1)
    same = [f"s{j}" for j in range(16)]
    items = [" ".join([*same, *(f"w{rng.randrange(10**6)}" for _ in range(24))]) for _ in range(6000)]
    index = decontamination.ItemIndex(list(range(6000)), items)
    values, _, words = decontamination.block_shingles(pa.array([" ".join([*same * 40, items[17]])]))
    tracemalloc.start()
    assert set(index.search(values, int(words[0]))) == {17}
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 40)
    items = [(i, f"alpha{i} beta gamma delta epsilon zeta{i} eta") for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, f"before {t} after") for i, t in items]
    assert {(r.doc_id, r.item_id) for r in decontamination.find_contamination(frame(spark, docs), bench).collect()} == {(i, i) for i, _ in items}
