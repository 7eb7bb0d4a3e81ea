import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import corpus, empty, frame
from tidemark.llm import blocks, infill


def plain(doc, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    r = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(t)
    a, b = sorted((r[0] % (n + 1), r[1] % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or r[2] % 100 >= 90:
        return doc, n, "plain", None, None, sha(t), sha(t)
    form = "spm" if r[3] % 100 < 20 else "psm"
    p, m, s = f"<P>{t[:a]}", f"<M>{t[a:b]}", f"<S>{t[b:]}"
    return doc, n, form, a, b - a, sha(s + p + m if form == "spm" else p + s + m), sha(t)


def awkward():
    rng = random.Random(4)
    return corpus() + [(5000 + i, "".join(rng.choice("aé日😀 <PSM>\ń") for _ in range(rng.randrange(300)))) for i in range(60)] + [(6000, "a<P>b"), (6001, "<" * 9), (6002, "S><M" * 5)]


def test_digests_match_plain_cuts(spark):
    rows = awkward()
    got = sorted((tuple(r) for r in infill.infill_digests(frame(spark, rows)).collect()), key=str)
    assert got == sorted((plain(d, t) for d, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", [infill.characters, infill.words, infill.lines])
def test_units_by_chunks_of_any_size(unit):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab é日\n ") for _ in range(rng.randrange(0, 90))) for _ in range(50)] + ["", "x"]
    data, at = blocks.text_buffer(pa.array(texts))
    for size in (1, 3, 64, 4096):
        units = infill.ChunkedUnits(data, at, unit, size)
        for i, t in enumerate(texts):
            b = t.encode()
            starts = [k for k in range(len(b)) if k == 0 or unit(np.array([b[k - 1]], np.uint8), np.array([b[k]], np.uint8))[0]]
            assert units.total[i] == len(starts)
            own = np.full(len(starts) + 1, i)
            assert (units.places(own, np.arange(len(starts) + 1)) - at[i]).tolist() == [*starts, len(b)]


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    data, at = blocks.text_buffer(pa.array(["é" * 50000, "b" * 50000]))
    units = infill.ChunkedUnits(data, at, infill.characters, 100)
    seen, marks = [], units._marks
    monkeypatch.setattr(units, "_marks", lambda i, j: (seen.append((i, j)), marks(i, j))[1])
    assert units.places(np.array([0, 1]), np.array([30000, 7])).tolist() == [60000, 100007]
    assert seen == [(600, 601), (1000, 1001)]


def test_words_and_columns_that_are_kept(spark):
    rows = [(i, f"one  two{i}\tthree <x> é {i}" + " more" * i, "clash") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").withColumnRenamed("output", "n_words")
    made = infill.fill_in_middle(docs, unit=infill.words, rate=100, suffix_first=50, keep=("text", "n_words"), chunk=5).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in made} == {"psm", "spm"}
    for r in made:
        assert r.back == r.text and r.n == len(r.text.split()) and r.n_words == "clash"
        prefix = r.output.split("<P>")[1].split("<S>" if r.form == "psm" else "<M>")[0]
        assert len(prefix.split()) == r.prefix_units


def test_empty_table(spark):
    assert infill.infill_digests(empty(spark)).collect() == []
