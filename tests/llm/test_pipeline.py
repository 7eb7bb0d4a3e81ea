"""Each stage of the pipeline on its own input, and the registered queries."""

import pytest

from tests.llm.fixtures import corpus, empty, frame
from tests.llm.test_nearjoin import linked_rows
from tests.llm.test_texts import language_rows

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stay(rows, size, least):
    """One row of each component: smallest id, nulls last; rows of one component with the smallest id have one text here."""
    roots = linked_rows(rows, size, least)
    best = {}
    for (d, t), (n, root) in zip(rows, roots):
        if n:
            best[root] = min(best.get(root, (True, 0, "")), (d is None, d or 0, t)) if root in best else (d is None, d or 0, t)
    return [(d, t) for (d, t), (n, _) in zip(rows, roots) if not n] + [(None if none else d, t) for none, d, t in best.values()]


def plain(spark, rows):
    return frame(spark, rows).select(*COLUMNS)


def test_language_stage_drops_what_has_no_letter(spark, sf_dir):
    rows = [(i, t) for i, t, _ in language_rows()]
    df = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in language_rows()] + [(800, None, "aa", "s", 0), (801, "1 2", None, "s", 3), (802, rows[0][1], None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.keep_known_languages(spark, df, sf_dir)
    assert out.columns == COLUMNS
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {i for i, _ in rows} | {802}
    assert got[802].lang == "aa"


def test_near_duplicate_stage_keeps_one_of_each_group(spark, sf_dir):
    rows = corpus()
    out = corpus_pipeline.keep_one_of_each_group(spark, plain(spark, rows), sf_dir)
    assert out.columns == COLUMNS
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert kept == sorted(stay(rows, 5, 80), key=str)


def test_near_duplicate_stage_tells_rows_with_one_id_apart(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (4, a + " end"), (None, b), (None, c), (None, c), (9, c), (None, "alone here"), (6, None), (6, None)]
    out = corpus_pipeline.keep_one_of_each_group(spark, plain(spark, rows), sf_dir)
    want = [(4, a + " end"), (5, b), (9, c), (None, "alone here"), (6, None), (6, None)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_masking_stage_keeps_every_row(spark, sf_dir):
    rows = [(1, "mail a@b.co now"), (2, None), (3, ""), (4, "clean"), (4, "clean")]
    out = corpus_pipeline.mask_personal_data(spark, plain(spark, rows), sf_dir)
    assert out.columns == COLUMNS
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.text) == [(1, "mail [EMAIL] now", 16), (4, "clean", 5), (4, "clean", 5)]
    assert out.count() == 5


def test_stages_on_an_empty_table(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark).select(*COLUMNS), sf_dir).collect() == [], name


def test_chain_of_stages_on_a_planted_corpus(spark, tmp_path):
    """The rows of the whole pipeline follow from plain Python, but for the copies of the mix, which are held to its targets."""
    from tests.llm.test_scores import WORD, brute_hits, targets

    rng = __import__("random").Random(9)
    prose = lambda n: " ".join(f"word{rng.choice('abcdefgh')}{rng.choice('klmnop')}" for _ in range(n))
    items = [(i, prose(30)) for i in range(3)]
    texts = [prose(rng.randrange(12, 90)) for _ in range(60)]
    texts += [texts[3], texts[4] + " tail", f"{prose(20)} {items[1][1]} {prose(9)}", f"{prose(30)} mail a.b@c.de end", "12 34 56", None]
    rows = [(i, t, "en", "xyz"[i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lettered = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    kept = stay(lettered, 5, 80)
    hit = {d for d, _ in brute_hits(kept, items)}
    want = {d: t.replace("a.b@c.de", "[EMAIL]") for d, t in kept if d not in hit}
    assert len(texts) - len(want) >= 5 and hit
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.text == want[r.doc_id] and r.source == "xyz"[r.doc_id % 3] for r in out)
    copies, size, taken = {}, {}, {}
    for r in out:
        copies.setdefault(r.doc_id, []).append(r.copy)
        taken[r.source] = taken.get(r.source, 0) + r["size"]
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 2 for c in copies.values())
    for d, t in want.items():
        size["xyz"[d % 3]] = size.get("xyz"[d % 3], 0) + len(WORD.findall(t))
    goal = targets(size)
    assert all(abs(taken[s] - goal[s]) <= 45 for s in goal)


def test_whole_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert set(COLUMNS) < set(out.columns) and 0 < out.select("doc_id").distinct().count() <= docs.count()
    assert out.where("copy < 1 OR copy > 2").count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_registered_queries_cover_every_document(spark, sf_dir, n):
    from tidemark.llm import queries

    (name,) = [q for q in queries.QUERIES if q.startswith(f"op{n}_")]
    out = queries.QUERIES[name](spark, sf_dir)
    if n != 4:
        assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    else:
        assert out.count() > 0
