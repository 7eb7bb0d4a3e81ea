"""Small corpora with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, labels string, score double, size int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = i % 10
        if kind == 0 and rows:
            text = rng.choice(rows)[1]  # exact copy
        elif kind in (1, 2) and rows:
            w = (rng.choice(rows)[1] or "x y z").split(" ")
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            text = " ".join(w)
        elif kind == 3:
            text = " ".join(words(rng, rng.randrange(0, 24)))
        else:
            text = " ".join(words(rng, rng.randrange(20, 260)))
        rows.append((i * 3, text))
    extra = [
        (1000, None), (1001, ""), (1002, "   \n\t "), (1003, "One"), (1004, "one TWO"), (1005, "one two"), (1006, "É ñ ü — “quotes” 日本語 текст"),
        (1007, "long " * 30000), (1008, "x" * 120000), (rows[4][0], rows[4][1]), (None, rows[5][1]), (None, None), (-7, rows[6][1]), (1009, rows[7][1] + " tail"),
    ]
    return rows + extra


def frame(spark, rows, lang="en"):
    """Columns beside the id and the text have names that operators use themselves."""
    full = [(i, t, lang, ["b", None, "a", "é", ""][j % 5], None if t is None else len(t), "clash", 0.5, 1) for j, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
