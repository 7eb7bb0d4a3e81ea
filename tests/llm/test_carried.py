from pyspark.sql import functions as F

from tests.llm.fixtures import corpus, frame
from tidemark.llm import languages, mixing, pii


def check(df, carried, want):
    assert len(set(df.columns)) == len(df.columns) and set(carried) <= set(df.columns)
    assert sorted((tuple(r) for r in df.select("doc_id", *carried).collect()), key=str) == sorted(want, key=str)


def test_carried_columns_with_the_names_of_results(spark):
    rows = corpus()
    docs = frame(spark, rows).withColumn("spans", F.col("text").substr(1, 3)).withColumn("n_email", F.col("n_chars")).withColumn("rejected", F.lit("own"))
    tail = lambda t: t if t is None else t[:3]
    size = lambda t: t if t is None else len(t)
    found = languages.identify_languages(docs, languages.fit_languages(docs), keep=("doc_id", "score", "rejected", "spans"))
    check(found, ["carried_score", "spans", "carried_rejected"], [(d, 0.5, tail(t), "own") for d, t in rows])
    assert {"lang_pred", "score", "entropy", "rejected"} <= set(found.columns) and dict(found.dtypes)["rejected"] == "boolean"
    spans = pii.detect_pii(docs, pii.fit_spans(docs), carry=("spans", "n_email", "labels"))
    check(spans, ["carried_spans", "carried_n_email", "labels"], [(d, tail(t), size(t), "clash") for d, t in rows])
    mixed = mixing.mix_documents(docs, carry=("size", "spans", "labels"))
    check(mixed, ["carried_size", "spans", "labels"], [(d, 1, tail(t), "clash") for d, t in rows])
