"""Corpus pipeline: language, near duplicates, benchmark passages, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept. All but
the last return the columns of ``documents``; the last returns a row for each copy in the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, languages, mixing, nearjoin, pii
from tidemark.llm.blocks import remove, shared_folder, written
from tidemark.llm.filters import only, row_key, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: words of a shingle, similarity in percent.
SHINGLE, LEAST = 5, 80


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects; a missing language is filled in.

    A null text, an empty one and one without a letter are rejected. Every row is judged by its text alone, so
    rows that repeat stay or go together; null ids stay null; of equally likely languages the first by name counts.
    """
    kept = tuple(c for c in COLUMNS if c in docs.columns)
    found = languages.identify_languages(docs, languages.fit_languages(docs), keep=(*kept[1:],))
    lang = F.coalesce("lang", "lang_pred") if "lang" in kept else F.col("lang_pred")
    return found.where(~F.col("rejected")).withColumn("lang", lang).select(*kept)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each component of near duplicates: five-word shingles, similarity 0.8 or more.

    Rows are told apart by id and text. Null ids come last, ties go by a hash of the row, of rows that
    repeat one stays. Documents without a set link with nothing and stay.
    """
    gone, again = nearjoin.repeated_rows(docs, size=SHINGLE, least=LEAST)
    key = row_key("doc_id", "text")
    rest = without(docs, key, gone)
    return rest if again.isEmpty() else without(rest, key, again).unionByName(only(rest, key, again))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark.

    Equal texts, and so rows that repeat, stay or go together. Null and empty texts hold no passage and stay; an
    empty benchmark drops nothing.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind in brackets."""
    docs = docs.select(*(c for c in docs.columns if c in COLUMNS))
    kept = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = pii.detect_pii(docs, pii.fit_spans(docs), carry=kept, masked=True)
    out = found.withColumn("text", F.col("masked"))
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document: ``copy`` counts from 1.

    Null and empty texts have size 0 and rate 1; a null source is a source; rows that repeat are documents of
    their own; of documents of one size the hash of the id, then the id, says which take the odd copies.
    """
    own = [c for c in docs.columns if c in COLUMNS]
    mixed = mixing.mix_documents(docs, carry=tuple(c for c in own if c != "doc_id"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return mixed.where("copies > 0").select(*own, "size", "rate", copies)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_passages),
    ("personal_data", mask_personal_data),
    ("mixture", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet in the shared folder and read again; the one before it is deleted then."""
    where = shared_folder(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{where}/{name}")
        if last:
            remove(spark, last)
        last = f"{where}/{name}"
    return docs


#: Fitted models and Newton steps have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None
