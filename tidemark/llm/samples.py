"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import fold

#: Rows are taken by this hash of their id, so that a sample does not depend on partitioning.
_SPREAD = 1 << 40


def share(id_col: str):
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(_SPREAD)) / F.lit(float(_SPREAD))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> list[tuple[str, int, int]]:
    """About ``most`` (text, label, id) at most, out of the rows that are not held out.

    The sample is drawn by a hash of the id from the ids that have a label, and of rows that repeat an id the
    one with the least text counts, so the rows that reach the driver are bounded by the parameter, not by the corpus.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(fold("doc_id", modulus) != held_out)
    total = known.count()
    if total > most:
        known = known.where(share("doc_id") < F.lit(most / total))
    known = known.withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()
    return sorted(((r.text or "", int(r.y), r.doc_id) for r in rows), key=lambda r: r[2])


def by_class(docs: DataFrame, label: str, modulus: int, held_out: int, most: int) -> list[tuple[str, str]]:
    """About ``most`` (text, class) a class at most, out of the rows that are not held out."""
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (fold("doc_id", modulus) != held_out))
    sizes = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    keep = F.lit(False)
    for name, n in sizes.items():
        keep = keep | ((F.col(label) == name) & (share("doc_id") < F.lit(min(1.0, most / n))))
    rows = known.where(keep).select("doc_id", label, "text").collect()
    return [(r.text, r[label]) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text))]
