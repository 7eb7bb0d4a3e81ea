"""Bitmaps of keys, bounded in size, that let most rows pass a filter without a join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key, and at most.
KEY_BITS, MOST_BITS = 16, 1 << 29


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of the 64-bit keys in column ``k``, KEY_BITS bits a key and MOST_BITS at most.

    A key whose bit is not set is not among them. Beyond its bound the map only tells less.
    """
    n, bits = keys.count(), 1 << 16
    while bits < min(MOST_BITS, n * KEY_BITS):
        bits *= 2
    place = F.pmod("k", F.lit(bits))
    maps = keys.groupBy(F.floor(place / 32768).alias("part")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(32768))).alias("bits")).collect()
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for r in maps:
        own = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        bitmap[r.part * 4096 : r.part * 4096 + len(own)] = own
    return bitmap


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row's id and text: equal rows have equal keys."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _split(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is surely not in column ``k`` of ``keys``, and the others, both with the key as ``_k``.

    A bitmap of the keys, bounded in size, lets most rows pass where they are read.
    """
    bitmap = key_bitmap(keys)
    shared, bits = docs.sparkSession.sparkContext.broadcast(bitmap), 8 * len(bitmap)

    @F.pandas_udf("boolean")
    def maybe(values: pd.Series) -> pd.Series:
        place = values.to_numpy(dtype=np.int64) % bits
        return pd.Series((shared.value[place >> 3] >> (place & 7) & 1).astype(bool))

    marked = docs.withColumn("_k", key).withColumn("_maybe", maybe("_k"))
    return marked.where("NOT _maybe"), marked.where("_maybe")


def without(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` (64 bits, not null) is not in column ``k`` of ``keys`` (different, not null); only rows that the bitmap holds are joined."""
    free, others = _split(docs, key, keys)
    joined = others.join(keys.select(F.col("k").alias("_k")), "_k", "left_anti")
    return free.unionByName(joined).select(*docs.columns)


def only(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """One row for each ``key`` in column ``k`` of ``keys``."""
    return _split(docs, key, keys)[1].join(keys.select(F.col("k").alias("_k")), "_k", "left_semi").dropDuplicates(["_k"]).select(*docs.columns)
