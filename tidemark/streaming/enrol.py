"""Streaming enrolment and identification: the gallery grows by appended passages, queries meet the gallery of the moment."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from tidemark.operators import retrieval


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives as long as the checkpoint: it is kept in it, so a new or a lost checkpoint has another one."""
    path = f"{checkpoint.rstrip('/')}/enrolment"
    try:
        return spark.read.schema("value string").text(path).first()[0]
    except AnalysisException:  # there is none yet
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(path)
        return spark.read.schema("value string").text(path).first()[0]


def enrol(passages: DataFrame, gallery_path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of passages (uid, vessel, vec) to the gallery; passages that are there already are not repeated.

    Each micro-batch writes into a folder of its checkpoint's name and its own number, so a batch that runs again replaces itself and no
    other's; it is compared with all that other batches wrote, of this checkpoint and of any other. Streams that run at the same
    time may both write a passage that is new to both: ``gallery`` reads it once.
    """
    run = _run_of(passages.sparkSession, checkpoint)
    uid = passages.schema["uid"].dataType.simpleString()

    def append(batch: DataFrame, number: int) -> None:
        new, spark = batch.dropDuplicates(["uid"]), batch.sparkSession
        try:
            there = spark.read.schema(f"uid {uid}, run string, batch int").option("basePath", gallery_path).parquet(gallery_path)
            new = new.join(there.where((F.col("run") != run) | (F.col("batch") != number)).select("uid"), "uid", "left_anti").select(*batch.columns)
        except AnalysisException as e:  # the first passages of the gallery
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        new.write.mode("overwrite").parquet(f"{gallery_path}/run={run}/batch={number}")

    return passages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gallery(spark: SparkSession, gallery_path: str, columns: str) -> DataFrame:
    """The enrolled passages (``columns``: their schema), each uid once: of what two streams wrote at a time one row stays, the same at each reading."""
    rows = spark.read.schema(f"{columns}, run string, batch int").option("basePath", gallery_path).parquet(gallery_path)
    names = [c for c in rows.columns if c not in ("run", "batch")]
    first = rows.groupBy("uid").agg(F.min_by(F.struct(*names), F.struct("run", "batch")).alias("r"))
    return first.select("r.*")


def identify(queries: DataFrame, gallery: DataFrame, most: int = 5) -> DataFrame:
    """Best score of each vessel for each query, ranked; all passages of a vessel count."""
    found = retrieval.identity_scores(retrieval.side(queries), retrieval.side(gallery), most=most)
    best = found.select("q", F.col("identity").cast(gallery.schema["vessel"].dataType).alias("vessel"), "score")
    order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("vessel"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def agreed(a: DataFrame, b: DataFrame, top: int = 3) -> DataFrame:
    """Vessels that both methods put among a query's first few."""
    x = a.where(F.col("rank") <= top).select("q", "vessel", F.col("rank").alias("rank_a"))
    y = b.where(F.col("rank") <= top).select("q", "vessel", F.col("rank").alias("rank_b"))
    return x.join(y, ["q", "vessel"])


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event type over tumbling windows, with a watermark for late events; batch or stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
