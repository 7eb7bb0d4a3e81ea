"""The domain roles of the given tables: segments, passages, recordings, lines, trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import retrieval

DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as segment vectors: the label is the vessel, five sessions a vessel."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("vessel"), (F.col("vec_id") % 5).alias("pid"), "vec_id", F.col("embedding").alias("vec"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, vessel, pid (time order), role and cohort by session, unit vector."""
    pooled = retrieval.pool(segments(spark, sf_dir), ["vessel", "pid"], "vec", DIM)
    return pooled.select((F.col("vessel") * 5 + F.col("pid")).alias("uid"), "vessel", "pid", "n_segments", (F.col("vessel") % 2).alias("cohort"), "vec")


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second method over the same passages: the first half of each vector."""
    return passages(spark, sf_dir).withColumn("vec", F.slice("vec", 1, DIM // 2))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tonal lines: the user is the clip, the value the frequency, the property the level."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("clip"), F.col("value").alias("freq_hz"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("mean_db"), "event_id", "ts")


def trial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as trials: quality is the truth, hundreds of characters the score (many ties)."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return y.join(d.select("doc_id", "lang", F.floor(F.col("n_chars") / 100).alias("score")), "doc_id").select("doc_id", "lang", (F.col("quality") == 1).alias("genuine"), "score")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recordings of customers; names of vessels are made of the customer's number and segment."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    r = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, "Motorboat").when(k % 7 == 1, F.concat(F.lit('Ferry "Star '), k.cast("string"), F.lit('" (leaving)'))).when(k % 7 == 2, F.concat(F.lit("Trawler "), k.cast("string"), F.lit(" (Duda)"))).otherwise(F.concat(F.lit("Vessel  "), k.cast("string"), F.lit(" (passing)")))
    link = F.when(k % 3 == 0, F.concat(F.lit("http://x/?MMSI="), (k * 1000).cast("string")))
    return r.select(
        F.col("o_orderkey").alias("id"), name.alias("name"), link.alias("link"), F.col("o_orderdate").cast("date").cast("string").alias("date"), F.when(k % 11 == 0, "Ambient noise").otherwise(F.col("c_mktsegment")).alias("type"), k.alias("owner"), "o_orderpriority", "o_orderstatus", "o_totalprice"
    )


def hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as vessels with the columns that the split needs."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_recordings"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("has_cpa"))
    h = c.join(n, "c_custkey", "left")
    return h.select(F.concat(F.lit("IARA:"), F.col("c_custkey").cast("string")).alias("vessel_id"), F.col("c_mktsegment").alias("type"), F.coalesce("n_recordings", F.lit(0)).alias("n_recordings"), F.coalesce("has_cpa", F.lit(False)).alias("has_cpa"), (F.col("c_custkey") % 97 == 0).alias("on_both_hardware"))


# The same roles in SQL.
SQL_PASSAGES = """
pd AS (SELECT label AS vessel, vec_id % 5 AS pid, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
pm AS (SELECT vessel, pid, i, avg(x) AS m FROM pd GROUP BY vessel, pid, i),
pv AS (SELECT vessel, pid, list(m ORDER BY i) AS mean FROM pm GROUP BY vessel, pid),
passages AS (SELECT (vessel * 5 + pid)::BIGINT AS uid, vessel::BIGINT AS vessel, pid::BIGINT AS pid, vessel % 2 AS cohort,
  list_transform(mean, lambda z: z / CASE WHEN sqrt(list_sum(list_transform(mean, lambda y: y * y))) > 0 THEN sqrt(list_sum(list_transform(mean, lambda y: y * y))) ELSE 1 END) AS vec FROM pv),
scorable AS (SELECT * FROM passages WHERE vessel IN (SELECT vessel FROM passages GROUP BY vessel HAVING count(*) >= 2))
"""
SQL_LOO = SQL_PASSAGES + """,
scores AS (SELECT a.uid AS q, b.uid AS g, a.vessel AS qv, b.vessel AS gv, a.vessel = b.vessel AS same, list_dot_product(a.vec, b.vec) AS score FROM scorable a JOIN passages b ON a.uid <> b.uid),
scores2 AS (SELECT a.uid AS q, b.uid AS g, list_dot_product(a.vec[1:32], b.vec[1:32]) AS score FROM scorable a JOIN passages b ON a.uid <> b.uid)
"""
SQL_TRIALS = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, g) AS rn FROM scores),
trials AS (SELECT q, any_value(qv) AS vessel, max(score) FILTER (WHERE same) AS gen_score, max(score) FILTER (WHERE NOT same) AS best_imp, min(rn) FILTER (WHERE same) AS rank, min(g) FILTER (WHERE rn = 1) AS top_match FROM ranked GROUP BY q HAVING count(*) FILTER (WHERE same) > 0)
"""
SQL_LINES = "lines AS (SELECT user_id AS clip, value AS freq_hz, (props->>'$.k')::DOUBLE + 1 AS mean_db, event_id, ts FROM events)"
SQL_SCORES = "scores AS (SELECT l.doc_id, lang, quality = 1 AS genuine, floor(n_chars / 100)::BIGINT AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
SQL_RECORDINGS = """recordings AS (SELECT o_orderkey AS id,
  CASE WHEN c_custkey % 7 = 0 THEN 'Motorboat' WHEN c_custkey % 7 = 1 THEN 'Ferry "Star ' || c_custkey || '" (leaving)' WHEN c_custkey % 7 = 2 THEN 'Trawler ' || c_custkey || ' (Duda)' ELSE 'Vessel  ' || c_custkey || ' (passing)' END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN 'http://x/?MMSI=' || (c_custkey * 1000) END AS link, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN c_custkey % 11 = 0 THEN 'Ambient noise' ELSE c_mktsegment END AS type, c_custkey AS owner, o_orderpriority, o_orderstatus, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey),
named AS (SELECT *, CASE WHEN contains(name, '"') THEN lower(regexp_extract(name, '"(.*?)"', 1)) ELSE trim(lower(regexp_replace(regexp_replace(name, '\\(.*?\\)', '', 'g'), '\\s+', ' ', 'g'))) END AS ident,
  nullif(regexp_extract(coalesce(link, ''), '(?i)mmsi=(\\d+)', 1), '') AS mmsi FROM recordings),
identified AS (SELECT *, (ident = 'motorboat' OR lower(name) LIKE '%duda%') AS uncertain,
  CASE WHEN ident = 'motorboat' OR lower(name) LIKE '%duda%' THEN 'rec:' || id WHEN mmsi IS NOT NULL THEN 'mmsi:' || mmsi ELSE 'name:' || ident END AS identity,
  CASE WHEN mmsi IS NOT NULL THEN 'mmsi' WHEN ident = 'motorboat' OR lower(name) LIKE '%duda%' THEN 'uncertain' ELSE 'named' END AS identity_conf, lower(type) LIKE '%ambient%' AS is_background FROM named)
"""
SQL_HULLS = """n AS (SELECT o_custkey, count(*) AS n_recordings, bool_or(o_orderpriority = '1-URGENT') AS has_cpa FROM orders GROUP BY o_custkey),
hulls AS (SELECT 'IARA:' || c_custkey AS vessel_id, c_mktsegment AS type, coalesce(n_recordings, 0) AS n_recordings, coalesce(has_cpa, false) AS has_cpa, c_custkey % 97 = 0 AS on_both_hardware FROM customer LEFT JOIN n ON o_custkey = c_custkey)
"""
