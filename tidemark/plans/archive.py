"""Queries on metadata: identities, splits, manifests, verification, histories, samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import text as T
from tidemark.operators import etl
from tidemark.plans.roles import SQL_HULLS, SQL_RECORDINGS, hulls, recordings, table
from tidemark.sources import archive
from tidemark.sources.shared import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _identified(spark, d):
    return etl.identify(recordings(spark, d))


SQL_ROLLUP = f"WITH {SQL_RECORDINGS}, g AS (SELECT identity, arg_min(type, id) AS type, count(id) AS n_recordings, count(DISTINCT day) AS n_sessions, arg_min(identity_conf, id) AS identity_conf, bool_or(is_background) AS is_background FROM identified GROUP BY identity), s AS (SELECT *, CASE WHEN is_background THEN 'ambient' WHEN n_recordings >= 2 AND identity_conf IN ('mmsi', 'named') THEN 'val' ELSE 'train' END AS split FROM g)"


@query(f"WITH {SQL_RECORDINGS} SELECT id, identity, identity_conf, is_background, coalesce(trim(lower(regexp_extract(name, '\\((.*?)\\)', 1))), '') AS state, 'SHIPSEAR:' || identity || '#d' || day AS session_id FROM identified")
def identity_text(spark, d):
    return _identified(spark, d).select("id", "identity", "identity_conf", "is_background", "state", "session_id")


@query(SQL_ROLLUP + " SELECT * FROM g")
def hull_rollup(spark, d):
    return etl.hull_rollup(_identified(spark, d))


@query(SQL_ROLLUP + " SELECT identity, split FROM s")
def freeze_split(spark, d):
    return etl.hull_split(etl.hull_rollup(_identified(spark, d))).select("identity", "split")


@query(SQL_ROLLUP + " SELECT r.id, CASE WHEN r.is_background AND coalesce(s.split, 'train') = 'train' THEN 'ambient' ELSE coalesce(s.split, 'train') END AS split FROM identified r LEFT JOIN s ON s.identity = r.identity")
def recording_split(spark, d):
    r = _identified(spark, d)
    h = etl.hull_split(etl.hull_rollup(r)).withColumnRenamed("identity", "vessel_id")
    return etl.recording_split(r.withColumnRenamed("identity", "vessel_id"), h).select("id", "split")


@query(SQL_ROLLUP + " SELECT s.identity AS vessel_id FROM s WHERE split = 'train' INTERSECT SELECT s.identity FROM s WHERE split = 'val'")
def split_disjoint(spark, d):
    h = etl.hull_split(etl.hull_rollup(_identified(spark, d))).withColumnRenamed("identity", "vessel_id")
    return etl.leaked(h.where("split = 'train'"), h.where("split = 'val'"))


def _sql_select(forced: str, order: str) -> str:
    return f"""WITH {SQL_HULLS}, e AS (SELECT * FROM hulls WHERE n_recordings >= 2), f AS (SELECT vessel_id FROM e WHERE on_both_hardware AND {forced}), p AS (SELECT * FROM e WHERE NOT on_both_hardware),
w AS (SELECT greatest(40 - (SELECT count(*) FROM f), 0) AS remaining), t AS (SELECT type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, type) AS pos FROM p GROUP BY type),
a AS (SELECT type, pos, greatest(1, round_even(n / (SELECT sum(n) FROM t) * remaining, 0)::INT) AS k FROM t, w),
u AS (SELECT type, pos, row_number() OVER (ORDER BY j, pos DESC) AS place FROM (SELECT type, pos, unnest(range(k)) AS j FROM a)),
adj AS (SELECT type, count(*) + CASE WHEN pos = 1 THEN greatest((SELECT max(remaining) FROM w) - (SELECT sum(k) FROM a), 0) ELSE 0 END AS k FROM u WHERE place <= (SELECT max(remaining) FROM w) GROUP BY type, pos),
c AS (SELECT p.vessel_id, p.type, row_number() OVER (PARTITION BY p.type ORDER BY has_cpa DESC, {order}, md5('42|' || vessel_id)) AS rn FROM p)
SELECT h.vessel_id, CASE WHEN h.vessel_id IN (SELECT vessel_id FROM f) OR h.vessel_id IN (SELECT c.vessel_id FROM c JOIN adj ON adj.type = c.type WHERE rn <= k) THEN 'val' ELSE 'train' END AS split FROM hulls h"""


@query(_sql_select("true", "n_recordings DESC"))
def select_val(spark, d):
    return etl.select_val(hulls(spark, d), 40).select("vessel_id", "split")


@query(_sql_select("false", "abs(n_recordings - 3)"))
def select_val_moderate(spark, d):
    """Vessels on both kinds of hardware stay in train; those with about three recordings come first."""
    return etl.select_val(hulls(spark, d), 40, both_hardware="train", prefer="moderate").select("vessel_id", "split")


@query(SQL_ROLLUP + " SELECT identity, CASE WHEN is_background THEN 'ambient' WHEN n_sessions >= 2 AND identity_conf IN ('mmsi', 'named') THEN 'val' ELSE 'train' END AS split FROM g")
def freeze_split_sessions(spark, d):
    """The split by sessions instead of recordings."""
    return etl.hull_split(etl.hull_rollup(_identified(spark, d)), min_sessions=2).select("identity", "split")


@query(SQL_ROLLUP + " SELECT type, count(*) AS n_hulls, sum(n_recordings)::BIGINT AS n_recordings, count(*) FILTER (WHERE n_sessions >= 2) AS n_multi FROM g GROUP BY GROUPING SETS ((type), ())")
def rollup_counts(spark, d):
    g = etl.hull_rollup(_identified(spark, d))
    return g.groupingSets([["type"], []], "type").agg(F.count("*").alias("n_hulls"), F.sum("n_recordings").alias("n_recordings"), F.count_if(F.col("n_sessions") >= 2).alias("n_multi"))


@query("WITH m AS (SELECT c_custkey AS rid, CASE WHEN c_custkey % 2 = 0 THEN 'IARA' ELSE 'SHIPSEAR' END AS source, 'sess' || c_nationkey AS session_id FROM customer), s AS (SELECT o_orderkey, o_custkey AS rid, CASE WHEN o_custkey % 2 = 0 THEN 'iara' ELSE 'ShipsEar' END AS source FROM orders) SELECT s.o_orderkey AS seg, m.session_id FROM s JOIN m ON m.rid = s.rid AND upper(s.source) = m.source")
def manifest_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    m = c.select(F.col("c_custkey").cast("string").alias("recording_id"), F.when(F.col("c_custkey") % 2 == 0, "IARA").otherwise("SHIPSEAR").alias("source"), F.concat(F.lit("sess"), F.col("c_nationkey").cast("string")).alias("session_id"))
    even = F.col("o_custkey") % 2 == 0
    s = o.select(F.col("o_orderkey").alias("seg"), F.when(even, "iara").otherwise("ShipsEar").alias("source"), F.when(even, F.format_string("A-%04d", "o_custkey")).otherwise(F.format_string("%d__x_y", "o_custkey")).alias("parent_clip"))
    return etl.with_sessions(s, m).select("seg", "session_id")


@query("SELECT o_orderkey AS seg, coalesce('sess' || c_nationkey, 'clip' || o_custkey) AS session FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey")
def session_fallback(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_custkey % 3 <> 0")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select(F.col("o_orderkey").alias("seg"), F.coalesce(F.concat(F.lit("sess"), F.col("c_nationkey").cast("string")), F.concat(F.lit("clip"), F.col("o_custkey").cast("string"))).alias("session"))


SQL_LOG = "log AS (SELECT o_orderkey AS id, 8000 - (o_orderkey % 50 = 0)::INT * 1000 AS dst_sr, 1 + (o_orderkey % 70 = 0)::INT AS dst_ch, count(*) * 8000 + (o_orderkey % 13 = 0)::INT * 4000 AS dst_frames, CASE WHEN o_orderkey % 90 = 0 THEN 0 ELSE 44100 END AS src_sr, count(*) * 44100 AS src_frames FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey), dur AS (SELECT *, coalesce(dst_frames / nullif(dst_sr, 0), 0) AS dst_dur, coalesce(src_frames / nullif(src_sr, 0), 0) AS src_dur FROM log), chk AS (SELECT *, abs(dst_dur - src_dur) AS dur_diff, CASE WHEN dst_sr <> 8000 OR dst_ch <> 1 THEN 'format' WHEN abs(dst_dur - src_dur) > 0.05 THEN 'duration' END AS problem FROM dur)"


def _checked(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    flag = lambda m: (F.col("id") % m == 0).cast("int")
    n = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n")).join(o.select(F.col("o_orderkey").alias("id")), "id", "left_semi")
    log = n.select("id", (8000 - flag(50) * 1000).alias("dst_sr"), (1 + flag(70)).alias("dst_ch"), (F.col("n") * 8000 + flag(13) * 4000).alias("dst_frames"), F.when(F.col("id") % 90 == 0, 0).otherwise(44100).alias("src_sr"), (F.col("n") * 44100).alias("src_frames"))
    return etl.verify(log)


@query(f"WITH {SQL_LOG} SELECT id, round(dst_dur, 8) AS dst_dur, round(src_dur, 8) AS src_dur, round(dur_diff, 8) AS dur_diff, problem FROM chk")
def verify_report(spark, d):
    return _checked(spark, d).select("id", F.round("dst_dur", 8).alias("dst_dur"), F.round("src_dur", 8).alias("src_dur"), F.round("dur_diff", 8).alias("dur_diff"), "problem")


SQL_MISSING = "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)"


@query(f"WITH {SQL_LOG} SELECT count(*) AS n_files, count(*) FILTER (WHERE problem = 'format') AS n_format, count(*) FILTER (WHERE problem = 'duration') AS n_duration, round(sum(dst_dur) / 3600, 6) AS hours, (SELECT count(*) FROM ({SQL_MISSING})) AS n_missing, CASE WHEN count(*) FILTER (WHERE problem IS NOT NULL) + (SELECT count(*) FROM ({SQL_MISSING})) = 0 THEN 'PASS' ELSE 'CHECK' END AS verdict FROM chk")
def verify_verdict(spark, d):
    gone = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").where("l_quantity > 10"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return etl.verdict(_checked(spark, d), gone).withColumn("hours", F.round("hours", 6))


@query(f"SELECT o_orderkey AS path FROM ({SQL_MISSING})")
def missing_paths(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_quantity > 10"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("path"))


@query("WITH i AS (SELECT DISTINCT 'k' || l_orderkey AS path FROM lineitem), m AS (SELECT 'k' || o_orderkey AS path FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT 'index.csv') SELECT (SELECT count(*) FROM i WHERE path NOT IN (SELECT path FROM m)) AS n_missing, (SELECT count(DISTINCT path) FROM m WHERE path NOT IN (SELECT path FROM i)) AS n_extra, (SELECT count(*) FROM (SELECT path FROM m GROUP BY path HAVING count(*) > 1)) AS n_repeated")
def archive_gate(spark, d):
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string")).alias("path")
    i = table(spark, d, "lineitem").select(key("l_orderkey"))
    m = table(spark, d, "orders").where("o_orderkey % 10 <> 0").select(key("o_orderkey"))
    return etl.archive_gate(i, m.unionByName(m.select(F.lit("index.csv").alias("path")).limit(1))).drop("ok")


@query("WITH i AS (SELECT page_id, replace(url, '\\', '/') AS p FROM pages), t AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 = 0), f AS (SELECT url, 'p:' || min(page_id) AS found FROM pages WHERE page_id % 3 = 1 GROUP BY url), n AS (SELECT split_part(url, '/', -1) AS base, 'n:' || min(page_id) AS found FROM pages GROUP BY base) SELECT page_id, coalesce(t.url, f.found, n.found) AS resolved FROM i LEFT JOIN t ON t.url = p LEFT JOIN f ON f.url = p LEFT JOIN n ON n.base = split_part(p, '/', -1)")
def path_resolution(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    base = F.substring_index("url", "/", -1)
    tree = p.where("page_id % 3 = 0").select(F.col("url").alias("path"))
    parents = p.where("page_id % 3 = 1").groupBy(F.col("url").alias("path")).agg(F.concat(F.lit("p:"), F.min("page_id").cast("string")).alias("found"))
    names = p.groupBy(base.alias("base")).agg(F.concat(F.lit("n:"), F.min("page_id").cast("string")).alias("found"))
    return etl.resolve_paths(p.select("page_id", F.replace("url", F.lit("/"), F.lit("\\")).alias("path")), tree, parents, names).select("page_id", "resolved")


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'very_heavy' WHEN event_id % 9 = 1 THEN 'no_rain' WHEN event_id % 9 = 2 THEN 'unknown' WHEN value - 200 = 0 THEN 'no_rain' WHEN value - 200 < 0.5 THEN 'light' WHEN value - 200 < 2 THEN 'moderate' ELSE 'heavy' END AS rain FROM events")
def rain_buckets(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 9
    named = F.when(k == 0, " Very Heavy").when(k == 1, "no rain")
    mm = F.when(k == 2, "n/a").otherwise((F.col("value") - 200).cast("string"))
    return e.select("event_id", T.rain_bucket(named, mm).alias("rain"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'rain' WHEN 1 THEN 'wind' WHEN 2 THEN 'waves' WHEN 3 THEN 'current' ELSE 'ambient' END AS condition FROM part")
def ambient_conditions(spark, d):
    word = F.element_at(F.array(*map(F.lit, ["Lluvia", "viento", "OLEAJE", "corriente", "mar"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.ambient_condition(F.concat(F.lit("9__"), word, F.lit("_2.wav"))).alias("condition"))


@query("SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}\\-_.]', '_', 'g') AS safe, printf('A/A-%04d.wav', page_id) AS src, regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', '') AS stem FROM pages")
def path_names(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.safe_name(F.col("url")).alias("safe"), F.substr(T.collection_path("r", F.lit("A"), F.col("page_id")), F.lit(3)).alias("src"), T.stem(F.col("url")).alias("stem"))


@query("SELECT vec_id, 'MV__c' || label AS clip_id, CASE WHEN vec_id % 2 = 0 THEN 'query' ELSE 'gallery' END AS piece, CASE vec_id % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'speed' ELSE 'speed_noise' END AS condition, (vec_id % 100)::INT AS seg_index, CASE WHEN vec_id % 2 = 0 AND vec_id % 3 > 0 THEN 4.0 END AS speed_pct FROM embeddings")
def tensor_manifest(spark, d):
    e = table(spark, d, "embeddings")
    v = F.col("vec_id")
    name = F.concat(F.lit("x/MV__c"), F.col("label").cast("string"), F.when(v % 2 == 0, "__query__").otherwise("__gallery__"), F.when(v % 3 == 0, "clean").when(v % 3 == 1, "speed").otherwise("speed_noise"), F.lit("__seg"), F.format_string("%03d", v % 100), F.lit(".npy"))
    return e.select("vec_id", T.tensor_name(name).alias("t")).select("vec_id", "t.*").withColumn("speed_pct", T.provenance(F.col("piece"), F.col("condition"), F.lit(4.0), "speed"))


@query("SELECT o_orderkey AS id, concat_ws('/', 'out', CASE WHEN o_orderkey % 5 = 0 THEN 'ambient' ELSE 'train' END, 'IARA', CASE WHEN o_orderkey % 5 = 0 THEN '_ambient' WHEN count(*) OVER (PARTITION BY o_custkey) >= 2 THEN 'IARA_' || o_custkey END, o_orderkey || '.wav') AS dst_path FROM orders")
def destination_paths(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("IARA:"), F.col("o_custkey").cast("string")).alias("vessel_id"), F.when(F.col("o_orderkey") % 5 == 0, "ambient").otherwise("train").alias("split"), F.lit("IARA").alias("source"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("file"))
    return etl.destination(o, "out").select("id", "dst_path")


@query("SELECT DISTINCT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS label FROM customer")
def label_encoding(spark, d):
    return etl.encode_labels(table(spark, d, "customer"), "c_mktsegment").withColumn("label", F.col("label").cast("long"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def passage_platform(spark, d):
    return etl.first_by(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("(SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)")
def set_algebra(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return c.subtract(s).union(s.subtract(c)).distinct()


@query("SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, sum(l_quantity) AS total, quantile_cont(l_quantity, 0.9) AS p90, median(l_quantity) AS p50 FROM lineitem GROUP BY l_returnflag")
def duration_stats(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min(q).alias("low"), F.max(q).alias("high"), F.sum(q).alias("total"), F.percentile(q, 0.9).alias("p90"), F.median(q).alias("p50"))


@query("WITH x AS (SELECT c_mktsegment AS method, o_orderpriority AS condition, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT method, max(n) FILTER (WHERE condition = '1-URGENT') AS clean, max(n) FILTER (WHERE condition = '2-HIGH') AS speed, max(n) FILTER (WHERE condition = '2-HIGH') - max(n) FILTER (WHERE condition = '1-URGENT') AS delta FROM x GROUP BY method")
def condition_report(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = x.groupBy(F.col("c_mktsegment").alias("method")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH"]).count()
    return wide.select("method", F.col("1-URGENT").alias("clean"), F.col("2-HIGH").alias("speed"), (F.col("2-HIGH") - F.col("1-URGENT")).alias("delta"))


# --- training plans ----------------------------------------------------------------------------------------

SQL_HISTORY = "h AS (SELECT event_id + 1 AS epoch, round(value / 490, 3) AS rank1 FROM events)"


def _history(spark, d):
    return table(spark, d, "events").select((F.col("event_id") + 1).alias("epoch"), F.round(F.col("value") / 490, 3).alias("rank1"))


@query(f"WITH {SQL_HISTORY}, b AS (SELECT *, max(rank1) OVER w AS best, coalesce(rank1 > max(rank1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM h WINDOW w AS (ORDER BY epoch ROWS UNBOUNDED PRECEDING)), c AS (SELECT *, epoch - max(CASE WHEN fresh THEN epoch END) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS waited FROM b) SELECT epoch, best, waited, waited >= 10 AS stop FROM c")
def best_so_far(spark, d):
    return etl.best_so_far(_history(spark, d), "rank1", 10).select("epoch", "best", "waited", "stop")


@query(f"WITH {SQL_HISTORY}, c AS (SELECT epoch, rank1, CASE WHEN epoch % 3 = 0 THEN rank1 / 2 END AS gap, CASE WHEN epoch % 5 = 0 THEN 1 - rank1 END AS eer FROM h) SELECT epoch, metric, round(value, 6) AS value FROM (UNPIVOT c ON rank1, gap, eer INTO NAME metric VALUE value)")
def epoch_curves(spark, d):
    h, e = _history(spark, d), F.col("epoch")
    h = h.withColumns({"gap": F.when(e % 3 == 0, F.col("rank1") / 2), "eer": F.when(e % 5 == 0, 1 - F.col("rank1"))})
    return etl.epoch_curves(h, ["rank1", "gap", "eer"]).withColumn("value", F.round("value", 6))


@query("SELECT o_orderkey AS id, o_orderstatus AS source, o_custkey AS vessel, o_orderpriority AS session, row_number() OVER (ORDER BY o_orderstatus, o_custkey, o_orderpriority, o_orderkey) AS place FROM orders")
def display_order(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("source"), F.col("o_custkey").alias("vessel"), F.col("o_orderpriority").alias("session"))
    return etl.places(o, "source", "vessel", "session", "id")


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE (CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'SKIP_EXISTS' ELSE 'MISSING_SRC' END) = 'OK'")
def arranged_files(spark, d):
    o, s = table(spark, d, "orders"), F.col("o_orderstatus")
    log = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.when(s == "F", "OK").when(s == "O", "SKIP_EXISTS").otherwise("MISSING_SRC").alias("status"))
    return etl.arranged(log).select("id", "priority")


@query("WITH m AS (SELECT doc_id, 'docs/' || doc_id || '.txt' AS name, octet_length(encode(coalesce(text, '')))::BIGINT AS length, sha256(coalesce(text, '')) AS sha256 FROM documents), s AS (SELECT *, coalesce(sum(512 + (length + 511) // 512 * 512) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM m) SELECT name, length, start + 512 AS data, sha256 FROM s")
def archive_members(spark, d):
    """Texts packed into an archive and read back, each from its own place."""
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("place"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    path = f"{shared_folder(spark)}.tar"
    manifest = archive.write_archive(doc.withColumn("length", F.octet_length("content").cast("long")), path)
    return manifest.join(archive.read_members(manifest, path), "name").select("name", "length", "data", F.sha2("content", 256).alias("sha256"))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL")
def counted_gate(spark, d):
    """A table that is only there because the counts of what was written agree with the source's."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    n, kinds = c.agg(F.count("*"), F.max("c_custkey")).first()
    kept = etl.write_counted(c, shared_folder(spark), {"n_rows": (F.count("*"), n), "last": (F.max("c_custkey"), kinds)})
    return kept.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query(f"WITH {SQL_HISTORY} SELECT epoch, rank1 FROM h ORDER BY epoch DESC LIMIT 10")
def last_history(spark, d):
    return _history(spark, d).orderBy(F.col("epoch").desc()).limit(10).select("epoch", "rank1")


@query(f"WITH {SQL_HISTORY}, t AS (SELECT epoch, (epoch - 1) % 100 + 1 AS e FROM h) SELECT epoch, round(CASE WHEN e <= 3 THEN 1e-3 * e / 3 ELSE 1e-6 + 0.5 * (1e-3 - 1e-6) * (1 + cos(3.141592653589793 * (e - 3) / 97.0)) END, 10) AS lr, (e - 1) % 25 + 1 AS set_idx FROM t")
def lr_schedule(spark, d):
    """Learning rate and epoch set of each epoch of the history, in runs of a hundred."""
    e = (F.col("epoch") - 1) % 100 + 1
    return _history(spark, d).select("epoch", F.round(T.learning_rate(e, 1e-3, 100), 10).alias("lr"), T.set_number(e).alias("set_idx"))


SQL_SETS = """WITH r AS (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT) AS path, l_suppkey AS vessel_id, l_partkey % (1 + l_suppkey % 40) <> 0 AS is_augmented FROM lineitem),
k AS (SELECT *, count(*) FILTER (WHERE NOT is_augmented) OVER (PARTITION BY vessel_id) AS n, count(*) FILTER (WHERE is_augmented) OVER (PARTITION BY vessel_id) AS m, row_number() OVER (PARTITION BY vessel_id, is_augmented ORDER BY md5('7|' || path)) - 1 AS rn FROM r),
f AS (SELECT *, CASE WHEN n >= 100 THEN 'heavy' WHEN n >= 25 THEN 'mid' ELSE 'short' END AS kind, least(100 - n, m) AS need FROM k),
slots AS (SELECT DISTINCT vessel_id, kind, kind = 'mid' AS aug, s, (CASE kind WHEN 'heavy' THEN (s - 1) * 100 + j ELSE (s - 1) * need + j END) % CASE kind WHEN 'heavy' THEN n ELSE m END AS rn FROM (SELECT DISTINCT vessel_id, kind, n, m, need FROM f WHERE kind = 'heavy' OR (kind = 'mid' AND need > 0)), range(1, 26) a(s), range(100) b(j) WHERE kind = 'heavy' OR j < need)
SELECT path, f.vessel_id, f.kind, is_augmented, s::INT AS set_idx FROM f JOIN slots ON slots.vessel_id = f.vessel_id AND slots.rn = f.rn AND is_augmented = aug
UNION ALL SELECT path, vessel_id, kind, is_augmented, s::INT FROM f, range(1, 26) t(s) WHERE kind = 'short' OR (kind = 'mid' AND NOT is_augmented)"""


@query(SQL_SETS)
def epoch_sets(spark, d):
    """All lines as rows of suppliers; the number of originals of a supplier depends on its key."""
    path = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long"))
    rows = table(spark, d, "lineitem").select(path.alias("path"), F.col("l_suppkey").alias("vessel_id"), (F.col("l_partkey") % (1 + F.col("l_suppkey") % 40) != 0).alias("is_augmented"))
    return etl.epoch_sets(rows)


@query("WITH c AS (SELECT s_suppkey AS clip_id, row_number() OVER (ORDER BY md5('42|' || s_suppkey)) AS rn, count(*) OVER () AS n FROM supplier) SELECT clip_id, CASE WHEN rn <= n // 2 THEN 'approach' ELSE 'recede' END AS doppler_sign FROM c")
def doppler_signs(spark, d):
    return etl.half_signs(table(spark, d, "supplier").select(F.col("s_suppkey").alias("clip_id")), 42)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('3|' || o_orderkey)) AS rn FROM orders) WHERE rn <= 4")
def capped_segments(spark, d):
    return etl.capped(table(spark, d, "orders"), "o_custkey", 4, 3, "o_orderkey").select("o_orderkey", "o_custkey")


def _sql_draw(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || id), 1, 12))::BIGINT % (SELECT count(*) FROM o)"


@query(f"WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY md5('9|' || vec_id), vec_id) - 1 AS i FROM embeddings), d AS (SELECT id, {_sql_draw(9)} AS x, {_sql_draw(10)} AS y FROM range(500) t(id)) SELECT id, a.vec_id AS a, b.vec_id AS b FROM d JOIN o a ON a.i = x JOIN o b ON b.i = y WHERE x <> y")
def random_pairs(spark, d):
    return etl.random_pairs(table(spark, d, "embeddings").select("vec_id"), "vec_id", 500, 9)


@query("SELECT conv_id, min(turn) AS start, count(*) AS length FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS grp, role FROM conversations) GROUP BY conv_id, role, grp HAVING count(*) >= 1")
def turn_islands(spark, d):
    c = table(spark, d, "conversations").withColumns({"above": F.lit(True), "one": F.lit(1)})
    return etl.islands(c, ["conv_id", "role"], "turn", "one", 1).select("conv_id", "start", "length")


@query("WITH n AS (SELECT c_nationkey, row_number() OVER (ORDER BY md5('5|' || c_nationkey), c_nationkey) AS rn FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM n WHERE rn <= 6)")
def pilot_subset(spark, d):
    return etl.sample_groups(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 6, 5)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 4 = 0 AND o_custkey % 3 <> 0")
def original_rows(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("split"), F.element_at(F.array(F.lit("x"), F.lit("iara"), F.lit("ShipsEar")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("source"), (F.col("o_orderkey") % 4).alias("is_augmented"))
    return etl.originals(o, ["F", "O"], ["IARA", "SHIPSEAR"]).select("id")


@query("SELECT 'IARA:' || c_custkey AS vessel_id, coalesce(n_name, 'Unknown') AS type, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 7 END AS n_recordings, c_custkey % 3 > 0 AS has_cpa, c_custkey % 4 = 1 AS on_both_hardware FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 6 <> 0")
def workbook_hulls(spark, d):
    c, n, k = table(spark, d, "customer"), table(spark, d, "nation").where("n_nationkey % 6 <> 0"), F.col("c_custkey")
    c = c.join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    text = lambda x: x.cast("string")
    sheet = c.select(text(k).alias("Ship ID"), F.when(k % 5 == 0, "n/a").otherwise(text(k % 7)).alias("Qty recordings"), text(k % 3).alias("With CPA"), F.when(k % 4 == 1, "2").when(k % 4 == 2, "none").alias("on Both"))
    ships = c.where("n_name IS NOT NULL").select(text(k).alias("Ship ID"), F.col("n_name").alias("AIS TYPE SUMMARY"))
    return etl.hulls_of_workbook(sheet, ships).select("vessel_id", "type", "n_recordings", "has_cpa", "on_both_hardware")


@query("SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL THEN NULL WHEN c_custkey % 9 = 0 THEN 'very_heavy' WHEN c_custkey % 9 = 1 THEN 'no_rain' WHEN c_acctbal = 0 THEN 'no_rain' WHEN c_acctbal < 0.5 THEN 'light' WHEN c_acctbal < 2 THEN 'moderate' ELSE 'heavy' END AS rain, CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment END AS wind FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey")
def ambient_weather(spark, d):
    c, o = table(spark, d, "customer").where("c_custkey % 2 = 0"), table(spark, d, "orders")
    k = F.col("c_custkey") % 9
    info = c.select(F.col("c_custkey").alias("IARA ID"), F.when(k == 0, " Very Heavy").when(k == 1, "no rain").alias("Rain state"), F.col("c_acctbal").cast("string").alias("Rain"), F.col("c_mktsegment").alias("Wind"), F.lit(1).alias("Sea state"))
    return etl.with_weather(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("recording_id")), info).select("id", "rain", "wind")


@query("WITH g AS (SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > 150000) AS hits, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey) SELECT o_custkey, hits, n, CASE WHEN hits = n THEN 'clean' WHEN hits = 0 THEN 'failed' ELSE 'partial' END AS verdict FROM g")
def group_verdicts(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 150000).alias("hit"))
    return etl.group_verdicts(o, "o_custkey")


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS computed FROM customer GROUP BY c_mktsegment")
def stored_gate(spark, d):
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("value"))
    return etl.stored_gate(g, g.withColumn("value", F.round("value", 4)), "c_mktsegment", "value").select("c_mktsegment", F.round("computed", 4).alias("computed"))


def _in(letters) -> str:
    return "(" + ", ".join(f"'{x}'" for x in sorted(letters)) + ")"


@query(f"WITH p AS (SELECT p_partkey AS id, chr((65 + p_partkey % 9)::INT) AS letter FROM part) SELECT id, CASE WHEN letter IN {_in(T.GLIDER_COLLECTIONS)} THEN 'Glider' ELSE 'OS' END AS platform, letter IN {_in(T.CPA_COLLECTIONS)} AS has_cpa, letter IN {_in(T.BACKGROUND_COLLECTIONS)} AS is_background FROM p")
def collection_kinds(spark, d):
    letter = F.char(65 + F.col("p_partkey") % 9)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.platform(letter).alias("platform"), T.has_cpa(letter).alias("has_cpa"), T.is_background(letter).alias("is_background"))


@query("WITH p AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS numbered FROM part) SELECT k AS id, CASE WHEN numbered THEN printf('B-%04d', k) ELSE k || '__boat_x' END AS clip, k::VARCHAR AS number, CASE WHEN numbered THEN 'IARA:' || k ELSE 'SE:ferry ' || k END || '/d' || k % 7 AS label, k % 50 AS passage, 'A_' || k || '__part_' || k AS clip_id FROM p")
def clip_names(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    numbered, text = k % 2 == 0, k.cast("string")
    source = F.when(numbered, "IARA").otherwise("SHIPSEAR")
    clip = T.clip_stem(source, F.lit("B"), k, F.concat(F.lit("a/b/"), text, F.lit("__boat_x.wav")))
    vessel = F.when(numbered, F.concat(F.lit("IARA:"), text)).otherwise(F.concat(F.lit("SHIPSEAR:name:ferry "), text))
    session = F.when(numbered, F.concat(F.lit("d"), (k % 7).cast("string"))).otherwise(F.concat(F.lit("SHIPSEAR:x#d"), (k % 7).cast("string")))
    passage = T.passage_number(F.concat(F.lit("mmsi_1_p"), (k % 50).cast("string"))).cast("long")
    return p.select(k.alias("id"), clip.alias("clip"), T.recording_number(source, clip).alias("number"), T.short_label(vessel, session).alias("label"), passage.alias("passage"), T.clip_id(F.concat(F.lit("A "), text), F.concat(F.lit("x/part "), text, F.lit(".wav"))).alias("clip_id"))


@query("SELECT event_id, round(10 * log10(greatest(value / 100, 1e-10)), 6) AS level, CASE WHEN value >= 300 THEN 'strong' WHEN value >= 100 THEN 'possible' ELSE 'weak' END AS band FROM events")
def display_bands(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(T.decibel(v / 100), 6).alias("level"), T.display_band(v, 300, 100).alias("band"))


@query("SELECT vec_id, len(embedding)::INT AS n_values, 'tpsw' AS normaliser FROM embeddings")
def tensor_gates(spark, d):
    """Arrays of the wanted size under the wanted normaliser; anything else is an error."""
    e = etl.shape_gate(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 64)
    return e.select("vec_id", "n_values", etl.equal_or_error(F.lit("tpsw"), "tpsw", "normaliser").alias("normaliser"))


for _name in ("best_so_far", "last_history"):  # names under which these were registered too
    QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"] = QUERIES[_name], ORACLES[_name]
