"""Queries on retrieval and verification: passages, scores, ranks, rates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import etl, metrics, neighbours, retrieval
from tidemark.plans.roles import SQL_LOO, SQL_PASSAGES, SQL_SCORES, SQL_TRIALS, halves, passages, segments, trial_scores
from tidemark.streaming import enrol

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Doubles are rounded in results, so that sums in another order agree.
PLACES = 8


def r(name: str):
    return F.round(name, PLACES).alias(name)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _loo(spark, d):
    return retrieval.leave_one_out(passages(spark, d))


def _trials(spark, d, of=passages, **how):
    p = of(spark, d)
    return retrieval.trials_against(p, p, **how)


def _profile(spark, d):
    """All pairs of passages; the scope is the platform (even and odd sessions)."""
    return retrieval.pair_profile(retrieval.side(passages(spark, d), scope=F.col("pid") % 2))


def _gallery(spark, d):
    p = passages(spark, d)
    return retrieval.trials_against(p.where("pid % 3 <> 0"), p.where("pid % 3 = 0"), skip_self=False)


SQL_GALLERY = SQL_PASSAGES + ", scores AS (SELECT a.uid AS q, b.uid AS g, a.vessel AS qv, b.vessel AS gv, a.vessel = b.vessel AS same, list_dot_product(a.vec, b.vec) AS score FROM passages a, passages b WHERE a.pid % 3 <> 0 AND b.pid % 3 = 0)"
TABLE = "SELECT count(*) AS n_queries, avg((rank <= 1)::INT) AS rank1, avg((rank <= 5)::INT) AS hit5, avg((rank <= 10)::INT) AS hit10, median(rank) AS median_rank"


@query(f"WITH {SQL_PASSAGES} SELECT uid, vessel, i, round(vec[i + 1], 8) AS value FROM passages, range(64) t(i)")
def passage_pool(spark, d):
    p = passages(spark, d)
    return p.select("uid", "vessel", F.posexplode("vec").alias("i", "value")).select("uid", "vessel", F.col("i").cast("long").alias("i"), r("value"))


@query(f"WITH {SQL_LOO} SELECT q, g, same, round(score, 8) AS score FROM scores")
def loo_scores(spark, d):
    return _loo(spark, d).select("q", "g", "same", r("score"))


@query(f"WITH {SQL_LOO} {SQL_TRIALS} SELECT q, vessel, round(gen_score, 8) AS gen_score, round(best_imp, 8) AS best_imp, rank, top_match FROM trials")
def loo_rank(spark, d):
    return _trials(spark, d).select("q", "vessel", r("gen_score"), r("best_imp"), "rank", "top_match")


RATES = """, imp AS (SELECT s.score FROM scores s JOIN trials t ON t.q = s.q WHERE NOT s.same), al AS (SELECT gen_score AS score, true AS genuine FROM trials UNION ALL SELECT score, false FROM imp),
x AS (SELECT row_number() OVER (ORDER BY score DESC, genuine DESC) AS pos, 1 - sum(genuine::INT) OVER w / sum(genuine::INT) OVER () AS fnr, sum((NOT genuine)::INT) OVER w / sum((NOT genuine)::INT) OVER () AS fpr FROM al WINDOW w AS (ORDER BY score DESC, genuine DESC ROWS UNBOUNDED PRECEDING)),
rates AS (SELECT (SELECT round(avg(CASE WHEN t.gen_score > i.score THEN 1.0 WHEN t.gen_score = i.score THEN 0.5 ELSE 0 END), 8) FROM trials t, imp i) AS auc, (SELECT round((fnr + fpr) / 2, 8) FROM x ORDER BY abs(fnr - fpr), pos LIMIT 1) AS eer)"""


def _table(t):
    return t.withColumns({"auc": F.round("auc", PLACES), "eer": F.round("eer", PLACES)})


@query(f"WITH {SQL_LOO} {SQL_TRIALS} {TABLE} FROM trials")
def loo_table(spark, d):
    return retrieval.retrieval_table(_trials(spark, d))


@query(f"WITH {SQL_LOO} {SQL_TRIALS} {RATES} {TABLE}, any_value(auc) AS auc, any_value(eer) AS eer FROM trials, rates")
def loo_full_table(spark, d):
    s = retrieval.side(passages(spark, d))
    return _table(retrieval.full_table(s, s))


@query(f"WITH {SQL_GALLERY} {SQL_TRIALS} {RATES} {TABLE}, any_value(auc) AS auc, any_value(eer) AS eer FROM trials, rates")
def gallery_query_table(spark, d):
    p = passages(spark, d)
    return _table(retrieval.full_table(retrieval.side(p.where("pid % 3 <> 0")), retrieval.side(p.where("pid % 3 = 0")), skip_self=False))


@query(f"WITH {SQL_LOO.replace('a.uid <> b.uid)', 'a.uid <> b.uid AND a.cohort = b.cohort)')} {SQL_TRIALS} {TABLE} FROM trials")
def source_pure_loo(spark, d):
    return retrieval.retrieval_table(_trials(spark, d, within="cohort"))


@query(f"WITH {SQL_LOO} {SQL_TRIALS} SELECT q, g AS match, round(score, 8) AS score, CASE WHEN same THEN 'HIT' ELSE 'MISS' END AS verdict FROM ranked WHERE rn = 1")
def nearest_passage(spark, d):
    return retrieval.nearest(_trials(spark, d)).select("q", "match", r("score"), "verdict")


@query("SELECT q, g, round(score, 8) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, g) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS g, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 3")
def nearest_segments(spark, d):
    """The three nearest other segments of each segment, cells that cannot reach left out."""
    s = retrieval.side(segments(spark, d), uid="vec_id")
    return neighbours.nearest_entries(s, s, 3).select("q", "g", r("score"), "rank")


@query(f"WITH {SQL_LOO} {SQL_TRIALS} SELECT p.uid, p.vessel, CASE WHEN n.q IS NULL THEN 'only passage' WHEN n.same THEN 'HIT' ELSE 'MISS' END AS verdict FROM passages p LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) n ON n.q = p.uid")
def retrieval_listing(spark, d):
    p = passages(spark, d)
    found = retrieval.nearest(retrieval.trials_against(p, p)).select(F.col("q").alias("uid"), "verdict")
    return p.join(found, "uid", "left").select("uid", "vessel", F.coalesce("verdict", F.lit("only passage")).alias("verdict"))


@query(f"WITH {SQL_GALLERY} {SQL_TRIALS} SELECT q, vessel, round(gen_score, 8) AS gen_score, round(best_imp, 8) AS best_imp, rank, top_match FROM trials")
def gallery_query_trials(spark, d):
    return _gallery(spark, d).select("q", "vessel", r("gen_score"), r("best_imp"), "rank", "top_match")


@query(f"WITH {SQL_GALLERY} {SQL_TRIALS} SELECT coalesce(vessel % 2, -1) AS cohort, count(*) AS n_queries, avg((rank = 1)::INT) AS rank1, round(avg(gen_score), 8) AS gen_mean, round(avg(best_imp), 8) AS imp_mean FROM trials GROUP BY GROUPING SETS ((vessel % 2), ())")
def cohort_block(spark, d):
    t = _gallery(spark, d).withColumn("cohort", F.col("vessel") % 2)
    sets = t.groupingSets([["cohort"], []], "cohort").agg(F.count("*").alias("n_queries"), F.avg((F.col("rank") == 1).cast("double")).alias("rank1"), F.round(F.avg("gen_score"), PLACES).alias("gen_mean"), F.round(F.avg("best_imp"), PLACES).alias("imp_mean"))
    return sets.withColumn("cohort", F.coalesce("cohort", F.lit(-1)))


def _sql_cohort(name: str, where: str) -> str:
    """One row of the cohort table: the queries of a cohort against the whole gallery."""
    scores = SQL_GALLERY.replace("a.pid % 3 <> 0 AND b.pid", f"{where} AND a.pid % 3 <> 0 AND b.pid")
    means = "(SELECT avg(r) FROM (SELECT avg((rank = 1)::INT) AS r FROM trials GROUP BY vessel)), 8) AS rank1_macro_vessel, median(rank) AS median_rank, any_value(auc) AS auc, any_value(eer) AS eer, round(avg(gen_score), 8) AS genuine_mean, (SELECT round(avg(score), 8) FROM imp) AS impostor_mean"
    return f"(WITH {scores} {SQL_TRIALS} {RATES} SELECT {name}::BIGINT AS cohort, count(*) AS n_queries, avg((rank = 1)::INT) AS rank1, round({means} FROM trials, rates)"


@query(" UNION ALL ".join(_sql_cohort(n, w) for n, w in (("NULL", "true"), ("0", "a.vessel % 2 = 0"), ("1", "a.vessel % 2 = 1"))))
def cohort_rates(spark, d):
    """The whole block of all queries and of each cohort, both rates included."""
    p = passages(spark, d)
    t = retrieval.cohort_table(retrieval.side(p.where("pid % 3 <> 0"), k=F.col("vessel") % 2), retrieval.side(p.where("pid % 3 = 0")))
    return t.select("cohort", "n_queries", "rank1", r("rank1_macro_vessel"), "median_rank", r("auc"), r("eer"), r("genuine_mean"), r("impostor_mean"))


def _sql_draw(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || id), 1, 12))::BIGINT % (SELECT count(*) FROM o)"


@query(f"""WITH {SQL_PASSAGES}, s AS (SELECT a.vessel = b.vessel AS same, list_dot_product(a.vec, b.vec) AS score FROM passages a JOIN passages b ON a.uid < b.uid),
v AS (SELECT score, count(*) FILTER (WHERE same) AS p, count(*) FILTER (WHERE NOT same) AS n FROM s GROUP BY score),
c AS (SELECT score, 1 - sum(p) OVER w / sum(p) OVER () AS fnr, sum(n) OVER w / sum(n) OVER () AS fpr FROM v WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
l AS (SELECT a.uid AS q, a.vessel = b.vessel AS same, row_number() OVER (PARTITION BY a.uid ORDER BY list_dot_product(a.vec, b.vec) DESC, b.uid) AS rn FROM scorable a JOIN passages b ON a.uid <> b.uid),
o AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY md5('9|' || vec_id), vec_id) - 1 AS i FROM embeddings),
d AS (SELECT id, {_sql_draw(9)} AS x, {_sql_draw(10)} AS y FROM range(20000) t(id)),
g AS (SELECT a.label = b.label AS same, list_dot_product(a.e, b.e) AS score FROM d JOIN o a ON a.i = x JOIN o b ON b.i = y WHERE x <> y)
SELECT round(avg(score) FILTER (WHERE same), 8) AS same, round(avg(score) FILTER (WHERE NOT same), 8) AS diff, round(avg(score) FILTER (WHERE same) - avg(score) FILTER (WHERE NOT same), 8) AS gap, avg((score < 0.5)::INT) FILTER (WHERE NOT same) AS diff_lt05,
(SELECT round(fpr, 8) FROM (SELECT * FROM c UNION ALL SELECT 'inf'::DOUBLE, 1, 0) ORDER BY abs(fnr - fpr), score DESC LIMIT 1) AS eer, (SELECT avg(same::INT) FROM l WHERE rn = 1) AS rank1,
(SELECT round(avg(score), 8) FROM g WHERE same) AS seg_same, (SELECT round(avg(score), 8) FROM g WHERE NOT same) AS seg_diff, (SELECT count(*) FROM passages) AS n_pass FROM s""")
def reid_report(spark, d):
    """Gap, error rate and rank-1 over passages with 20,000 drawn pairs of segments."""
    s = segments(spark, d)
    draw = etl.random_pairs(s.select("vec_id"), "vec_id", 20000, 9)
    a, b = (s.select(F.col("vec_id").alias(i), F.col("vessel").alias(f"v{i}"), F.col("vec").alias(f"e{i}")) for i in "ab")
    sampled = draw.join(a, "a").join(b, "b").select((F.col("va") == F.col("vb")).alias("same"), retrieval.dot("ea", "eb").alias("score"))
    t = retrieval.reid_report(retrieval.side(passages(spark, d)), sampled)
    return t.select(r("same"), r("diff"), r("gap"), "diff_lt05", r("eer"), "rank1", r("seg_same"), r("seg_diff"), "n_pass")


@query(f"WITH {SQL_LOO} {SQL_TRIALS}, v AS (SELECT vessel, avg((rank = 1)::INT) AS r1 FROM trials GROUP BY vessel) SELECT round(avg(r1), 8) AS rank1_macro_vessel, count(*) AS n_vessels FROM v")
def macro_rank1(spark, d):
    return retrieval.macro_rank1(_trials(spark, d)).select(r("rank1_macro_vessel"), "n_vessels")


@query(
    """WITH scores AS (SELECT a.vec_id AS q, b.vec_id AS g, a.label = b.label AS same, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, g) AS rn FROM scores)
SELECT q, round(max(score) FILTER (WHERE same), 8) AS gen_score, round(max(score) FILTER (WHERE NOT same), 8) AS best_imp, min(rn) FILTER (WHERE same) AS rank, min(g) FILTER (WHERE rn = 1) AS top_match FROM ranked GROUP BY q HAVING count(*) FILTER (WHERE same) > 0"""
)
def segment_trials(spark, d):
    s = segments(spark, d)
    return retrieval.trials_against(s, s, uid="vec_id").select("q", r("gen_score"), r("best_imp"), "rank", "top_match")


COLLAPSE = "CASE WHEN {0} IN (2, 3, 4) THEN 2 ELSE {0} END"


@query(f"WITH {SQL_LOO}, best AS (SELECT q, {COLLAPSE.format('qv')} AS own, {COLLAPSE.format('gv')} AS identity, max(score) AS score FROM scores GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, identity) AS rank FROM best) SELECT q, round(score, 8) AS score, rank FROM k WHERE identity = own")
def collapsed_identity_rank(spark, d):
    p = retrieval.scorable(passages(spark, d)).withColumn("own", F.expr(COLLAPSE.format("vessel")))
    every = passages(spark, d).withColumn("own", F.expr(COLLAPSE.format("vessel")))
    best = retrieval.identity_scores(retrieval.side(p, vessel="own"), retrieval.side(every, vessel="own"), skip_self=True).withColumn("identity", F.col("identity").cast("long"))
    return retrieval.identity_rank(best.join(p.select(F.col("uid").alias("q"), "own"), "q"), F.col("own")).select("q", r("score"), "rank")


@query(f"WITH {SQL_PASSAGES} SELECT a.uid AS q, b.uid AS g, round(list_dot_product(a.vec, b.vec), 8) AS score FROM passages a JOIN passages b ON a.uid < b.uid ORDER BY list_dot_product(a.vec, b.vec) DESC LIMIT 8")
def discovery_pairs(spark, d):
    return retrieval.top_pairs(retrieval.side(passages(spark, d)), 8).select("q", "g", r("score"))


@query(f"WITH {SQL_PASSAGES}, s AS (SELECT a.vessel = b.vessel AS same, list_dot_product(a.vec, b.vec) AS score FROM passages a JOIN passages b ON a.uid < b.uid) SELECT round(avg(score) FILTER (WHERE same), 8) AS same, round(avg(score) FILTER (WHERE NOT same), 8) AS diff, round(avg(score) FILTER (WHERE same) - avg(score) FILTER (WHERE NOT same), 8) AS gap, avg((score < 0.5)::INT) FILTER (WHERE NOT same) AS diff_below_half FROM s")
def pair_gap(spark, d):
    return metrics.pair_summary(_profile(spark, d)).select(r("same"), r("diff"), r("gap"), F.col("diff_below").alias("diff_below_half"))


@query(f"WITH {SQL_PASSAGES}, s AS (SELECT a.pid % 2 AS x, b.pid % 2 AS y, a.vessel = b.vessel AS same, list_dot_product(a.vec, b.vec) AS score FROM passages a JOIN passages b ON a.uid < b.uid), l AS (SELECT *, unnest(CASE WHEN x = y THEN [CASE WHEN x = 0 THEN 'OS' ELSE 'Glider' END, 'all'] ELSE ['cross', 'all'] END) AS slice FROM s) SELECT slice, count(*) AS n, round(avg(score) FILTER (WHERE same), 8) AS same, round(avg(score) FILTER (WHERE NOT same), 8) AS diff FROM l GROUP BY slice")
def platform_gap(spark, d):
    s = _profile(spark, d)
    label = F.when(F.col("a") != F.col("b"), "cross").when(F.col("a") == 0, "OS").otherwise("Glider")
    s = s.withColumn("slice", F.explode(F.array(label, F.lit("all"))))
    return metrics.pair_summary(s, ["slice"]).select("slice", "n", r("same"), r("diff"))


@query(f"WITH {SQL_PASSAGES}, s AS (SELECT a.vessel = b.vessel AS same, list_dot_product(a.vec, b.vec) AS score FROM passages a JOIN passages b ON a.uid < b.uid), h AS (SELECT same, least(floor((score + 0.2) / (1.2 / 49)), 48)::INT AS bin, count(*) AS n FROM s WHERE score BETWEEN -0.2 AND 1.0 GROUP BY ALL) SELECT same, bin, n, round(n / (sum(n) OVER (PARTITION BY same) * (1.2 / 49)), 8) AS density FROM h")
def cosine_histogram(spark, d):
    return metrics.histogram(_profile(spark, d)).select("same", "bin", "n", r("density"))


FUSED = """, z1 AS (SELECT *, (score - avg(score) OVER w) / CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN stddev_pop(score) OVER w ELSE 1 END AS z FROM scores WINDOW w AS (PARTITION BY q)),
z2 AS (SELECT *, (score - avg(score) OVER w) / CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN stddev_pop(score) OVER w ELSE 1 END AS z FROM scores2 WINDOW w AS (PARTITION BY q)),
f AS (SELECT z1.q, z1.g, z1.qv, z1.same, 0.5 * (z1.z + z2.z) AS score FROM z1 JOIN z2 ON z1.q = z2.q AND z1.g = z2.g)"""


@query(f"WITH {SQL_LOO} {FUSED} {SQL_TRIALS.replace('FROM scores)', 'FROM f)')} SELECT q, rank, top_match FROM trials")
def z_fusion(spark, d):
    return retrieval.fused_trials(retrieval.side(passages(spark, d)), retrieval.side(halves(spark, d))).select("q", "rank", "top_match")


@query(f"WITH {SQL_LOO} {SQL_TRIALS}, r2 AS (SELECT s.q, s.g, s.qv = b.vessel AS same, s.score, row_number() OVER (PARTITION BY s.q ORDER BY s.score DESC, s.g) AS rn FROM (SELECT x.*, a.vessel AS qv FROM scores2 x JOIN passages a ON a.uid = x.q) s JOIN passages b ON b.uid = s.g), t2 AS (SELECT q, min(rn) FILTER (WHERE same) AS rank, max(score) FILTER (WHERE same) AS gen_score FROM r2 GROUP BY q) SELECT count(*) FILTER (WHERE a.rank = 1 AND b.rank = 1) AS both, count(*) FILTER (WHERE a.rank = 1 AND b.rank <> 1) AS only_first, count(*) FILTER (WHERE a.rank <> 1 AND b.rank = 1) AS only_second, count(*) FILTER (WHERE a.rank <> 1 AND b.rank <> 1) AS neither, count(*) FILTER (WHERE b.rank < a.rank) AS second_better, round(corr(a.gen_score, b.gen_score), 6) AS score_correlation FROM trials a JOIN t2 b ON a.q = b.q")
def method_agreement(spark, d):
    a, b = _trials(spark, d), _trials(spark, d, halves)
    return metrics.agreement(a, b).withColumn("score_correlation", F.round("score_correlation", 6))


@query(f"WITH {SQL_GALLERY} {SQL_TRIALS} SELECT avg((rank <= 1)::INT) AS hit1, avg((rank <= 5)::INT) AS hit5, avg((rank <= 10)::INT) AS hit10, avg((rank <= 20)::INT) AS hit20, avg((p.vessel >= 4)::INT) AS top_is_trained FROM trials JOIN passages p ON p.uid = top_match WHERE trials.vessel < 4")
def holdout_hits(spark, d):
    p = passages(spark, d)
    t = retrieval.trials_against(p.where("pid % 3 <> 0 AND vessel < 4"), p.where("pid % 3 = 0"), skip_self=False)
    seen = p.select(F.col("uid").alias("top_match"), (F.col("vessel") >= 4).alias("trained"))
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double")).alias(f"hit{k}")
    return t.join(seen, "top_match").agg(hit(1), hit(5), hit(10), hit(20), F.avg(F.col("trained").cast("double")).alias("top_is_trained"))


SQL_DEPTH = f"""WITH {SQL_PASSAGES},
rest AS (SELECT a.uid AS q, a.vessel AS qv, a.vec AS qe, b.vec AS re, row_number() OVER (PARTITION BY a.uid ORDER BY b.pid, b.uid) AS k FROM scorable a JOIN passages b ON a.vessel = b.vessel AND a.uid <> b.uid),
ex AS (SELECT q, qv, k, generate_subscripts(re, 1) AS i, unnest(re) AS x FROM rest WHERE k <= 5),
run AS (SELECT q, qv, k, i, avg(x) OVER (PARTITION BY q, i ORDER BY k ROWS UNBOUNDED PRECEDING) AS m FROM ex),
pooled AS (SELECT q, qv, k, list(m ORDER BY i) AS m FROM run GROUP BY q, qv, k),
gen AS (SELECT p.q, p.qv, p.k, list_dot_product(list_transform(p.m, lambda z: z / (sqrt(list_sum(list_transform(p.m, lambda y: y * y))) + 1e-12)), s.vec) AS gen_score FROM pooled p JOIN scorable s ON s.uid = p.q),
imp AS (SELECT s.uid AS q, list_dot_product(s.vec, g.vec) AS s FROM scorable s JOIN passages g ON g.pid = 0 AND g.vessel <> s.vessel),
t AS (SELECT gen.q, qv, k, gen_score, max(s) AS best_imp, 1 + count(*) FILTER (WHERE s > gen_score) AS rank, count(*) + 1 AS n_gallery FROM gen JOIN imp ON imp.q = gen.q GROUP BY gen.q, qv, k, gen_score)"""


def _depth(spark, d):
    p = passages(spark, d)
    return retrieval.depth_trials(p, p.where("pid = 0"), 64)


@query(SQL_DEPTH + " SELECT q, k, round(gen_score, 8) AS gen_score, round(best_imp, 8) AS best_imp, rank, n_gallery FROM t")
def gallery_depth_trials(spark, d):
    return _depth(spark, d).select("q", "k", r("gen_score"), r("best_imp"), "rank", "n_gallery")


@query(SQL_DEPTH + ", deep AS (SELECT *, max(k) OVER (PARTITION BY q) AS most FROM t) SELECT k, count(*) AS n_trials, avg((rank = 1)::INT) AS rank1, median(rank) AS median_rank, count(*) FILTER (WHERE most >= 4) AS n_fixed FROM deep GROUP BY k")
def gallery_depth_curve(spark, d):
    t = _depth(spark, d).withColumn("most", F.max("k").over(W.partitionBy("q")))
    return t.groupBy("k").agg(F.count("*").alias("n_trials"), F.avg((F.col("rank") == 1).cast("double")).alias("rank1"), F.median("rank").alias("median_rank"), F.count_if(F.col("most") >= 4).alias("n_fixed"))


SQL_NEAREST = "(SELECT round(avg(CASE WHEN a.gen_score > b.best_imp THEN 1.0 WHEN a.gen_score = b.best_imp THEN 0.5 ELSE 0 END), 8) FROM trials a, trials b)"
SQL_SELF = SQL_PASSAGES + ", scores AS (SELECT a.uid AS q, b.uid AS g, {0} AS qv, {1} AS gv, {0} = {1} AS same, list_dot_product(a.vec, b.vec) AS score FROM passages a, passages b WHERE a.pid > 0 AND b.pid = 0)"
RAW, COLLAPSED = (SQL_SELF.format(*(c.format(f"{s}.vessel") for s in "ab")) for c in ("{0}", COLLAPSE))


@query(f"WITH {RAW} {SQL_TRIALS} SELECT count(*) AS n_queries, avg((rank = 1)::INT) AS rank1, {SQL_NEAREST} AS auc, round(avg(gen_score), 8) AS genuine_mean, (SELECT round(avg(score), 8) FROM scores WHERE NOT same) AS impostor_mean FROM trials")
def self_match(spark, d):
    """Each vessel's later sessions against the first ones of all: one genuine entry a query."""
    p = passages(spark, d)
    q, g = retrieval.side(p.where("pid > 0")), retrieval.side(p.where("pid = 0"))
    rows = retrieval.sizes(q, g)
    t = retrieval.tiled_trials(q, g, skip_self=False, rows=rows).persist()  # a row a query, read three times
    every = retrieval.row_stats(q, g, skip_self=False, rows=rows).agg(F.sum(F.col("mean")).alias("total"), F.count("*").alias("n")).crossJoin(g.agg(F.count("*").alias("n_gallery")))
    rows = t.agg(F.count("*").alias("n_queries"), F.avg((F.col("rank") == 1).cast("double")).alias("rank1"), F.sum("gen_score").alias("genuine"))
    table = rows.crossJoin(every).crossJoin(metrics.nearest_impostor_auc(t).select("auc"))  # one row each
    rest = (F.col("total") * F.col("n_gallery") - F.col("genuine")) / (F.col("n") * F.col("n_gallery") - F.col("n_queries"))
    return table.select("n_queries", "rank1", r("auc"), F.round(F.col("genuine") / F.col("n_queries"), PLACES).alias("genuine_mean"), F.round(rest, PLACES).alias("impostor_mean"))


@query(" UNION ALL ".join(f"(WITH {sql} {SQL_TRIALS} SELECT '{name}' AS identities, count(*) AS n_queries, avg((rank = 1)::INT) AS rank1, {SQL_NEAREST} AS auc FROM trials)" for name, sql in (("raw", RAW), ("collapsed", COLLAPSED))))
def raw_vs_collapsed(spark, d):
    p = passages(spark, d)

    def scored(name, identity):
        own = p.withColumn("own", F.expr(identity))
        t = retrieval.trials_against(own.where("pid > 0"), own.where("pid = 0"), vessel="own", skip_self=False)
        t = t.persist()
        return t.agg(F.lit(name).alias("identities"), F.count("*").alias("n_queries"), F.avg((F.col("rank") == 1).cast("double")).alias("rank1")).crossJoin(metrics.nearest_impostor_auc(t).select(r("auc")))

    return scored("raw", "vessel").unionByName(scored("collapsed", COLLAPSE.format("vessel")))


@query(f"WITH {SQL_LOO} {SQL_TRIALS}, b AS (SELECT q FROM scores GROUP BY q HAVING max(abs(score)) > 1e-8) SELECT count(*) AS n_bearing, avg((rank = 1)::INT) AS rank1 FROM trials WHERE q IN (SELECT q FROM b)")
def signature_rank1(spark, d):
    """Rank-1 over the queries that have any score at all."""
    s = retrieval.side(passages(spark, d))
    bearing = retrieval.row_stats(s, s).where("largest > 1e-8").select("q")
    return _trials(spark, d).join(bearing, "q", "left_semi").agg(F.count("*").alias("n_bearing"), F.avg((F.col("rank") == 1).cast("double")).alias("rank1"))


@query(f"WITH {SQL_PASSAGES}, s AS (SELECT a.cohort AS x, a.vessel = b.vessel AS same, list_dot_product(a.vec, b.vec) AS score FROM passages a JOIN passages b ON a.uid < b.uid AND a.cohort = b.cohort), g AS (SELECT x, avg(score) FILTER (WHERE same) - avg(score) FILTER (WHERE NOT same) AS gap FROM s GROUP BY x) SELECT round(a.gap, 8) AS train_gap, round(b.gap, 8) AS val_gap, round(a.gap - b.gap, 8) AS spread FROM g a, g b WHERE a.x = 0 AND b.x = 1")
def gap_spread(spark, d):
    """Gap of the train cohort less the gap of the val cohort."""
    s = retrieval.pair_profile(retrieval.side(passages(spark, d), scope=F.col("cohort"))).where("a = b")
    gap = lambda x: F.max(F.when(F.col("a") == x, F.col("gap")))
    return metrics.pair_summary(s, ["a"]).agg(F.round(gap(0), PLACES).alias("train_gap"), F.round(gap(1), PLACES).alias("val_gap"), F.round(gap(0) - gap(1), PLACES).alias("spread"))


SQL_HALF = SQL_LOO.replace("scores AS (SELECT", "scores0 AS (SELECT", 1).replace("scores2 AS (SELECT a.uid AS q, b.uid AS g, list_dot", "scores AS (SELECT a.uid AS q, b.uid AS g, a.vessel AS qv, b.vessel AS gv, a.vessel = b.vessel AS same, list_dot")


@query(" UNION ALL ".join(f"(WITH {sql} {SQL_TRIALS} SELECT '{name}' AS model, count(*) AS n_queries, avg((rank <= 1)::INT) AS rank1, median(rank) AS median_rank FROM trials)" for name, sql in (("before", SQL_HALF), ("after", SQL_LOO))))
def two_models(spark, d):
    """Two models over the same trials."""
    both = _trials(spark, d, halves).withColumn("model", F.lit("before")).unionByName(_trials(spark, d).withColumn("model", F.lit("after")))
    return both.groupBy("model").agg(F.count("*").alias("n_queries"), F.avg((F.col("rank") <= 1).cast("double")).alias("rank1"), F.median("rank").alias("median_rank"))


SQL_IDENTIFY = ", best AS (SELECT q, gv AS vessel, max(score) AS score FROM scores GROUP BY q, gv), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vessel) AS rank FROM best)"


@query(f"WITH {SQL_GALLERY} {SQL_IDENTIFY} SELECT q, vessel, round(score, 8) AS score, rank FROM k WHERE rank <= 5")
def enrol_identify(spark, d):
    p = passages(spark, d)
    return enrol.identify(p.where("pid % 3 <> 0"), p.where("pid % 3 = 0")).select("q", "vessel", r("score"), "rank")


@query(f"WITH {SQL_GALLERY} {SQL_IDENTIFY}, b2 AS (SELECT a.uid AS q, b.vessel, max(list_dot_product(a.vec[1:32], b.vec[1:32])) AS score FROM passages a, passages b WHERE a.pid % 3 <> 0 AND b.pid % 3 = 0 GROUP BY a.uid, b.vessel), k2 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vessel) AS rank FROM b2) SELECT k.q, k.vessel, k.rank AS rank_a, k2.rank AS rank_b FROM k JOIN k2 ON k.q = k2.q AND k.vessel = k2.vessel WHERE k.rank <= 3 AND k2.rank <= 3")
def agreement_tag(spark, d):
    p, h = passages(spark, d), halves(spark, d)
    a = enrol.identify(p.where("pid % 3 <> 0"), p.where("pid % 3 = 0"), 3)
    b = enrol.identify(h.where("pid % 3 <> 0"), h.where("pid % 3 = 0"), 3)
    return enrol.agreed(a, b)


# --- verification ------------------------------------------------------------------------------------------

PAIRS = "FROM scores a, scores b WHERE a.genuine AND NOT b.genuine"


@query(f"WITH {SQL_SCORES} SELECT (SELECT count(*) FROM scores WHERE genuine) AS n_genuine, (SELECT count(*) FROM scores WHERE NOT genuine) AS n_impostor, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 8) AS auc {PAIRS}")
def auc_mann_whitney(spark, d):
    return metrics.auc(trial_scores(spark, d)).select("n_genuine", "n_impostor", r("auc"))


@query(f"WITH {SQL_SCORES} SELECT a.lang, count(DISTINCT a.doc_id) AS n_genuine, count(DISTINCT b.doc_id) AS n_impostor, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 8) AS auc {PAIRS} AND a.lang = b.lang GROUP BY a.lang")
def auc_by_language(spark, d):
    return metrics.auc(trial_scores(spark, d), ["lang"]).where("auc IS NOT NULL").select("lang", "n_genuine", "n_impostor", r("auc"))


@query(f"WITH {SQL_SCORES}, x AS (SELECT lang, row_number() OVER v AS pos, 1 - sum(genuine::INT) OVER w / sum(genuine::INT) OVER (PARTITION BY lang) AS fnr, sum((NOT genuine)::INT) OVER w / sum((NOT genuine)::INT) OVER (PARTITION BY lang) AS fpr FROM (SELECT *, count(*) FILTER (WHERE genuine) OVER (PARTITION BY lang) AS tp, count(*) OVER (PARTITION BY lang) AS t FROM scores) WHERE tp > 0 AND tp < t WINDOW v AS (PARTITION BY lang ORDER BY score DESC, genuine DESC), w AS (PARTITION BY lang ORDER BY score DESC, genuine DESC ROWS UNBOUNDED PRECEDING)), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY abs(fnr - fpr), pos) AS rn FROM x) SELECT lang, round((fnr + fpr) / 2, 8) AS eer FROM k WHERE rn = 1")
def eer_by_language(spark, d):
    return metrics.eer_sorted(trial_scores(spark, d), ["lang"]).select("lang", r("eer"))


@query(f"WITH {SQL_LOO} {SQL_TRIALS}, h AS (SELECT s.q, s.g, s.score, a.vessel = b.vessel AS same FROM scores2 s JOIN passages a ON a.uid = s.q JOIN passages b ON b.uid = s.g), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, g) AS rn FROM h), t2 AS (SELECT q, min(rn) FILTER (WHERE same) AS rank FROM k GROUP BY q) SELECT t.q, t.rank AS rank_a, t2.rank AS rank_b FROM trials t JOIN t2 ON t2.q = t.q")
def aligned_methods(spark, d):
    """Both methods' ranks of the same queries; an error if one lacks a query."""
    both = etl.aligned(_trials(spark, d).select("q", "rank"), _trials(spark, d, halves).select("q", "rank"), ["q"])
    return both.select("q", "rank_a", "rank_b")


@query(f"WITH {SQL_GALLERY} {SQL_TRIALS}, b AS (SELECT 'cohort ' || vessel % 2 AS benchmark, avg((rank = 1)::INT) AS rank1, count(*) AS n_queries FROM trials GROUP BY ALL UNION ALL SELECT 'all', avg((rank = 1)::INT), count(*) FROM trials) SELECT *, row_number() OVER (ORDER BY rank1 DESC, benchmark) AS place FROM b")
def benchmark_order(spark, d):
    t = _gallery(spark, d).withColumn("benchmark", F.explode(F.array(F.concat(F.lit("cohort "), (F.col("vessel") % 2).cast("string")), F.lit("all"))))
    return etl.benchmark_order(t.groupBy("benchmark").agg(F.avg((F.col("rank") == 1).cast("double")).alias("rank1"), F.count("*").alias("n_queries")))


@query(f"WITH {SQL_LOO} {SQL_TRIALS} SELECT round(avg(CASE WHEN a.gen_score > b.best_imp THEN 1.0 WHEN a.gen_score = b.best_imp THEN 0.5 ELSE 0 END), 8) AS auc FROM trials a, trials b")
def auc_nearest_impostor(spark, d):
    return metrics.nearest_impostor_auc(_trials(spark, d)).select(r("auc"))


@query(f"WITH {SQL_SCORES}, x AS (SELECT row_number() OVER (ORDER BY score DESC, genuine DESC) AS pos, 1 - sum(genuine::INT) OVER w / sum(genuine::INT) OVER () AS fnr, sum((NOT genuine)::INT) OVER w / sum((NOT genuine)::INT) OVER () AS fpr FROM scores WINDOW w AS (ORDER BY score DESC, genuine DESC ROWS UNBOUNDED PRECEDING)) SELECT round((fnr + fpr) / 2, 8) AS eer FROM x ORDER BY abs(fnr - fpr), pos LIMIT 1")
def eer_sorted(spark, d):
    return metrics.eer_sorted(trial_scores(spark, d)).select(r("eer"))


SQL_SWEEP = f"""WITH {SQL_SCORES}, t AS (SELECT DISTINCT score AS tau FROM scores),
c AS (SELECT tau, count(*) FILTER (WHERE genuine AND score >= tau) AS tp, count(*) FILTER (WHERE NOT genuine AND score >= tau) AS fp, count(*) FILTER (WHERE genuine AND score < tau) AS fn, count(*) FILTER (WHERE NOT genuine AND score < tau) AS tn FROM t, scores GROUP BY tau),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS false_alarm, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c)"""


@query(SQL_SWEEP + " SELECT tau, tp, fp, fn, tn, round(precision, 8) AS precision, round(recall, 8) AS recall, round(false_alarm, 8) AS false_alarm, round(f1, 8) AS f1 FROM s")
def confusion_sweep(spark, d):
    return metrics.sweep(trial_scores(spark, d)).select("tau", "tp", "fp", "fn", "tn", r("precision"), r("recall"), r("false_alarm"), r("f1"))


@query(SQL_SWEEP + " SELECT tau, round(f1, 8) AS f1 FROM s ORDER BY s.f1 DESC, tau LIMIT 1")
def f1_optimum(spark, d):
    return metrics.f1_optimum(metrics.sweep(trial_scores(spark, d))).select("tau", r("f1"))


@query(SQL_SWEEP + " SELECT round((false_alarm + 1 - recall) / 2, 8) AS eer FROM s ORDER BY abs(false_alarm - (1 - recall)), tau LIMIT 1")
def eer_threshold(spark, d):
    return metrics.eer_threshold(metrics.sweep(trial_scores(spark, d))).select(r("eer"))


@query(SQL_SWEEP + " SELECT round(false_alarm, 8) AS eer FROM s ORDER BY abs(false_alarm - (1 - recall)), tau DESC LIMIT 1")
def eer_roc(spark, d):
    return metrics.eer_roc(metrics.sweep(trial_scores(spark, d))).select(r("eer"))


@query(SQL_SWEEP + " SELECT tau, round(recall, 8) AS recall, round(false_alarm, 8) AS false_alarm FROM s ORDER BY round(abs((1 - round(s.recall, 4)) - round(s.false_alarm, 4)), 9), tau LIMIT 1")
def eer_sweep_row(spark, d):
    return metrics.sweep_eer_row(metrics.sweep(trial_scores(spark, d))).select("tau", r("recall"), r("false_alarm"))
