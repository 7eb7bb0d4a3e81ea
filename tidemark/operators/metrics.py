"""Verification metrics over scores with a truth column. Each definition is kept apart: they differ on ties.

A score table has ``genuine`` (boolean) and ``score``. All but the nearest-impostor AUC first count the
scores by value, so what is sorted is the number of different values, not of trials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def counted(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Genuine and impostor trials at each score, a row a value."""
    return scores.groupBy(*(by or []), "score").agg(F.count_if("genuine").alias("p"), F.count_if(~F.col("genuine")).alias("n"))


#: Ranges into which running totals over all scores are split.
RANGES = 64


def running(c: DataFrame, by: list[str] | None = None, falling: bool = False) -> DataFrame:
    """Adds totals up to and including each score (``cp``, ``cn``) and of all scores (``tp``, ``tn``), of all rows or of each group.

    The values of a group are split into ranges: a total a range, carried over a few dozen rows a group, plus the running total inside
    the range. So no task holds all values, nor those of one large group.
    """
    by = by or []
    order = F.col("score").desc() if falling else F.col("score").asc()
    cuts = F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 100 * RANGES).alias("_b")
    if by:
        # a null group is a group
        keys = [F.struct(F.col(k).isNull(), F.col(k)).alias(f"_g{i}") for i, k in enumerate(by)]
        names = [f"_g{i}" for i in range(len(by))]
        c = c.select("*", *keys)
        x = c.join(c.groupBy(*names).agg(cuts), names)
    else:
        names = []
        x = c.crossJoin(F.broadcast(c.agg(cuts)))
    x = x.withColumn("_k", F.size(F.filter("_b", lambda b: b < F.col("score")))).drop("_b")
    parts = x.groupBy(*names, "_k").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    every = W.partitionBy(*names) if names else W.partitionBy(F.lit(1))
    before = every.orderBy(F.col("_k").desc() if falling else F.col("_k").asc()).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = parts.select(*names, "_k", F.coalesce(F.sum("sp").over(before), zero).alias("bp"), F.coalesce(F.sum("sn").over(before), zero).alias("bn"), F.sum("sp").over(every).alias("tp"), F.sum("sn").over(every).alias("tn"))
    upto = W.partitionBy(*names, "_k").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    inside = x.withColumns({"ip": F.sum("p").over(upto), "in_": F.sum("n").over(upto)})
    # without groups there are at most RANGES parts
    both = inside.join(parts, [*names, "_k"]) if names else inside.join(F.broadcast(parts), "_k")
    return both.select(*by, "score", "p", "n", (F.col("bp") + F.col("ip")).alias("cp"), (F.col("bn") + F.col("in_")).alias("cn"), "tp", "tn")


def auc(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney with average ranks: chance that a genuine score beats an impostor one, ties half; null without both."""
    return auc_counted(counted(scores, by), by)


def auc_counted(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``auc`` of trials counted by score (``score``, ``p``, ``n``)."""
    c = running(counts, by)
    wins = F.col("p") * (F.col("cn") - F.col("n") + F.col("n") / 2)
    out = c.groupBy(*(by or [])).agg(F.sum(wins).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(*(by or []), F.col("p").alias("n_genuine"), F.col("n").alias("n_impostor"), F.try_divide("w", F.col("p").cast("double") * F.col("n")).alias("auc"))


def nearest_impostor_auc(trials: DataFrame) -> DataFrame:
    """Every genuine score against every query's nearest impostor; both have a row a query."""
    long = trials.select(F.lit(True).alias("genuine"), F.col("gen_score").alias("score")).unionByName(trials.where("best_imp IS NOT NULL").select(F.lit(False).alias("genuine"), F.col("best_imp").alias("score")))
    return auc(long)


def eer_sorted(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row by row down the sorted scores (genuine first within a value): first least gap of miss and false-alarm rates, their mean.

    Within a value the rates move linearly along its genuine rows, then along its impostor rows, so the
    least gap is at an end of a stretch or where it crosses zero; every row is looked at by position.
    """
    return eer_counted(counted(scores, by), by)


def eer_counted(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``eer_sorted`` of trials counted by score; a group without trials of both kinds gives no row."""
    by = by or []
    c = running(counts, by, falling=True)
    c = c.select(*by, "score", "p", "n", (F.col("cp") - F.col("p")).alias("p0"), (F.col("cn") - F.col("n")).alias("n0"), "tp", "tn")
    # rows of a value: p genuine ones, then n impostor ones; the gap 1 - i/tp - j/tn falls along both
    zero_i = F.floor((1 - F.col("n0") / F.col("tn")) * F.col("tp")).cast("long") - F.col("p0")
    zero_j = F.floor((1 - (F.col("p0") + F.col("p")) / F.col("tp")) * F.col("tn")).cast("long") - F.col("n0")
    near = lambda z, m: F.array(*(F.least(F.greatest(z + d, F.lit(1)), m) for d in (-1, 0, 1, 2)))
    genuine = F.when(F.col("p") > 0, F.transform(F.array_union(F.array(F.lit(1).cast("long"), F.col("p")), near(zero_i, F.col("p"))), lambda i: F.struct((F.col("p0") + i).alias("i"), F.col("n0").alias("j"))))
    impostor = F.when(F.col("n") > 0, F.transform(F.array_union(F.array(F.lit(1).cast("long"), F.col("n")), near(zero_j, F.col("n"))), lambda j: F.struct((F.col("p0") + F.col("p")).alias("i"), (F.col("n0") + j).alias("j"))))
    none = F.array().cast("array<struct<i:bigint,j:bigint>>")
    rows = c.where("tp > 0 AND tn > 0").select(*by, "tp", "tn", F.explode(F.concat(F.coalesce(genuine, none), F.coalesce(impostor, none))).alias("at"))
    fnr, fpr = 1 - F.col("at.i") / F.col("tp"), F.col("at.j") / F.col("tn")
    rows = rows.select(*by, ((fnr + fpr) / 2).alias("eer"), F.abs(fnr - fpr).alias("gap"), (F.col("at.i") + F.col("at.j")).alias("pos"))
    return rows.groupBy(*by).agg(F.min_by("eer", F.struct("gap", "pos")).alias("eer"))


def sweep(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion at each different score as threshold (accepted from it up): counts, precision, recall, false alarm, F1; empty ratios are 0."""
    c = running(counted(scores, by), by, falling=True)
    c = c.select(*(by or []), F.col("score").alias("tau"), F.col("cp").alias("tp"), F.col("cn").alias("fp"), F.col("tp").alias("np"), F.col("tn").alias("nn"))
    c = c.withColumns({"fn": F.col("np") - F.col("tp"), "tn": F.col("nn") - F.col("fp")})
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b.cast("double")), F.lit(0.0))
    c = c.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("np")), "false_alarm": ratio("fp", F.col("nn"))})
    f1 = F.coalesce(F.try_divide(2 * F.col("tp").cast("double"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    return c.withColumn("f1", f1).select(*(by or []), "tau", "tp", "fp", "fn", "tn", "precision", "recall", "false_alarm", "f1")


def f1_optimum(swept: DataFrame) -> DataFrame:
    """The row with the highest F1, the lowest threshold of equals."""
    best = F.max_by(F.struct("tau", "precision", "recall", "false_alarm", "f1"), F.struct("f1", -F.col("tau")))
    return swept.agg(best.alias("b")).select("b.*")


def eer_threshold(swept: DataFrame) -> DataFrame:
    """Over the thresholds, rising: first least gap of false-accept and false-reject rates, their mean."""
    frr = 1 - F.col("recall")
    return swept.agg(F.min_by((F.col("false_alarm") + frr) / 2, F.struct(F.abs(F.col("false_alarm") - frr), F.col("tau"))).alias("eer"))


def eer_roc(swept: DataFrame) -> DataFrame:
    """The false-alarm rate at the least gap, thresholds falling; the point that accepts nothing is on the curve."""
    frr = 1 - F.col("recall")
    start = swept.agg(F.lit(0.0).alias("false_alarm"), F.lit(1.0).alias("frr"), F.lit(float("inf")).alias("tau"))
    points = swept.select("false_alarm", frr.alias("frr"), "tau").unionByName(start)
    return points.agg(F.min_by("false_alarm", F.struct(F.abs(F.col("false_alarm") - F.col("frr")), -F.col("tau"))).alias("eer"))


def sweep_eer_row(swept: DataFrame, places: int = 4) -> DataFrame:
    """The threshold whose rounded miss and false-alarm rates are nearest."""
    gap = F.abs((1 - F.round("recall", places)) - F.round("false_alarm", places))
    return swept.agg(F.min_by(F.struct("tau", "recall", "false_alarm"), F.struct(gap, F.col("tau"))).alias("b")).select("b.*")


def pair_summary(profile: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of a profile of pairs: pairs, mean score of same and of different ones, their gap, share of different pairs below the bound."""
    of = lambda same, c: F.sum(F.when(F.col("same") == same, F.col(c)))
    same, other = F.try_divide(of(True, "total"), of(True, "n")), F.try_divide(of(False, "total"), of(False, "n"))
    return profile.groupBy(*(by or [])).agg(F.sum("n").alias("n"), same.alias("same"), other.alias("diff"), (same - other).alias("gap"), F.try_divide(of(False, "under"), of(False, "n")).alias("diff_below"))


def histogram(profile: DataFrame, low: float = -0.2, high: float = 1.0, bins: int = 49) -> DataFrame:
    """Density by class of equal width, of same and of different pairs; what is outside counts in no class."""
    c = profile.where("bin >= 0").groupBy("same", F.col("bin").cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    return c.withColumn("density", F.col("n") / (F.sum("n").over(W.partitionBy("same")) * ((high - low) / bins)))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two methods on the same trials: both hit, only one, neither; how often the second ranks better; correlation of genuine scores."""
    t = a.select("q", F.col("rank").alias("ra"), F.col("gen_score").alias("sa")).join(b.select("q", F.col("rank").alias("rb"), F.col("gen_score").alias("sb")), "q")
    x, y = F.col("ra") == 1, F.col("rb") == 1
    varied = (F.stddev_pop("sa") > 0) & (F.stddev_pop("sb") > 0)
    mean_a, mean_b = F.avg("sa"), F.avg("sb")
    corr = F.when(varied, (F.avg(F.col("sa") * F.col("sb")) - mean_a * mean_b) / F.nullif(F.stddev_pop("sa") * F.stddev_pop("sb"), F.lit(0.0)))
    return t.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_first"), F.count_if(~x & y).alias("only_second"), F.count_if(~x & ~y).alias("neither"), F.count_if(F.col("rb") < F.col("ra")).alias("second_better"), corr.alias("score_correlation"))
