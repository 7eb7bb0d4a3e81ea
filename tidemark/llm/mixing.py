"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a token constraint: the words that the mix takes of it. Document rates maximise
the entropy relative to one copy each, bounded by ``CAP``, under these constraints; the solution is
an exponentially tilted rate ``CAP / (1 + exp(-dual * size / mean size))``, with one dual variable
a source, found by Newton steps on the convex dual. A rate depends on the source and the size
alone, so the steps run over the table of (source, size) counts, which is aggregated before any
shuffle and does not grow with the copies in it. Rates become whole copies by cumulative rounding
in order of size, so that the words taken of a source miss its target by less than one document;
a few last steps move copies of one size to close that gap.

Defined cases: a null text has size 0; documents without words are taken 0 words; a null source is
a source of its own, after all others; equal sizes are told apart by a hash of the id, then the id,
and rows that repeat in full share their copies in any order; an empty table gives an empty result.
Columns other than the id, the text, the source and the carried ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.blocks import cut

# Weights of the sources in order, repeating; share of all words that the mix takes; most copies of a document.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2
#: Newton stops at this relative error of the worst source, or after so many steps; closing steps after rounding; rows a bucket.
TOLERANCE, STEPS, CLOSING, BUCKET_ROWS = 1e-6, 40, 6, 200_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    """A null-free form of the source: nulls and the empty string stay apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def source_targets(counts: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Target of each source: shares by weight, stopped at ``cap`` times the source, the excess reshared.

    With sources in rising order of cap over weight, those whose cap lies under the level are full;
    the level is the largest of (words left) / (weight left) over that order. The table has a row a source.
    """
    sources = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    everyone = W.partitionBy(F.lit(1))
    rank = F.row_number().over(everyone.orderBy((F.col("key") == "").asc(), F.col("key")))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1))
    sources = sources.withColumn("limit", (cap * F.col("source_size")).cast("double"))
    by_limit = everyone.orderBy(F.col("limit") / F.col("weight"), "key")
    left = share * F.sum("source_size").over(everyone) - (F.sum("limit").over(by_limit.rowsBetween(W.unboundedPreceding, 0)) - F.col("limit"))
    level = F.max(left / F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing))).over(everyone)
    return sources.withColumn("level", level).select("key", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def _rate(cap: int) -> Column:
    tilt = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -F.col("dual") * F.col("size") / F.col("mean")))
    return F.when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), F.lit(float(cap))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(cap / (1 + F.exp(tilt)))


def solve_dual(counts: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """Newton iterations; each is one aggregation of the (source, size) counts to a row a source."""
    mean = counts.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    dual = cut(targets.join(mean, "key").select("key", "source_size", "target", F.greatest("mean", F.lit(1e-9)).alias("mean"), F.lit(0.0).alias("dual")))
    for _ in range(STEPS):
        rated = counts.join(dual, "key").withColumn("rate", _rate(cap))
        mass = F.col("n") * F.col("size") * F.col("rate")
        step = rated.groupBy("key", "source_size", "target", "mean", "dual").agg((F.sum(mass) - F.col("target")).alias("gap"), F.sum(mass * F.col("size") / F.col("mean") * (1 - F.col("rate") / cap)).alias("curve"))
        move = F.when(F.col("curve") > 1e-12, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("gap") / F.col("curve")))).otherwise(0.0)
        step = cut(step.select("key", "source_size", "target", "mean", "dual", "gap", (F.col("dual") - move).alias("next")))
        worst = step.agg(F.max(F.abs("gap") / F.greatest("target", F.lit(1.0)))).first()[0]
        if worst is None or worst <= TOLERANCE:
            return step.select("key", "source_size", "target", "mean", "dual")
        dual = step.select("key", "source_size", "target", "mean", F.col("next").alias("dual"))
    return dual


def round_copies(counts: DataFrame, dual: DataFrame, cap: int = CAP) -> DataFrame:
    """Copies of all documents of a (source, size) together: cumulative rounding, then copies of one size moved."""
    cells = counts.join(dual, "key").withColumn("rate", _rate(cap))
    falling = W.partitionBy("key").orderBy(F.col("size").desc())
    total = F.sum(F.col("n") * F.col("rate")).over(falling.rowsBetween(W.unboundedPreceding, 0))
    cells = cells.withColumn("upto", F.floor(total + 0.5 + 1e-9))
    cells = cells.withColumn("copies", F.least(F.greatest(F.col("upto") - F.coalesce(F.lag("upto").over(falling), F.lit(0)), F.lit(0)), cap * F.col("n"))).drop("upto")
    own = W.partitionBy("key")
    for _ in range(CLOSING):
        gap = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(own)
        cells = cells.withColumn("gap", gap)
        room = F.when(F.col("gap") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        many = F.least(room, F.greatest(F.round(F.abs("gap") / F.greatest("size", F.lit(1))), F.lit(1)).cast("long"))
        cells = cells.withColumn("many", F.when(F.col("size") > 0, many).otherwise(0))
        ahead = F.abs("gap") - F.abs(F.col("gap") - F.signum("gap") * F.col("many") * F.col("size"))
        cells = cells.withColumn("gain", F.when(F.col("many") > 0, ahead).otherwise(F.lit(-1.0)))
        first = F.row_number().over(own.orderBy(F.col("gain").desc(), "size"))
        cells = cells.withColumn("copies", F.when((first == 1) & (F.col("gain") > 0), F.col("copies") + F.signum("gap").cast("long") * F.col("many")).otherwise(F.col("copies")))
    return cells.select("key", "size", "n", "source_size", "target", "rate", "copies")


def mix_documents(docs: DataFrame, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Each document with its size, its source's size and target, its rate and its whole copies.

    The carried columns travel with the rows, so no join by id is made and repeated ids are safe; one whose name
    is the name of a result comes back as ``carried_`` and its name.
    """
    narrow = docs.select(F.col(id_col).alias("id"), _key(source_col).alias("key"), word_count(text_col).alias("size"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    if not carry:
        narrow = cut(narrow)
    counts = cut(narrow.groupBy("key", "size").agg(F.count("*").alias("n")))
    rows = counts.agg(F.sum("n")).first()[0] or 0
    cells = cut(round_copies(counts, solve_dual(counts, source_targets(counts, weights, share, cap), cap), cap))
    buckets = -(-rows // BUCKET_ROWS) or 1
    spread = F.xxhash64(F.col("id").cast("string"))
    narrow = narrow.withColumn("spread", spread).withColumn("bucket", F.pmod("spread", F.lit(buckets)).cast("int"))
    if buckets == 1:
        before = counts.select("key", "size", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("before"))
    else:
        base = cut(narrow.groupBy("key", "size", "bucket").agg(F.count("*").alias("m")))
        upto = F.sum("m").over(W.partitionBy("key", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        before = base.select("key", "size", "bucket", (upto - F.col("m")).alias("before"))
    plan = before.join(cells, ["key", "size"])
    place = F.row_number().over(W.partitionBy("key", "size", "bucket").orderBy("spread", "id"))
    out = narrow.withColumn("place", place).join(plan, ["key", "size", "bucket"])
    each = F.floor(F.col("copies") / F.col("n"))
    extra = (F.col("before") + F.col("place") <= F.col("copies") - each * F.col("n")).cast("long")
    taken = {id_col, "size", "source_size", "target", "taken", "rate", "copies"}
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", ((each + extra) * F.col("size")).cast("long").alias("taken"), "rate", (each + extra).cast("long").alias("copies"), *(F.col(f"c{i}").alias(f"carried_{c}" if c in taken else c) for i, c in enumerate(carry))
    )
