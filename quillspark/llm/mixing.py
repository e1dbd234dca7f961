"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import settle

#: Fixed values of the query: weights by rank of the source, repeating; the share of all sizes; most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
WORDS = r"[^\x20\x09-\x0D]+"
#: A hash has HASH_BITS bits; each histogram looks at STEP_BITS of them, the next one inside the boundary bucket only.
HASH_BITS, STEP_BITS = 48, 12


def size_of(text: str = "text") -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """48 bits that depend on the id and the text."""
    both = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, target) of (source, source_size), one row per source.

    Targets are in proportion to the weights until one reaches ``most`` times its source's size; what is over goes to
    the rest by weight. So a source is capped if the budget reaches the level at which it is. Windows run over one row
    per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("sid", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("sid", F.lit(len(weights))) + F.lit(len(weights)) - 1).cast("int") % len(weights) + 1).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    every = W.partitionBy(F.lit(0))
    by_level = every.orderBy("level", "sid")
    level = ranked.withColumn("level", F.col("cap") / F.col("weight")).withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    capped = level.withColumn("capped", before + F.col("level") * after <= F.col("budget"))
    left = F.col("budget") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(left / free * F.col("weight"))
    return capped.select("source", "sid", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with copies and threshold: a document is taken ``copies`` times, once more if its hash is less.

    ``rows`` has sid, size and h. The whole passes of a source come off its target; a histogram of sizes by hash bucket
    finds the bucket in which what remains runs out, and the next one refines that bucket alone, down to single hashes.
    Its boundary hash is taken if that comes nearer to the target.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    bounds = plan.select("sid", "budget", F.lit(0).cast("long").alias("prefix"))
    for used in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        shift = HASH_BITS - used
        inside = rows.join(bounds, "sid").where(F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
        buckets = inside.groupBy("sid", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        reached = F.sum("n").over(W.partitionBy("sid").orderBy("bucket"))
        boundary = buckets.withColumn("reached", reached).where("reached > budget")
        first = boundary.groupBy("sid").agg(F.min_by(F.struct("bucket", "n", (F.col("budget") - F.col("reached") + F.col("n")).alias("rest")), "bucket").alias("b"))
        bounds = settle(first.select("sid", F.col("b.rest").alias("budget"), F.col("b.bucket").alias("prefix"), F.col("b.n").alias("n")), "bounds")
    # A source without a boundary has no budget left after its whole passes: it takes no hash.
    over = F.when(F.col("rest") * 2 >= F.col("n"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    last = bounds.withColumnRenamed("budget", "rest")
    return plan.join(last, "sid", "left").select("source", "sid", "source_size", "target", "copies", F.coalesce(over, F.lit(0)).alias("threshold"))


def plan_mix(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(narrow rows with doc_id, source, size, h; the plan of each source)."""
    rows = settle(docs.select("doc_id", "source", size_of().alias("size"), hash_of().alias("h")), "sizes")
    sources = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **options), "sources")
    keyed = rows.join(sources.select("source", "sid"), rows.source.eqNullSafe(sources.source)).select("sid", "size", "h")
    return rows, settle(thresholds(keyed, sources), "mix")


def _times(copies: str = "copies", h: str = "h", threshold: str = "threshold") -> Column:
    return F.col(copies) + F.when(F.col(h) < F.col(threshold), 1).otherwise(0)


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies, one row per row of ``docs``.

    Sizes are words of whole texts, 0 for a null text. Sources go by code point with null as the last one; a source of
    size 0 has target 0. The hash is one of id and text, so reruns agree and rows of one id are told apart; rows equal
    in both go together. No document is taken more than twice. An empty table gives an empty result, other columns are
    ignored.
    """
    rows, plan = plan_mix(docs, **options)
    joined = rows.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return joined.select("doc_id", "size", "source_size", "target", (_times() * F.col("size")).cast("long").alias("taken"), _times().cast("long").alias("copies"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    _, plan = plan_mix(docs, **options)
    few = plan.select(F.col("source").alias("__qs_source"), F.col("copies").alias("__qs_copies"), F.col("threshold").alias("__qs_threshold"))
    joined = docs.withColumn("__qs_h", hash_of()).join(few, F.col("source").eqNullSafe(F.col("__qs_source")))
    times = joined.withColumn("__qs_times", _times("__qs_copies", "__qs_h", "__qs_threshold").cast("int")).where(F.col("__qs_times") > 0)
    return times.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__qs_times"))).alias("__qs_copy")).drop("__qs_copy")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM s),
w AS (SELECT *, ([5, 2, 1])[(sid - 1) % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM r),
l AS (SELECT *, cap / weight AS level, 1.5::DOUBLE * sum(source_size::DOUBLE) OVER () AS budget FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY level, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + level * sum(weight) OVER (ORDER BY level, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE
  (budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () * weight END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
q AS (SELECT p.source, h, sum(size) AS n, any_value(target - copies * source_size) AS budget
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source GROUP BY p.source, h),
u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS reached FROM q),
b AS (SELECT source, min_by(CASE WHEN (budget - reached + n) * 2 >= n THEN h + 1 ELSE h END, h) AS threshold
  FROM u WHERE reached > budget GROUP BY source)
SELECT d.doc_id, d.size, p.source_size, p.target,
  (d.size * (p.copies + CASE WHEN d.h < coalesce(b.threshold, 0) THEN 1 ELSE 0 END))::BIGINT AS taken,
  (p.copies + CASE WHEN d.h < coalesce(b.threshold, 0) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""
