"""Mixing sources to target weights: hash-threshold histograms, DataFrame functions only.

A document's rank in its source is a 52-bit hash of its id and text, so "the documents below a
threshold" is a sample of the source, and larger budgets give supersets. The threshold that meets a
budget comes from a histogram of words by source and hash bucket: the bucket in which the running sum
crosses the budget is cut into finer buckets, and only its rows are read again, until a bucket is one hash.
Nothing is sorted but bucket numbers, and documents are chosen by a filter on the hash.

Defined cases: null text has size 0; the null source is a source, last in order; sources without
words get target 0; rows equal in id and text have one hash and are taken together; documents without
words are taken 0 words; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.llm.common import word_count
from paneltide.scale import staged

HASH_BITS = 52
#: Bits of the hash that each histogram level resolves. The last level sees a 2^-26 part of a source at most.
LEVELS = (13, 13, 26)
TOP = 1 << HASH_BITS
PASSES = 2


def rank_hash(doc_id: Column, text: Column) -> Column:
    """52 bits of the MD5 of id and text, the same in other engines."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """What the thresholds are found from: source, size in words, hash."""
    return docs.select("source", word_count(F.col("text")).alias("size"),
                       rank_hash(F.col("doc_id"), F.col("text")).alias("hash"))


def targets(sizes: DataFrame, share: float, weights: Sequence[int], cap: float) -> DataFrame:
    """Per source: source_size and target. One row a source from here on.

    Resharing the excess of capped sources until none is above its cap ends where every source gets
    min(cap * size, level * weight); sources are capped in the order of cap * size / weight, so the
    level comes from running sums in that order.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (nth - 1) % len(weights) + 1))
    by = by.withColumn("_full_at", F.lit(cap) * F.col("source_size") / F.col("_w"))
    order = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.lit(share) * F.sum("source_size").over(Window.partitionBy())
              - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(rest))
    by = by.withColumn("_level", level)
    by = by.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "source", "_level")))
                       .over(Window.partitionBy())["_level"])
    capped = F.lit(cap) * F.col("source_size")
    return by.select("source", "source_size", F.least(capped, F.coalesce(F.col("_level") * F.col("_w"), capped)).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source: the largest hash threshold whose documents sum to `budget` at most, and their sum `used`."""
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("used"))
    left = HASH_BITS
    for bits in LEVELS:
        left -= bits
        width = 1 << left
        found = state.withColumnRenamed("source", "_source")
        inside = rows.join(found, F.col("source").eqNullSafe(F.col("_source"))).where(
            (F.col("hash") >= F.col("base")) & (F.col("hash") < F.col("base") + F.lit(width << bits)))
        bins = inside.groupBy("source", ((F.col("hash") - F.col("base")) / F.lit(width)).cast("long").alias("_bin")).agg(
            F.sum("size").alias("_size"), F.first("base").alias("base"), F.first("used").alias("used"),
            F.first("budget").alias("budget"))
        run = F.col("used") + F.sum("_size").over(Window.partitionBy("source").orderBy("_bin"))
        bins = bins.withColumn("_fits", run <= F.col("budget"))
        step = bins.groupBy("source").agg(
            F.min(F.when(~F.col("_fits"), F.col("_bin"))).alias("_cross"),
            F.coalesce(F.sum(F.when(F.col("_fits"), F.col("_size"))), F.lit(0)).alias("_more"),
        ).withColumnRenamed("source", "_source")
        state = staged(state.join(step, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "budget",
            F.when(F.col("_cross").isNull(), F.lit(TOP)).otherwise(F.col("base") + F.col("_cross") * width).alias("base"),
            (F.col("used") + F.coalesce("_more", F.lit(0))).alias("used")), "mix")
    return state.select("source", F.col("base").alias("threshold"), "used")


def plan(docs: DataFrame, share: float = 1.5, weights: Sequence[int] = (3, 1, 2), cap: float = 2.0,
         passes: int = PASSES) -> DataFrame:
    """Per source: source_size, target, whole rounds `full`, and per pass a size limit and a hash threshold.

    The first pass takes documents by hash while they fit into what whole rounds leave of the target. A long
    document at the threshold can leave a gap; later passes fill it with documents of at most the gap's size.
    """
    rows = staged(measured(docs), "mix_sizes").where(F.col("size") > 0)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = staged(targets(rows.unionByName(docs.select("source", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("hash"))),
                           share, weights, cap).withColumn("full", full).withColumn(
        "budget", F.col("target") - F.col("full") * F.col("source_size")).withColumn("passes", F.expr(
            "cast(array() as array<struct<size:double,threshold:bigint>>)")), "mix")
    for _ in range(passes):
        known = state.select(F.col("source").alias("_source"), "budget", "passes")
        left = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).where(
            (F.col("size") <= F.col("budget")) & ~chosen("size", "hash")).select("source", "size", "hash")
        found = thresholds(left, state.select("source", "budget")).withColumnRenamed("source", "_source")
        state = staged(state.join(found, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
            "passes", F.concat("passes", F.array(F.struct(F.col("budget").alias("size"), "threshold")))).withColumn(
            "budget", F.col("budget") - F.col("used")).drop("_source", "threshold", "used"), "mix")
    return state.select("source", "source_size", "target", "full", "passes")


def chosen(size: str, hashed: str, passes: str = "passes") -> Column:
    """True if any pass takes a document of that size and hash once more."""
    return F.exists(F.col(passes), lambda p: (F.col(size) <= p["size"]) & (F.col(hashed) < p["threshold"]))


def decided(docs: DataFrame, per_source: DataFrame) -> DataFrame:
    """docs with _size, _source_size, _target and _times, the number of times that the mix takes the row."""
    small = per_source.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"),
                              F.col("target").alias("_target"), F.col("full").alias("_full"), F.col("passes").alias("_passes"))
    out = docs.withColumns({"_size": word_count(F.col("text")), "_hash": rank_hash(F.col("doc_id"), F.col("text"))})
    out = out.join(small, F.col("source").eqNullSafe(F.col("_source")))
    more = F.when(chosen("_size", "_hash", "_passes"), 1).otherwise(0)
    return out.withColumn("_times", F.when(F.col("_size") > 0, F.col("_full") + more).otherwise(F.lit(0)).cast("int")).drop(
        "_source", "_hash", "_full", "_passes")


def mix(docs: DataFrame, share: float = 1.5, weights: Sequence[int] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, times, taken."""
    narrow = docs.select("doc_id", "text", "source")
    out = decided(narrow, plan(narrow, share, weights, cap))
    return out.select("doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                      F.col("_target").alias("target"), F.col("_times").alias("times"),
                      (F.col("_size") * F.col("_times")).cast("long").alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, weights: Sequence[int] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken. Their columns travel in one struct, so no name clashes."""
    names = docs.columns
    held = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    out = decided(held, plan(docs.select("doc_id", "text", "source"), share, weights, cap)).where("_times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[F.col("_row").getField(c).alias(c) for c in names])
