"""Order statistics inside groups: positions, ranks, exact quantiles, top-k.

Every operator has two plans with equal results (see ``scale``). The split plan range-partitions
the rows on (group, order, row hash), fixes that placement in a written table, ranks
inside each (partition, group) slice and adds the rows of the earlier slices of the same group.
Ties that straddle slices are repaired from the first and last tie run of each slice, at most two
runs per slice, so no task ever holds a whole group. Carries take the last value of the earlier
slices in the same way. Quantiles of large groups are selected between brackets instead, without
placing or sorting the rows.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.scale import is_wide, join_groups, small_side, staged, task_row_limit

ALL_BEFORE = (Window.unboundedPreceding, -1)
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def _sort_key(value: str, descending: bool) -> Column:
    return F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()


#: Quantile brackets: half width and error of the sketch, as shares of the rows of a group.
BRACKET, SKETCH_ERROR = 0.001, 0.0001


def _placed(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows in written slices of (group, order, row hash), none longer than a task may hold: adds ``_part`` and ``_salt``."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / task_row_limit(spark)))
    salted = df.withColumn("_salt", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return staged(
        salted.repartitionByRange(parts, *[F.col(g) for g in group], *order, F.col("_salt"))
        .withColumn("_part", F.spark_partition_id()))


def _split_scan(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                weight: Column | None = None) -> DataFrame:
    """Adds ``_part`` plus 1-based ``_pos`` and ``_before`` (weight of all earlier rows)."""
    placed = _placed(df.withColumn("_w", F.lit(1.0) if weight is None else weight.cast("double")), group, order)
    slices = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_w").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(*ALL_BEFORE)
    offsets = small_side(slices.select(
        "_part", *group,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows0"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_sum0"),
    ))
    inside = Window.partitionBy("_part", *group).orderBy(*order, F.col("_salt"))
    local = placed.withColumn("_pos", F.row_number().over(inside)).withColumn(
        "_before", F.coalesce(F.sum("_w").over(inside.rowsBetween(*ALL_BEFORE)), F.lit(0.0)))
    return (join_groups(local, offsets, ["_part", *group])
            .withColumn("_pos", F.col("_pos") + F.col("_rows0"))
            .withColumn("_before", F.col("_before") + F.col("_sum0"))
            .drop("_rows0", "_sum0", "_salt", "_w"))


def split_ranks(df: DataFrame, group: Sequence[str], value: str, descending: bool,
                then: Sequence[Column] = (), weight: Column | None = None) -> DataFrame:
    """Split plan of the ranks of a non-NULL column: adds ``_first`` (lowest rank of the tie run),
    ``_ties`` (its length), ``_n`` (group size) and ``_before`` (weight of the rows ahead, ties ordered by ``then``).
    """
    scan = _split_scan(df, group, [_sort_key(value, descending), *then], weight)
    sliced = Window.partitionBy("_part", *group)
    run = Window.partitionBy("_part", *group, value)
    scan = scan.withColumns({
        "_first": F.min("_pos").over(run), "_ties": F.count(F.lit(1)).over(run),
        "_lo": F.min("_pos").over(sliced), "_hi": F.max("_pos").over(sliced)})
    edge = (F.col("_first") == F.col("_lo")) | (F.col("_first") + F.col("_ties") - 1 == F.col("_hi"))
    edges = small_side(
        scan.filter(edge).groupBy(*group, value)
        .agg(F.min("_pos").alias("_first_all"), F.count(F.lit(1)).alias("_ties_all")))
    sizes = small_side(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")))
    ranked = (join_groups(scan.drop("_lo", "_hi", "_part", "_pos"), edges, [*group, value], "left")
              .withColumn("_first", F.coalesce("_first_all", "_first"))
              .withColumn("_ties", F.coalesce("_ties_all", "_ties"))
              .drop("_first_all", "_ties_all"))
    return join_groups(ranked, sizes, list(group))


def add_positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "position",
                  bound: int | None = None) -> DataFrame:
    """1-based position of each row in its group under a total order."""
    if not is_wide(df, group, bound):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return (_split_scan(df, group, order).withColumn(name, F.col("_pos").cast("int"))
            .drop("_part", "_pos", "_before"))


def add_prefix_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: Column,
                   name: str, bound: int | None = None) -> DataFrame:
    """Sum of ``weight`` over the rows that come strictly earlier in a total order (0.0 first)."""
    if not is_wide(df, group, bound):
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(*ALL_BEFORE)
        return df.withColumn(name, F.coalesce(F.sum(weight.cast("double")).over(w), F.lit(0.0)))
    return _split_scan(df, group, order, weight).withColumnRenamed("_before", name).drop("_part", "_pos")


def add_ranks(df: DataFrame, group: Sequence[str], value: str, *, low: str | None = None,
              average: str | None = None, percent: str | None = None, descending: bool = True,
              bound: int | None = None) -> DataFrame:
    """Tie-aware ranks of the non-NULL values; NULL values get NULL ranks.

    ``low``: ties share the lowest rank. ``average``: ties share the mean rank. ``percent``:
    average rank over the count of non-NULL values, times 100 (not SQL ``percent_rank``).
    """
    if not is_wide(df, group, bound):
        whole = Window.partitionBy(*group)
        ordered = whole.orderBy(_sort_key(value, descending))
        first = F.rank().over(ordered)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
        total = F.count(value).over(whole)
        ranked = df.withColumns({"_first": first, "_ties": ties, "_n": total})
    else:
        ranked = split_ranks(df.filter(F.col(value).isNotNull()), group, value, descending).drop("_before")
        ranked = ranked.unionByName(df.filter(F.col(value).isNull()), allowMissingColumns=True)
    there = F.col(value).isNotNull()
    mean_rank = F.col("_first") + (F.col("_ties") - F.lit(1)) / F.lit(2.0)
    out = {}
    if low:
        out[low] = F.when(there, F.col("_first").cast("int"))
    if average:
        out[average] = F.when(there, mean_rank)
    if percent:
        out[percent] = F.when(there, F.try_divide(mean_rank, F.col("_n")) * F.lit(100.0))
    return ranked.withColumns(out).drop("_first", "_ties", "_n")


def carry_last(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str,
               bound: int | None = None) -> DataFrame:
    """Last non-NULL ``value`` of the group up to and including each row, in ascending order of the named columns.

    The split plan carries inside slices and starts every slice from the last value of the earlier ones.
    Rows equal in the order must be equal in ``value`` too, or their order is open.
    """
    steps = [F.col(c) for c in order]
    if not is_wide(df, group, bound):
        line = Window.partitionBy(*group).orderBy(*steps).rowsBetween(*UP_TO_HERE)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(line))
    placed = _placed(df, group, steps)
    ends = placed.groupBy("_part", *group).agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*steps, F.col(value).alias("_kept")))).alias("_end"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(*ALL_BEFORE)
    carried = small_side(ends.select("_part", *group, F.last("_end._kept", ignorenulls=True).over(earlier).alias("_carried")))
    line = Window.partitionBy("_part", *group).orderBy(*steps, "_salt").rowsBetween(*UP_TO_HERE)
    local = placed.withColumn(out, F.last(value, ignorenulls=True).over(line))
    return (join_groups(local, carried, ["_part", *group]).withColumn(out, F.coalesce(out, "_carried"))
            .drop("_part", "_salt", "_carried"))


def _selected(df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of large groups in two reads and no sort of the rows.

    A mergeable sketch brackets each wanted rank between two values of the group. The second read counts: inside a
    bracket per distinct value, outside per gap between brackets. Running sums over those cells find the ranks. A bracket
    holds about 2 * BRACKET of a group, and its error is a tenth of that; groups too small for brackets are counted value by value.
    """
    present = df.select(*group, value).filter(F.col(value).isNotNull())
    levels = sorted(set(probs.values()))
    ends = [(max(p - BRACKET, 0.0), min(p + BRACKET, 1.0)) for p in levels]
    sketch = lambda at: F.percentile_approx(value, F.array(*[F.lit(e) for e in at]), round(1 / SKETCH_ERROR))
    # one sketch for all ends: lows first, then highs; an end at 0 or 1 is open, ranks beyond it do not exist
    found = df.groupBy(*group).agg(F.count(value).alias("_n"), sketch([*(e[0] for e in ends), *(e[1] for e in ends)]).alias("_at"))
    brackets = small_side(found)
    k = len(levels)
    small = F.col("_n") * F.lit(BRACKET) <= 4
    ahead = [~small & (F.col(value) < F.col("_at")[i]) if ends[i][0] > 0 else F.lit(False) for i in range(k)]
    inside = small
    for i in range(k):
        past = F.col(value) > F.col("_at")[k + i] if ends[i][1] < 1 else F.lit(False)
        inside = inside | ~(ahead[i] | past)
    gap = sum((F.when(a, 0).otherwise(1) for a in ahead), F.lit(0))
    cells = staged(join_groups(present, brackets, list(group)).groupBy(*group, gap.alias("_gap"), F.when(inside, F.col(value)).alias("_held"))
                   .agg(F.count(F.lit(1)).alias("_rows")), "cells")
    placed = add_prefix_sum(cells, group, [F.col("_gap"), F.col("_held").asc_nulls_last()], F.col("_rows"), "_before")
    sizes = small_side(cells.groupBy(*group).agg(F.sum("_rows").alias("_n")))
    placed = join_groups(placed, sizes, list(group))
    cols = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        holds = lambda rank: (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_rows"))
        held = F.coalesce("_held", F.raise_error(F.lit("a rank fell outside its bracket")).cast("double"))
        low, high = (F.max(F.when(holds(rank + 1), held)) for rank in (F.floor(at), F.ceil(at)))
        share = F.max(at - F.floor(at))
        cols.append(F.when(share == 0, low).otherwise((F.lit(1.0) - share) * low + share * high).alias(name))
    return join_groups(brackets.select(*group), placed.groupBy(*group).agg(*cols), list(group), "left")


def quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float],
              bound: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group, one column per name.

    Groups of more rows than a task may hold are selected between brackets. A group without values gives NULL in both plans.
    """
    if not is_wide(df, group, bound):
        return df.groupBy(*group).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()])
    return _selected(df, group, value, probs)


def with_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float],
                   bound: int | None = None) -> DataFrame:
    """Attach group quantiles to every row."""
    if not is_wide(df, group, bound):
        w = Window.partitionBy(*group)
        return df.withColumns({n: F.percentile(value, F.lit(p)).over(w) for n, p in probs.items()})
    return join_groups(df, small_side(quantiles(df, group, value, probs, bound)), list(group), "left")


def winsorise(df: DataFrame, group: Sequence[str], value: str, limits: tuple[float, float] = (0.01, 0.99),
              out: str | None = None, bound: int | None = None) -> DataFrame:
    """Clip a column to its group quantiles; NULL stays NULL."""
    held = with_quantiles(df, group, value, {"_wlo": limits[0], "_whi": limits[1]}, bound)
    clipped = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("_wlo")), F.col("_whi")))
    return held.withColumn(out or value, clipped).drop("_wlo", "_whi")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
          position: str | None = None) -> DataFrame:
    """First k rows of each group. Spark limits each map task to k rows per group before the shuffle."""
    name = position or "_place"
    best = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(
        F.col(name) <= k)
    return best if position else best.drop(name)


def top_k_overlap(left: DataFrame, right: DataFrame, group: Sequence[str], entity: str, score: str,
                  k: int = 10, name: str = "overlap") -> DataFrame:
    """Size of the intersection of two top-k sets per group."""
    order = [F.col(score).desc_nulls_last(), F.col(entity)]
    a = top_k(left.filter(F.col(score).isNotNull()), group, order, k).select(*group, entity)
    b = top_k(right.filter(F.col(score).isNotNull()), group, order, k).select(*group, entity)
    shared = a.join(b, [*group, entity]).groupBy(*group).agg(F.count(F.lit(1)).alias(name))
    return (a.select(*group).distinct().join(shared, list(group), "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("int")))


def latest_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each group under an order given newest first."""
    return top_k(df, group, order, 1)
