"""Roll-ups of children to parents and of fine periods to coarse ones.

All are grouped aggregations with a map-side partial step, so one hot parent or entity is reduced
before the shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.functions.scalar import col, ratio
from paneltide.operators.growth import filled_from_neighbours
from paneltide.operators.order import quantiles
from paneltide.scale import largest_group

REDUCERS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "median": F.median, "count": F.count}


def roll_up(children: DataFrame, bridge: DataFrame, child: str, parent: Sequence[str], values: Sequence[str],
            how: str = "sum", extra: Sequence[str] = ()) -> DataFrame:
    """Child values to parents through a bridge; children without a parent are dropped.

    ``extra`` are further grouping columns (usually the period).
    """
    if how not in REDUCERS:
        raise ValueError(f"unknown reducer {how!r}")
    joined = children.join(bridge.select(child, *parent), child)
    keys = [*parent, *extra]
    if how == "median":
        # An exact median keeps the values of a group together, so it goes through the size check.
        size = largest_group(joined, keys)
        parts = [quantiles(joined, keys, v, {v: 0.5}, size) for v in values]
        return reduce(lambda a, b: a.join(b, keys, "outer"), parts)
    return joined.groupBy(*keys).agg(*[REDUCERS[how](v).alias(v) for v in values])


def members_at(bridge: DataFrame, facts: DataFrame, child: str, period: str,
               valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Join facts to the bridge version that holds in their period (open ends are NULL)."""
    alive = ((F.col(valid_from).isNull() | (F.col(period) >= F.col(valid_from)))
             & (F.col(valid_to).isNull() | (F.col(period) <= F.col(valid_to))))
    return facts.join(bridge, child).filter(alive).drop(valid_from, valid_to)


def period_mean(df: DataFrame, keys: Sequence[str], date: str, value: str, at_least: int = 6,
                start: int | None = None, out: str = "value") -> DataFrame:
    """Yearly mean of a finer series, kept from ``start`` where enough observations exist."""
    got = df.groupBy(*keys, F.year(date).alias("period")).agg(F.avg(value).alias(out), F.count(value).alias("n_obs"))
    got = got.filter(F.col("n_obs") >= at_least)
    return got if start is None else got.filter(F.col("period") >= start)


def collapse(df: DataFrame, keys: Sequence[str], date: str, value: str, how: str = "mean") -> DataFrame:
    """One value per series and year: the mean or the last observation."""
    held = df.filter(F.col(value).isNotNull())
    if how == "mean":
        pick = F.avg(value)
    elif how == "last":
        pick = F.max_by(value, date)
    else:
        raise ValueError(f"unknown collapse {how!r}")
    return held.groupBy(*keys, F.year(date).alias("period")).agg(pick.alias("value"))


def complete_periods(df: DataFrame, keys: Sequence[str], value: str, part: str, parts: int,
                     how: str = "mean") -> DataFrame:
    """Aggregate only the groups that have every one of their parts (4 quarters, 12 months)."""
    got = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        REDUCERS[how](value).alias(value), F.count_distinct(part).alias("_parts"))
    return got.filter(F.col("_parts") == parts).drop("_parts")


def complete_membership_sum(facts: DataFrame, members: DataFrame, child: str, parent: str, value: str,
                            periods: Sequence[int], period: str = "period") -> DataFrame:
    """Parent sum per period, NULL unless every member is present with a value.

    Member rows per (parent, period) are counted from the bridge, not by expanding a grid.
    """
    size = members.groupBy(parent).agg(F.count(F.lit(1)).alias("_members"))
    sums = facts.join(members.select(child, parent), child).groupBy(parent, period).agg(
        F.count(value).alias("_have"), F.sum(value).alias("_sum"))
    grid = size.withColumn(period, F.explode(F.array(*[F.lit(p) for p in periods])))
    return (grid.join(sums, [parent, period], "left")
            .select(parent, period, F.when(F.col("_have") == F.col("_members"), F.col("_sum")).alias(value)))


def weighted_rollup(children: DataFrame, child: str, parent: str, value: str, weight: str,
                    period: str = "period") -> DataFrame:
    """Weighted mean per parent; a child's missing weights are filled from its own neighbours first."""
    held = children.withColumn("_w", filled_from_neighbours(weight, child, period)).filter(
        F.col(value).isNotNull() & F.col("_w").isNotNull())
    return held.groupBy(parent, period).agg(
        ratio(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias(value))


def total_and_average(size: str, level: str) -> list[Column]:
    """Total of ``size`` and the size-weighted average of ``level``; NULL without a total."""
    return [F.sum(size).alias(size), ratio(F.sum(F.col(size) * F.col(level)), F.sum(size)).alias(level)]


def concentration(value: str | Column) -> Column:
    """Sum of squared shares over the positive cells of a group."""
    x = F.when(col(value) > 0, col(value).cast("double"))
    return ratio(F.sum(x * x), F.sum(x) * F.sum(x))


def set_share(value: str | Column, member: Column) -> Column:
    """Share of the cells in a set; a zero or missing share is NULL."""
    share = ratio(F.sum(F.when(member, col(value))), F.sum(value))
    return F.when(share != 0, share)


def net_flow(inflow: DataFrame, outflow: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Inflow minus outflow, a side that lacks the key counts as zero.

    Both sides are signed, stacked and summed: the partial sums go before the one exchange.
    """
    flows = inflow.select(*keys, *values).unionByName(
        outflow.select(*keys, *[(-F.col(v)).alias(v) for v in values]))
    return flows.groupBy(*keys).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"net_{v}") for v in values])


def pooled_summary(df: DataFrame, outer: Sequence[str], inner: str, aggs: Sequence[Column],
                   label: str = "POOLED") -> DataFrame:
    """Aggregates by (outer, inner) plus one pooled row per outer group, over the same rows."""
    grouped = df.groupingSets([[F.col(c) for c in (*outer, inner)], [F.col(c) for c in outer]],
                              *[F.col(c) for c in (*outer, inner)])
    got = grouped.agg(F.grouping(inner).alias("_all"), *aggs)
    return got.withColumn(inner, F.when(F.col("_all") == 1, F.lit(label)).otherwise(F.col(inner))).drop("_all")


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-NULL cells per column, one row per column."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "share")


def coverage_by_period(df: DataFrame, columns: Sequence[str], period: str = "period") -> DataFrame:
    """Entities with a value per period and measure."""
    return df.groupBy(period).agg(*[F.count(c).alias(c) for c in columns]).unpivot(
        [period], list(columns), "measure", "n_entities")


def arg_max(df: DataFrame, group: Sequence[str], name: str, value: str) -> DataFrame:
    """Name of the best value per group, the first name on a tie, as one aggregation."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))
    held = df.filter(F.col(value).isNotNull())
    return (held.groupBy(*group) if group else held.groupBy()).agg(best.alias("b")).select(
        *group, F.col("b.n").alias(name), (-F.col("b.v")).alias(value))


def period_median(df: DataFrame, value: str, period: str = "period", out: str = "median",
                  bound: int | None = None) -> DataFrame:
    return quantiles(df, [period], value, {out: 0.5}, bound)
