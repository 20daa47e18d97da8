"""Time-shift operators on an (entity, period) panel.

(entity, period) is a key, so the history of one entity is at most as long as the number of
periods; windows over one entity stay small however many entities there are. Exact shifts are
value-range frames: period t finds period t - k itself or NULL, never a neighbour across a gap,
and every shift of every column shares one exchange on the entity.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.functions.scalar import col, ratio
from paneltide.operators.order import carry_last


def history(entity: str = "entity", period: str = "period"):
    return Window.partitionBy(entity).orderBy(period)


def shifted(value: str | Column, by: int, entity: str = "entity", period: str = "period") -> Column:
    """Value at exactly ``period + by`` of the same entity, NULL when that period is absent."""
    return F.first(col(value)).over(history(entity, period).rangeBetween(by, by))


def exact_growth(value: str | Column, lag: int = 1, entity: str = "entity", period: str = "period") -> Column:
    """x(t) / x(t - lag) - 1; NULL if the earlier period is absent or zero."""
    return ratio(value, shifted(value, -lag, entity, period)) - F.lit(1.0)


def exact_difference(value: str | Column, lag: int = 1, entity: str = "entity", period: str = "period") -> Column:
    return col(value) - shifted(value, -lag, entity, period)


def forward_growth(value: str | Column, ahead: int, entity: str = "entity", period: str = "period") -> Column:
    """x(t + ahead) / x(t) - 1 where x(t) > 0."""
    return ratio(shifted(value, ahead, entity, period), value, positive=True) - F.lit(1.0)


def guarded_change(df: DataFrame, value: str, out: str, kind: str = "growth",
                   entity: str = "entity", period: str = "period") -> DataFrame:
    """Drop missing values first, keep only changes between consecutive periods."""
    held = df.select(entity, period, value).filter(F.col(value).isNotNull())
    change = exact_growth(value, 1, entity, period) if kind == "growth" else exact_difference(value, 1, entity, period)
    return held.withColumn(out, change).select(entity, period, out).filter(F.col(out).isNotNull())


def adjacent_growth(value: str, entity: str = "entity", order: str = "period") -> Column:
    """Growth over the previous row present, whatever its distance."""
    return ratio(value, F.lag(value).over(Window.partitionBy(entity).orderBy(order))) - F.lit(1.0)


def trailing_mean(value: str, span: int = 3, at_least: int = 2, entity: str = "entity",
                  period: str = "period") -> Column:
    """Mean over the periods t - span + 1 .. t that are present, NULL below ``at_least`` of them."""
    frame = history(entity, period).rangeBetween(-(span - 1), 0)
    return F.when(F.count(value).over(frame) >= at_least, F.avg(value).over(frame))


def carried(value: str, upto: int = -1, entity: str = "entity", period: str = "period") -> Column:
    """Latest non-NULL value known at period ``t + upto`` or earlier (-1: strictly before t)."""
    frame = history(entity, period).rangeBetween(Window.unboundedPreceding, upto)
    return F.last(value, ignorenulls=True).over(frame)


def filled(df: DataFrame, value: str, out: str, entity: str = "entity", period: str = "period",
           bound: int | None = None) -> DataFrame:
    """Forward fill, then backward fill, of lines of any length (numeric periods)."""
    turned = "_back"
    ahead = carry_last(df, [entity], [period, value], value, out, bound)
    line = ahead.withColumn(turned, -F.col(period))
    return carry_last(line, [entity], [turned, value], value, "_later", bound).withColumn(
        out, F.coalesce(out, "_later")).drop(turned, "_later")


def filled_from_neighbours(value: str, entity: str = "entity", period: str = "period") -> Column:
    """Forward fill, then backward fill, per entity."""
    rows = history(entity, period)
    # Backward fill runs forward over the reversed order: a frame that only grows.
    back = Window.partitionBy(entity).orderBy(F.col(period).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(value, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0)),
                      F.last(value, ignorenulls=True).over(back))


def same_months_growth(monthly: DataFrame, value: str, upto_month: int, entity: str = "entity",
                       date: str = "date") -> DataFrame:
    """Mean over January .. ``upto_month`` of each year against the same months a year earlier."""
    part = (monthly.filter(F.month(date) <= upto_month)
            .groupBy(entity, F.year(date).alias("period")).agg(F.avg(value).alias("ytd_mean")))
    return part.withColumn("ytd_growth", exact_growth("ytd_mean", 1, entity, "period"))


def month_over_year(monthly: DataFrame, value: str, all_label: str, entity: str = "entity",
                    date: str = "date", digits: int = 4) -> DataFrame:
    """Growth over the same month of the prior year, plus a row per month with the entity median."""
    month_no = F.year(date) * 12 + F.month(date)
    base = monthly.select(F.col(entity).cast("string").alias(entity), F.trunc(date, "month").alias("month"),
                          month_no.alias("_m"), value)
    grown = base.withColumn("yoy", exact_growth(value, 12, entity, "_m")).filter(F.col("yoy").isNotNull())
    from paneltide.operators.order import quantiles
    middle = quantiles(grown, ["month"], "yoy", {"yoy": 0.5}).withColumn(entity, F.lit(all_label))
    return grown.select(entity, "month", "yoy").unionByName(middle).withColumn("yoy", F.round("yoy", digits))


def annualised(value: str | Column, months: int) -> Column:
    return col(value) * F.lit(12.0 / months)


def backcast(anchor_levels: DataFrame, other: DataFrame, anchor_period: int, value: str, other_value: str,
             entity: str = "entity", period: str = "period") -> DataFrame:
    """Carry an anchor level back along another series' growth.

    Chaining year by year telescopes to anchor * other(t) / other(anchor), so one join does it.
    A year whose chain crosses a missing or zero level is NULL, as step-by-step chaining would be.
    """
    anchor = anchor_levels.filter(F.col(period) == anchor_period).select(entity, F.col(value).alias("_a"))
    frame = Window.partitionBy(entity).orderBy(F.col(period).desc()).rowsBetween(Window.unboundedPreceding, 0)
    chain = (other.filter(F.col(period) <= anchor_period)
             .withColumn("_base", F.max(F.when(F.col(period) == anchor_period, F.col(other_value)))
                         .over(Window.partitionBy(entity)))
             .withColumn("_ok", (F.count(F.when(F.col(other_value) != 0, 1)).over(frame)
                                 == F.lit(anchor_period) - F.col(period) + 1)))
    joined = chain.join(anchor, entity).filter(F.col(period) < anchor_period)
    return joined.select(entity, period, F.when(
        F.col("_ok"), ratio(F.col("_a") * F.col(other_value), "_base")).alias(value))


def chain_step(level: str | Column, growth: str | Column) -> Column:
    """One chaining step, skipped when the growth is missing."""
    return col(level) * (F.lit(1.0) + F.coalesce(col(growth), F.lit(0.0)))


def override_cells(panel: DataFrame, overrides: DataFrame, value: str, new: str,
                   keys: Sequence[str] = ("entity", "period")) -> DataFrame:
    """Overwrite a measure where the override table has a value for the cell."""
    return (panel.join(overrides.select(*keys, F.col(new).alias("_new")), list(keys), "left")
            .withColumn(value, F.coalesce("_new", value)).drop("_new"))


def chained_splice(panel: DataFrame, growth: DataFrame, value: str, rate: str, cells: DataFrame,
                   entity: str = "entity", period: str = "period") -> DataFrame:
    """Replace listed (entity, period) cells by the prior level times one plus an outside growth."""
    prior = panel.select(entity, (F.col(period) + 1).alias(period), F.col(value).alias("_prior"))
    fresh = (cells.join(prior, [entity, period]).join(growth, [entity, period])
             .select(entity, period, (F.col("_prior") * (F.lit(1.0) + F.col(rate))).alias("_fresh")))
    return override_cells(panel, fresh, value, "_fresh", (entity, period))


def last_n(df: DataFrame, n: int, entity: str = "entity", period: str = "period") -> DataFrame:
    from paneltide.operators.order import top_k
    return top_k(df, [entity], [F.col(period).desc()], n)


def change_since_first(df: DataFrame, value: str, entity: str = "entity", period: str = "period") -> DataFrame:
    """Total change and compound growth per period between the first and last observation."""
    ends = df.filter(F.col(value).isNotNull()).groupBy(entity).agg(
        F.min_by(value, period).alias("first_value"), F.max_by(value, period).alias("last_value"),
        (F.max(period) - F.min(period)).alias("span"))
    total = ratio("last_value", "first_value")
    return ends.select(entity, "first_value", "last_value", "span", (total - 1.0).alias("total_change"),
                       F.when((F.col("span") > 0) & (total > 0),
                              F.pow(total, F.lit(1.0) / F.when(F.col("span") > 0, F.col("span"))) - 1.0)
                       .alias("compound_growth"))
