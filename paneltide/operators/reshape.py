"""Wide to long, long to wide, grids."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE_COLUMN = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def unpivot_dates(df: DataFrame, ids: Sequence[str], value: str = "value") -> DataFrame:
    """One row per id and date column that holds a value."""
    dates = [c for c in df.columns if DATE_COLUMN.match(c)]
    return (df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in dates])
            .unpivot(list(ids), [F.col(f"`{c}`") for c in dates], "date", value)
            .filter(F.col(value).isNotNull()).withColumn("date", F.to_date("date")))


def unpivot_family(df: DataFrame, ids: Sequence[str], prefix: str, value: str) -> DataFrame:
    """Columns ``prefix<year>`` to rows; years without a column simply do not occur."""
    family = [c for c in df.columns if re.fullmatch(re.escape(prefix) + r"\d{4}", c)]
    return (df.unpivot(list(ids), family, "_name", value)
            .withColumn("period", F.substring("_name", -4, 4).cast("int")).drop("_name"))


def pivot_mean(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Name/value rows to one column per listed name, duplicates averaged."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.avg(value))


def pivot_first(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence | None = None) -> DataFrame:
    """Pivot of a table that is unique on (keys, name).

    Without ``names`` every name of the data is a column, in order: one more aggregation, and Spark's own limit
    (``spark.sql.pivotMaxValues``) refuses a column that is no short list instead of dropping rows.
    """
    grouped = df.groupBy(*keys)
    return (grouped.pivot(name) if names is None else grouped.pivot(name, list(names))).agg(F.max(value))


def golden_long(panel: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, value) rows, NULL values kept so that absence can be checked too."""
    return panel.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "column", "value")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name of same-schema period frames."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def spine(entities: DataFrame, lo: int, hi: int, period: str = "period") -> DataFrame:
    """Every entity at every period of a closed range, as a per-row expansion rather than a join."""
    return entities.withColumn(period, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
