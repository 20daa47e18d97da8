"""Row gates, sentinel repair and duplicate handling."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.functions.scalar import col


def threshold_gate(df: DataFrame, value: str, floor: float) -> DataFrame:
    return df.filter(F.col(value) >= floor)


def gap_free(df: DataFrame, entity: str = "entity", period: str = "period", latest_start: int | None = None) -> DataFrame:
    """Entities whose periods form one unbroken run up to the latest period of the table."""
    runs = df.groupBy(entity).agg(F.min(period).alias("first_period"), F.max(period).alias("last_period"),
                                  F.count_distinct(period).alias("n_periods"))
    newest = df.agg(F.max(period)).scalar()
    ok = (F.col("n_periods") == F.col("last_period") - F.col("first_period") + 1) & (
        F.col("last_period") == newest)
    if latest_start is not None:
        ok = ok & (F.col("first_period") <= latest_start)
    return runs.filter(ok)


def two_gate_universe(candidates: DataFrame, covered: DataFrame, entity: str, size: str, floor: float
                      ) -> tuple[DataFrame, DataFrame]:
    """Entities above the floor split into the universe and a drop log with reasons.

    ``covered`` is the outcome of the name match, one row per entity: a NULL match means no region
    was found, ``full_coverage`` false means the region exists without an unbroken series.
    """
    judged = threshold_gate(candidates, size, floor).join(covered, entity, "left")
    reason = (F.when(F.col("region").isNull(), F.lit("no matching region"))
              .when(~F.col("full_coverage"), F.lit("incomplete series")))
    judged = judged.withColumn("reason", reason)
    return (judged.filter(F.col("reason").isNull()).drop("reason", "full_coverage"),
            judged.filter(F.col("reason").isNotNull()).select(entity, size, "reason"))


def members_of(df: DataFrame, keys: DataFrame, on: Sequence[str], keep: bool = True) -> DataFrame:
    """Rows whose key is (not) in a key set."""
    return df.join(keys.select(*on), list(on), "left_semi" if keep else "left_anti")


def repair_sentinels(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Per-column rule: ``negative_to_zero``, ``negative_to_null`` or ``zero_to_null``."""
    def fixed(name: str, rule: str) -> Column:
        c = F.col(name)
        if rule == "negative_to_zero":
            return F.when(c < 0, F.lit(0)).otherwise(c)
        if rule == "negative_to_null":
            return F.when(c >= 0, c)
        if rule == "zero_to_null":
            return F.when(c != 0, c)
        raise ValueError(f"unknown rule {rule!r}")
    return df.withColumns({name: fixed(name, rule) for name, rule in rules.items()})


def remap_codes(df: DataFrame, code: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace listed sub-area codes by their parent code (a fixed, hand-kept map)."""
    if not mapping:
        return df
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(code, F.coalesce(F.try_element_at(table, F.col(code)), F.col(code)))


class ConflictingDuplicates(ValueError):
    """Rows share a key but disagree on a value."""


def dedup_checked(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Collapse identical duplicates; raise when a key has conflicting values.

    The conflict check is an aggregation inside the same plan: the row that disagrees raises when
    the result is computed, so the table is read once.
    """
    packed = F.struct(*[F.col(v) for v in values])
    one = df.groupBy(*keys).agg(F.min(packed).alias("_a"), F.max(packed).alias("_b"))
    picked = F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("_a")).otherwise(
        F.raise_error(F.concat(F.lit("conflicting duplicates for key "), F.to_json(F.struct(*keys)))))
    return one.select(*keys, picked.alias("_v")).select(*keys, "_v.*")


def conflicting_keys(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The keys ``dedup_checked`` would refuse."""
    packed = F.struct(*[F.col(v) for v in values])
    return df.groupBy(*keys).agg(F.min(packed).alias("_a"), F.max(packed).alias("_b")).filter(
        ~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def replace_periods(df: DataFrame, fresh: DataFrame, periods: Sequence[int], period: str = "period") -> DataFrame:
    """Swap the rows of some periods for rebuilt rows."""
    return df.filter(~F.col(period).isin(list(periods))).unionByName(fresh.select(*df.columns))


def preferred(first: str | Column, fallback: str | Column) -> Column:
    return F.coalesce(col(first), col(fallback))


def code_at_period(default: Column, overrides: DataFrame, df: DataFrame, entity: str, period: str,
                   out: str = "code") -> DataFrame:
    """Source code per entity and period: a dated override, otherwise the default rule.

    ``overrides`` holds (entity, code, valid_from, valid_to) with at most one row valid at a time.
    """
    o = overrides.select(F.col(entity).alias("_e"), F.col("code").alias("_c"), "valid_from", "valid_to")
    hit = ((F.col(entity) == F.col("_e"))
           & (F.col("valid_from").isNull() | (F.col(period) >= F.col("valid_from")))
           & (F.col("valid_to").isNull() | (F.col(period) <= F.col("valid_to"))))
    return df.join(o, hit, "left").withColumn(out, F.coalesce("_c", default)).drop(
        "_e", "_c", "valid_from", "valid_to")
