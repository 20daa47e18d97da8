"""Data-quality flags. Every check returns rows of one flag schema with a stable id."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.functions.scalar import col, ratio, stable_id
from paneltide.operators.growth import exact_growth
from paneltide.operators.match import membership_changes
from paneltide.operators.order import quantiles
from paneltide.plans.model import (
    CROSS_SOURCE_GAP, CROSS_SOURCE_SIGMA, GOLDEN_ATOL, GOLDEN_RTOL, OUTLIER_SIGMA, TOP_MOVER_RANKS)
from paneltide.scale import is_wide, join_groups, small_side, staged

KEYS = ("entity", "period")


def flags(df: DataFrame, check: Column, severity: Column, measure: Column, detail: Column,
          entity: Column | None = None, period: Column | None = None) -> DataFrame:
    who = F.lit("") if entity is None else entity.cast("string")
    when = F.lit("") if period is None else period.cast("string")
    return df.select(stable_id(check, who, when, measure).alias("flag_id"), check.alias("check"),
                     severity.alias("severity"), who.alias("entity"), when.alias("period"),
                     measure.alias("measure"), detail.alias("detail"))


def with_center_and_spread(df: DataFrame, group: Sequence[str], value: str, bound: int | None = None) -> DataFrame:
    """Attach the group median and the population standard deviation of a column: one aggregation, read once, unless a group is split."""
    if not is_wide(df, group, bound):
        whole = Window.partitionBy(*group)
        return df.withColumns({"_mid": F.percentile(value, F.lit(0.5)).over(whole), "_std": F.stddev_pop(value).over(whole)})
    df = staged(df, "spread")
    mid = quantiles(df, group, value, {"_mid": 0.5}, bound)
    spread = df.groupBy(*group).agg(F.stddev_pop(value).alias("_std"))
    return join_groups(df, small_side(join_groups(mid, spread, list(group))), list(group))


def divergence(pairs: DataFrame, bound: int | None = None) -> DataFrame:
    """Cross-source check on a long table (check, entity, period, a, b) of two growth readings.

    The difference is centred at the period median; a row is kept when it is beyond the absolute
    or the standardised limit (no spread: standardised difference zero).
    """
    held = with_center_and_spread(
        pairs.withColumn("_d", F.col("a") - F.col("b")).filter(F.col("_d").isNotNull()), ["check", "period"], "_d", bound)
    centred = F.col("_d") - F.col("_mid")
    z = F.when(F.col("_std") > 0, centred / F.when(F.col("_std") > 0, F.col("_std"))).otherwise(0.0)
    return held.select("check", *KEYS, centred.alias("centred"), z.alias("z")).filter(
        (F.abs("centred") > CROSS_SOURCE_GAP) | (F.abs("z") > CROSS_SOURCE_SIGMA))


def growth_table(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long (measure, entity, period, growth) of several level columns from one entity exchange."""
    held = panel.select(*KEYS, *[exact_growth(c).alias(c) for c in columns])
    return held.unpivot(list(KEYS), list(columns), "measure", "growth").filter(F.col("growth").isNotNull())


def outliers(panel: DataFrame, columns: Sequence[str], sigma: float = OUTLIER_SIGMA, bound: int | None = None) -> DataFrame:
    """Growth beyond ``sigma`` population deviations from the period median, per measure."""
    held = with_center_and_spread(growth_table(panel, columns), ["measure", "period"], "growth", bound)
    z = ratio(F.col("growth") - F.col("_mid"), "_std")
    return held.select("measure", *KEYS, "growth", z.alias("z")).filter(F.abs("z") > sigma)


def membership_watch(current: DataFrame, reference: DataFrame, universe: DataFrame, parent: str, child: str) -> DataFrame:
    """Parents whose membership changed: blocking inside the universe, a warning elsewhere."""
    changed = membership_changes(current, reference, parent, child).groupBy(parent).agg(
        F.count(F.when(F.col("change") == "added", 1)).alias("n_added"),
        F.count(F.when(F.col("change") == "removed", 1)).alias("n_removed"))
    inside = universe.select(parent).distinct().withColumn("_in", F.lit(True))
    return changed.join(inside, parent, "left").select(
        parent, "n_added", "n_removed", F.when(F.col("_in"), "BLOCKER").otherwise("WARN").alias("severity"))


def top_entrants(current: DataFrame, prior: DataFrame, k: int = 10, mover: int = TOP_MOVER_RANKS) -> DataFrame:
    """New members of the top k: absent before, a big mover, or simply entered."""
    old = prior.select("entity", F.col("rank").alias("prior_rank"))
    held = current.filter(F.col("rank") <= k).select("entity", "rank").join(old, "entity", "left")
    outside = F.col("prior_rank") > k
    move = (F.when(F.col("prior_rank").isNull(), "new")
            .when(outside & (F.col("prior_rank") - F.col("rank") > mover), "moved").when(outside, "entered"))
    return held.withColumn("move", move).filter(F.col("move").isNotNull())


def golden_mismatches(golden: DataFrame, current: DataFrame, rtol: float = GOLDEN_RTOL, atol: float = GOLDEN_ATOL) -> DataFrame:
    """Stored values against current ones; equal when both are missing or within tolerance.

    Both sides are long tables (entity, period, column, value).
    """
    now = current.select(*KEYS, "column", F.col("value").alias("current_value"))
    both = golden.select(*KEYS, "column", F.col("value").alias("golden_value")).join(now, [*KEYS, "column"], "left")
    g, c = F.col("golden_value"), F.col("current_value")
    same = (g.isNull() & c.isNull()) | (g.isNotNull() & c.isNotNull() & (F.abs(g - c) <= atol + rtol * F.abs(c)))
    return both.filter(~F.coalesce(same, F.lit(False)))


def open_blockers(flagged: DataFrame, dispositions: DataFrame) -> DataFrame:
    return flagged.filter(F.col("severity") == "BLOCKER").join(dispositions.select("flag_id"), "flag_id", "left_anti")


def publication_gate(flagged: DataFrame, dispositions: DataFrame, report_digest: DataFrame,
                     panel_digest: DataFrame) -> DataFrame:
    """One row: clear only when the report was made from this panel and no blocker is open."""
    now = panel_digest.select(F.struct("digest", "n_rows")).scalar()
    held = report_digest.select(
        (F.struct("digest", "n_rows") == now).alias("same_panel"),
        open_blockers(flagged, dispositions).agg(F.count_distinct("flag_id")).scalar().alias("open_blockers"))
    return held.select("same_panel", "open_blockers", (F.col("same_panel") & (F.col("open_blockers") == 0)).alias("clear"))


def report_counts(flagged: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Counts by check and severity with the status of each line."""
    done = dispositions.select("flag_id").distinct().withColumn("_done", F.lit(True))
    held = flagged.join(done, "flag_id", "left")
    still = F.count(F.when((F.col("severity") == "BLOCKER") & F.col("_done").isNull(), 1))
    return held.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n_flags"), still.alias("n_open")).withColumn(
        "status", F.when(F.col("n_open") == 0, "GREEN").otherwise("NEEDS DISPOSITION"))


def reconcile(left: DataFrame, right: DataFrame, value: str, tolerance: float = 0.03,
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Two readings of one series: totals and largest difference per period, and how many entities are outside."""
    both = left.select(*keys, F.col(value).alias("_a")).join(right.select(*keys, F.col(value).alias("_b")), list(keys))
    off = F.abs(ratio(F.col("_a") - F.col("_b"), "_b"))
    return both.groupBy("period").agg(
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"),
        ratio(F.sum("_a") - F.sum("_b"), F.sum("_b")).alias("total_pct_diff"),
        F.count(F.when(off > tolerance, 1)).alias("n_outside")).withColumn(
        "within", F.abs("total_pct_diff") <= tolerance)


def outside(left: DataFrame, right: DataFrame, value: str, tolerance: float = 0.03, keys: Sequence[str] = KEYS) -> DataFrame:
    """The entities and periods whose two readings are further apart than the tolerance."""
    both = left.select(*keys, F.col(value).alias("value")).join(right.select(*keys, F.col(value).alias("other")), list(keys))
    return both.withColumn("pct_diff", ratio(F.col("value") - F.col("other"), "other")).filter(F.abs("pct_diff") > tolerance)


def boundary_ratio(area_totals: DataFrame, member_sums: DataFrame, value: str) -> DataFrame:
    """Published area total over the sum of its members, per entity and period."""
    return area_totals.select(*KEYS, F.col(value).alias("_a")).join(
        member_sums.select(*KEYS, F.col(value).alias("_m")), list(KEYS)).select(
        *KEYS, ratio("_a", "_m").alias("boundary_ratio"))


def published_mismatches(actual: DataFrame, expected: DataFrame, name: str = "figure", tolerance: float = 1e-9) -> DataFrame:
    """Recomputed figures against published ones after rounding to the published digits."""
    both = expected.join(actual.select(name, F.col("value").alias("_now")), name, "left")
    shown = F.round(F.col("_now") * F.pow(F.lit(10.0), F.col("digits"))) / F.pow(F.lit(10.0), F.col("digits"))
    return both.select(name, "value", shown.alias("recomputed"),
                       F.coalesce(F.abs(shown - F.col("value")) <= tolerance, F.lit(False)).alias("ok"))


def rank_outside_interval(ranked: DataFrame, intervals: DataFrame, allowed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Entities whose published rank lies outside their own interval and that are not on the allow list."""
    both = ranked.select(*keys, "rank").join(intervals.select(*keys, "rank_lo", "rank_hi"), list(keys))
    return both.filter(~F.col("rank").between(F.col("rank_lo"), F.col("rank_hi"))).join(
        allowed.select("entity"), "entity", "left_anti")


def sister_pairs(frames: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Stack checks name -> (table, growth column, sister table, growth column) into one long pair table."""
    out = None
    for check, (a, ca, b, cb) in frames.items():
        part = a.select(*KEYS, col(ca).alias("a")).join(b.select(*KEYS, col(cb).alias("b")), list(KEYS)).withColumn(
            "check", F.lit(check))
        out = part if out is None else out.unionByName(part)
    return out
