"""Walk-forward evaluation: every (strategy, horizon, period) window in one plan, no driver loop."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.functions.scalar import interval_name
from paneltide.operators.concordance import weighted_tau
from paneltide.operators.growth import forward_growth, shifted
from paneltide.operators.match import aligned
from paneltide.operators.order import quantiles, top_k, winsorise, with_quantiles
from paneltide.operators.rollup import pooled_summary
from paneltide.operators.stats import zscores
from paneltide.plans.model import MIN_COVERAGE, MIN_WINDOW_ROWS, PRECISION_K, TOP_QUANTILE, WINSOR_LIMITS
from paneltide.scale import is_wide, join_groups, small_side, staged

WINDOW = ("strategy", "horizon", "period")


def usable_periods(scores: DataFrame, at_least: float = MIN_COVERAGE) -> DataFrame:
    """Periods whose median indicator count is high enough.

    The count has one value per number of indicators, so the exact median keeps a handful of
    distinct values per period at any number of entities.
    """
    return scores.groupBy("period").agg(F.median("n_indicators").alias("_m")).filter(
        F.col("_m") >= at_least).select("period")


def realised(target: DataFrame, value: str, horizons: Sequence[int], kind: str = "growth") -> DataFrame:
    """(horizon, entity, period, realized): forward outcome over each horizon, known ones only."""
    ahead = {h: forward_growth(value, h) if kind == "growth" else shifted(value, h) - F.col(value) for h in horizons}
    held = target.select("entity", "period", *[c.alias(f"_{h}") for h, c in ahead.items()])
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_{h}").alias("realized")) for h in horizons])
    return (held.select("entity", "period", F.explode(cells).alias("_c"))
            .select("_c.horizon", "entity", "period", "_c.realized").filter(F.col("realized").isNotNull()))


def window_rows(rankings: DataFrame, outcome: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Ranking rows with their realised outcome; a ranking with a ``horizon`` column meets only its own.

    Both sides grow with the entities: they meet sorted, since a compressed panel looks small enough to pass through the driver.
    """
    held = rankings.filter(F.col("score").isNotNull())
    if periods is not None:
        held = held.join(periods, "period", "left_semi")
    on = ["entity", "period"] + (["horizon"] if "horizon" in held.columns else [])
    return held.join(outcome.hint("merge"), on)


def enough_rows(frame: DataFrame, group: Sequence[str], at_least: int = MIN_WINDOW_ROWS,
                bound: int | None = None) -> DataFrame:
    if not is_wide(frame, group, bound):
        return frame.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group))).filter(
            F.col("_n") >= at_least).drop("_n")
    sizes = small_side(frame.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least))
    return join_groups(frame, sizes.select(*group), list(group))


def window_metrics(frame: DataFrame, group: Sequence[str] = WINDOW, *, k: int = PRECISION_K,
                   clip: bool = True, at_least: int = MIN_WINDOW_ROWS, bound: int | None = None) -> DataFrame:
    """Per window: rows, weighted tau, precision@k, top-k edge over the median (in points).

    The outcome is clipped inside the window unless it was clipped before (``clip`` false).
    """
    held = enough_rows(frame, group, at_least, bound)
    if clip:
        held = winsorise(held, group, "realized", WINSOR_LIMITS, bound=bound)
    held = with_quantiles(held, group, "realized", {"_cut": TOP_QUANTILE, "_mid": 0.5}, bound)
    held = mark_top(held, group, "score", k, "_top", bound)
    top = F.when(F.col("_top"), F.col("realized"))
    got = weighted_tau(held, group, "score", "realized", "entity", name="weighted_tau", bound=bound, also={
        "n_entities": (F.count, F.col("score")),
        "_hits": (F.avg, F.when(F.col("_top"), (F.col("realized") >= F.col("_cut")).cast("double"))),
        "_best": (F.avg, top), "_middle": (F.max, F.col("_mid"))})
    return got.select(*group, "n_entities", "weighted_tau",
                      F.when(F.col("n_entities") >= k, F.col("_hits")).alias("precision_at_k"),
                      ((F.col("_best") - F.col("_middle")) * 100.0).alias("edge_pp"))


def mark_top(df: DataFrame, group: Sequence[str], score: str, k: int, flag: str, bound: int | None = None) -> DataFrame:
    """Boolean column: is the row among the k best of its group (ties by entity)."""
    order = [F.col(score).desc(), F.col("entity")]
    if not is_wide(df, group, bound):
        return df.withColumn(flag, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) <= k)
    best = small_side(top_k(df, group, order, k).select(*group, "entity", F.lit(True).alias(flag)))
    return df.join(best, [*group, "entity"], "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def evaluate(rankings: DataFrame, target: DataFrame, value: str, horizons: Sequence[int],
             periods: DataFrame | None = None, regimes: Mapping[str, tuple[int, int]] | None = None,
             k: int = PRECISION_K, bound: int | None = None, group: Sequence[str] = WINDOW) -> DataFrame:
    """The shared harness: any ranking table against any forward target."""
    frame = window_rows(rankings, realised(target, value, horizons), periods)
    return window_metrics(frame, group, k=k, bound=bound).withColumn("regime", interval_name("period", regimes or {}))


def summarise(windows: DataFrame, keys: Sequence[str] = ("strategy", "horizon")) -> DataFrame:
    """Mean of the windows by regime, plus the mean of all windows per key."""
    return pooled_summary(windows, keys, "regime", [
        F.count(F.lit(1)).alias("n_windows"), F.avg("weighted_tau").alias("mean_tau"),
        F.avg("precision_at_k").alias("mean_precision")])


def headline(summary: DataFrame, long_h: int, short_h: int, calm: str) -> DataFrame:
    """One row per strategy: pooled long, calm-regime long, pooled short."""
    def pick(value: str, h: int, regime: str) -> Column:
        return F.max(F.when((F.col("horizon") == h) & (F.col("regime") == regime), F.col(value)))
    return summary.groupBy("strategy").agg(
        pick("mean_tau", long_h, "POOLED").alias("tau_long"), pick("mean_precision", long_h, "POOLED").alias("precision_long"),
        pick("mean_tau", long_h, calm).alias("tau_long_calm"), pick("mean_tau", short_h, "POOLED").alias("tau_short"))


def uplift(head: DataFrame, reference: str, columns: Sequence[str]) -> DataFrame:
    """Reference minus every strategy."""
    head = staged(head, "headline")  # used for the reference and for the comparison
    own = head.filter(F.col("strategy") == reference).select(F.struct(*columns)).scalar()
    return head.withColumn("_ref", own).select(
        "strategy", *columns, *[(F.col("_ref")[c] - F.col(c)).alias(f"uplift_{c}") for c in columns])


def precision_by_k(frame: DataFrame, ks: Sequence[int], group: Sequence[str] = WINDOW, *, clip: bool = True,
                   bound: int | None = None) -> DataFrame:
    """Precision at several cut-offs from one top-max(k) pass, plus a pooled row per horizon."""
    held = enough_rows(frame, group, MIN_WINDOW_ROWS, bound)
    if clip:
        held = winsorise(held, group, "realized", WINSOR_LIMITS, bound=bound)
    cuts = quantiles(held, group, "realized", {"_cut": TOP_QUANTILE}, bound)
    sizes = held.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    best = top_k(held, group, [F.col("score").desc(), F.col("entity")], max(ks), position="_place")
    spread = best.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("_place") <= F.col("k"))
    per = (spread.join(cuts, list(group)).join(sizes, list(group)).filter(F.col("_n") >= F.col("k"))
           .groupBy(*group, "k").agg(F.avg((F.col("realized") >= F.col("_cut")).cast("double")).alias("precision"))
           .withColumn("period", F.col("period").cast("string")))
    outer = [c for c in group if c != "period"]
    return pooled_summary(per, [*outer, "k"], "period", [F.avg("precision").alias("precision")])


def outcome_frame(rankings: DataFrame, outcome: DataFrame, n_strategies: int, periods: DataFrame | None = None,
                  bound: int | None = None) -> DataFrame:
    """Long frame for paired comparison: outcome clipped before the join, same entities for all rankings."""
    clipped = winsorise(outcome, ["horizon", "period"], "realized", WINSOR_LIMITS, bound=bound)
    return aligned(window_rows(rankings, clipped, periods), ["horizon", "period"], "entity", "strategy", n_strategies)


def blended_outcome(growth: DataFrame, change: DataFrame, bound: int | None = None) -> DataFrame:
    """Mean of the standardised clipped growth and the standardised clipped change."""
    g = winsorise(growth, ["horizon", "period"], "realized", WINSOR_LIMITS, bound=bound)
    c = winsorise(change, ["horizon", "period"], "realized", WINSOR_LIMITS, out="_change", bound=bound).drop("realized")
    both = g.join(c, ["horizon", "entity", "period"])
    z = zscores(both, ["horizon", "period"], {"_a": "realized", "_b": "_change"}, sample=True, bound=bound)
    return z.select("horizon", "entity", "period", ((F.col("_a") + F.col("_b")) / 2.0).alias("realized"))


def largest_entities(panel: DataFrame, size: str, n: int) -> DataFrame:
    """The n largest entities by their latest known size."""
    latest = panel.filter(F.col(size).isNotNull()).groupBy("entity").agg(F.max_by(size, "period").alias("_s"))
    return latest.orderBy(F.col("_s").desc(), "entity").limit(n).select("entity")


def regime_flags(panel: DataFrame, value: str, windows: DataFrame, horizons: Sequence[int], stressed: Column,
                 threshold: float, bound: int | None = None) -> DataFrame:
    """Period-level flag (median growth above a threshold) beside the window accuracy it should warn about."""
    from paneltide.operators.growth import adjacent_growth
    grown = panel.select("period", adjacent_growth(value).alias("_g")).filter(F.col("_g").isNotNull())
    level = quantiles(grown, ["period"], "_g", {"median_growth": 0.5}, bound)
    taus = windows.groupBy("period").agg(*[
        F.max(F.when(F.col("horizon") == h, F.col("weighted_tau"))).alias(f"tau_{h}") for h in horizons])
    out = level.join(taus, "period", "left")
    fires = F.col("median_growth") > threshold
    return out.select("period", "median_growth", fires.alias("flag_fires"), stressed.alias("hindsight_shock"),
                      (fires & ~stressed).alias("false_alarm"), (~fires & stressed).alias("missed"),
                      *[f"tau_{h}" for h in horizons])


def flag_payoff(flagged: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Mean accuracy of flagged against quiet periods, with the counts of false alarms and misses."""
    return flagged.groupBy("flag_fires").agg(
        F.count(F.lit(1)).alias("n_periods"), F.count(F.when(F.col("false_alarm"), 1)).alias("n_false_alarms"),
        F.count(F.when(F.col("missed"), 1)).alias("n_missed"), *[F.avg(f"tau_{h}").alias(f"mean_tau_{h}") for h in horizons])
