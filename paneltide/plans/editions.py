"""Reader-facing table logic over ranked editions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.operators.order import add_ranks, top_k
from paneltide.plans.model import MATERIAL, SCHEME_FACTORS, Model
from paneltide.plans.rankings import strategies, tilted_weights
from paneltide.plans.scoring import composite

KEYS = ("entity", "period")


def rank_changes(current: DataFrame, prior: DataFrame, prior_intervals: DataFrame) -> DataFrame:
    """Move against the prior edition; notable only outside the entity's own prior interval."""
    old = prior.select("entity", F.col("rank").alias("prior_rank")).join(
        prior_intervals.select("entity", F.col("rank_lo").alias("prior_lo"), F.col("rank_hi").alias("prior_hi")), "entity", "left")
    held = current.select("entity", "rank").join(old, "entity", "left")
    return held.select(
        "entity", "rank", "prior_rank", F.col("prior_rank").isNull().alias("is_new"),
        (F.col("prior_rank") - F.col("rank")).alias("delta"),
        F.coalesce((F.col("rank") < F.col("prior_lo")) | (F.col("rank") > F.col("prior_hi")), F.lit(False)).alias("notable"))


def rank_range(norm: DataFrame, model: Model, factors: Mapping[str, Mapping[str, float] | None] = SCHEME_FACTORS,
               bound: int | None = None) -> DataFrame:
    """Lowest and highest rank of each entity over alternative weightings."""
    long = strategies(norm, {n: composite(tilted_weights(model, f)) for n, f in factors.items()})
    ranked = add_ranks(long, ["period", "strategy"], "score", low="rank", bound=bound)
    return ranked.groupBy(*KEYS).agg(F.min("rank").alias("rank_lo"), F.max("rank").alias("rank_hi"))


def contributors(scored: DataFrame, model: Model, floor: float = MATERIAL) -> DataFrame:
    """Best, second best and worst bucket of each row, named only beyond the floor (declared order on ties)."""
    names = list(model.buckets)
    parts = F.array(*[F.struct((-F.col(f"bucket_{b}")).alias("v"), F.lit(i).alias("i"), F.lit(b).alias("b"))
                      for i, b in enumerate(names)])
    down = F.array(*[F.struct(F.col(f"bucket_{b}").alias("v"), F.lit(i).alias("i"), F.lit(b).alias("b"))
                     for i, b in enumerate(names)])
    best, worst = F.array_sort(parts), F.array_sort(down)
    def named(cell: Column, ok: Column) -> Column:
        return F.when(ok, cell["b"])
    return scored.select(
        *KEYS, named(best[0], best[0]["v"] < -floor).alias("strength"),
        named(best[1], best[1]["v"] < -floor).alias("second_strength"),
        named(worst[0], worst[0]["v"] < -floor).alias("drag"))


def percentile_table(norm: DataFrame, columns: Sequence[str], bound: int | None = None) -> DataFrame:
    """Long (entity, period, indicator, pct): percentile rank of every indicator within its period.

    Unpivoting first ranks all indicators in one exchange.
    """
    long = norm.select(*KEYS, *columns).unpivot(list(KEYS), list(columns), "indicator", "value")
    return add_ranks(long, ["period", "indicator"], "value", percent="pct", descending=False, bound=bound).drop("value")


def strengths_and_weaknesses(pct: DataFrame, high: float = 65.0, low: float = 35.0, most: int = 5) -> DataFrame:
    """Up to ``most`` indicators per entity at or beyond each cut, strongest first."""
    held = pct.withColumn("side", F.when(F.col("pct") >= high, "strength").when(F.col("pct") <= low, "weakness")).filter(
        F.col("side").isNotNull())
    extreme = F.when(F.col("side") == "strength", -F.col("pct")).otherwise(F.col("pct"))
    return top_k(held.withColumn("_x", extreme), [*KEYS, "side"], [F.col("_x"), F.col("indicator")], most, "place").drop("_x")


def trajectory(scores: DataFrame, appended: DataFrame) -> DataFrame:
    """Rank history with an extra edition appended."""
    return scores.select(*KEYS, "rank").unionByName(appended.select(*KEYS, "rank"))


def sanity_profile(df: DataFrame, measure: str, level: str, k: int = 10, bound: int | None = None) -> DataFrame:
    """Top risers of a measure in its latest period beside the level's percentile in its own latest period."""
    def latest(c: str) -> DataFrame:
        held = df.filter(F.col(c).isNotNull())
        return held.filter(F.col("period") == held.agg(F.max("period")).scalar())
    a = add_ranks(latest(measure).select(*KEYS, measure), ["period"], measure, percent="measure_pct", descending=False, bound=bound)
    b = add_ranks(latest(level).select(*KEYS, level), ["period"], level, percent="level_pct", descending=False, bound=bound)
    best = top_k(a, ["period"], [F.col(measure).desc(), F.col("entity")], k)
    return best.join(b.select("entity", "level_pct"), "entity", "left").select("entity", measure, "measure_pct", "level_pct")
