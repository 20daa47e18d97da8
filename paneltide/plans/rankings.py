"""Ranking sources: tables (strategy, entity, period, score) with higher = better.

All strategies that are functions of one row come out of a single pass that turns the row into
one row per strategy, so a hundred variants cost one scan and no join.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.functions.scalar import col, present_mean, uniform
from paneltide.operators.growth import exact_growth
from paneltide.operators.stats import zscores
from paneltide.plans.model import Model, check_weights
from paneltide.plans.scoring import composite

KEYS = ("entity", "period")


def strategies(df: DataFrame, scores: Mapping[str, Column], extra: Sequence[str] = ()) -> DataFrame:
    """One output row per (input row, strategy)."""
    cells = F.array(*[F.struct(F.lit(n).alias("strategy"), c.cast("double").alias("score")) for n, c in scores.items()])
    return df.select(*KEYS, *extra, F.explode(cells).alias("_c")).select("_c.strategy", *KEYS, *extra, "_c.score")


def neutral(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def full_model(model: Model) -> dict[str, Column]:
    return {"full": composite(model.weights)}


def equal_weight(model: Model) -> dict[str, Column]:
    return {"equal_weight": present_mean([neutral(k) for k in model.names])}


def single_indicators(model: Model) -> dict[str, Column]:
    return {f"only:{k}": F.col(k) for k in model.names}


def ablations(model: Model) -> dict[str, Column]:
    """Composite without one indicator, and without one bucket."""
    out = {f"drop:{k}": composite({n: w for n, w in model.weights.items() if n != k}) for k in model.names}
    for bucket, names in model.buckets.items():
        out[f"drop_bucket:{bucket}"] = composite({n: w for n, w in model.weights.items() if n not in names})
    return out


def weight_schemes(schemes: Mapping[str, Mapping[str, float]]) -> dict[str, Column]:
    for name, weights in schemes.items():
        check_weights(weights, name)
    return {name: composite(weights) for name, weights in schemes.items()}


def tilted_weights(model: Model, factors: Mapping[str, float] | None) -> dict[str, float]:
    """Bucket factors applied and renormalised to one; None means equal weights."""
    if factors is None:
        return {k: 1.0 / len(model.names) for k in model.names}
    raw = {k: v.weight * factors.get(v.bucket, 1.0) for k, v in model.indicators.items()}
    total = sum(raw.values())
    return {k: w / total for k, w in raw.items()}


def persistence(target: DataFrame, value: str, horizons: Sequence[int]) -> DataFrame:
    """Trailing growth over as many periods as are to be predicted; carries ``horizon``."""
    held = target.select(*KEYS, *[exact_growth(value, h).alias(f"_{h}") for h in horizons])
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_{h}").alias("score")) for h in horizons])
    return (held.select(*KEYS, F.explode(cells).alias("_c"))
            .select(F.lit("persistence").alias("strategy"), *KEYS, "_c.horizon", "_c.score")
            .filter(F.col("score").isNotNull()))


def random_scores(keys: DataFrame, seeds: int) -> DataFrame:
    """Reproducible random rankings, one per seed; only the order matters."""
    return (keys.select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
            .select(F.lit("random").alias("strategy"), "seed", *KEYS,
                    uniform(F.lit("rank"), "seed", "entity", "period").alias("score")))


def blend(scores: DataFrame, norm: DataFrame, momentum: str, bound: int | None = None) -> DataFrame:
    """Half standardised composite, half momentum z."""
    z = zscores(scores.select(*KEYS, "score"), ["period"], {"_z": "score"}, sample=True, bound=bound)
    both = z.join(norm.select(*KEYS, momentum), list(KEYS), "left")
    return both.select(F.lit("blend").alias("strategy"), *KEYS,
                       (F.lit(0.5) * neutral("_z") + F.lit(0.5) * neutral(momentum)).alias("score"))


def category_index(df: DataFrame, categories: Mapping[str, Sequence[tuple[str, int]]],
                   ready: Sequence[str] = (), bound: int | None = None) -> DataFrame:
    """Mean of category means of oriented z-scores, missing values neutral.

    ``categories`` lists (column, sign); columns in ``ready`` are oriented scores already.
    """
    raw = {c: s for parts in categories.values() for c, s in parts if c not in ready}
    z = zscores(df, ["period"], {f"_z_{c}": c for c in raw}, sample=True,
                signs={f"_z_{c}": s for c, s in raw.items()}, bound=bound)
    means = [present_mean([neutral(c if c in ready else f"_z_{c}") for c, _ in parts])
             for parts in categories.values()]
    return z.select(F.lit("category_index").alias("strategy"), *KEYS, present_mean(means).alias("score"))


def standardised(df: DataFrame, columns: Mapping[str, tuple[str, int]], bound: int | None = None) -> DataFrame:
    """Long ranking table from raw columns: strategy -> (column, sign), sample z within period."""
    z = zscores(df, ["period"], {n: c for n, (c, _) in columns.items()}, sample=True,
                signs={n: s for n, (_, s) in columns.items()}, bound=bound)
    return strategies(z, {n: F.col(f"`{n}`") for n in columns}).filter(F.col("score").isNotNull())


def augmented(weight: float, score: str = "score", candidate: str = "cand") -> Column:
    return F.lit(1.0 - weight) * F.col(score) + F.lit(weight) * neutral(candidate)
