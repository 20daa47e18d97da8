"""Panel -> indicators -> within-period z-scores -> weighted composite -> rank."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.functions.scalar import annuity_payment, present_count, ratio
from paneltide.operators.growth import exact_difference, exact_growth, shifted, trailing_mean
from paneltide.operators.order import add_ranks, winsorise
from paneltide.operators.stats import zscores
from paneltide.plans.model import Measure, Model

KEYS = ("entity", "period")


def measure_column(m: Measure) -> Column:
    if m.kind == "ratio":
        return ratio(F.col(m.a), m.b) * F.lit(m.scale)
    if m.kind == "growth":
        return exact_growth(m.a)
    if m.kind == "complement":
        return F.lit(1.0) - F.col(m.a)
    if m.kind == "payment":
        return ratio(annuity_payment(m.a, m.c), m.b)
    raise ValueError(f"unknown measure kind {m.kind!r}")


def indicators(panel: DataFrame, model: Model, keep: Sequence[str] = ()) -> DataFrame:
    """Keys plus one column per indicator; all growth windows share one exchange on the entity."""
    return panel.select(*KEYS, *keep, *[measure_column(v.measure).alias(k) for k, v in model.indicators.items()])


def with_trailing_means(ind: DataFrame, columns: Sequence[str], span: int = 3, at_least: int = 2) -> DataFrame:
    """Variant model inputs: chosen growth indicators replaced by their multi-period mean."""
    return ind.withColumns({c: trailing_mean(c, span, at_least) for c in columns})


def normalised(ind: DataFrame, model: Model, bound: int | None = None) -> DataFrame:
    """Directional z-scores within each period (population form)."""
    return zscores(ind, ["period"], {k: k for k in model.names}, signs=model.signs, bound=bound)


def composite(weights: Mapping[str, float]) -> Column:
    """Weighted sum with missing scores at zero, the neutral value."""
    return F.expr(" + ".join(f"{float(w)!r}D * coalesce(`{name}`, 0.0D)" for name, w in weights.items()) or "0.0D")


def scored(norm: DataFrame, model: Model, bound: int | None = None) -> DataFrame:
    """Composite, bucket sub-scores, indicator count and within-period rank."""
    extra = {"n_indicators": present_count(model.names), "score": composite(model.weights)}
    for bucket, names in model.buckets.items():
        extra[f"bucket_{bucket}"] = composite({n: model.weights[n] for n in names})
    keep = [c for c in norm.columns if c not in model.names]
    held = norm.withColumns(extra).select(*keep, *extra)
    return add_ranks(held, ["period"], "score", low="rank", bound=bound)


def scored_panel(panel: DataFrame, model: Model, keep: Sequence[str] = (), bound: int | None = None) -> DataFrame:
    return scored(normalised(indicators(panel, model, keep), model, bound), model, bound)


def edition(scores: DataFrame, period: int) -> DataFrame:
    """One ranked cross-section, best first."""
    return scores.filter(F.col("period") == period).orderBy("rank", "entity")


def score_with(ind: DataFrame, weights: Mapping[str, float], signs: Mapping[str, int],
               bound: int | None = None) -> DataFrame:
    """Score of an indicator table under any weight map and direction map."""
    z = zscores(ind, ["period"], {k: k for k in weights}, signs=signs, bound=bound)
    return z.select(*KEYS, composite(weights).alias("score"))


def permit_momentum(panel: DataFrame, total: str, multi: str, stock: str, bound: int | None = None) -> DataFrame:
    """Growth of both unit counts and change of both rates over stock, each winsorised in its period.

    A growth needs a positive prior count.
    """
    def grown(c: str) -> Column:
        return ratio(c, shifted(c, -1), positive=True) - F.lit(1.0)
    held = panel.withColumns({"_rt": ratio(total, stock, positive=True), "_rm": ratio(multi, stock, positive=True)})
    raw = held.select(
        *KEYS, grown(total).alias("total_growth"), grown(multi).alias("multi_growth"),
        exact_difference("_rt").alias("total_rate_change"), exact_difference("_rm").alias("multi_rate_change"))
    for c in ("total_growth", "multi_growth", "total_rate_change", "multi_rate_change"):
        raw = winsorise(raw, ["period"], c, bound=bound)
    return raw


def imputed_share(total: str, reported: str, limit: float = 0.25) -> tuple[Column, Column]:
    """Share of a total that was not reported, and whether it is above the limit."""
    share = F.lit(1.0) - ratio(reported, total)
    return share, share > limit


def valuation_measures(value: str = "home_value", rent: str = "rent") -> dict[str, Column]:
    annual = F.col(rent) * 12.0
    return {"price_to_rent": ratio(value, annual), "gross_yield": ratio(annual, value),
            "appreciation": exact_growth(value)}
