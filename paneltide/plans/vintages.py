"""Rebuilt editions: what a model would have shown at a cut, from the vintages known by then.

The store is long and bitemporal: (entity, measure, period, vintage, value); a vintage is the time at which a value of a period became
known, and a later vintage of the same period replaces it. A cut is a time. Nothing with a later vintage than a cut reaches it.

A value is the newest from its own vintage up to the one before the next, so the store is cut into validity intervals by one window, and
a value meets only those cuts of its interval that look back at its period: no cut is joined with all rows. Recipes name the
(measure, lag) cells that they need; those are picked by one aggregation over (cut, entity), for all recipes, variants and cuts at
once, and the recipes are then plain expressions over the cells.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.functions.scalar import present_mean, ratio
from paneltide.operators.stats import spearman
from paneltide.plans.model import Model
from paneltide.plans.scoring import composite, normalised
from paneltide.scale import staged

MIN_EDITION_RHO = 0.80


def cell(measure: str, lag: int) -> str:
    return f"{measure}@{lag}"


@dataclass(frozen=True)
class Recipe:
    """An input of a model: the cells it needs and how it is made of them."""

    needs: tuple[tuple[str, int], ...]
    make: Callable[[], Column]


def level(measure: str, lag: int = 0) -> Recipe:
    """The value of the period `lag` before the cut."""
    return Recipe(((measure, lag),), lambda: F.col(f"`{cell(measure, lag)}`"))


def complement(measure: str, lag: int = 0) -> Recipe:
    return Recipe(((measure, lag),), lambda: F.lit(1.0) - F.col(f"`{cell(measure, lag)}`"))


def first_known(measure: str, lags: Sequence[int]) -> Recipe:
    """The newest value among several lags: a carry with a bound."""
    return Recipe(tuple((measure, i) for i in lags), lambda: F.coalesce(*[F.col(f"`{cell(measure, i)}`") for i in lags]))


def growth(measure: str, lag: int = 0) -> Recipe:
    """Growth from the period before, both as known at the cut."""
    return Recipe(((measure, lag), (measure, lag + 1)),
                  lambda: ratio(F.col(f"`{cell(measure, lag)}`"), F.col(f"`{cell(measure, lag + 1)}`")) - 1.0)


def mean_growth(measure: str, lag: int, span: int, at_least: int) -> Recipe:
    """Mean of the last `span` growths, if `at_least` of them are known."""
    parts = [growth(measure, lag + i) for i in range(span)]
    return Recipe(tuple(dict.fromkeys(n for p in parts for n in p.needs)), lambda: present_mean([p.make() for p in parts], at_least))


def quotient(above: Recipe, below: Recipe, times: float = 1.0) -> Recipe:
    return Recipe(above.needs + below.needs, lambda: ratio(above.make() * times, below.make()))


def otherwise(first: Recipe, then: Recipe) -> Recipe:
    """The first, or where it is missing the second: a stand-in."""
    return Recipe(first.needs + then.needs, lambda: F.coalesce(first.make(), then.make()))


def known(store: DataFrame, cuts: Sequence[int], depth: int) -> DataFrame:
    """(cut, entity, measure, period, value): the newest vintage at each cut, of periods down to `depth` before it."""
    same = Window.partitionBy("entity", "measure", "period").orderBy("vintage")
    until = F.coalesce(F.lead("vintage").over(same) - 1, F.lit(max(cuts)))
    held = store.select("entity", "measure", "period", "vintage", "value", until.alias("_until"))
    asked = F.filter(F.array(*[F.lit(int(c)) for c in sorted(cuts)]), lambda c: (c >= F.col("vintage")) & (c <= F.col("_until"))
                     & (c >= F.col("period")) & (c <= F.col("period") + depth))
    return held.select(F.explode(asked).alias("cut"), "entity", "measure", "period", "value")


def rebuilt(store: DataFrame, cuts: Sequence[int], variants: Mapping[str, Mapping[str, Recipe]]) -> DataFrame:
    """(variant, cut, entity, inputs): every variant's inputs at every cut, in one pass over the store."""
    needs = sorted({n for recipes in variants.values() for r in recipes.values() for n in r.needs})
    depth = max(lag for _, lag in needs)
    cells = known(store.filter(F.col("measure").isin(sorted({m for m, _ in needs}))), cuts, depth)
    lag = F.col("cut") - F.col("period")
    wide = cells.groupBy("cut", "entity").agg(*[
        F.max(F.when((F.col("measure") == m) & (lag == i), F.col("value"))).alias(cell(m, i)) for m, i in needs])
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), *[r.make().alias(c) for c, r in recipes.items()]) for v, recipes in variants.items()])
    return wide.select("cut", "entity", F.explode(rows).alias("_row")).select("_row.variant", "cut", "entity", *[f"_row.{c}" for c in next(iter(variants.values()))])


def editions(inputs: DataFrame, model: Model, bound: int | None = None) -> DataFrame:
    """(variant, cut, entity, score): each edition standardised by itself."""
    one = inputs.withColumn("period", F.struct("variant", "cut"))
    norm = normalised(one, model, bound)
    return norm.select("period.variant", "period.cut", "entity", composite(model.weights).alias("score"))


def edition_pairs(scores: DataFrame, floor: float = MIN_EDITION_RHO, bound: int | None = None) -> DataFrame:
    """Per variant and cut: rank correlation with the same variant's edition at the cut before, over shared entities."""
    scores = staged(scores.filter(F.col("score").isNotNull()), "editions")
    before = scores.select("variant", (F.col("cut") + 1).alias("cut"), "entity", F.col("score").alias("_before"))
    both = scores.join(before, ["variant", "cut", "entity"])
    rho = spearman(both, ["variant", "cut"], "score", "_before", bound=bound)
    return rho.select("variant", "cut", "n", "rho", (F.col("rho") >= floor).alias("pass"))


def boundary_series(store: DataFrame, measure: str, breaks: Sequence[int], cut: int) -> DataFrame:
    """(entity, period, value, base): one series in the boundaries of the newest base, as known at a cut.

    The store has a column `base`, the boundary definition (a vintage of the areas) that a value was counted in. Values of the newest base known at
    the cut stand as they are. Older ones are chained to them where two bases both have the period of a break: they are scaled by the
    quotient there, from the newest break back. Entities without a link keep no older values.
    """
    same = Window.partitionBy("entity", "period", "base").orderBy(F.col("vintage").desc())
    held = staged(store.filter((F.col("measure") == measure) & (F.col("vintage") <= cut) & F.col("value").isNotNull()).withColumn(
        "_nth", F.row_number().over(same)).filter("_nth = 1").select("entity", "period", "base", "value"), "boundary")
    if not breaks:
        return held.filter("base = 0").select("entity", "period", "value", "base")
    # breaks are a declaration: base i holds from breaks[i - 1] on, and reaches back to it
    links = None
    for i, at in enumerate(breaks):
        new = held.filter((F.col("base") == i + 1) & (F.col("period") == at)).select("entity", F.col("value").alias("_new"))
        old = held.filter((F.col("base") == i) & (F.col("period") == at)).select("entity", F.col("value").alias("_old"))
        one = new.join(old, "entity").select("entity", F.lit(i).alias("_base"), ratio("_new", "_old").alias("_link"))
        links = one if links is None else links.unionByName(one)
    newest = Window.partitionBy("entity").orderBy(F.col("_base").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a factor is the product of the links from the newest base back, and there only while none is missing
    factors = links.withColumns({
        "_factor": F.aggregate(F.collect_list("_link").over(newest), F.lit(1.0), lambda a, x: a * x),
        "_whole": F.count("_link").over(newest) == F.lit(len(breaks)) - F.col("_base")}).filter("_whole").select(F.col("entity").alias("_of"), "_base", "_factor")
    starts = F.array(*[F.lit(int(b)) for b in breaks])
    own = F.size(F.filter(starts, lambda b: b <= F.col("period")))
    rows = held.filter(F.col("base") == own)
    out = rows.join(factors, (F.col("entity") == F.col("_of")) & (F.col("base") == F.col("_base")), "left")
    return out.filter((F.col("base") == len(breaks)) | F.col("_factor").isNotNull()).select(
        "entity", "period", (F.col("value") * F.coalesce("_factor", F.lit(1.0))).alias("value"), "base")
