"""Indicator rows as they could have been built at the time.

Every carried input is a frame that ends before its cut, so all periods are rebuilt in one pass
over the panel and none can see data at or after its own cut.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.functions.scalar import annuity_payment, ratio
from paneltide.operators.growth import annualised, carried, chain_step, exact_growth, same_months_growth, shifted
from paneltide.plans.model import Model
from paneltide.plans.scoring import indicators

KEYS = ("entity", "period")

# Where each input of the early row comes from.
EARLY_SOURCE = {
    "trailing_rent_growth": "fast", "cost_to_own_vs_rent": "fast", "permits_to_stock": "proxy",
    "net_migration": "proxy", "rent_to_income": "proxy", "job_growth": "proxy", "income_growth": "proxy",
    "employment_diversity": "carried"}


def early_rows(panel: DataFrame, ind: DataFrame, flows: DataFrame, jobs: DataFrame, state_growth: DataFrame | None,
               state: str = "state") -> DataFrame:
    """Rows from fast inputs, proxies and carries, for every period of the panel at once.

    ``flows``: (entity, period, flow) proxy for net migration. ``jobs``: (entity, period,
    proxy_job_growth), falling back to the carried growth. ``state_growth``: (state, period, g)
    chains the carried income level and is the income growth; without it income is carried flat.
    """
    slow = panel.select(
        *KEYS, "permits_total", "rent", *([state] if state_growth is not None else []),
        carried("housing_units").alias("_stock"), carried("population").alias("_pop"), carried("income_pc").alias("_inc"))
    prior = ind.select(
        *KEYS, "trailing_rent_growth", "cost_to_own_vs_rent", carried("job_growth").alias("_jobs"),
        carried("income_growth").alias("_incg"), carried("employment_diversity").alias("_div"))
    held = slow.join(prior, list(KEYS)).join(flows.select(*KEYS, "flow"), list(KEYS), "left").join(
        jobs.select(*KEYS, "proxy_job_growth"), list(KEYS), "left")
    held = held.join(state_growth.select(state, "period", "g"), [state, "period"], "left") if state_growth is not None \
        else held.withColumn("g", F.lit(None).cast("double"))
    income = chain_step("_inc", "g")
    return held.select(
        *KEYS, ratio("flow", "_pop").alias("net_migration"),
        F.coalesce("proxy_job_growth", "_jobs").alias("job_growth"),
        F.coalesce("g", "_incg").alias("income_growth"), ratio("permits_total", "_stock").alias("permits_to_stock"),
        ratio(F.col("rent") * 12.0, income).alias("rent_to_income"), "cost_to_own_vs_rent", "trailing_rent_growth",
        F.col("_div").alias("employment_diversity"))


def mid_period_rows(panel: DataFrame, ind: DataFrame, monthly: DataFrame, rates: DataFrame, flows: DataFrame,
                    growth: DataFrame, month: int, override: DataFrame | None = None, state: str = "state") -> DataFrame:
    """Rows for period T from data through month ``month`` of T.

    ``monthly``: (entity, date, rent, home_value, jobs, units). Levels come from T-2 or earlier,
    flows from T-1 (a newer vintage may override one period's flow), state growth from T-1 and the
    start of T (columns g_prior, g_now at (state, T)); missing part-period units fall back to the
    prior year's pace.
    """
    rent = same_months_growth(monthly, "rent", month)
    jobs = same_months_growth(monthly, "jobs", month)
    part = monthly.filter(F.month("date") <= month).groupBy("entity", F.year("date").alias("period")).agg(
        F.avg("home_value").alias("_value"), F.sum("units").alias("_units"))
    slow = panel.select(
        *KEYS, state, carried("housing_units", -2).alias("_stock"), carried("population", -2).alias("_pop"),
        carried("income_pc", -2).alias("_inc"), shifted("permits_total", -1).alias("_pace"))
    prior = ind.select(*KEYS, carried("job_growth").alias("_jobs"), carried("employment_diversity").alias("_div"))
    late_flow = flows.select("entity", (F.col("period") + 1).alias("period"), "flow")
    held = (slow.join(prior, list(KEYS))
            .join(rent.select(*KEYS, F.col("ytd_mean").alias("_rent"), F.col("ytd_growth").alias("_rentg")), list(KEYS), "left")
            .join(jobs.select(*KEYS, F.col("ytd_growth").alias("_jobg")), list(KEYS), "left")
            .join(part, list(KEYS), "left").join(late_flow, list(KEYS), "left")
            .join(growth.select(state, "period", "g_prior", "g_now"), [state, "period"], "left")
            .join(rates.select("period", "rate"), "period", "left"))
    flow = F.col("flow")
    if override is not None:
        held = held.join(override.select(*KEYS, F.col("flow").alias("_newer")), list(KEYS), "left")
        flow = F.coalesce("_newer", "flow")
    units = F.coalesce(F.col("_units"), F.col("_pace") * F.lit(month / 12.0))
    income = chain_step(chain_step("_inc", "g_prior"), "g_now")
    return held.select(
        *KEYS, ratio(flow, "_pop").alias("net_migration"), F.coalesce("_jobg", "_jobs").alias("job_growth"),
        F.col("g_now").alias("income_growth"), ratio(annualised(units, month), "_stock").alias("permits_to_stock"),
        ratio(F.col("_rent") * 12.0, income).alias("rent_to_income"),
        ratio(annuity_payment("_value", "rate"), "_rent").alias("cost_to_own_vs_rent"),
        F.col("_rentg").alias("trailing_rent_growth"), F.col("_div").alias("employment_diversity"))


def proxied(ind: DataFrame, column: str, proxy: DataFrame, periods: Sequence[int] | None = None) -> DataFrame:
    """Put a proxy (entity, period, proxy) in the place of an indicator in chosen periods, where it exists."""
    chosen = F.lit(True) if periods is None else F.col("period").isin(list(periods))
    return (ind.join(proxy.select(*KEYS, F.col("proxy").alias("_p")), list(KEYS), "left")
            .withColumn(column, F.when(chosen, F.coalesce("_p", column)).otherwise(F.col(column))).drop("_p"))


def carry_missing(ind: DataFrame, columns: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """Fill missing inputs of chosen periods from the period just before."""
    chosen = F.col("period").isin(list(periods))
    return ind.withColumns({c: F.when(chosen, F.coalesce(F.col(c), shifted(c, -1))).otherwise(F.col(c)) for c in columns})


def variant_with_proxy(ind: DataFrame, final_growth: DataFrame, column: str, proxy: DataFrame, span: int = 3,
                       at_least: int = 2) -> DataFrame:
    """Multi-period mean whose newest part is the proxy of the period, older parts final values."""
    older = final_growth.select(*KEYS, *[shifted(column, -i).alias(f"_l{i}") for i in range(1, span)])
    held = ind.drop(column).join(older, list(KEYS), "left").join(
        proxy.select(*KEYS, F.col("proxy").alias("_l0")), list(KEYS), "left")
    parts = F.array(*[F.col(f"_l{i}") for i in range(span)])
    present = F.filter(parts, lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present))
    return held.withColumn(column, F.when(F.size(present) >= at_least, mean)).drop(*[f"_l{i}" for i in range(span)])


def provenance(model: Model, source: Mapping[str, str] = EARLY_SOURCE) -> list[tuple[str, str, float]]:
    return [(k, source[k], w) for k, w in model.weights.items()]


def history_with_early(panel: DataFrame, model: Model, early: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Final indicators with the rows of some periods replaced by their early form."""
    ind = indicators(panel, model)
    return ind.filter(~F.col("period").isin(list(periods))).unionByName(
        early.filter(F.col("period").isin(list(periods))).select(*ind.columns))


def rebuilt_variants(ind: DataFrame, early: DataFrame, periods: DataFrame, columns: Sequence[str], flow: str = "net_migration",
                     late: Sequence[str] = ("job_growth", "income_growth")) -> dict[str, DataFrame]:
    """Indicator tables that tell which stand-in costs accuracy, by name.

    ``real``: final values. ``pseudo``: the early rows in the asked periods. ``flow_proxied``: final values but for the flow.
    ``late_final``: early rows with the final values of the late inputs, where there are any.
    """
    names = [*KEYS, *columns]
    real = ind.select(*names)
    pseudo = real.join(periods, "period", "left_anti").unionByName(early.join(periods, "period", "left_semi").select(*names))
    proxy = pseudo.select(*KEYS, F.col(flow).alias("_p"), F.lit(True).alias("_met"))
    final = real.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in late])
    return {
        "real": real, "pseudo": pseudo,
        "flow_proxied": real.join(proxy, list(KEYS), "left").withColumn(
            flow, F.when(F.col("_met"), F.col("_p")).otherwise(F.col(flow))).select(*names),
        "late_final": pseudo.join(final, list(KEYS), "left").withColumns(
            {c: F.coalesce(f"_{c}", c) for c in late}).select(*names)}


def series_coverage(series: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """Per expected entity: was the series found, when was it last observed."""
    seen = series.groupBy("entity").agg(F.max("period").alias("last_obs"), F.count(name).alias("n_obs"))
    return expected.select("entity").join(seen, "entity", "left").select(
        "entity", F.col("last_obs").isNotNull().alias("found"), "last_obs", F.coalesce("n_obs", F.lit(0)).alias("n_obs"))


def growth_pairs(proxy: DataFrame, proxy_value: str, final: DataFrame, final_value: str) -> DataFrame:
    """(entity, period, proxy, final) exact-prior growth of two series, both present."""
    a = proxy.select(*KEYS, exact_growth(proxy_value).alias("proxy"))
    b = final.select(*KEYS, exact_growth(final_value).alias("final"))
    return a.join(b, list(KEYS)).filter(F.col("proxy").isNotNull() & F.col("final").isNotNull())
