"""Bootstraps and input-noise intervals as rows with a replicate key.

Draws are MD5 based, so they are reproducible on any engine and after any task retry.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.functions.scalar import draw_bits, wide_draw_bits
from paneltide.operators import noise
from paneltide.operators import replicates as blocks
from paneltide.operators.concordance import weighted_tau
from paneltide.operators.order import add_positions, quantiles, top_k
from paneltide.operators.stats import percentile_interval
from paneltide.plans.model import LEADING_LOW, MIN_WINDOW_ROWS, TIERS
from paneltide.scale import largest_group, spread, staged, task_row_limit


def draws(units: DataFrame, unit: str, replicates: int, seed: str = "boot", bound: int | None = None) -> DataFrame:
    """(replicate, unit, copies): n units drawn n times with replacement, as multiplicities.

    Every unit emits one draw per replicate, so nothing is crossed; equal draws are summed before
    they meet the data. Units come numbered out of one task, so they are dealt over all partitions before they draw.
    """
    known = units.select(unit).distinct().withColumn("_all", F.lit(0))
    indexed = add_positions(known, ["_all"], [F.col(unit)], "_at", bound).drop("_all")
    total = known.agg(F.count(F.lit(1))).scalar()
    pulls = (spread(indexed.select("_at"), "_at").select("_at", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
             .select("replicate", (wide_draw_bits(F.lit(seed), "replicate", "_at") % total + 1).alias("_at")))
    counted = pulls.groupBy("replicate", "_at").agg(F.count(F.lit(1)).alias("copies"))
    return counted.join(indexed, "_at").select("replicate", unit, "copies")


def cluster_draws(members: DataFrame, cluster: str, replicates: int, seed: str = "boot",
                  bound: int | None = None) -> DataFrame:
    """Draw clusters, take all their members: (replicate, entity, copies)."""
    picked = draws(members, cluster, replicates, seed, bound)
    return picked.join(members.select("entity", cluster).distinct(), cluster).select("replicate", "entity", "copies")


def replicate_taus(frame: DataFrame, drawn: DataFrame, bound: int | None = None,
                   windows: Sequence[str] = ("horizon", "period")) -> DataFrame:
    """Pooled tau per (replicate, strategy): mean over the windows with enough drawn rows.

    Blocks of replicates where the units of a window are one task's matrix, else a row a replicate in the split plan.
    """
    group = ["strategy", *windows]
    size = largest_group(frame, group) if bound is None else bound
    if blocks.fits(size, task_row_limit(frame.sparkSession)):
        block = blocks.block_size(size)
        per = blocks.taus(frame, blocks.folded(drawn, block=block), group, "score", "realized", block=block).withColumnRenamed("n", "_n")
    else:
        per = weighted_tau(frame.join(drawn, "entity"), ["replicate", *group], "score", "realized", "entity", copies="copies",
                           bound=bound, also={"_n": (F.sum, F.col("copies"))})
    return per.filter(F.col("_n") >= MIN_WINDOW_ROWS).groupBy("replicate", "strategy").agg(F.avg("tau").alias("tau"))


def pooled_taus(frame: DataFrame, bound: int | None = None, windows: Sequence[str] = ("horizon", "period")) -> DataFrame:
    """Full-sample point estimate per strategy."""
    per = weighted_tau(frame, ["strategy", *windows], "score", "realized", "entity", bound=bound,
                       also={"_n": (F.count, F.col("score"))})
    return per.filter(F.col("_n") >= MIN_WINDOW_ROWS).groupBy("strategy").agg(F.avg("tau").alias("tau"))


def bootstrap(frame: DataFrame, replicates: int, *, members: DataFrame | None = None, cluster: str | None = None,
              seed: str = "boot", bound: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(point estimates, replicate estimates) of a window frame, by entity or by cluster of entities.

    The frame feeds the draws, the point and the replicates, and the estimates feed intervals and
    gaps, so each of the three is written once.
    """
    frame = staged(frame, "frame")
    drawn = (draws(frame, "entity", replicates, seed, bound) if members is None
             else cluster_draws(members, cluster, replicates, seed, bound))
    return staged(pooled_taus(frame, bound), "point"), staged(replicate_taus(frame, drawn, bound), "replicates")


def tau_intervals(point: DataFrame, replicates: DataFrame) -> DataFrame:
    """Point estimate with its 95% interval per strategy."""
    return point.join(percentile_interval(replicates, ["strategy"], "tau", bound=0), "strategy")


def paired_gaps(point: DataFrame, replicates: DataFrame, reference: str | None = None) -> DataFrame:
    """Reference minus each other strategy on the same draws; the best point estimate by default."""
    if reference is None:
        ref = point.agg(F.min(F.struct((-F.col("tau")).alias("t"), F.col("strategy").alias("s"))).getField("s")).scalar()
    else:
        ref = F.lit(reference)
    ref_rep = replicates.filter(F.col("strategy") == ref).select("replicate", F.col("tau").alias("_ref"))
    gaps = replicates.join(ref_rep, "replicate").select("strategy", (F.col("_ref") - F.col("tau")).alias("gap"))
    interval = percentile_interval(gaps, ["strategy"], "gap", lo="gap_lo", hi="gap_hi", bound=0)
    best = point.filter(F.col("strategy") == ref).select("tau").scalar()
    return (point.join(interval, "strategy")
            .select("strategy", ref.alias("reference"), "tau", (best - F.col("tau")).alias("gap"),
                    "gap_lo", "gap_hi", ((F.col("gap_lo") > 0) | (F.col("gap_hi") < 0)).alias("excludes_zero"),
                    (F.col("gap_lo") > 0).alias("reliably_worse")))


def simplest_acceptable(gaps: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """Among the schemes not reliably worse than the best: fewest indicators, then smallest gap."""
    n = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    ok = gaps.withColumn("n_indicators", F.try_element_at(n, F.col("strategy"))).filter(~F.col("reliably_worse"))
    return ok.orderBy("n_indicators", "gap", "strategy").limit(1).select("strategy", "n_indicators")


def noisy_ranks(norm: DataFrame, base: Column, reliability: Mapping[str, float], weights: Mapping[str, float],
                replicates: int, seed: str = "noise", group: str = "edition", bound: int | None = None) -> DataFrame:
    """Rank of every entity in every draw: chosen inputs become rho * z + sqrt(1 - rho^2) * noise.

    Ranks come in blocks (`operators.noise`), which `rank_intervals` takes.
    """
    rows = norm.select(group, "entity", base.cast("double").alias("_base"), *[
        F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(f"_z{i}") for i, k in enumerate(reliability)])
    return noise.noisy_ranks(rows, [(f"{seed}-{k}", rho, weights[k]) for k, rho in reliability.items()], replicates, group, bound)


def hundredths(ordered: str, percent: int) -> Column:
    """A percentile of an ordered array of whole numbers, in hundredths: interpolated, but a whole number, so halves are halves everywhere."""
    at = (F.size(ordered) - 1) * percent
    i, part = F.floor(at / 100).cast("int"), at % 100
    low, high = F.element_at(ordered, i + 1), F.element_at(ordered, F.least(i + 2, F.size(ordered)))
    return low.cast("bigint") * (100 - part) + high.cast("bigint") * part


def half_even(x: Column) -> Column:
    """Hundredths to whole numbers, halves to the even one."""
    whole, rest = F.floor(x / 100), x % 100
    return (whole + F.when((rest > 50) | ((rest == 50) & (whole % 2 == 1)), 1).otherwise(0)).cast("int")


def rank_intervals(ranks: DataFrame, group: str = "edition") -> DataFrame:
    """5th, 50th and 95th percentile of the drawn ranks with the tier they imply.

    Ends round half to even. Ranks are blocks of draws, or rows with a rank each. One group is the draws of one entity, so its size is the draw count.
    """
    if noise.is_blocks(ranks):
        q = noise.percentiles(ranks, group, {"_q5": 5, "_q50": 50, "_q95": 95})
    else:
        rows = ranks.groupBy(group, "entity").agg(F.sort_array(F.collect_list("rank")).alias("_q"))
        q = rows.select(group, "entity", *[hundredths("_q", p).alias(f"_q{p}") for p in (5, 50, 95)])
    return q.select(group, "entity", half_even(F.col("_q5")).alias("rank_lo"), (F.col("_q50") / F.lit(100.0)).alias("rank_median"),
                    half_even(F.col("_q95")).alias("rank_hi")).withColumn("tier", tier("rank_lo", "rank_median"))


def tier(low: str, median: str, tiers: Sequence[tuple[str, float | None]] = TIERS, leading: int = LEADING_LOW) -> Column:
    out = None
    for i, (name, cut) in enumerate(tiers):
        if cut is None:
            return F.lit(name) if out is None else out.otherwise(F.lit(name))
        hit = F.col(median) <= cut
        hit = hit & (F.col(low) <= leading) if i == 0 else hit
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def tier_counts(intervals: DataFrame, group: str = "edition", tiers: Sequence[tuple[str, float | None]] = TIERS) -> DataFrame:
    """Entities per tier and edition, with the fixed position of the tier."""
    place = F.create_map(*[x for i, (n, _) in enumerate(tiers) for x in (F.lit(n), F.lit(i + 1))])
    return intervals.groupBy(group, "tier").agg(F.count(F.lit(1)).alias("n_entities")).withColumn(
        "tier_order", F.try_element_at(place, F.col("tier")))


def random_edge(outcome: DataFrame, seeds: int, k: int, group: Sequence[str] = ("horizon", "period"),
                bound: int | None = None) -> DataFrame:
    """Reference for the top-k edge: k random entities against the median, in points, mean over seeds."""
    shuffled = outcome.select(*group, "entity", "realized", F.explode(
        F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")).withColumn(
        "_u", draw_bits(F.lit("pick"), "seed", "entity", "period"))
    picked = top_k(shuffled, [*group, "seed"], [F.col("_u"), F.col("entity")], k)
    per_seed = picked.groupBy(*group, "seed").agg(F.avg("realized").alias("_best"))
    middle = quantiles(outcome, group, "realized", {"_mid": 0.5}, bound)
    return per_seed.join(middle, list(group)).groupBy(*group).agg(
        F.avg((F.col("_best") - F.col("_mid")) * 100.0).alias("random_edge_pp"))
