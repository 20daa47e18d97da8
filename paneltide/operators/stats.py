"""Within-group standardisation and correlation."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.functions.scalar import col, ratio
from paneltide.operators.order import add_ranks, quantiles
from paneltide.scale import is_wide, join_groups, largest_group, small_side


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson over the rows where both are present; NULL when either side is constant.

    Spelled out from its moments because the built-in raises on a constant side in ANSI mode.
    """
    a, b = col(x), col(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def zscores(df: DataFrame, group: Sequence[str], columns: Mapping[str, str], *, sample: bool = False,
            signs: Mapping[str, int] | None = None, bound: int | None = None) -> DataFrame:
    """Standardise columns within groups; ``columns`` maps output name to input column.

    Population form (default): a group without spread gives 0 for every row, missing input included.
    Sample form: a group without spread gives NULL. ``signs`` flips chosen outputs with -1.
    """
    spread = "stddev_samp" if sample else "stddev_pop"
    stats = {}
    for out, src in columns.items():
        stats[f"_avg_{out}"], stats[f"_std_{out}"] = f"avg(`{src}`)", f"{spread}(`{src}`)"
    if is_wide(df, group, bound):
        table = small_side(df.groupBy(*group).agg(*[F.expr(e).alias(n) for n, e in stats.items()]))
        held = join_groups(df, table, list(group), "left")
    else:
        part = ", ".join(f"`{g}`" for g in group)
        held = df.withColumns({n: F.expr(f"{e} OVER (PARTITION BY {part})") for n, e in stats.items()})
    out_cols = {}
    for out, src in columns.items():
        avg, std = f"`_avg_{out}`", f"`_std_{out}`"
        z = f"(`{src}` - {avg}) / nullif({std}, 0.0D)"
        z = z if sample else f"CASE WHEN {std} = 0 THEN 0.0D ELSE {z} END"
        out_cols[out] = F.expr(f"-({z})" if (signs or {}).get(out, 1) < 0 else z)
    return held.withColumns(out_cols).drop(*stats)


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str, *, at_least: int = 2, name: str = "rho",
             bound: int | None = None) -> DataFrame:
    """Rank correlation per group on complete pairs, NULL below ``at_least`` pairs."""
    ranked = _pair_ranks(df, group, {"_rx": x, "_ry": y}, bound)
    return ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) >= at_least, correlation("_rx", "_ry")).alias(name))


def _pair_ranks(df: DataFrame, group: Sequence[str], columns: Mapping[str, str], bound: int | None) -> DataFrame:
    held = df
    for src in columns.values():
        held = held.filter(F.col(src).isNotNull())
    size = largest_group(held, group) if bound is None else bound
    for out, src in columns.items():
        held = add_ranks(held, group, src, average=out, descending=False, bound=size)
    return held


def rank_orthogonality(df: DataFrame, group: Sequence[str], score: str, other: str, outcome: str,
                       bound: int | None = None) -> DataFrame:
    """Rank correlation of score and outcome: raw, with ``other`` partialled out, and of the misses.

    The partial form is the correlation of the residuals of the ranks after a linear fit on the
    ranks of ``other``, which reduces to the three pairwise correlations.
    """
    ranked = _pair_ranks(df, group, {"_s": score, "_o": other, "_r": outcome}, bound)
    got = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), correlation("_s", "_r").alias("spearman_raw"),
        correlation("_s", "_o").alias("_so"), correlation("_o", "_r").alias("_or"),
        correlation(F.col("_r") - F.col("_s"), F.col("_r") - F.col("_o")).alias("error_correlation"))
    left = F.greatest(F.lit(0.0), (1 - F.col("_so") * F.col("_so")) * (1 - F.col("_or") * F.col("_or")))
    return got.withColumn("partial_spearman", ratio(
        F.col("spearman_raw") - F.col("_so") * F.col("_or"), F.sqrt(left))).drop("_so", "_or")


def correlation_pairs(df: DataFrame, columns: Sequence[str], others: Sequence[str] | None = None,
                      group: Sequence[str] = ()) -> DataFrame:
    """Long correlation table (left, right, r) from a single aggregation pass."""
    pairs = [(a, b) for a in columns for b in others] if others else list(combinations(columns, 2))
    wide = df.groupBy(*group).agg(*[correlation(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_{i}").alias("r"))
                      for i, (a, b) in enumerate(pairs)])
    return wide.select(*group, F.explode(cells).alias("c")).select(*group, "c.*")


def percentile_interval(df: DataFrame, group: Sequence[str], value: str, level: float = 0.95,
                        lo: str = "lo", hi: str = "hi", bound: int | None = None) -> DataFrame:
    """Central interval over replicates, missing ones ignored."""
    tail = (1.0 - level) / 2.0
    return quantiles(df, group, value, {lo: tail, hi: 1.0 - tail}, bound)


def leave_one_out(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Range of the group mean when any single row is left out, beside the plain range."""
    w = Window.partitionBy(*group)
    n, total = F.count(value).over(w), F.sum(value).over(w)
    held = df.filter(F.col(value).isNotNull()).withColumn(
        "_loo", F.when(n > 1, (total - F.col(value)) / F.when(n > 1, n - 1)))
    return held.groupBy(*group).agg(
        F.count(value).alias("n_windows"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.min("_loo").alias("jackknife_min"), F.max("_loo").alias("jackknife_max"))


def rank_persistence(df: DataFrame, value: str, entity: str = "entity", period: str = "period",
                     at_least: int = 10, bound: int | None = None) -> DataFrame:
    """Rank correlation of x(t) with x(t - 1) for each period."""
    from paneltide.operators.growth import shifted
    pairs = df.select(entity, period, value, shifted(value, -1, entity, period).alias("_prev"))
    return spearman(pairs, [period], value, "_prev", at_least=at_least, name="persistence", bound=bound)
