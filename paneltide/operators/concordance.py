"""Top-weighted Kendall correlation without a pair join.

For rows i, j of one group with score x, outcome y and weight w (the reciprocal of the outcome
rank, summed over the copies of a resampled row) and multiplicity m:

    tau = sum over pairs of (w_i m_j + w_j m_i) sgn(x_i - x_j) sgn(y_i - y_j)
          / sqrt((T - T_x) * (T - T_y))

T is the weight of all pairs and T_x, T_y that of pairs tied in x or y. The numerator comes from a
radix walk over the rank code of x: two codes that differ do so first at exactly one digit level,
so each row is emitted once per level and meets, inside the block that shares the higher digits,
the rows of another digit. Taking every pair at its member that comes later along y, it only needs
the running count and running weight of each digit. That is rows * log(rows) work. A group that a task may hold
goes there as it is, and the walk runs over arrays (`operators.replicates`); a larger one is emitted by level and cut.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.operators.order import ALL_BEFORE, split_ranks
from paneltide.operators.replicates import block_sums, group_taus
from paneltide.scale import join_groups, largest_group, small_side, staged, task_row_limit

DIGIT_BITS = 3
RADIX = 1 << DIGIT_BITS
MAX_BLOCK = 1 << 18  # ranks of a large group that one task walks whole


def _copies_weight(start: str, copies: str):
    """Sum of 1 / (rank + 1) over the zero-based ranks start .. start + copies - 1."""
    single = F.lit(1.0) / (F.col(start) + F.lit(1.0))
    steps = F.sequence(F.lit(1), F.col(copies).cast("int"))
    many = F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.lit(1.0) / (F.col(start) + k))
    return F.when(F.col(copies) == 1, single).otherwise(many)


def _codes_wide(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rank codes by the split plan: one ordering pass for the outcome, one for the score. The outcome code runs downwards."""
    ranks = {"_first": F.col("_first").cast("int") - 1}
    held = split_ranks(rows, group, "_y", True, [F.col("_tie")], F.col("_m"))
    held = held.withColumns({"_dy": ranks["_first"], "_wt": _copies_weight("_before", "_m")})
    held = split_ranks(held.drop("_first", "_ties", "_n", "_before"), group, "_x", False)
    return held.withColumn("_dx", ranks["_first"]).withColumnRenamed("_n", "_rows").drop("_first", "_ties", "_before")


DIGITS = range(RADIX)


def _numbers(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in ("_x", "_y")})


def _running(over: str) -> dict[str, Column]:
    """Count and weight of every digit over a window given as SQL text."""
    return {f"_{out}{d}": F.expr(f"coalesce(sum(CASE WHEN _digit = {d} THEN {src} END) OVER ({over}), 0)")
            for out, src in (("c", "_m"), ("v", "_wt")) for d in DIGITS}


def _pair_term() -> Column:
    """Pairs of a row with the rows before it; those have the better outcome, hence the order of the signs."""
    return F.expr(" + ".join(f"signum({d} - _digit) * (_wt * _c{d} + _m * _v{d})" for d in DIGITS))


def weighted_tau(df: DataFrame, group: Sequence[str], score: str, outcome: str, tie: str, *,
                 copies: str | None = None, name: str = "tau", bound: int | None = None,
                 also: Mapping[str, tuple[Callable[[Column], Column], Column]] | None = None) -> DataFrame:
    """Per group: rank correlation of ``score`` with ``outcome``, pairs weighted by outcome rank.

    ``tie`` orders equal outcomes when ranks are assigned (best outcome first). ``copies`` is the
    multiplicity of a row in a bootstrap replicate; copies of one row are ties in both variables.
    Rows with a NULL score or outcome must be dropped by the caller. NULL when either side is constant.

    ``also`` adds plain aggregates of the same rows (name -> aggregate function, row expression), so
    that other statistics of the group need no second pass. The functions must ignore NULL.
    """
    also = also or {}
    m = F.lit(1).cast("bigint") if copies is None else F.col(copies).cast("bigint")
    extra = [f"_also_{n}" for n in also]
    rows = df.select(*group, F.col(score).alias("_x"), F.col(outcome).alias("_y"), F.col(tie).alias("_tie"),
                     m.alias("_m"), *[c.alias(f"_also_{n}") for n, (_, c) in also.items()])
    size = largest_group(rows, group) if bound is None else bound
    if size > task_row_limit(df.sparkSession):
        got = _aggregate_wide(_codes_wide(rows, group), group, also)
    elif not also:
        return group_taus(_numbers(rows), group).withColumnRenamed("_tau", name)
    else:
        return group_taus(_numbers(rows), group, extra).groupBy(*group).agg(
            *[f(F.col(f"_also_{n}")).alias(n) for n, (f, _) in also.items()], F.max("_tau").alias(name))
    total = (F.col("_mm") - 1) * F.col("_ww")
    spread = F.greatest(total - F.col("_tx"), F.lit(0.0)) * F.greatest(total - F.col("_ty"), F.lit(0.0))
    # a side whose longest tie run is the whole group is constant: no pair is ordered
    varies = (F.col("_lx") < F.col("_mm")) & (F.col("_ly") < F.col("_mm"))
    return got.select(*group, *also, F.when(
        varies, F.try_divide(F.coalesce(F.col("_num"), F.lit(0.0)), F.sqrt(spread))).alias(name))


def _digits(coded: DataFrame, keep: Sequence[str], lowest: int | Column = 0) -> DataFrame:
    bits = F.length(F.bin(F.greatest(F.col("_rows") - 1, F.lit(1)).cast("bigint")))
    levels = F.ceil(bits / F.lit(float(DIGIT_BITS))).cast("int")
    low = F.lit(lowest) if isinstance(lowest, int) else lowest
    steps = F.when(low < levels, F.sequence(low, F.greatest(levels - 1, low)))
    return (coded.select(*keep, "_dx", "_dy", "_m", "_wt", F.explode(steps).alias("_level"))
            .withColumns({
                "_block": F.expr(f"shiftright(_dx, {DIGIT_BITS} * (_level + 1))"),
                "_digit": F.expr(f"shiftright(_dx, {DIGIT_BITS} * _level) & {RADIX - 1}")}))


def _aggregate_wide(coded: DataFrame, group: Sequence[str], also) -> DataFrame:
    """Split form: the numerator and each tie sum are their own aggregations, joined per group."""
    coded = staged(coded)
    terms = _whole_blocks(coded, group)
    numerator = terms.groupBy(*group).agg(F.sum("_term").alias("_num"))
    base = coded.groupBy(*group).agg(
        F.sum("_m").alias("_mm"), F.sum("_wt").alias("_ww"),
        *[f(F.col(f"_also_{n}")).alias(n) for n, (f, _) in also.items()])
    for code, out, longest in (("_dx", "_tx", "_lx"), ("_dy", "_ty", "_ly")):
        ties = coded.groupBy(*group, code).agg(F.sum("_m").alias("_mt"), F.sum("_wt").alias("_wtt"))
        base = join_groups(base, ties.groupBy(*group).agg(
            F.sum((F.col("_mt") - 1) * F.col("_wtt")).alias(out), F.max("_mt").alias(longest)), list(group))
    return join_groups(base, numerator, list(group), "left")


def _whole_blocks(coded: DataFrame, group: Sequence[str]) -> DataFrame:
    """Pair terms: blocks of ranks that a task may hold go there whole, once; only the levels above them are emitted a row a level.

    A long tie run of the score can make such a block larger: its rows are emitted at every level.
    """
    limit = min(task_row_limit(coded.sparkSession), MAX_BLOCK)
    low = int(math.log(limit, RADIX) + 1e-9)
    cut = coded.withColumn("_low", F.expr(f"shiftright(_dx, {DIGIT_BITS * low})"))
    key = [*group, "_low"]
    long = small_side(cut.groupBy(*key).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > limit))
    marked = join_groups(cut, long, key, "left")
    inside = block_sums(marked.where(F.col("_size").isNull()).select(*key, "_dx", "_dy", "_m", "_wt"), key).select(*group, "_term")
    above = _digits(marked, list(group), F.when(F.col("_size").isNull(), F.lit(low)).otherwise(0))
    return _balance_wide(above, group).unionByName(inside)


def _stretches(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Cells (block, stretch, y, digit) with their sums; no stretch has more cells than a task may hold.

    Summing to cells first keeps tied outcomes from piling up. Which blocks are cut is told by their
    measured rows: a long tie run of the score fills a block of any width.
    """
    step = max(1, task_row_limit(rows.sparkSession) // RADIX)  # a stretch has one cell at most for each y and digit
    block = [*group, "_level", "_block"]
    long = small_side(rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > step))
    return (join_groups(rows, long, block, "left")
            .withColumn("_stretch", F.when(F.col("_size") > step, F.floor(F.col("_dy") / step)).otherwise(0).cast("int"))
            .groupBy(*block, "_stretch", "_dy", "_digit").agg(F.sum("_m").alias("_m"), F.sum("_wt").alias("_wt")))


def _balance_wide(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """The same terms with each long block cut into stretches of y; running sums inside a stretch start from
    those of the earlier stretches.
    """
    block = [*group, "_level", "_block"]
    key = [*block, "_stretch"]
    cells = _stretches(rows, group)
    names = [f"_{out}{d}" for out in "cv" for d in DIGITS]
    per_stretch = cells.groupBy(*key).agg(*[F.expr(
        f"coalesce(sum(CASE WHEN _digit = {n[2:]} THEN {'_m' if n[1] == 'c' else '_wt'} END), 0) AS {n}") for n in names])
    ahead = Window.partitionBy(*block).orderBy("_stretch").rowsBetween(*ALL_BEFORE)
    carried = per_stretch.select(*key, *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_o{n}") for n in names])
    part = ", ".join(f"`{g}`" for g in key)
    inner = cells.withColumns(_running(f"PARTITION BY {part} ORDER BY _dy RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"))
    full = join_groups(inner, carried, key).withColumns({n: F.expr(f"{n} + _o{n}") for n in names})
    return full.select(*group, _pair_term().alias("_term"))
