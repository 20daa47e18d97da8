"""Decision tables: does a candidate, a variant or an as-of rebuild clear its bars?"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.functions.scalar import col, ratio
from paneltide.operators.order import top_k_overlap
from paneltide.operators.rollup import coverage_by_period
from paneltide.operators.stats import correlation, spearman, zscores
from paneltide.plans.model import Model
from paneltide.plans.rankings import strategies
from paneltide.plans.resample import bootstrap, paired_gaps
from paneltide.plans.scoring import composite
from paneltide.plans.walkforward import outcome_frame, window_metrics, window_rows
from paneltide.scale import staged

KEYS = ("entity", "period")

# Gate bars.
MIN_STANDALONE_TAU = 0.10
MAX_CORRELATION = 0.70
MIN_RETENTION = 0.85
MIN_OVERLAP = 7.0
MIN_EDITION_RHO = 0.80


def candidate_scores(panel: DataFrame, columns: Mapping[str, tuple[str | Column, int]],
                     bound: int | None = None) -> DataFrame:
    """One oriented sample z-score column per candidate: name -> (value, direction)."""
    held = panel.select(*KEYS, *[col(c).alias(f"_raw_{n}") for n, (c, _) in columns.items()])
    z = zscores(held, ["period"], {n: f"_raw_{n}" for n in columns}, sample=True,
                signs={n: s for n, (_, s) in columns.items()}, bound=bound)
    return z.select(*KEYS, *columns)


def candidate_gate(norm: DataFrame, cand: DataFrame, names: Sequence[str], model: Model, outcome: DataFrame,
                   periods: DataFrame | None, weights: Sequence[float] = (0.10,), replicates: int = 800,
                   bound: int | None = None) -> DataFrame:
    """All candidates at all weights in one plan.

    Standalone tau (sign turned when negative), largest absolute correlation with a current
    indicator, and the bootstrap interval of the tau gained by adding the candidate.
    """
    wide = staged(norm.join(cand, list(KEYS), "left"), "candidates")
    alone = window_metrics(
        window_rows(strategies(wide, {n: F.col(n) for n in names}), outcome, periods), bound=bound)
    taus = staged(alone.groupBy("strategy").agg(F.avg("weighted_tau").alias("_tau")).select(
        F.col("strategy").alias("candidate"), F.abs("_tau").alias("standalone_tau"), (F.col("_tau") < 0).alias("flipped")),
        "standalone")

    one = wide.agg(*[correlation(n, k).alias(f"{n}|{k}") for n in names for k in model.names])
    worst = [F.struct(F.lit(n).alias("candidate"),
                      F.greatest(*[F.abs(F.col(f"`{n}|{k}`")) for k in model.names]).alias("max_abs_corr")) for n in names]
    corr = one.select(F.explode(F.array(*worst)).alias("c")).select("c.*")

    # The direction found above turns the candidate before it is blended in: one row per candidate.
    turns = taus.agg(F.map_from_entries(F.collect_list(F.struct(
        "candidate", F.when(F.col("flipped"), -1.0).otherwise(1.0).alias("s"))))).scalar()
    turned = wide.withColumns({"score": composite(model.weights), "_turn": turns})
    scores: dict[str, Column] = {"full": F.col("score")}
    for n in names:
        lean = F.coalesce(F.col(n), F.lit(0.0)) * F.coalesce(F.try_element_at("_turn", F.lit(n)), F.lit(1.0))
        for w in weights:
            scores[f"{n}@{w:g}"] = F.lit(1.0 - w) * F.col("score") + F.lit(w) * lean
    frame = outcome_frame(strategies(turned, scores), outcome, len(scores), periods, bound)
    point, drawn = bootstrap(frame, replicates, bound=bound)
    gaps = paired_gaps(point, drawn, "full").filter(
        F.col("strategy") != "full")
    gained = gaps.select(
        F.substring_index("strategy", "@", 1).alias("candidate"),
        F.substring_index("strategy", "@", -1).cast("double").alias("weight"),
        (-F.col("gap")).alias("delta_tau"), (-F.col("gap_hi")).alias("delta_lo"), (-F.col("gap_lo")).alias("delta_hi"))
    out = gained.join(taus, "candidate").join(corr, "candidate")
    return out.withColumn("adopt", (F.col("standalone_tau") > MIN_STANDALONE_TAU)
                          & (F.col("max_abs_corr") < MAX_CORRELATION) & (F.col("delta_lo") > 0))


def candidate_correlations(norm: DataFrame, cand: DataFrame, names: Sequence[str], model: Model, k: int = 3) -> DataFrame:
    """Per candidate the k current indicators that it goes with most closely: candidate, place, indicator, corr. One aggregation for all pairs."""
    wide = norm.join(cand, list(KEYS), "left")
    one = wide.agg(*[F.array(*[F.struct(correlation(n, i).alias("corr"), F.lit(i).alias("indicator")) for i in model.names]).alias(n) for n in names])
    each = one.unpivot([], list(names), "candidate", "pairs").select("candidate", F.array_sort(
        F.filter("pairs", lambda p: p["corr"].isNotNull()),
        lambda a, b: F.when(F.abs(a["corr"]) > F.abs(b["corr"]), -1).when(F.abs(a["corr"]) < F.abs(b["corr"]), 1).when(a["indicator"] < b["indicator"], -1).otherwise(1)).alias("pairs"))
    return each.select("candidate", F.posexplode(F.slice("pairs", 1, k)).alias("at", "pair")).select(
        "candidate", (F.col("at") + 1).alias("place"), "pair.indicator", "pair.corr")


def conjunctive_verdict(gates: DataFrame, order: Sequence[str], replacement: DataFrame) -> DataFrame:
    """A candidate passes only if it passes at every weight; a passing replacement takes precedence,
    then the first passing candidate in declared order. ``replacement`` has one row: name, pass."""
    place = F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))])
    each = gates.groupBy("candidate").agg(F.min("adopt").alias("pass"))
    first = each.filter("pass").agg(F.min(F.struct(
        F.try_element_at(place, F.col("candidate")).alias("i"), "candidate")).getField("candidate")).scalar()
    return replacement.select(
        F.when(F.col("pass"), F.concat(F.lit("replace:"), F.col("name")))
        .when(first.isNotNull(), F.concat(F.lit("add:"), first))
        .otherwise(F.lit("reject all")).alias("verdict"))


def replacement(better: DataFrame, stable: DataFrame, name: str) -> DataFrame:
    """One row (name, pass): a replacement must pass both of its gates; a gate without a row or a verdict fails."""
    both = better.agg(F.bool_and("pass").alias("_a")).withColumn("_b", stable.agg(F.bool_and("pass")).scalar())
    return both.select(F.lit(name).alias("name"), F.coalesce(F.col("_a") & F.col("_b"), F.lit(False)).alias("pass"))


def coverage_kill(df: DataFrame, measures: Sequence[str], floor: int, periods: DataFrame | None = None) -> DataFrame:
    """A measure fails when any period that has data covers fewer than ``floor`` entities."""
    held = df if periods is None else df.join(periods, "period", "left_semi")
    per = coverage_by_period(held, measures)
    some = F.when(F.col("n_entities") > 0, F.col("n_entities"))
    return per.groupBy("measure").agg(
        F.coalesce(F.min(some), F.lit(0)).alias("min_covered"), F.count(some).alias("periods_with_data"),
        F.count(F.lit(1)).alias("periods_total")).withColumn(
        "ok", (F.col("periods_with_data") > 0) & (F.col("min_covered") >= floor))


def variant_verdict(gaps: DataFrame, variant: str, rule: str = "not_worse") -> DataFrame:
    """Variant against current on the same draws; ``gaps`` is current minus each strategy.

    ``not_worse``: the interval of variant - current reaches zero or above. ``better``: it lies above zero.
    """
    passed = F.col("gap_hi") < 0 if rule == "better" else F.col("gap_lo") <= 0
    return gaps.filter(F.col("strategy") == variant).select(
        "strategy", F.col("tau").alias("tau_variant"), (F.col("tau") + F.col("gap")).alias("tau_current"),
        (-F.col("gap")).alias("gap"), (-F.col("gap_hi")).alias("gap_lo"), (-F.col("gap_lo")).alias("gap_hi"),
        passed.alias("pass"))


def edition_stability(first: DataFrame, second: DataFrame, floor: float = MIN_EDITION_RHO,
                      bound: int | None = None) -> DataFrame:
    """Rank correlation of two editions' scores over the shared entities."""
    both = first.select("entity", F.col("score").alias("a")).join(
        second.select("entity", F.col("score").alias("b")), "entity").withColumn("_all", F.lit(0))
    return spearman(both, ["_all"], "a", "b", bound=bound).select("n", "rho", (F.col("rho") >= floor).alias("pass"))


def agreement(left: DataFrame, right: DataFrame, k: int = 10, at_least: int = 10, bound: int | None = None) -> DataFrame:
    """Per period: rank correlation and top-k overlap of two score tables over shared entities."""
    both = left.select(*KEYS, F.col("score").alias("a")).join(right.select(*KEYS, F.col("score").alias("b")), list(KEYS))
    both = both.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    rho = spearman(both, ["period"], "a", "b", at_least=at_least, bound=bound)
    shared = top_k_overlap(both.withColumnRenamed("a", "score"), both.withColumnRenamed("b", "score"),
                           ["period"], "entity", "score", k)
    return rho.join(shared, "period").filter(F.col("n") >= at_least)


def retention_gate(summary: DataFrame, agreed: DataFrame, final: str, proxy: str, horizon: int) -> DataFrame:
    """tau(proxy) / tau(final) and mean overlap against their bars; one row."""
    def tau(name: str) -> Column:
        return F.max(F.when((F.col("strategy") == name) & (F.col("horizon") == horizon)
                            & (F.col("regime") == "POOLED"), F.col("mean_tau")))
    one = summary.agg(tau(final).alias("tau_final"), tau(proxy).alias("tau_proxy"))
    kept = one.withColumns({"mean_overlap": agreed.agg(F.avg("overlap")).scalar(), "retention": ratio("tau_proxy", "tau_final")})
    return kept.withColumn("pass", (F.col("retention") >= MIN_RETENTION) & (F.col("mean_overlap") >= MIN_OVERLAP))


def loss_decomposition(windows: DataFrame, horizon: int, reference: str = "real") -> DataFrame:
    """Mean tau of every variant's windows at one horizon, and the share of the reference's that it retains."""
    mean = staged(windows.filter(F.col("horizon") == horizon).groupBy("strategy").agg(F.avg("weighted_tau").alias("tau")), "loss")
    own = mean.filter(F.col("strategy") == reference).select("tau").scalar()
    return mean.withColumn("_own", own).select("strategy", "tau", ratio("tau", "_own").alias("retention"))


def side_by_side(summary: DataFrame, left: str, right: str) -> DataFrame:
    """Two strategies of a summary on one row per (horizon, regime)."""
    a = summary.filter(F.col("strategy") == left).select(
        "horizon", "regime", F.col("mean_tau").alias("mean_tau_a"), F.col("mean_precision").alias("mean_precision_a"))
    b = summary.filter(F.col("strategy") == right).select(
        "horizon", "regime", F.col("mean_tau").alias("mean_tau_b"), F.col("mean_precision").alias("mean_precision_b"))
    return a.join(b, ["horizon", "regime"])


def guarded_candidates(panel: DataFrame, levels: Mapping[str, str], changes: Mapping[str, str]) -> DataFrame:
    """Long candidate table (candidate, entity, period, cand) of levels and guarded one-period changes."""
    from paneltide.operators.growth import guarded_change
    out = [panel.filter(F.col(c).isNotNull()).select(F.lit(n).alias("candidate"), *KEYS, F.col(c).cast("double").alias("cand"))
           for n, c in levels.items()]
    out += [guarded_change(panel, c, "cand", "difference").select(F.lit(n).alias("candidate"), *KEYS, "cand")
            for n, c in changes.items()]
    frame = out[0]
    for more in out[1:]:
        frame = frame.unionByName(more)
    return frame

