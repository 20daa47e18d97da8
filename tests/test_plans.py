"""Scoring, evaluation, resampling, as-of and registry rules."""
import random
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.catalog import build
from paneltide.plans import asof, editions, gates, quality, rankings, registry, resample, scoring, walkforward
from paneltide.plans.model import RENT_MODEL, Indicator, Measure, Model
from paneltide.scale import staging_path

MEASURES = ["net_migration", "population", "total_emp", "income_pc", "permits_total", "housing_units", "rent", "home_value",
            "mortgage_rate", "emp_hhi"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(3)
    data = [(e, p, *[round(rng.uniform(1, 9), 3) for _ in MEASURES], f"S{e % 3}") for e in range(24) for p in range(2010, 2018)]
    return spark.createDataFrame(data, "entity int, period int, " + ", ".join(f"{m} double" for m in MEASURES) + ", state string").cache()


@pytest.fixture(scope="module")
def norm(panel):
    return scoring.normalised(scoring.indicators(panel, RENT_MODEL), RENT_MODEL).cache()


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        Model({"a": Indicator(Measure("complement", "a"), 0.9, "b")})
    with pytest.raises(ValueError):
        rankings.weight_schemes({"s": {"a": 0.4, "b": 0.5}})


def test_scores_split_into_buckets_and_ranks_run(norm):
    s = scoring.scored(norm, RENT_MODEL)
    gap = s.select(F.max(F.abs(F.col("score") - sum(F.col(f"bucket_{b}") for b in RENT_MODEL.buckets))).alias("d")).first().d
    assert gap < 1e-12
    assert [r["rank"] for r in scoring.edition(s, 2015).collect()] == list(range(1, 25))
    assert s.filter("period = 2010").agg(F.max("n_indicators")).first()[0] == 5
    assert sorted(r.period for r in walkforward.usable_periods(s).collect()) == list(range(2011, 2018))


def test_small_windows_are_dropped_and_pooled_is_a_mean(norm, panel):
    ranking = rankings.strategies(norm, rankings.full_model(RENT_MODEL))
    got = walkforward.evaluate(ranking, panel, "rent", [1, 3], None, {"early": (2010, 2012)})
    assert got.filter("horizon = 3").count() == 5 and got.filter("horizon = 1").count() == 7
    few = walkforward.evaluate(ranking.filter("entity < 9"), panel, "rent", [1])
    assert few.count() == 0
    summ = {(r.horizon, r.regime): r.mean_tau for r in walkforward.summarise(got).collect()}
    mean = got.filter("horizon = 1").agg(F.avg("weighted_tau")).first()[0]
    assert summ[(1, "POOLED")] == pytest.approx(mean)


def test_windows_agree_in_both_plans(spark, norm, panel):
    ranking = rankings.strategies(norm, rankings.full_model(RENT_MODEL) | rankings.equal_weight(RENT_MODEL))
    run = lambda: sorted(map(tuple, walkforward.evaluate(ranking, panel, "rent", [2]).drop("regime").collect()))
    one = run()
    spark.conf.set("spark.paneltide.maxTaskRows", "7")
    try:
        two = run()
    finally:
        spark.conf.unset("spark.paneltide.maxTaskRows")
    assert [a[:3] for a in one] == [b[:3] for b in two]
    for a, b in zip(one, two):
        assert a[3:] == pytest.approx(b[3:])


def test_horizon_matched_persistence(panel):
    p = rankings.persistence(panel, "rent", [1, 3])
    assert p.filter("horizon = 3").agg(F.min("period")).first()[0] == 2013
    rows = walkforward.window_rows(p, walkforward.realised(panel, "rent", [1, 3]))
    assert rows.groupBy("strategy", "horizon", "entity", "period").count().filter("count > 1").count() == 0


def test_identical_rankings_have_no_gap(norm, panel):
    same = {"a": scoring.composite(RENT_MODEL.weights), "b": scoring.composite(RENT_MODEL.weights)}
    frame = walkforward.outcome_frame(rankings.strategies(norm, same), walkforward.realised(panel, "rent", [3]), 2)
    point, reps = resample.bootstrap(frame, 8)
    got = resample.paired_gaps(point, reps, "a").filter("strategy = 'b'").first()
    assert got.gap == pytest.approx(0.0) and got.gap_lo == pytest.approx(0.0) and not got.excludes_zero
    assert reps.groupBy("strategy").count().first()["count"] == 8


def test_draw_counts(spark):
    units = spark.range(30).select(F.col("id").alias("entity"))
    per = resample.draws(units, "entity", 5).groupBy("replicate").agg(F.sum("copies").alias("n")).collect()
    assert len(per) == 5 and all(r.n == 30 for r in per)
    members = units.withColumn("c", F.col("entity") % 4)
    got = resample.cluster_draws(members, "c", 3)
    assert got.join(members, "entity").groupBy("replicate", "c").agg(F.count_distinct("copies").alias("k")).filter("k > 1").count() == 0


def test_tiers(spark):
    df = spark.createDataFrame([(10, 28.0), (11, 28.0), (1, 28.5), (50, 70.0), (60, 95.0), (60, 95.5)], "lo int, med double")
    assert [r.t for r in df.select(resample.tier("lo", "med").alias("t")).collect()] == [
        "Leading cluster", "Strong", "Strong", "Mid", "Weak", "Lagging"]


def test_early_rows_cannot_see_the_future(spark, panel):
    flows = panel.select("entity", "period", F.col("net_migration").alias("flow"))
    jobs = panel.select("entity", "period", F.lit(None).cast("double").alias("proxy_job_growth"))
    growth = panel.select("state", "period").distinct().withColumn("g", F.lit(0.01))
    def build(p):
        return asof.early_rows(p, scoring.indicators(p, RENT_MODEL), flows, jobs, growth)
    slow = ["population", "total_emp", "income_pc", "housing_units", "emp_hhi"]
    changed = panel.withColumns({c: F.when(F.col("period") >= 2014, F.col(c) * 7).otherwise(F.col(c)) for c in slow})
    a, b = build(panel).filter("period <= 2014"), build(changed).filter("period <= 2014")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert build(panel).filter("period > 2014").exceptAll(build(changed)).count() > 0


def test_golden_tolerance(spark):
    g = spark.createDataFrame([(1, 1, "c", None), (2, 1, "c", 1.0), (3, 1, "c", 1.00009), (4, 1, "c", 1.0002), (5, 1, "c", 1.0)],
                              "entity int, period int, column string, value double")
    c = spark.createDataFrame([(1, 1, "c", None), (2, 1, "c", None), (3, 1, "c", 1.0), (4, 1, "c", 1.0)],
                              "entity int, period int, column string, value double")
    assert sorted(r.entity for r in quality.golden_mismatches(g, c).collect()) == [2, 4, 5]


def test_top_entrants(spark):
    cur = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 11)], "entity int, rank int")
    old = spark.createDataFrame([(1, 2), (2, 11), (3, 30)], "entity int, rank int")
    assert {r.entity: r.move for r in quality.top_entrants(cur, old).collect()} == {2: "entered", 3: "moved", 4: "new"}


def test_runs_are_written_once_and_gated(spark, norm, panel):
    root = staging_path(spark, "runs")
    scores = scoring.scored(norm, RENT_MODEL)
    clear = spark.createDataFrame([(True,)], "clear boolean")
    registry.freeze_run(scores, panel, root, "r1", 2012, RENT_MODEL.weights, clear, "2013-01-01")
    with pytest.raises(Exception, match="(?i)already exists"):
        registry.freeze_run(scores, panel, root, "r1", 2012, RENT_MODEL.weights, clear, "2013-01-02")
    with pytest.raises(registry.PublicationBlocked):
        registry.freeze_run(scores, panel, root, "r2", 2012, RENT_MODEL.weights, spark.createDataFrame([(False,)], "clear boolean"), "x")
    registry.freeze_run(scores, panel, root, "r3", 2016, RENT_MODEL.weights, clear, "2017-01-01")
    runs = registry.read_runs(spark, root).select("run_id", "entity", "period", "score")
    got = {r.run_id: r for r in registry.grade_runs(runs, panel, "rent", 3, scores).collect()}
    assert got["r1"].closed and got["r1"].retention == pytest.approx(1.0) and got["r1"].overlap == 10
    assert not got["r3"].closed and got["r3"].waits_for == 2019 and got["r3"].weighted_tau is None


def test_digest_ignores_order(spark):
    a = spark.range(50).repartition(5)
    assert registry.digest(a).first() == registry.digest(spark.range(50).orderBy(F.desc("id"))).first()
    assert registry.digest(a).first() != registry.digest(spark.range(1, 51)).first()


def test_contributors_need_a_material_share(spark):
    row = [0.021, 0.019, -0.019, -0.3, 0.0]
    df = spark.createDataFrame([(1, 1, *row)], "entity int, period int, " + ", ".join(f"bucket_{b} double" for b in RENT_MODEL.buckets))
    got = editions.contributors(df, RENT_MODEL).first()
    names = list(RENT_MODEL.buckets)
    assert (got.strength, got.second_strength, got.drag) == (names[0], None, names[3])


def test_verdict_precedence(spark):
    g = spark.createDataFrame([("a", 0.05, True), ("a", 0.1, False), ("b", 0.05, True), ("b", 0.1, True)], "candidate string, weight double, adopt boolean")
    rep = lambda ok: spark.createDataFrame([("v", ok)], "name string, pass boolean")
    assert gates.conjunctive_verdict(g, ["a", "b"], rep(False)).first().verdict == "add:b"
    assert gates.conjunctive_verdict(g, ["a", "b"], rep(True)).first().verdict == "replace:v"
    assert gates.conjunctive_verdict(g.filter("candidate = 'a'"), ["a"], rep(False)).first().verdict == "reject all"


def test_a_replacement_must_pass_both_gates(spark):
    def one(*passes):
        return spark.createDataFrame([(p,) for p in passes], "pass boolean")
    cases = [(one(True), one(True), True), (one(True), one(False), False), (one(False), one(True), False), (one(), one(True), False), (one(None), one(True), False), (one(True), one(), False)]
    for better, stable, wanted in cases:
        assert gates.replacement(better, stable, "v").collect() == [("v", wanted)]


def test_interim_outcomes_are_clipped_before_the_join(spark):
    values = [float(e) for e in range(39)] + [1e6]
    outcome = spark.createDataFrame([("h1", e, 2000, v) for e, v in enumerate(values)], "read string, entity int, period int, realized double")
    runs = spark.createDataFrame([("a", e, 2000, float(e)) for e in range(20, 40)], "run_id string, entity int, period int, score double")
    mine = np.clip(values, *np.quantile(values, [0.01, 0.99]))[20:]
    got = registry.grade_interim(runs, [outcome]).first()
    assert got.n_entities == 20 and got.edge_pp == pytest.approx((mine[-10:].mean() - np.median(mine)) * 100)


def test_models_are_compared_on_one_outcome_of_enough_entities(spark, norm, panel):
    scores = scoring.scored(norm, RENT_MODEL)
    runs = scores.filter("period = 2012").select(F.lit("r").alias("run_id"), "entity", "period", "score")
    few = registry.grade_runs(runs, panel, "rent", 3, scores.filter("entity < 9")).first()
    assert few.n_entities == 24 and few.current_tau is None and few.retention is None and few.overlap is None
    some = registry.grade_runs(runs, panel, "rent", 3, scores.filter("entity < 15")).first()
    assert some.n_entities == 24 and some.current_tau is not None and some.overlap == 10


def test_boundary_consistent_series_spans_the_data(spark):
    periods = [*range(1990, 1999), 2005]
    panel = spark.createDataFrame([(e, p, float(e + p)) for e in range(1, 7) for p in periods], "entity int, period int, population double")
    supplier = spark.createDataFrame([(e, 1 + 3 * (e > 4)) for e in range(1, 7)], "s_suppkey long, s_nationkey int")
    got = {(r["parent"], r["period"]): r["v"] for r in build.boundary_consistent_series(types.SimpleNamespace(panel=panel, supplier=supplier)).collect() if r["v"] is not None}
    now = {(k, p): float(sum(e + p for e in es)) for k, es in ((1, range(1, 5)), (4, (5, 6))) for p in periods}
    old = {p: float(2 + p + 4 + p) for p in range(1990, 1999)}
    assert got == pytest.approx(now | {(1, p): now[1, 1998] * old[p] / old[1998] for p in range(1990, 1998)}, abs=1e-3)
