"""Queries: rank correlation, walk-forward windows, baselines, ablations, effect sizes."""
from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.catalog.base import (
    HORIZONS, MODEL, REGIMES, WF, WIDE, comp_sql, metrics_select, metrics_sql, query, r, regime_sql, rounded, rounded_all, rs,
    strategies_sql, summary_sql, tau_sql, with_parts, z_sql)
from paneltide.functions.scalar import interval_name
from paneltide.operators import order, stats
from paneltide.operators.concordance import weighted_tau
from paneltide.operators.rollup import arg_max
from paneltide.plans import rankings as rk
from paneltide.plans import walkforward as wf
from paneltide.plans.scoring import valuation_measures
from paneltide.scale import staged

M3 = ["weighted_tau", "precision_at_k", "edge_pp"]


def periods(t):
    return wf.usable_periods(t.scored)


def outcome(t, horizons=HORIZONS):
    return wf.realised(t.panel, "rent", horizons)


def evaluated(t, ranking, horizons=HORIZONS, target=None, value="rent", k=10):
    got = wf.evaluate(ranking, t.panel if target is None else target, value, horizons, periods(t), REGIMES, k, t.bound)
    return got


def shown(df, cols=M3, drop=("regime",)):
    return rounded_all(df.drop(*drop), cols)


FULL = {"full": comp_sql(MODEL.weights)}
EQUAL = {"equal_weight": "(" + "+".join(f"coalesce({k},0)" for k in MODEL.names) + f")/{len(MODEL.names)}"}
SINGLE = {f"only:{k}": k for k in MODEL.names}
DROPS = {f"drop:{k}": comp_sql({n: w for n, w in MODEL.weights.items() if n != k}) for k in MODEL.names}
DROPS |= {f"drop_bucket:{b}": comp_sql({n: w for n, w in MODEL.weights.items() if n not in ks}) for b, ks in MODEL.buckets.items()}
G = ["strategy", "horizon", "period"]


def wf_extra(scores, more="", g=None, clip=True, k=10, source="norm"):
    return strategies_sql(scores, source) + ",\n" + WF + ",\n" + metrics_sql("wf", g or G, k, clip) + more


@query("usable_periods", with_parts("SELECT period FROM usable", "usable"), stage=True)
def usable_periods(t):
    return periods(t)


@query("forward_outcome", with_parts(f"SELECT horizon, entity, period, {r('realized')} FROM outcome", "outcome"))
def forward_outcome(t):
    return rounded_all(outcome(t), ["realized"])


@query("walk_forward", with_parts(metrics_select("strategy, horizon, period, " + regime_sql() + " AS regime"), "usable", "outcome", extra=wf_extra(FULL)), stage=True)
def walk_forward(t):
    return shown(evaluated(t, rk.strategies(t.norm, rk.full_model(MODEL))), drop=())


@query("walk_forward_summary", with_parts(f"SELECT strategy, horizon, regime, n_windows, {rs('mean_tau', 'mean_precision')} FROM summ", "usable", "outcome",
                                          extra=wf_extra(FULL | EQUAL, ",\n" + summary_sql())), stage=True)
def walk_forward_summary(t):
    ranking = rk.strategies(t.norm, rk.full_model(MODEL) | rk.equal_weight(MODEL))
    return rounded_all(wf.summarise(evaluated(t, ranking)), ["mean_tau", "mean_precision"])


@query("walk_forward_other_target", with_parts(metrics_select(), "usable", "panel", extra="outcome AS (SELECT h.horizon, a.entity, a.period, b.home_value/a.home_value-1 AS realized FROM panel a "
       "CROSS JOIN (VALUES (1),(2),(3)) h(horizon) JOIN panel b ON b.entity=a.entity AND b.period=a.period+h.horizon WHERE a.home_value>0),\n" + wf_extra(FULL)), stage=True)
def walk_forward_other_target(t):
    return shown(evaluated(t, rk.strategies(t.norm, rk.full_model(MODEL)), value="home_value"))


def _baselines(t, horizons):
    out = outcome(t, horizons)
    plain = rk.strategies(t.norm, rk.full_model(MODEL) | rk.equal_weight(MODEL) | rk.single_indicators(MODEL))
    rows = wf.window_rows(plain, out, periods(t))
    own = wf.window_rows(rk.persistence(t.panel, "rent", horizons), out, periods(t))
    return rows.unionByName(own)


PERSIST = """persist AS (SELECT 'persistence' AS strategy, h.horizon, a.entity, a.period, a.rent/nullif(b.rent,0)-1 AS score FROM panel a
  CROSS JOIN (VALUES (1),(2),(3)) h(horizon) JOIN panel b ON b.entity=a.entity AND b.period=a.period-h.horizon),
wfb AS (SELECT * FROM wf UNION ALL SELECT strategy, horizon, period, entity, score, realized FROM persist JOIN outcome USING (horizon, entity, period)
  WHERE score IS NOT NULL AND period IN (SELECT period FROM usable))"""
BASE = strategies_sql(FULL | EQUAL | SINGLE) + ",\n" + WF + ",\n" + PERSIST + ",\n" + metrics_sql("wfb", G)
HEAD = """,
head AS (SELECT strategy, max(CASE WHEN horizon=3 AND regime='POOLED' THEN mean_tau END) AS tau_long, max(CASE WHEN horizon=3 AND regime='POOLED' THEN mean_precision END) AS precision_long,
  max(CASE WHEN horizon=3 AND regime='early' THEN mean_tau END) AS tau_long_calm, max(CASE WHEN horizon=1 AND regime='POOLED' THEN mean_tau END) AS tau_short FROM summ GROUP BY strategy)"""
HC = ["tau_long", "precision_long", "tau_long_calm", "tau_short"]


def _head(t):
    m = wf.window_metrics(_baselines(t, HORIZONS), bound=t.bound).withColumn("regime", interval_name("period", REGIMES))
    return wf.headline(wf.summarise(m), 3, 1, "early")


@query("baseline_windows", with_parts(metrics_select(), "usable", "outcome", extra=BASE), stage=True)
def baseline_windows(t):
    return shown(wf.window_metrics(_baselines(t, HORIZONS), bound=t.bound), drop=())


@query("baseline_headline", with_parts(f"SELECT strategy, {rs(*HC)} FROM head", "usable", "outcome", extra=BASE + ",\n" + summary_sql() + HEAD), stage=True)
def baseline_headline(t):
    return rounded_all(_head(t), HC)


@query("baseline_uplift", with_parts(f"SELECT h.strategy, {r('h.tau_long', 'tau_long')}, {r('f.tau_long-h.tau_long', 'uplift_tau_long')} FROM head h, (SELECT * FROM head WHERE strategy='full') f",
                                     "usable", "outcome", extra=BASE + ",\n" + summary_sql() + HEAD), stage=True)
def baseline_uplift(t):
    return rounded_all(wf.uplift(_head(t), "full", ["tau_long"]), ["tau_long", "uplift_tau_long"])


@query("best_single_indicator", with_parts(f"SELECT horizon, arg_max(strategy, tau) AS strategy, {r('max(tau)', 'tau')} FROM (SELECT strategy, horizon, avg(weighted_tau) AS tau FROM metrics WHERE strategy LIKE 'only:%' GROUP BY ALL) GROUP BY horizon",
                                           "usable", "outcome", extra=BASE), stage=True)
def best_single_indicator(t):
    m = evaluated(t, rk.strategies(t.norm, rk.single_indicators(MODEL)))
    mean = m.groupBy("strategy", "horizon").agg(F.avg("weighted_tau").alias("tau"))
    return rounded_all(arg_max(mean, ["horizon"], "strategy", "tau"), ["tau"])


SEEDS = 50  # fixed value
RAND = f"""ranked AS (SELECT 'random' AS strategy, seed, entity, period, (cast('0x'||substr(md5('rank:'||seed||':'||entity||':'||period),1,8) AS BIGINT)+0.5)/4294967296.0::DOUBLE AS score
  FROM panel, range({SEEDS}) s(seed)),
wf AS (SELECT seed, horizon, period, entity, score, realized FROM ranked JOIN outcome USING (entity, period) WHERE period IN (SELECT period FROM usable)),
{metrics_sql('wf', ['seed', 'horizon', 'period'])}"""


@query("baseline_random", with_parts(f"SELECT horizon, {r('avg(weighted_tau)', 'tau')}, {r('avg(precision_at_k)', 'precision')} FROM metrics GROUP BY horizon", "usable", "outcome", extra=RAND), stage=True)
def baseline_random(t):
    ranking = rk.random_scores(t.panel, SEEDS)
    m = wf.window_metrics(wf.window_rows(ranking, outcome(t), periods(t)), ["seed", "horizon", "period"], bound=t.bound)
    return rounded_all(m.groupBy("horizon").agg(F.avg("weighted_tau").alias("tau"), F.avg("precision_at_k").alias("precision")), ["tau", "precision"])


@query("ablation_deltas", with_parts(f"""SELECT a.strategy, a.horizon, {r('a.tau', 'tau')}, {r('a.tau-f.tau', 'delta')} FROM mean a JOIN (SELECT * FROM mean WHERE strategy='full') f USING (horizon) WHERE a.strategy<>'full'""",
                                     "usable", "outcome", extra=wf_extra(FULL | DROPS, ",\nmean AS (SELECT strategy, horizon, avg(weighted_tau) AS tau FROM metrics GROUP BY ALL)")), stage=True)
def ablation_deltas(t):
    m = evaluated(t, rk.strategies(t.norm, rk.full_model(MODEL) | rk.ablations(MODEL)))
    mean = m.groupBy("strategy", "horizon").agg(F.avg("weighted_tau").alias("tau"))
    full = mean.filter("strategy = 'full'").select("horizon", F.col("tau").alias("_f"))
    d = mean.filter("strategy <> 'full'").join(full, "horizon").select("strategy", "horizon", "tau", (F.col("tau") - F.col("_f")).alias("delta"))
    return rounded_all(d, ["tau", "delta"])


TILT = {"demand_heavy": {"net_migration": .4, "job_growth": .3, "permits_to_stock": .3}, "two_factor": {"net_migration": .5, "permits_to_stock": .5}}


@query("weight_schemes", with_parts(metrics_select(), "usable", "outcome", extra=wf_extra({n: comp_sql(w) for n, w in TILT.items()})), stage=True)
def weight_schemes(t):
    return shown(evaluated(t, rk.strategies(t.norm, rk.weight_schemes(TILT))))


BLEND = f"""ranked AS (SELECT 'blend' AS strategy, s.entity, s.period, 0.5*coalesce(z,0)+0.5*coalesce(n.trailing_rent_growth,0) AS score
  FROM (SELECT entity, period, {z_sql('score', 1, 'period', True)} AS z FROM scored) s LEFT JOIN norm n USING (entity, period))"""


@query("blend_ranking", with_parts(f"SELECT strategy, entity, period, {r('score')} FROM ranked", "scored", extra=BLEND))
def blend_ranking(t):
    return rounded_all(rk.blend(t.scored, t.norm, "trailing_rent_growth", t.bound), ["score"])


CATS = {"labour": [("job_growth", 1), ("avg_pay", 1)], "vacancy": [("permits_mf", -1)], "momentum": [("trailing_rent_growth", 1), ("home_value", 1)]}
CAT_SQL = f"""jn AS (SELECT n.entity, n.period, n.job_growth, n.trailing_rent_growth, p.avg_pay, p.permits_mf, p.home_value FROM norm n JOIN panel p USING (entity, period)),
zz AS (SELECT entity, period, job_growth, trailing_rent_growth, {z_sql('avg_pay', 1, 'period', True)} AS z1, {z_sql('permits_mf', -1, 'period', True)} AS z2, {z_sql('home_value', 1, 'period', True)} AS z3 FROM jn),
cat AS (SELECT entity, period, ((coalesce(job_growth,0)+coalesce(z1,0))/2+coalesce(z2,0)+(coalesce(trailing_rent_growth,0)+coalesce(z3,0))/2)/3 AS score FROM zz)"""


def category(t):
    joined = t.norm.select("entity", "period", "job_growth", "trailing_rent_growth").join(
        t.panel.select("entity", "period", "avg_pay", "permits_mf", "home_value"), ["entity", "period"])
    return rk.category_index(joined, CATS, ["job_growth", "trailing_rent_growth"], t.bound)


@query("category_index", with_parts(f"SELECT 'category_index' AS strategy, entity, period, {r('score')} FROM cat", "norm", extra=CAT_SQL))
def category_index(t):
    return rounded_all(category(t), ["score"])


@query("category_index_verdict", with_parts(f"SELECT strategy, {rs(*HC)} FROM head", "usable", "outcome", extra=CAT_SQL + ",\n" + strategies_sql(FULL, name="r0")
       + ",\nranked AS (SELECT * FROM r0 UNION ALL SELECT 'category_index', entity, period, score FROM cat),\n" + WF + ",\n" + metrics_sql("wf", G) + ",\n" + summary_sql() + HEAD), stage=True)
def category_index_verdict(t):
    ranking = rk.strategies(t.norm, rk.full_model(MODEL)).unionByName(category(t))
    return rounded_all(wf.headline(wf.summarise(evaluated(t, ranking)), 3, 1, "early"), HC)


VAL_SQL = f"""val AS (SELECT entity, period, {z_sql('home_value/nullif(rent*12,0)', -1, 'period', True)} AS lv, {z_sql('rent*12/nullif(home_value,0)', 1, 'period', True)} AS hy FROM panel),
{strategies_sql({'low_valuation': 'lv', 'high_yield': 'hy'}, 'val')},
{WF}, {metrics_sql('wf', G)}"""


@query("valuation_rankings", with_parts(metrics_select(), "usable", "outcome", extra=VAL_SQL), stage=True)
def valuation_rankings(t):
    v = t.panel.select("entity", "period", *[c.alias(n) for n, c in valuation_measures().items()])
    ranking = rk.standardised(v, {"low_valuation": ("price_to_rent", -1), "high_yield": ("gross_yield", 1)}, t.bound)
    return shown(evaluated(t, ranking))


APPRECIATION = {"low_valuation": ("price_to_rent", -1), "high_yield": ("gross_yield", 1), "price_momentum": ("appreciation", 1)}
APPR_SQL = f"""outcome AS (SELECT h.horizon, a.entity, a.period, b.home_value/a.home_value-1 AS realized FROM panel a
  CROSS JOIN (VALUES (1),(2),(3)) h(horizon) JOIN panel b ON b.entity=a.entity AND b.period=a.period+h.horizon WHERE a.home_value>0),
vm AS (SELECT p.entity, p.period, p.home_value/nullif(p.rent*12,0) AS price_to_rent, p.rent*12/nullif(p.home_value,0) AS gross_yield, p.home_value/nullif(q.home_value,0)-1 AS appreciation
  FROM panel p LEFT JOIN panel q ON q.entity=p.entity AND q.period=p.period-1),
val AS (SELECT entity, period, {', '.join(f"{z_sql(c, s, 'period', True)} AS {n}" for n, (c, s) in APPRECIATION.items())} FROM vm),
{strategies_sql({n: n for n in APPRECIATION}, 'val', 'r0')},
{strategies_sql(FULL, name='r1')},
ranked AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1),
{WF}, {metrics_sql('wf', G)}"""


@query("appreciation_rankings", with_parts(metrics_select(), "usable", "panel", extra=APPR_SQL), stage=True)
def appreciation_rankings(t):
    """Valuation, yield, price momentum and the model as predictors of what prices do next."""
    v = t.panel.select("entity", "period", *[c.alias(n) for n, c in valuation_measures().items()])
    ranking = rk.standardised(v, APPRECIATION, t.bound).unionByName(rk.strategies(t.norm, rk.full_model(MODEL)))
    return shown(evaluated(t, ranking, value="home_value"))


@query("precision_several_k", with_parts(f"SELECT strategy, horizon, k, coalesce(period,'POOLED') AS period, {r('avg(precision)', 'precision')} FROM per GROUP BY GROUPING SETS ((strategy,horizon,k,period),(strategy,horizon,k))", "usable", "outcome", extra=strategies_sql(FULL) + ",\n" + WF + """,
lim AS (SELECT strategy, horizon, period, quantile_cont(realized,0.01) AS lo, quantile_cont(realized,0.99) AS hi FROM wf GROUP BY ALL HAVING count(*)>=10),
c AS (SELECT w.* EXCLUDE (realized), least(greatest(realized,lo),hi) AS realized FROM wf w JOIN lim USING (strategy, horizon, period)),
q AS (SELECT *, quantile_cont(realized,0.75) OVER (PARTITION BY strategy, horizon, period) AS cut, row_number() OVER (PARTITION BY strategy, horizon, period ORDER BY score DESC, entity) AS place, count(*) OVER (PARTITION BY strategy, horizon, period) AS n FROM c),
per AS (SELECT strategy, horizon, k, period::VARCHAR AS period, avg((realized>=cut)::INT) AS precision FROM q, (VALUES (10),(20)) kk(k) WHERE place<=k AND n>=k GROUP BY ALL)"""), stage=True)
def precision_several_k(t):
    rows = wf.window_rows(rk.strategies(t.norm, rk.full_model(MODEL)), outcome(t), periods(t))
    return rounded_all(wf.precision_by_k(rows, [10, 20], bound=t.bound), ["precision"])


@query("effect_size", with_parts(f"SELECT strategy, horizon, count(*) AS n_windows, {r('avg(edge_pp)', 'mean_pp')}, {r('min(edge_pp)', 'min_pp')}, {r('max(edge_pp)', 'max_pp')}, {r('avg(weighted_tau)', 'mean_tau')} FROM metrics GROUP BY strategy, horizon",
                                 "usable", "outcome", extra=wf_extra(FULL | EQUAL | {"momentum": "trailing_rent_growth"})), stage=True)
def effect_size(t):
    ranking = rk.strategies(t.norm, rk.full_model(MODEL) | rk.equal_weight(MODEL) | {"momentum": F.col("trailing_rent_growth")})
    m = evaluated(t, ranking).groupBy("strategy", "horizon").agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("edge_pp").alias("mean_pp"), F.min("edge_pp").alias("min_pp"),
        F.max("edge_pp").alias("max_pp"), F.avg("weighted_tau").alias("mean_tau"))
    return rounded_all(m, ["mean_pp", "min_pp", "max_pp", "mean_tau"])


@query("horizon_decay", with_parts(f"SELECT horizon, count(*) AS n_windows, {r('avg(weighted_tau)', 'mean_tau')}, {r('min(weighted_tau)', 'min_tau')}, {r('max(weighted_tau)', 'max_tau')}, {r('avg(edge_pp)', 'mean_pp')}, {r('avg(precision_at_k)', 'mean_precision')} FROM metrics GROUP BY horizon",
       "usable", "panel", extra="outcome AS (SELECT h.horizon, a.entity, a.period, b.rent/a.rent-1 AS realized FROM panel a CROSS JOIN range(1,7) h(horizon) JOIN panel b ON b.entity=a.entity AND b.period=a.period+h.horizon WHERE a.rent>0),\n" + wf_extra(FULL)), stage=True)
def horizon_decay(t):
    m = evaluated(t, rk.strategies(t.norm, rk.full_model(MODEL)), range(1, 7)).withColumn("horizon", F.col("horizon").cast("bigint"))
    g = m.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("weighted_tau").alias("mean_tau"), F.min("weighted_tau").alias("min_tau"),
                                 F.max("weighted_tau").alias("max_tau"), F.avg("edge_pp").alias("mean_pp"), F.avg("precision_at_k").alias("mean_precision"))
    return rounded_all(g, ["mean_tau", "min_tau", "max_tau", "mean_pp", "mean_precision"])


RANKED3 = """rk AS (SELECT horizon, period, count(*) OVER w AS n,
  rank() OVER (PARTITION BY horizon, period ORDER BY s)+(count(*) OVER (PARTITION BY horizon, period, s)-1)/2.0 AS rs,
  rank() OVER (PARTITION BY horizon, period ORDER BY o)+(count(*) OVER (PARTITION BY horizon, period, o)-1)/2.0 AS ro,
  rank() OVER (PARTITION BY horizon, period ORDER BY realized)+(count(*) OVER (PARTITION BY horizon, period, realized)-1)/2.0 AS rr
  FROM tri WINDOW w AS (PARTITION BY horizon, period)),
cc AS (SELECT horizon, period, any_value(n) AS n, corr(rs,rr) AS sr, corr(rs,ro) AS so, corr(ro,rr) AS orr, corr(rr-rs, rr-ro) AS ec FROM rk GROUP BY horizon, period)"""


@query("orthogonality", with_parts(f"SELECT horizon, period, n, {r('sr', 'spearman_raw')}, {r('(sr-so*orr)/nullif(sqrt((1-so*so)*(1-orr*orr)),0)', 'partial_spearman')}, {r('ec', 'error_correlation')} FROM cc",
       "scored", "outcome", extra="tri AS (SELECT horizon, period, s.score AS s, n.trailing_rent_growth AS o, realized FROM scored s JOIN norm n USING (entity, period) JOIN outcome USING (entity, period) WHERE n.trailing_rent_growth IS NOT NULL),\n" + RANKED3))
def orthogonality(t):
    tri = t.norm.select("entity", "period", F.col("trailing_rent_growth").alias("other"),
                        rk.full_model(MODEL)["full"].alias("score")).join(outcome(t), ["entity", "period"])
    o = stats.rank_orthogonality(tri, ["horizon", "period"], "score", "other", "realized", t.bound)
    return rounded_all(o, ["spearman_raw", "partial_spearman", "error_correlation"])


@query("redundancy", with_parts("SELECT \"left\", \"right\", " + r("c", "r") + " FROM rr", "norm", extra="""j AS (SELECT n.*, p.home_value/nullif(p.rent*12,0) AS price_to_rent, p.rent*12/nullif(p.home_value,0) AS gross_yield
  FROM norm n JOIN panel p USING (entity, period) WHERE period=1998),
rr AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a},{b}) AS c FROM j" for a in ("price_to_rent", "gross_yield") for b in MODEL.names) + ")"))
def redundancy(t):
    v = valuation_measures()
    p = t.panel.filter("period = 1998").select("entity", "period", v["price_to_rent"].alias("price_to_rent"), v["gross_yield"].alias("gross_yield"))
    j = t.norm.filter("period = 1998").join(p, ["entity", "period"])
    return rounded_all(stats.correlation_pairs(j, ["price_to_rent", "gross_yield"], MODEL.names), ["r"])


@query("correlation_matrix", with_parts("SELECT * FROM (SELECT \"left\", \"right\", " + r("c", "r") + " FROM rr) WHERE abs(r)>=0.1", "norm", extra="rr AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a},{b}) AS c FROM norm" for i, a in enumerate(MODEL.names) for b in MODEL.names[i + 1:]) + ")"))
def correlation_matrix(t):
    return rounded_all(stats.correlation_pairs(t.norm, MODEL.names), ["r"]).filter(F.abs("r") >= 0.1)


BLEND_OUT = """chg AS (SELECT h.horizon, a.entity, a.period, b.home_value-a.home_value AS realized FROM panel a CROSS JOIN (VALUES (1),(2),(3)) h(horizon) JOIN panel b ON b.entity=a.entity AND b.period=a.period+h.horizon),
la AS (SELECT horizon, period, quantile_cont(realized,0.01) AS lo, quantile_cont(realized,0.99) AS hi FROM outcome GROUP BY ALL),
lb AS (SELECT horizon, period, quantile_cont(realized,0.01) AS lo, quantile_cont(realized,0.99) AS hi FROM chg GROUP BY ALL),
ab AS (SELECT o.horizon, o.entity, o.period, least(greatest(o.realized,la.lo),la.hi) AS a, least(greatest(c.realized,lb.lo),lb.hi) AS b FROM outcome o JOIN chg c USING (horizon, entity, period)
  JOIN la ON la.horizon=o.horizon AND la.period=o.period JOIN lb ON lb.horizon=o.horizon AND lb.period=o.period)"""


@query("blended_target", with_parts(f"SELECT horizon, entity, period, {r('(' + z_sql('a', 1, 'horizon, period', True) + '+' + z_sql('b', 1, 'horizon, period', True) + ')/2', 'realized')} FROM ab", "outcome", extra=BLEND_OUT))
def blended_target(t):
    b = wf.blended_outcome(outcome(t), wf.realised(t.panel, "home_value", HORIZONS, "difference"), t.bound)
    return rounded_all(b, ["realized"])


@query("sub_universe", with_parts(metrics_select(), "usable", "outcome", extra="""big AS (SELECT entity FROM (SELECT entity, arg_max(population, period) AS s FROM panel GROUP BY entity) ORDER BY s DESC, entity LIMIT 50),
""" + strategies_sql(FULL) + ",\n" + WF.replace("FROM usable)", "FROM usable) AND entity IN (SELECT entity FROM big)") + ",\n" + metrics_sql("wf", G)), stage=True)
def sub_universe(t):
    big = wf.largest_entities(t.panel, "population", 50)
    return shown(evaluated(t, rk.strategies(t.norm, rk.full_model(MODEL)).join(big, "entity", "left_semi")))


FLAGGED = """flagged AS (SELECT l.period, g AS median_growth, g>0.01 AS flag_fires, l.period BETWEEN 1998 AND 1999 AS hindsight_shock, g>0.01 AND NOT l.period BETWEEN 1998 AND 1999 AS false_alarm,
  NOT g>0.01 AND l.period BETWEEN 1998 AND 1999 AS missed, m1.weighted_tau AS tau_1, m3.weighted_tau AS tau_3
  FROM (SELECT period, median(g) AS g FROM (SELECT period, rent/nullif(lag(rent) OVER (PARTITION BY entity ORDER BY period),0)-1 AS g FROM panel) GROUP BY period HAVING median(g) IS NOT NULL) l
  LEFT JOIN (SELECT * FROM metrics WHERE horizon=1) m1 USING (period) LEFT JOIN (SELECT * FROM metrics WHERE horizon=3) m3 USING (period))"""


def flagged(t):
    m = evaluated(t, rk.strategies(t.norm, rk.full_model(MODEL)))
    return wf.regime_flags(t.panel, "rent", m, [1, 3], F.col("period").between(1998, 1999), 0.01, t.bound)


@query("regime_flag", with_parts(f"SELECT period, flag_fires, hindsight_shock, false_alarm, missed, {rs('median_growth', 'tau_1', 'tau_3')} FROM flagged", "usable", "outcome", extra=wf_extra(FULL) + ",\n" + FLAGGED), stage=True)
def regime_flag(t):
    return rounded_all(flagged(t), ["median_growth", "tau_1", "tau_3"])


@query("regime_flag_payoff", with_parts(f"SELECT flag_fires, count(*) AS n_periods, count(CASE WHEN false_alarm THEN 1 END) AS n_false_alarms, count(CASE WHEN missed THEN 1 END) AS n_missed, {r('avg(tau_1)', 'mean_tau_1')}, {r('avg(tau_3)', 'mean_tau_3')} FROM flagged GROUP BY flag_fires", "usable", "outcome", extra=wf_extra(FULL) + ",\n" + FLAGGED), stage=True)
def regime_flag_payoff(t):
    return rounded_all(wf.flag_payoff(flagged(t), [1, 3]), ["mean_tau_1", "mean_tau_3"])


@query("augmented_ranking", with_parts(metrics_select(), "usable", "outcome", extra=f"""aug AS (SELECT s.entity, s.period, 0.9::DOUBLE*s.score+0.1::DOUBLE*coalesce(z,0) AS score FROM scored s LEFT JOIN (SELECT entity, period, {z_sql('population', 1, 'period', True)} AS z FROM panel WHERE entity%7<>0) c USING (entity, period)),
""" + strategies_sql({"augmented": "score"}, "aug") + ",\n" + WF + ",\n" + metrics_sql("wf", G)), stage=True)
def augmented_ranking(t):
    z = stats.zscores(t.panel.filter("entity % 7 <> 0"), ["period"], {"cand": "population"}, sample=True, bound=t.bound)
    both = t.scored.select("entity", "period", "score").join(z.select("entity", "period", "cand"), ["entity", "period"], "left")
    return shown(evaluated(t, rk.strategies(both, {"augmented": rk.augmented(0.1)})))


@query("leave_one_window_out", with_parts(f"""SELECT horizon, any_value(n) AS n_windows, {r('min(weighted_tau)', 'min_value')}, {r('max(weighted_tau)', 'max_value')}, {r('min(j)', 'jackknife_min')}, {r('max(j)', 'jackknife_max')}
  FROM (SELECT *, (s-weighted_tau)/nullif(n-1,0) AS j FROM (SELECT *, count(*) OVER (PARTITION BY horizon) AS n, sum(weighted_tau) OVER (PARTITION BY horizon) AS s FROM metrics)) GROUP BY horizon""", "usable", "outcome", extra=wf_extra(FULL)), stage=True)
def leave_one_window_out(t):
    m = evaluated(t, rk.strategies(t.norm, rk.full_model(MODEL)))
    return rounded_all(stats.leave_one_out(m, ["horizon"], "weighted_tau"), ["min_value", "max_value", "jackknife_min", "jackknife_max"])


def _avg_rank(c, part="period"):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {c})+(count(*) OVER (PARTITION BY {part}, {c})-1)/2.0"


@query("index_vs_momentum", with_parts(f"""SELECT {r('(SELECT corr(score, m) FROM jj)', 'pooled_pearson')}, {r('avg(rho)', 'mean_spearman')} FROM
  (SELECT period, corr(a,b) AS rho FROM (SELECT period, {_avg_rank('score')} AS a, {_avg_rank('m')} AS b FROM jj) GROUP BY period)""", "norm",
  extra=CAT_SQL + ",\njj AS (SELECT c.entity, c.period, c.score, n.trailing_rent_growth AS m FROM cat c JOIN norm n USING (entity, period) WHERE n.trailing_rent_growth IS NOT NULL)"))
def index_vs_momentum(t):
    j = category(t).join(t.norm.select("entity", "period", F.col("trailing_rent_growth").alias("m")), ["entity", "period"]).filter("m IS NOT NULL")
    rho = stats.spearman(j, ["period"], "score", "m", bound=t.bound).agg(F.avg("rho")).scalar()
    pooled = j.agg(stats.correlation("score", "m").alias("pooled_pearson")).withColumn("mean_spearman", rho)
    return rounded_all(pooled, ["pooled_pearson", "mean_spearman"])


@query("spearman_per_period", with_parts(f"SELECT period, n, {r('rho')} FROM (SELECT period, count(*) AS n, CASE WHEN count(*)>=30 THEN corr(a,b) END AS rho FROM (SELECT period, {_avg_rank('job_growth')} AS a, {_avg_rank('income_growth')} AS b FROM ind WHERE job_growth IS NOT NULL AND income_growth IS NOT NULL) GROUP BY period)", "ind"))
def spearman_per_period(t):
    return rounded_all(stats.spearman(t.ind, ["period"], "job_growth", "income_growth", at_least=30, bound=t.bound), ["rho"])


@query("pearson_per_period", with_parts(f"SELECT period, {r('corr(job_growth, income_growth)', 'r')} FROM ind WHERE job_growth IS NOT NULL GROUP BY period", "ind"))
def pearson_per_period(t):
    g = t.ind.filter("job_growth IS NOT NULL").groupBy("period").agg(stats.correlation("job_growth", "income_growth").alias("r"))
    return rounded_all(g, ["r"])


@query("rank_persistence", with_parts(f"SELECT {r('median(rho)', 'median_persistence')}, count(*) AS n_periods FROM (SELECT period, corr(a,b) AS rho FROM (SELECT q.period, {_avg_rank('q.rent', 'q.period')} AS a, {_avg_rank('p.rent', 'q.period')} AS b FROM panel q JOIN panel p ON p.entity=q.entity AND p.period=q.period-1) GROUP BY period)", "panel"))
def rank_persistence(t):
    p = stats.rank_persistence(t.panel, "rent", bound=t.bound)
    return rounded_all(p.agg(F.median("persistence").alias("median_persistence"), F.count(F.lit(1)).alias("n_periods")), ["median_persistence"])


CUST = """ranked AS (SELECT entity, period, coalesce(income_pc,0)-coalesce(emp_hhi,0)*100 AS score FROM customer_panel),
rows AS (SELECT a.period, a.entity, k.score, b.rent/a.rent-1 AS realized FROM customer_panel a JOIN customer_panel b ON b.entity=a.entity AND b.period=a.period+1 JOIN ranked k ON k.entity=a.entity AND k.period=a.period WHERE a.rent>0)"""


def _customer_rows(t):
    p = t.customer_panel
    ranking = p.select("entity", "period", (F.coalesce("income_pc", F.lit(0.0)) - F.coalesce("emp_hhi", F.lit(0.0)) * 100).alias("score"))
    return wf.window_rows(ranking, wf.realised(p, "rent", [1]).drop("horizon"))


@query("weighted_tau_gappy", with_parts(f"SELECT period, {r('tau')} FROM tt", "customer_panel", extra=CUST + "," + tau_sql("rows", "tt", ["period"])))
def weighted_tau_gappy(t):
    return rounded_all(weighted_tau(_customer_rows(t), ["period"], "score", "realized", "entity", bound=t.rows("customer")), ["tau"])


@query("weighted_tau_split", with_parts(f"SELECT period, {r('tau')} FROM tt", "customer_panel", extra=CUST + "," + tau_sql("rows", "tt", ["period"])))
def weighted_tau_split(t):
    return rounded_all(weighted_tau(_customer_rows(t), ["period"], "score", "realized", "entity", bound=WIDE), ["tau"])


def _pct_rank_sql(c):
    return f"({_avg_rank(c)})/count({c}) OVER (PARTITION BY period)*100"


@query("ranks_split", with_parts(f"SELECT entity, period, (rank() OVER (PARTITION BY period ORDER BY permits_total DESC))::INT AS low, {r('(' + _avg_rank('permits_total').replace('ORDER BY permits_total', 'ORDER BY permits_total DESC') + ')', 'average')} FROM customer_panel", "customer_panel"))
def ranks_split(t):
    k = order.add_ranks(t.customer_panel.select("entity", "period", "permits_total"), ["period"], "permits_total", low="low", average="average", bound=WIDE)
    return rounded_all(k.select("entity", "period", "low", "average"), ["average"])


@query("quantiles_split", with_parts(f"SELECT period, {r('quantile_cont(rent,0.01)', 'p01')}, {r('median(rent)', 'p50')}, {r('quantile_cont(rent,0.99)', 'p99')} FROM customer_panel GROUP BY period", "customer_panel"))
def quantiles_split(t):
    q = order.quantiles(t.customer_panel, ["period"], "rent", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, bound=WIDE)
    return rounded_all(q, ["p01", "p50", "p99"])


@query("quantiles", with_parts(f"SELECT period, {r('quantile_cont(rent,0.025)', 'lo')}, {r('median(rent)', 'mid')}, {r('quantile_cont(rent,0.975)', 'hi')} FROM customer_panel GROUP BY period", "customer_panel"))
def quantiles(t):
    return rounded_all(order.quantiles(t.customer_panel, ["period"], "rent", {"lo": 0.025, "mid": 0.5, "hi": 0.975}, t.rows("customer")), ["lo", "mid", "hi"])


@query("winsorise_within_period", with_parts(f"SELECT entity, period, {r('least(greatest(rent,lo),hi)', 'rent')} FROM customer_panel JOIN (SELECT period, quantile_cont(rent,0.01) AS lo, quantile_cont(rent,0.99) AS hi FROM customer_panel GROUP BY period) USING (period)", "customer_panel"))
def winsorise_within_period(t):
    w = order.winsorise(t.customer_panel.select("entity", "period", "rent"), ["period"], "rent", bound=t.rows("customer"))
    return rounded_all(w, ["rent"])


@query("average_rank", with_parts(f"SELECT entity, period, {r(_avg_rank('permits_total'), 'avg_rank')}, {r(_pct_rank_sql('permits_total'), 'pct')} FROM customer_panel", "customer_panel"))
def average_rank(t):
    k = order.add_ranks(t.customer_panel.select("entity", "period", "permits_total"), ["period"], "permits_total", average="avg_rank",
                        percent="pct", descending=False, bound=t.rows("customer"))
    return rounded_all(k.drop("permits_total"), ["avg_rank", "pct"])


@query("top_k_per_period", with_parts("SELECT entity, period, place::INT AS place FROM (SELECT entity, period, row_number() OVER (PARTITION BY period ORDER BY population DESC, entity) AS place FROM customer_panel) WHERE place<=10", "customer_panel"))
def top_k_per_period(t):
    return order.top_k(t.customer_panel.select("entity", "period", "population"), ["period"], [F.col("population").desc(), F.col("entity")], 10, "place").drop("population")


@query("top_k_overlap", with_parts("""SELECT period, count(*) FILTER (a AND b)::INT AS overlap FROM (SELECT period, row_number() OVER (PARTITION BY period ORDER BY population DESC, entity)<=50 AS a,
  row_number() OVER (PARTITION BY period ORDER BY income_pc DESC, entity)<=50 AS b FROM customer_panel) GROUP BY period""", "customer_panel"))
def top_k_overlap(t):
    p = staged(t.customer_panel.select("entity", "period", "population", "income_pc"), "panel")
    return order.top_k_overlap(p.select("entity", "period", F.col("population").alias("score")), p.select("entity", "period", F.col("income_pc").alias("score")), ["period"], "entity", "score", 50)
