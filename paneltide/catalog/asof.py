"""Queries: rows as they could have been built at the time."""
from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.catalog.base import (
    MODEL, WF, comp_sql, metrics_select, metrics_sql, norm_sql, query, r, rounded_all, rs, strategies_sql, summary_sql, with_parts)
from paneltide.catalog.validate import G, M3, _avg_rank, evaluated, periods
from paneltide.operators import growth, stats
from paneltide.plans import asof, gates, rankings as rk, walkforward as wf
from paneltide.plans.scoring import composite, normalised, scored
from paneltide.scale import staged

S = F.col
NAMES = MODEL.names

# Stand-ins: the flow proxy is known for three entities in four, the jobs proxy is a quantity
# growth that lacks every fifth entity, and the state of an entity is its nation.
PROXIES = """flows AS (SELECT entity, period, net_migration*0.9 AS flow FROM panel WHERE entity%4<>3),
jobs AS (SELECT p.entity, p.period, p.population/nullif(q.population,0)-1 AS proxy_job_growth FROM panel p JOIN panel q ON q.entity=p.entity AND q.period=p.period-1 WHERE p.entity%5<>0),
st AS (SELECT s_suppkey AS entity, s_nationkey AS state FROM supplier),
sl AS (SELECT state, period, sum(income_pc*population)/nullif(sum(population),0) AS v FROM panel JOIN st USING (entity) GROUP BY ALL),
sg AS (SELECT a.state, a.period, a.v/nullif(b.v,0)-1 AS g FROM sl a JOIN sl b ON b.state=a.state AND b.period=a.period-1 WHERE a.state%6<>5)"""


def inputs(t):
    p = t.panel
    flows = p.filter("entity % 4 <> 3").select("entity", "period", (S("net_migration") * 0.9).alias("flow"))
    jobs = p.select("entity", "period", growth.exact_growth("population").alias("proxy_job_growth")).filter(
        "entity % 5 <> 0 AND proxy_job_growth IS NOT NULL")
    placed = p.join(t.nation_of_supplier(), "entity")
    level = placed.groupBy("state", "period").agg((F.sum(S("income_pc") * S("population")) / F.sum("population")).alias("v"))
    sg = level.filter("state % 6 <> 5").select("state", "period", growth.exact_growth("v", 1, "state", "period").alias("g")).filter("g IS NOT NULL")
    return placed, flows, jobs, sg


def _last(c, upto):
    return f"last_value({c} IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND {-upto} PRECEDING)"


def early_sql(chained: bool = True) -> str:
    g = "g.g" if chained else "NULL::DOUBLE"
    return f"""car AS (SELECT entity, period, permits_total, rent, {_last('housing_units', -1)} AS stock, {_last('population', -1)} AS pop, {_last('income_pc', -1)} AS inc FROM panel),
cin AS (SELECT entity, period, trailing_rent_growth, cost_to_own_vs_rent, {_last('job_growth', -1)} AS jobs0, {_last('income_growth', -1)} AS incg, {_last('employment_diversity', -1)} AS div0 FROM ind),
early AS (SELECT c.entity, c.period, f.flow/nullif(pop,0) AS net_migration, coalesce(j.proxy_job_growth, jobs0) AS job_growth, coalesce({g}, incg) AS income_growth, permits_total/nullif(stock,0) AS permits_to_stock,
  rent*12/nullif(inc*(1+coalesce({g},0)),0) AS rent_to_income, cost_to_own_vs_rent, trailing_rent_growth, div0 AS employment_diversity
  FROM car c JOIN cin i USING (entity, period) JOIN st USING (entity) LEFT JOIN flows f ON f.entity=c.entity AND f.period=c.period LEFT JOIN jobs j ON j.entity=c.entity AND j.period=c.period LEFT JOIN sg g ON g.state=st.state AND g.period=c.period)"""


def early(t, chained=True):
    placed, flows, jobs, sg = inputs(t)
    return asof.early_rows(placed, t.ind, flows, jobs, sg if chained else None)


@query("early_rows", with_parts(f"SELECT entity, period, {rs(*NAMES)} FROM early", "ind", extra=PROXIES + ",\n" + early_sql()), stage=True)
def early_rows(t):
    return rounded_all(early(t), NAMES)


@query("early_rows_flat_income", with_parts(f"SELECT entity, period, {rs(*NAMES)} FROM early", "ind", extra=PROXIES + ",\n" + early_sql(False)), stage=True)
def early_rows_flat_income(t):
    return rounded_all(early(t, False), NAMES)


EDITION = (PROXIES + ",\n" + early_sql() + ",\nmix AS (SELECT * FROM ind WHERE period<>2000 UNION ALL SELECT entity, period, " + ", ".join(NAMES)
           + " FROM early WHERE period=2000),\n" + norm_sql("mix", "enorm"))


@query("early_edition", with_parts(f"SELECT entity, rank() OVER (ORDER BY {comp_sql(MODEL.weights)} DESC)::INT AS rank, {r(comp_sql(MODEL.weights), 'score')} FROM enorm WHERE period=2000",
                                   "ind", extra=EDITION.replace("SELECT * FROM ind WHERE", "SELECT entity, period, " + ", ".join(NAMES) + " FROM ind WHERE")), stage=True)
def early_edition(t):
    mixed = asof.history_with_early(t.rated(t.panel), MODEL, early(t), [2000])
    s = scored(normalised(mixed, MODEL, t.bound), MODEL, t.bound).filter("period = 2000")
    return rounded_all(s.select("entity", "rank", "score"), ["score"])


@query("pseudo_history", with_parts(metrics_select(), "usable", "outcome", extra=PROXIES + ",\n" + early_sql() + ",\n" + norm_sql("early", "pnorm") + ",\n"
                                    + strategies_sql({"pseudo": comp_sql(MODEL.weights)}, "pnorm") + ",\n" + WF + ",\n" + metrics_sql("wf", G)), stage=True)
def pseudo_history(t):
    pnorm = staged(normalised(early(t), MODEL, t.bound), "pseudo")
    return rounded_all(evaluated(t, rk.strategies(pnorm, {"pseudo": composite(MODEL.weights)})).drop("regime"), M3)


_N = ", ".join(NAMES)
REBUILT = PROXIES + ",\n" + early_sql() + f""",
v_real AS (SELECT entity, period, {_N} FROM ind),
v_pseudo AS (SELECT * FROM v_real WHERE period NOT IN (SELECT period FROM usable) UNION ALL SELECT entity, period, {_N} FROM early WHERE period IN (SELECT period FROM usable)),
v_flow_proxied AS (SELECT i.* REPLACE (CASE WHEN p.entity IS NULL THEN i.net_migration ELSE p.net_migration END AS net_migration) FROM v_real i LEFT JOIN v_pseudo p ON p.entity=i.entity AND p.period=i.period),
v_late_final AS (SELECT p.* REPLACE (coalesce(i.job_growth, p.job_growth) AS job_growth, coalesce(i.income_growth, p.income_growth) AS income_growth) FROM v_pseudo p LEFT JOIN v_real i ON p.entity=i.entity AND p.period=i.period)"""
VARIANTS = ("real", "pseudo", "flow_proxied", "late_final")


def variants_sql(names):
    """Normalised tables n_<name>, and their scores as strategies."""
    return (REBUILT + ",\n" + ",\n".join(norm_sql(f"v_{n}", f"n_{n}") for n in names) + ",\nranked AS ("
            + " UNION ALL ".join(f"SELECT '{n}' AS strategy, entity, period, ({comp_sql(MODEL.weights)})::DOUBLE AS score FROM n_{n}" for n in names)
            + "),\n" + WF + ",\n" + metrics_sql("wf", G))


def rebuilt(t, names):
    """strategy, entity, period, score of the variants, each normalised by itself."""
    frames = asof.rebuilt_variants(t.ind, staged(early(t), "early"), periods(t), NAMES)
    out = None
    for n in names:
        part = rk.strategies(normalised(frames[n], MODEL, t.bound), {n: composite(MODEL.weights)})
        out = part if out is None else out.unionByName(part)
    return staged(out, "rebuilt")


@query("loss_decomposition", with_parts(f"SELECT strategy, {r('tau')}, {r('tau/nullif((SELECT tau FROM m3 WHERE strategy=$$real$$),0)', 'retention')} FROM m3", "usable", "outcome",
                                        extra=variants_sql(VARIANTS) + ",\nm3 AS (SELECT strategy, avg(weighted_tau) AS tau FROM metrics WHERE horizon=3 GROUP BY strategy)"), stage=True)
def loss_decomposition(t):
    return rounded_all(gates.loss_decomposition(evaluated(t, rebuilt(t, VARIANTS), [3]), 3), ["tau", "retention"])


REBUILT_GATE = variants_sql(VARIANTS[:2]) + ",\n" + summary_sql() + f""",
sc AS (SELECT a.entity, a.period, a.score AS a, b.score AS b FROM ranked a JOIN ranked b ON a.entity=b.entity AND a.period=b.period AND a.strategy='real' AND b.strategy='pseudo'),
ag AS (SELECT period, count(*) AS n, count(*) FILTER (ka<=10 AND kb<=10)::INT AS overlap FROM (SELECT period, row_number() OVER (PARTITION BY period ORDER BY a DESC, entity) AS ka,
  row_number() OVER (PARTITION BY period ORDER BY b DESC, entity) AS kb FROM sc) GROUP BY period HAVING count(*)>=10)"""


@query("retention_gate_rebuilt", with_parts(f"SELECT {r('f', 'tau_final')}, {r('p', 'tau_proxy')}, {r('mo', 'mean_overlap')}, {r('p/nullif(f,0)', 'retention')}, p/nullif(f,0)>=0.85 AND mo>=7 AS pass FROM (SELECT max(CASE WHEN strategy='real' THEN mean_tau END) AS f, max(CASE WHEN strategy='pseudo' THEN mean_tau END) AS p FROM summ WHERE horizon=3 AND regime='POOLED'), (SELECT avg(overlap) AS mo FROM ag WHERE period IN (SELECT period FROM usable))",
                                            "usable", "outcome", extra=REBUILT_GATE), stage=True)
def retention_gate_rebuilt(t):
    ranking = rebuilt(t, VARIANTS[:2])
    real, pseudo = (ranking.filter(S("strategy") == n).select("entity", "period", "score") for n in VARIANTS[:2])
    agreed = gates.agreement(real, pseudo, bound=t.bound).join(periods(t), "period", "left_semi")
    g = gates.retention_gate(wf.summarise(evaluated(t, ranking)), agreed, "real", "pseudo", 3)
    return rounded_all(g, ["tau_final", "tau_proxy", "mean_overlap", "retention"])


# Mid-period: data through May of T. State growth comes for T-1 and for T.
MID = f"""yt AS (SELECT entity, year(date) AS period, avg(rent) AS rent, avg(jobs) AS jobs, avg(home_value) AS value, sum(units) AS units FROM monthly WHERE month(date)<=5 GROUP BY ALL),
rt AS (SELECT year(l_shipdate) AS period, avg(l_tax*100) AS rate FROM lineitem WHERE month(l_shipdate)<=5 GROUP BY 1),
sg2 AS (SELECT coalesce(a.state,b.state) AS state, coalesce(a.period,b.period+1) AS period, b.g AS g_prior, a.g AS g_now FROM sg a FULL JOIN sg b ON b.state=a.state AND b.period=a.period-1),
newer AS (SELECT entity, period, net_migration*0.8 AS flow FROM panel WHERE period=2000 AND entity%3=0),
slow AS (SELECT entity, period, {_last('housing_units', -2)} AS stock, {_last('population', -2)} AS pop, {_last('income_pc', -2)} AS inc FROM panel),
prior AS (SELECT entity, period, {_last('job_growth', -1)} AS jobs0, {_last('employment_diversity', -1)} AS div0 FROM ind),
mid AS (SELECT s.entity, s.period, coalesce(nw.flow, f.flow)/nullif(pop,0) AS net_migration, coalesce(y.jobs/nullif(z.jobs,0)-1, jobs0) AS job_growth, g_now AS income_growth,
  coalesce(y.units, q.permits_total*5/12)*12/5/nullif(stock,0) AS permits_to_stock, y.rent*12/nullif(inc*(1+coalesce(g_prior,0))*(1+coalesce(g_now,0)),0) AS rent_to_income,
  y.value*(rate/1200)*pow(1+rate/1200,360)/(pow(1+rate/1200,360)-1)/nullif(y.rent,0) AS cost_to_own_vs_rent, y.rent/nullif(z.rent,0)-1 AS trailing_rent_growth, div0 AS employment_diversity
  FROM slow s JOIN prior USING (entity, period) JOIN st ON st.entity=s.entity LEFT JOIN yt y ON y.entity=s.entity AND y.period=s.period LEFT JOIN yt z ON z.entity=s.entity AND z.period=s.period-1
  LEFT JOIN panel q ON q.entity=s.entity AND q.period=s.period-1 LEFT JOIN flows f ON f.entity=s.entity AND f.period=s.period-1 LEFT JOIN newer nw ON nw.entity=s.entity AND nw.period=s.period
  LEFT JOIN sg2 ON sg2.state=st.state AND sg2.period=s.period LEFT JOIN rt ON rt.period=s.period)"""


@query("mid_period_rows", with_parts(f"SELECT entity, period, {rs(*NAMES)} FROM mid", "ind", "monthly", extra=PROXIES + ",\n" + MID), stage=True)
def mid_period_rows(t):
    return rounded_all(mid(t), NAMES)


def mid(t):
    placed, flows, _, sg = inputs(t)
    rates = t.lineitem.filter(F.month("l_shipdate") <= 5).groupBy(F.year("l_shipdate").alias("period")).agg(F.avg(S("l_tax") * 100).alias("rate"))
    both = sg.select("state", "period", S("g").alias("g_now")).join(
        sg.select("state", (S("period") + 1).alias("period"), S("g").alias("g_prior")), ["state", "period"], "full")
    newer = t.panel.filter("period = 2000 AND entity % 3 = 0").select("entity", "period", (S("net_migration") * 0.8).alias("flow"))
    return asof.mid_period_rows(placed, t.ind, t.monthly, rates, flows, both, 5, newer)


@query("mid_period_history", with_parts(metrics_select(), "usable", "outcome", "monthly", extra=PROXIES + ",\n" + MID + ",\n" + norm_sql("mid", "mnorm") + ",\n"
                                        + strategies_sql({"mid": comp_sql(MODEL.weights)}, "mnorm") + ",\n" + WF + ",\n" + metrics_sql("wf", G)), stage=True)
def mid_period_history(t):
    """Every period's mid-period rows ranked and tested against what followed."""
    mnorm = staged(normalised(mid(t), MODEL, t.bound), "mid")
    return rounded_all(evaluated(t, rk.strategies(mnorm, {"mid": composite(MODEL.weights)})).drop("regime"), M3)


MID_GATE = (PROXIES + ",\n" + MID + ",\n" + norm_sql("mid", "mnorm") + ",\nranked AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS strategy, entity, period, ({comp_sql(MODEL.weights)})::DOUBLE AS score FROM {src}" for n, src in (("final", "norm"), ("mid", "mnorm"))) + "),\n" + WF + ",\n" + metrics_sql("wf", G)
    + ",\n" + summary_sql() + """,
sc AS (SELECT a.entity, a.period, a.score AS a, b.score AS b FROM ranked a JOIN ranked b ON a.entity=b.entity AND a.period=b.period AND a.strategy='final' AND b.strategy='mid'),
ag AS (SELECT period, count(*) AS n, count(*) FILTER (ka<=10 AND kb<=10)::INT AS overlap FROM (SELECT period, row_number() OVER (PARTITION BY period ORDER BY a DESC, entity) AS ka,
  row_number() OVER (PARTITION BY period ORDER BY b DESC, entity) AS kb FROM sc) GROUP BY period HAVING count(*)>=10)""")


@query("mid_period_gate", with_parts(f"SELECT {r('f', 'tau_final')}, {r('p', 'tau_proxy')}, {r('mo', 'mean_overlap')}, {r('p/nullif(f,0)', 'retention')}, p/nullif(f,0)>=0.85 AND mo>=7 AS pass FROM (SELECT max(CASE WHEN strategy='final' THEN mean_tau END) AS f, max(CASE WHEN strategy='mid' THEN mean_tau END) AS p FROM summ WHERE horizon=3 AND regime='POOLED'), (SELECT avg(overlap) AS mo FROM ag WHERE period IN (SELECT period FROM usable))",
                                     "usable", "outcome", "monthly", extra=MID_GATE), stage=True)
def mid_period_gate(t):
    """Retention and overlap of the mid-period history against the final one."""
    mnorm = normalised(mid(t), MODEL, t.bound)
    ranking = staged(rk.strategies(t.norm, {"final": composite(MODEL.weights)}).unionByName(rk.strategies(mnorm, {"mid": composite(MODEL.weights)})), "mid")
    final, early_ = (ranking.filter(S("strategy") == n).select("entity", "period", "score") for n in ("final", "mid"))
    agreed = gates.agreement(final, early_, bound=t.bound).join(periods(t), "period", "left_semi")
    g = gates.retention_gate(wf.summarise(evaluated(t, ranking)), agreed, "final", "mid", 3)
    return rounded_all(g, ["tau_final", "tau_proxy", "mean_overlap", "retention"])


@query("proxy_substitution", with_parts(f"SELECT i.entity, i.period, {r('CASE WHEN i.period IN (1999,2000) THEN coalesce(f.flow/nullif(p.population,0), i.net_migration) ELSE i.net_migration END', 'net_migration')} FROM ind i JOIN panel p USING (entity, period) LEFT JOIN flows f USING (entity, period)",
                                        "ind", extra=PROXIES), stage=True)
def proxy_substitution(t):
    _, flows, _, _ = inputs(t)
    proxy = t.panel.select("entity", "period", "population").join(flows, ["entity", "period"]).select("entity", "period", (S("flow") / S("population")).alias("proxy"))
    return rounded_all(asof.proxied(t.ind, "net_migration", proxy, [1999, 2000]).select("entity", "period", "net_migration"), ["net_migration"])


GAPPY = "gi AS (SELECT entity, period, CASE WHEN period=2000 AND entity%2=0 THEN NULL ELSE job_growth END AS job_growth FROM ind)"


@query("previous_period_carry", with_parts(f"SELECT a.entity, a.period, {r('CASE WHEN a.period=2000 THEN coalesce(a.job_growth, b.job_growth) ELSE a.job_growth END', 'job_growth')} FROM gi a LEFT JOIN gi b ON b.entity=a.entity AND b.period=a.period-1", "ind", extra=GAPPY))
def previous_period_carry(t):
    gi = t.ind.select("entity", "period", F.when(~((S("period") == 2000) & (S("entity") % 2 == 0)), S("job_growth")).alias("job_growth"))
    return rounded_all(asof.carry_missing(gi, ["job_growth"], [2000]), ["job_growth"])


@query("carry_forward", with_parts(f"SELECT entity, period, {r(_last('permits_mf', -1), 'before')}, {r(_last('permits_mf', -2), 'two_back')} FROM customer_panel", "customer_panel"))
def carry_forward(t):
    return rounded_all(t.customer_panel.select("entity", "period", growth.carried("permits_mf").alias("before"), growth.carried("permits_mf", -2).alias("two_back")), ["before", "two_back"])


@query("variant_with_proxy", with_parts(f"""SELECT i.entity, i.period, {r('CASE WHEN n>=2 THEN s/n END', 'job_growth')} FROM (SELECT i.entity, i.period, (j.proxy_job_growth IS NOT NULL)::INT+(a.job_growth IS NOT NULL)::INT+(b.job_growth IS NOT NULL)::INT AS n,
  coalesce(j.proxy_job_growth,0)+coalesce(a.job_growth,0)+coalesce(b.job_growth,0) AS s FROM ind i LEFT JOIN jobs j USING (entity, period) LEFT JOIN ind a ON a.entity=i.entity AND a.period=i.period-1 LEFT JOIN ind b ON b.entity=i.entity AND b.period=i.period-2) i""", "ind", extra=PROXIES), stage=True)
def variant_with_proxy(t):
    _, _, jobs, _ = inputs(t)
    v = asof.variant_with_proxy(t.ind, t.ind, "job_growth", jobs.select("entity", "period", S("proxy_job_growth").alias("proxy")))
    return rounded_all(v.select("entity", "period", "job_growth"), ["job_growth"])


WEIGHT_VALUES = ", ".join(f"('{k}', '{s}', {w})" for k, s, w in asof.provenance(MODEL))


@query("provenance_weights", with_parts(f"SELECT source, {r('sum(w)', 'weight')}, {r('sum(sz)/nullif(sum(nz),0)', 'mean_abs_z')} FROM (SELECT v.source, v.k, max(v.w) AS w, sum(abs(CASE v.k " + " ".join(f"WHEN '{k}' THEN {k}" for k in NAMES)
                                        + " END)) AS sz, count(CASE v.k " + " ".join(f"WHEN '{k}' THEN {k}" for k in NAMES) + f" END) AS nz FROM norm, (VALUES {WEIGHT_VALUES}) v(k, source, w) GROUP BY v.source, v.k) GROUP BY source", "norm"))
def provenance_weights(t):
    tags = t.spark.createDataFrame(asof.provenance(MODEL), "indicator string, source string, weight double")
    long = t.norm.unpivot(["entity", "period"], NAMES, "indicator", "z").join(F.broadcast(tags), "indicator")
    one = long.groupBy("source", "indicator").agg(F.max("weight").alias("weight"), F.sum(F.abs("z")).alias("sz"), F.count("z").alias("nz"))
    g = one.groupBy("source").agg(F.sum("weight").alias("weight"), F.try_divide(F.sum("sz"), F.sum("nz")).alias("mean_abs_z"))
    return rounded_all(g, ["weight", "mean_abs_z"])


PAIRS = """pairs AS (SELECT p.entity, p.period, p.population/nullif(q.population,0)-1 AS proxy, p.total_emp/nullif(q.total_emp,0)-1 AS final FROM panel p JOIN panel q ON q.entity=p.entity AND q.period=p.period-1)"""


@query("proxy_quality", with_parts(f"SELECT a.period, {r('a.pearson', 'pearson')}, b.n, {r('b.rho', 'rho')} FROM (SELECT period, corr(proxy, final) AS pearson FROM pairs GROUP BY period) a JOIN (SELECT period, count(*) AS n, corr(x,y) AS rho FROM (SELECT period, {_avg_rank('proxy')} AS x, {_avg_rank('final')} AS y FROM pairs) GROUP BY period) b USING (period)", "panel", extra=PAIRS), stage=True)
def proxy_quality(t):
    pairs = asof.growth_pairs(t.panel, "population", t.panel, "total_emp")
    level = pairs.groupBy("period").agg(stats.correlation("proxy", "final").alias("pearson"))
    return rounded_all(level.join(stats.spearman(pairs, ["period"], "proxy", "final", at_least=10, bound=t.bound), "period"), ["pearson", "rho"])


@query("series_coverage", with_parts("SELECT c.c_custkey AS entity, p.last_obs IS NOT NULL AS found, p.last_obs, coalesce(p.n_obs,0) AS n_obs FROM customer c LEFT JOIN (SELECT entity, max(period) AS last_obs, count(rent) AS n_obs FROM customer_panel WHERE entity%7<>0 GROUP BY entity) p ON p.entity=c.c_custkey", "customer_panel"))
def series_coverage(t):
    p = t.customer_panel.filter("entity % 7 <> 0")
    return asof.series_coverage(p, t.customer.select(S("c_custkey").alias("entity")), "rent")
