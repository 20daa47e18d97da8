"""Queries: panel, indicators, z-scores, composite, editions."""
from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.catalog.base import MEASURES, MODEL, comp_sql, query, r, rounded, rounded_all, rs, with_parts, z_sql
from paneltide.operators.stats import zscores
from paneltide.plans import editions, rankings, scoring


SCORE_COLS = ["score"] + [f"bucket_{b}" for b in MODEL.buckets]


@query("panel_star", with_parts(f"SELECT entity, period, {rs(*MEASURES, 'mortgage_rate', digits=4)} FROM panel", "panel"))
def panel_star(t):
    return rounded_all(t.rated(t.panel), [*MEASURES, "mortgage_rate"], 4)


@query("panel_gappy", with_parts(f"SELECT entity, period, {rs(*MEASURES, 'mortgage_rate', digits=4)} FROM customer_panel", "customer_panel"))
def panel_gappy(t):
    return rounded_all(t.rated(t.customer_panel), [*MEASURES, "mortgage_rate"], 4)


@query("indicator_table", with_parts(f"SELECT entity, period, {rs(*MODEL.names)} FROM ind", "ind"))
def indicator_table(t):
    return rounded_all(t.ind, MODEL.names)


@query("zscore_population", with_parts(f"SELECT entity, period, {rs(*MODEL.names)} FROM norm", "norm"))
def zscore_population(t):
    return rounded_all(t.norm, MODEL.names)


@query("zscore_sample", with_parts(
    f"SELECT entity, period, {r(z_sql('rent', 1, 'period', True), 'z_rent')}, {r(z_sql('housing_units', -1, 'period', True), 'z_stock')} FROM panel", "panel"))
def zscore_sample(t):
    z = zscores(t.panel, ["period"], {"z_rent": "rent", "z_stock": "housing_units"}, sample=True,
                signs={"z_stock": -1}, bound=t.bound)
    return rounded_all(z.select("entity", "period", "z_rent", "z_stock"), ["z_rent", "z_stock"])


@query("score_and_rank", with_parts(f"SELECT entity, period, n_indicators, rank, {rs(*SCORE_COLS)} FROM scored", "scored"))
def score_and_rank(t):
    return rounded_all(t.scored, SCORE_COLS)


@query("ranked_edition", with_parts(f"SELECT entity, period, n_indicators, rank, {rs(*SCORE_COLS)} FROM scored WHERE period=1998", "scored"))
def ranked_edition(t):
    return rounded_all(scoring.edition(t.scored, 1998), SCORE_COLS)


ALT = {"net_migration": 0.5, "rent_to_income": 0.3, "income_growth": 0.2}


@query("score_any_weights", with_parts(f"SELECT entity, period, {r(comp_sql(ALT), 'score')} FROM norm", "norm"))
def score_any_weights(t):
    return rounded_all(scoring.score_with(t.ind, ALT, MODEL.signs, t.bound), ["score"])


MOM = ["total_growth", "multi_growth", "total_rate_change", "multi_rate_change"]


@query("permit_momentum", with_parts(f"SELECT entity, period, {rs(*MOM)} FROM clipped", "panel", extra="""
raw AS (SELECT p.entity, p.period, p.permits_total/CASE WHEN q.permits_total>0 THEN q.permits_total END-1 AS total_growth,
  p.permits_mf/CASE WHEN q.permits_mf>0 THEN q.permits_mf END-1 AS multi_growth,
  p.permits_total/nullif(p.housing_units,0)-q.permits_total/nullif(q.housing_units,0) AS total_rate_change,
  p.permits_mf/nullif(p.housing_units,0)-q.permits_mf/nullif(q.housing_units,0) AS multi_rate_change
  FROM panel p LEFT JOIN panel q ON q.entity=p.entity AND q.period=p.period-1),
lim AS (SELECT period, """ + ", ".join(f"quantile_cont({c},0.01) AS lo_{c}, quantile_cont({c},0.99) AS hi_{c}" for c in MOM) + """ FROM raw GROUP BY period),
clipped AS (SELECT entity, period, """ + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c},lo_{c}),hi_{c}) END AS {c}" for c in MOM) + " FROM raw JOIN lim USING (period))"))
def permit_momentum(t):
    return rounded_all(scoring.permit_momentum(t.panel, "permits_total", "permits_mf", "housing_units", t.bound), MOM)


@query("imputed_share", with_parts(f"SELECT entity, period, {r('1-permits_mf/nullif(permits_total,0)', 'share')}, "
                                   "coalesce(1-permits_mf/nullif(permits_total,0)>0.25, false) AS flagged FROM panel", "panel"))
def imputed_share(t):
    share, flagged = scoring.imputed_share("permits_total", "permits_mf")
    return t.panel.select("entity", "period", rounded(share).alias("share"), F.coalesce(flagged, F.lit(False)).alias("flagged"))


@query("valuation_measures", with_parts(
    f"SELECT p.entity, p.period, {r('p.home_value/nullif(p.rent*12,0)', 'price_to_rent')}, {r('p.rent*12/nullif(p.home_value,0)', 'gross_yield')}, "
    f"{r('p.home_value/nullif(q.home_value,0)-1', 'appreciation')} FROM panel p LEFT JOIN panel q ON q.entity=p.entity AND q.period=p.period-1", "panel"))
def valuation_measures(t):
    return t.panel.select("entity", "period", *[rounded(c).alias(n) for n, c in scoring.valuation_measures().items()])


def _trail(c):
    w = "OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {w}>=2 THEN avg({c}) {w} END"


@query("multi_year_variant", with_parts(
    f"SELECT entity, period, {r(_trail('job_growth'), 'job_growth')}, {r(_trail('income_growth'), 'income_growth')}, {rs('net_migration')} FROM ind", "ind"))
def multi_year_variant(t):
    v = scoring.with_trailing_means(t.ind, ["job_growth", "income_growth"])
    return rounded_all(v.select("entity", "period", "job_growth", "income_growth", "net_migration"),
                       ["job_growth", "income_growth", "net_migration"])


# ---- editions --------------------------------------------------------------------------------

SCHEMES = {n: rankings.tilted_weights(MODEL, f) for n, f in editions.SCHEME_FACTORS.items()}


@query("rank_range_schemes", with_parts("SELECT entity, period, min(k)::INT AS rank_lo, max(k)::INT AS rank_hi FROM rk GROUP BY entity, period", "norm", extra="rk AS (" + " UNION ALL ".join(
    f"SELECT entity, period, rank() OVER (PARTITION BY period ORDER BY {comp_sql(w)} DESC) AS k FROM norm" for w in SCHEMES.values()) + ")"))
def rank_range_schemes(t):
    return editions.rank_range(t.norm, MODEL, bound=t.bound)


PCT = "((rank() OVER (PARTITION BY period, indicator ORDER BY value)+(count(*) OVER (PARTITION BY period, indicator, value)-1)/2.0)/count(value) OVER (PARTITION BY period, indicator)*100)::DOUBLE"
LONG = "long AS (SELECT entity, period, indicator, value FROM (" + " UNION ALL ".join(
    f"SELECT entity, period, '{k}' AS indicator, {k} AS value FROM norm" for k in MODEL.names) + ") WHERE value IS NOT NULL)"


@query("percentile_rank", with_parts(f"SELECT entity, period, indicator, {r(PCT, 'pct')} FROM long", "norm", extra=LONG))
def percentile_rank(t):
    p = editions.percentile_table(t.norm, MODEL.names, t.bound).filter(F.col("pct").isNotNull())
    return rounded_all(p.select("entity", "period", "indicator", "pct"), ["pct"])


@query("strengths_weaknesses", with_parts(
    f"SELECT entity, period, side, indicator, {r('pct')}, place::INT AS place FROM placed WHERE place<=5", "norm", extra=LONG + f""",
pc AS (SELECT entity, period, indicator, {PCT} AS pct FROM long),
sided AS (SELECT *, CASE WHEN pct>=65 THEN 'strength' WHEN pct<=35 THEN 'weakness' END AS side FROM pc),
placed AS (SELECT *, row_number() OVER (PARTITION BY entity, period, side ORDER BY CASE WHEN side='strength' THEN -pct ELSE pct END, indicator) AS place FROM sided WHERE side IS NOT NULL)"""))
def strengths_weaknesses(t):
    s = editions.strengths_and_weaknesses(editions.percentile_table(t.norm, MODEL.names, t.bound))
    return rounded_all(s.select("entity", "period", "side", "indicator", "pct", "place"), ["pct"])


_B = list(MODEL.buckets)
_VALUES = ", ".join(f"('{b}', {i}, bucket_{b})" for i, b in enumerate(_B))


@query("top_contributors", with_parts("""SELECT entity, period, max(CASE WHEN up=1 AND v>0.02 THEN b END) AS strength,
  max(CASE WHEN up=2 AND v>0.02 THEN b END) AS second_strength, max(CASE WHEN down=1 AND v<-0.02 THEN b END) AS drag
  FROM parts GROUP BY entity, period""", "scored", extra=f"""parts AS (SELECT entity, period, b, v,
  row_number() OVER (PARTITION BY entity, period ORDER BY v DESC, i) AS up, row_number() OVER (PARTITION BY entity, period ORDER BY v, i) AS down
  FROM (SELECT entity, period, u.b, u.i, u.v FROM scored, LATERAL (VALUES {_VALUES}) u(b,i,v)))"""))
def top_contributors(t):
    return editions.contributors(t.scored, MODEL)


@query("rank_changes", with_parts("""SELECT c.entity, c.rank, p.rank AS prior_rank, p.rank IS NULL AS is_new, p.rank-c.rank AS delta,
  coalesce(c.rank<p.rank-5 OR c.rank>p.rank+5, false) AS notable FROM scored c LEFT JOIN (SELECT * FROM scored WHERE period=1998 AND entity%10<>3) p USING (entity)
  WHERE c.period=1999""", "scored"))
def rank_changes(t):
    prior = t.scored.filter((F.col("period") == 1998) & (F.col("entity") % 10 != 3))
    span = prior.select("entity", (F.col("rank") - 5).alias("rank_lo"), (F.col("rank") + 5).alias("rank_hi"))
    return editions.rank_changes(t.scored.filter("period = 1999"), prior, span)


@query("rank_trajectory", with_parts("""SELECT entity, period, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS k FROM
  (SELECT entity, period, rank FROM scored WHERE period<2001 UNION ALL SELECT entity, period, rank FROM scored WHERE period=2001)) WHERE k<=5""", "scored"))
def rank_trajectory(t):
    from paneltide.operators.growth import last_n
    s = t.scored
    return last_n(editions.trajectory(s.filter("period < 2001"), s.filter("period = 2001")), 5)


@query("sanity_profile", with_parts(f"""SELECT a.entity, {r('a.x', 'trailing_rent_growth')}, {r('a.pct', 'measure_pct')}, {r('b.pct', 'level_pct')} FROM a LEFT JOIN b USING (entity)
  ORDER BY a.x DESC, a.entity LIMIT 10""", "ind", extra="""j AS (SELECT i.entity, i.period, i.trailing_rent_growth AS x, p.rent AS y FROM ind i JOIN panel p USING (entity, period)),
a AS (SELECT entity, x, (rank() OVER (ORDER BY x)+(count(*) OVER (PARTITION BY x)-1)/2.0)/count(*) OVER ()*100 AS pct FROM j WHERE x IS NOT NULL AND period=(SELECT max(period) FROM j WHERE x IS NOT NULL)),
b AS (SELECT entity, y, (rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2.0)/count(*) OVER ()*100 AS pct FROM j WHERE period=(SELECT max(period) FROM j WHERE y IS NOT NULL))"""))
def sanity_profile(t):
    j = t.ind.select("entity", "period", "trailing_rent_growth").join(t.panel.select("entity", "period", "rent"), ["entity", "period"])
    s = editions.sanity_profile(j, "trailing_rent_growth", "rent", 10, t.bound)
    return rounded_all(s, ["trailing_rent_growth", "measure_pct", "level_pct"])
