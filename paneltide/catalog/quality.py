"""Queries: data-quality flags, registry, grading."""
from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.catalog.base import MODEL, metrics_sql, query, r, rounded_all, rs, with_parts
from paneltide.catalog.resample import NOISE, intervals
from paneltide.operators import reshape
from paneltide.operators.growth import same_months_growth
from paneltide.plans import quality, registry
from paneltide.plans.scoring import edition
from paneltide.plans.walkforward import realised
from paneltide.scale import staging_path

S = F.col
GROWTHS = """gg AS (SELECT p.entity, p.period, p.income_pc/nullif(q.income_pc,0)-1 AS inc, p.avg_pay/nullif(q.avg_pay,0)-1 AS pay, p.rent/nullif(q.rent,0)-1 AS rent, p.home_value/nullif(q.home_value,0)-1 AS val FROM panel p JOIN panel q ON q.entity=p.entity AND q.period=p.period-1),
pairs AS (SELECT 'income' AS "check", entity, period, inc AS a, pay AS b FROM gg UNION ALL SELECT 'value', entity, period, rent, val FROM gg),
dd AS (SELECT *, a-b AS d FROM pairs),
ct AS (SELECT *, d-median(d) OVER (PARTITION BY "check", period) AS centred, stddev_pop(d) OVER (PARTITION BY "check", period) AS sd FROM dd),
div AS (SELECT "check", entity, period, centred, CASE WHEN sd>0 THEN centred/sd ELSE 0 END AS z FROM ct)"""


def divergent(t):
    g = quality.growth_table(t.panel, ["income_pc", "avg_pay", "rent", "home_value"])
    wide = reshape.pivot_first(g, ["entity", "period"], "measure", "growth", ["income_pc", "avg_pay", "rent", "home_value"])
    pairs = quality.sister_pairs({"income": (wide, "income_pc", wide, "avg_pay"), "value": (wide, "rent", wide, "home_value")})
    return quality.divergence(pairs, t.bound)


@query("cross_source_divergence", with_parts(f'SELECT "check", entity, period, {rs("centred", "z")} FROM div WHERE abs(centred)>0.04 OR abs(z)>3', "panel", extra=GROWTHS), stage=True)
def cross_source_divergence(t):
    return rounded_all(divergent(t), ["centred", "z"])


OUTL = """lg AS (SELECT 'rent' AS measure, p.entity, p.period, p.rent/nullif(q.rent,0)-1 AS growth FROM customer_panel p JOIN customer_panel q ON q.entity=p.entity AND q.period=p.period-1 UNION ALL SELECT 'income_pc', p.entity, p.period, p.income_pc/nullif(q.income_pc,0)-1 FROM customer_panel p JOIN customer_panel q ON q.entity=p.entity AND q.period=p.period-1),
oz AS (SELECT *, (growth-median(growth) OVER (PARTITION BY measure, period))/nullif(stddev_pop(growth) OVER (PARTITION BY measure, period),0) AS z FROM lg WHERE growth IS NOT NULL)"""


@query("outlier_gate", with_parts(f"SELECT measure, entity, period, {rs('growth', 'z')} FROM oz WHERE abs(z)>4", "customer_panel", extra=OUTL))
def outlier_gate(t):
    o = quality.outliers(t.customer_panel, ["rent", "income_pc"], bound=2 * t.rows("customer"))
    return rounded_all(o, ["growth", "z"])


@query("outlier_gate_split", with_parts(f"SELECT measure, entity, period, {rs('growth', 'z')} FROM oz WHERE abs(z)>4", "customer_panel", extra=OUTL))
def outlier_gate_split(t):
    return rounded_all(quality.outliers(t.customer_panel, ["rent", "income_pc"], bound=1 << 40), ["growth", "z"])


@query("membership_watch", """SELECT s_nationkey AS parent, count(CASE WHEN s_suppkey%7=0 AND s_suppkey%5<>0 THEN 1 END) AS n_added, count(CASE WHEN s_suppkey%5=0 AND s_suppkey%7<>0 THEN 1 END) AS n_removed,
  CASE WHEN s_nationkey<12 THEN 'BLOCKER' ELSE 'WARN' END AS severity FROM supplier WHERE (s_suppkey%7=0)<>(s_suppkey%5=0) GROUP BY s_nationkey""")
def membership_watch(t):
    m = t.supplier.select(S("s_nationkey").alias("parent"), S("s_suppkey").alias("child"))
    universe = t.nation.filter("n_nationkey < 12").select(S("n_nationkey").alias("parent"))
    return quality.membership_watch(m.filter("child % 5 <> 0 OR child % 7 = 0"), m.filter("child % 7 <> 0 OR child % 5 = 0"), universe, "parent", "child")


@query("top_entrants", with_parts("""SELECT c.entity, c.rank, p.rank AS prior_rank, CASE WHEN p.rank IS NULL THEN 'new' WHEN p.rank-c.rank>15 THEN 'moved' ELSE 'entered' END AS move
  FROM (SELECT * FROM scored WHERE period=1999) c LEFT JOIN (SELECT * FROM scored WHERE period=1998 AND entity%10<>3) p USING (entity) WHERE c.rank<=10 AND (p.rank IS NULL OR p.rank>10)""", "scored"))
def top_entrants(t):
    return quality.top_entrants(edition(t.scored, 1999), edition(t.scored, 1998).filter("entity % 10 <> 3"))


GOLD = "gold AS (SELECT entity, period, 'rent' AS \"column\", CASE WHEN entity%13=0 THEN NULL WHEN entity%5=0 THEN rent*1.001 ELSE rent*1.00001 END AS value FROM panel)"


@query("golden_values", with_parts(f"SELECT g.entity, g.period, g.\"column\", {r('g.value', 'golden_value', 3)}, {r('p.rent', 'current_value', 3)} FROM gold g LEFT JOIN panel p USING (entity, period) WHERE coalesce(NOT abs(g.value-p.rent)<=1e-8+1e-4*abs(p.rent), true)", "panel", extra=GOLD))
def golden_values(t):
    v = F.when(S("entity") % 13 == 0, None).when(S("entity") % 5 == 0, S("rent") * 1.001).otherwise(S("rent") * 1.00001)
    gold = t.panel.select("entity", "period", F.lit("rent").alias("column"), v.alias("value"))
    now = reshape.golden_long(t.panel, ["entity", "period"], ["rent"])
    return rounded_all(quality.golden_mismatches(gold, now), ["golden_value", "current_value"], 3)


FLAGS = GROWTHS + """,
hits AS (SELECT * FROM div WHERE abs(centred)>0.04 OR abs(z)>3),
fl AS (SELECT substr(sha1("check"||'|'||entity||'|'||period||'|'||'growth'),1,10) AS flag_id, "check", CASE WHEN abs(z)>3 THEN 'BLOCKER' ELSE 'WARN' END AS severity, entity::VARCHAR AS entity, period::VARCHAR AS period, 'growth' AS measure, "check"||' readings diverge' AS detail FROM hits)"""


def flag_rows(t):
    d = divergent(t)
    severity = F.when(F.abs("z") > 3, "BLOCKER").otherwise("WARN")
    return quality.flags(d, S("check"), severity, F.lit("growth"), F.concat("check", F.lit(" readings diverge")), S("entity"), S("period"))




@query("flag_ids", with_parts("SELECT * FROM fl", "panel", extra=FLAGS), stage=True)
def flag_ids(t):
    return flag_rows(t)


DISPOSED = ",\ndisp AS (SELECT flag_id FROM fl WHERE entity::INT%2=0)"


@query("flag_report", with_parts("SELECT \"check\", severity, count(*) AS n_flags, count(CASE WHEN severity='BLOCKER' AND d.flag_id IS NULL THEN 1 END) AS n_open, CASE WHEN count(CASE WHEN severity='BLOCKER' AND d.flag_id IS NULL THEN 1 END)=0 THEN 'GREEN' ELSE 'NEEDS DISPOSITION' END AS status FROM fl LEFT JOIN disp d USING (flag_id) GROUP BY ALL", "panel", extra=FLAGS + DISPOSED), stage=True)
def flag_report(t):
    f = flag_rows(t)
    return quality.report_counts(f, f.filter(S("entity").cast("int") % 2 == 0).select("flag_id"))


@query("publication_gate", with_parts("SELECT same_panel, open_blockers, same_panel AND open_blockers=0 AS clear FROM (SELECT count(DISTINCT flag_id) AS open_blockers FROM fl WHERE severity='BLOCKER' AND flag_id NOT IN (SELECT flag_id FROM disp)), (SELECT unnest([true,false]) AS same_panel)", "panel", extra=FLAGS + DISPOSED), stage=True)
def publication_gate(t):
    f = flag_rows(t)
    d = registry.digest(t.panel)
    # a report made from this panel, and one made before one of its values was known
    before = registry.digest(t.panel.withColumn("rent", F.when(S("rent") != t.panel.agg(F.max("rent")).scalar(), S("rent"))))
    return quality.publication_gate(f, f.filter(S("entity").cast("int") % 2 == 0).select("flag_id"), d.unionByName(before), d)


@query("series_reconciliation", with_parts(f"SELECT period, {r('max(abs(a-b))', 'max_abs_diff', 3)}, {r('(sum(a)-sum(b))/nullif(sum(b),0)', 'total_pct_diff')}, count(CASE WHEN abs((a-b)/nullif(b,0))>0.03 THEN 1 END) AS n_outside, abs((sum(a)-sum(b))/nullif(sum(b),0))<=0.03 AS within FROM (SELECT period, home_value AS a, home_value*(1+(entity%9)/100.0::DOUBLE) AS b FROM panel) GROUP BY period", "panel"))
def series_reconciliation(t):
    other = t.panel.select("entity", "period", (S("home_value") * (1 + (S("entity") % 9) / 100.0)).alias("home_value"))
    q = quality.reconcile(t.panel, other, "home_value")
    return rounded_all(rounded_all(q, ["max_abs_diff"], 3), ["total_pct_diff"])


@query("series_outside", with_parts(f"SELECT entity, period, {r('a', 'value', 3)}, {r('b', 'other', 3)}, {r('(a-b)/nullif(b,0)', 'pct_diff')} FROM (SELECT entity, period, home_value AS a, home_value*(1+(entity%9)/100.0::DOUBLE) AS b FROM panel) WHERE abs((a-b)/nullif(b,0))>0.03", "panel"))
def series_outside(t):
    other = t.panel.select("entity", "period", (S("home_value") * (1 + (S("entity") % 9) / 100.0)).alias("home_value"))
    q = quality.outside(t.panel, other, "home_value")
    return rounded_all(rounded_all(q, ["value", "other"], 3), ["pct_diff"])


@query("boundary_ratio", with_parts(f"SELECT a.entity, a.period, {r('a.v/nullif(m.v,0)', 'boundary_ratio')} FROM (SELECT s_nationkey AS entity, period, sum(population) AS v FROM panel JOIN supplier ON s_suppkey=entity GROUP BY ALL) a JOIN (SELECT s_nationkey AS entity, period, sum(population) AS v FROM panel JOIN supplier ON s_suppkey=entity WHERE s_suppkey%4<>0 GROUP BY ALL) m USING (entity, period)", "panel"))
def boundary_ratio(t):
    rows = t.panel.select(S("entity").alias("child"), "period", "population").join(t.supplier.select(S("s_suppkey").alias("child"), S("s_nationkey").alias("entity")), "child")
    total = lambda d: d.groupBy("entity", "period").agg(F.sum("population").alias("population"))
    return rounded_all(quality.boundary_ratio(total(rows), total(rows.filter("child % 4 <> 0")), "population"), ["boundary_ratio"])


@query("published_figures", with_parts(f"SELECT figure, value, {r('shown', 'recomputed')}, coalesce(abs(shown-value)<=1e-9, false) AS ok FROM (SELECT 'entities' AS figure, 100.0::DOUBLE AS value, round((SELECT count(DISTINCT entity) FROM panel),0)::DOUBLE AS shown UNION ALL SELECT 'mean_rent', 1.5, round((SELECT avg(rent) FROM panel)*10)/10 UNION ALL SELECT 'missing', 3.0, NULL)", "panel"))
def published_figures(t):
    expected = t.spark.createDataFrame([("entities", 100.0, 0), ("mean_rent", 1.5, 1), ("missing", 3.0, 0)], "figure string, value double, digits int")
    one = t.panel.agg(F.count_distinct("entity").cast("double").alias("entities"), F.avg("rent").alias("mean_rent"))
    actual = one.unpivot([], ["entities", "mean_rent"], "figure", "value")
    return rounded_all(quality.published_mismatches(actual, expected), ["recomputed"])


@query("rank_outside_interval", with_parts("SELECT s.entity, s.period, s.rank, rank_lo, rank_hi FROM scored s JOIN iv ON iv.entity=s.entity AND iv.edition='e'||(s.period-1) WHERE NOT s.rank BETWEEN rank_lo AND rank_hi AND s.entity%10<>1", "scored", extra=NOISE), stage=True)
def rank_outside_interval(t):
    """Every edition's ranks against the intervals of the edition before."""
    iv = intervals(t).withColumn("period", F.substring("edition", 2, 10).cast("int") + 1)
    allowed = t.supplier.filter("s_suppkey % 10 = 1").select(S("s_suppkey").alias("entity"))
    return quality.rank_outside_interval(t.scored, iv, allowed)


# ---- registry ----------------------------------------------------------------------------------

RUNS = "runs AS (SELECT 'r'||period AS run_id, entity, period, score FROM scored)"
GRADE = RUNS + """,
wr0 AS (SELECT run_id, period, entity, score, realized FROM runs JOIN outcome USING (entity, period) WHERE horizon=3),
wrl AS (SELECT run_id, quantile_cont(realized,0.01) AS lo, quantile_cont(realized,0.99) AS hi FROM wr0 GROUP BY run_id),
wr AS (SELECT run_id, period, entity, score, least(greatest(realized,lo),hi) AS realized FROM wr0 JOIN wrl USING (run_id)),
""" + metrics_sql("wr", ["run_id", "period"], clip=False) + """,
nowr AS (SELECT run_id, w.period, entity, n.net_migration AS score, realized FROM wr w JOIN norm n USING (entity, period) WHERE n.net_migration IS NOT NULL),
""" + metrics_sql("nowr", ["run_id", "period"], clip=False, name="cur") + """,
ov AS (SELECT run_id, count(*) FILTER (a<=10 AND b<=10)::INT AS overlap FROM (SELECT w.run_id, row_number() OVER (PARTITION BY w.run_id ORDER BY w.score DESC, entity) AS a, row_number() OVER (PARTITION BY w.run_id ORDER BY n.score DESC, entity) AS b FROM wr w JOIN nowr n USING (run_id, entity)) GROUP BY run_id HAVING count(*)>=10)"""
GC = ["weighted_tau", "precision_at_k", "edge_pp", "current_tau", "retention"]


def frozen(t):
    """Freeze every edition into a fresh registry folder, and freeze it again, which changes nothing."""
    root = staging_path(t.spark, "registry")
    clear = t.spark.createDataFrame([(True,)], "clear boolean")
    runs = {f"r{r['period']}": (r["period"], f"{r['period']}-12-31") for r in t.panel.select("period").distinct().collect()}
    for _ in range(2):
        registry.freeze_runs(t.scored, t.panel, root, runs, MODEL.weights, clear)
    return root


@query("frozen_runs", with_parts(f"SELECT run_id, entity, period, {r('score')} FROM runs", "scored", extra=RUNS), stage=True)
def frozen_runs(t):
    return rounded_all(registry.read_runs(t.spark, frozen(t)).select("run_id", "entity", "period", "score"), ["score"])


@query("operative_run", """SELECT p::INT AS score_period, CASE WHEN p<=top THEN 'r'||p ELSE 'r'||top END AS run_id, p<=top AS exact FROM (SELECT DISTINCT year(l_shipdate) AS p FROM lineitem UNION SELECT DISTINCT year(l_shipdate)+3 FROM lineitem),
  (SELECT max(year(l_shipdate)) AS top FROM lineitem)""", stage=True)
def operative_run(t):
    """Periods of the panel, and three periods on, of which the last have no run yet."""
    asked = t.panel.select(S("period").alias("score_period")).union(t.panel.select(S("period") + 3)).distinct()
    return registry.operative_runs(registry.committed_runs(t.spark, frozen(t)), asked)


@query("grade_runs", with_parts(f"SELECT l.run_id, l.period AS score_period, l.period+3<=mp AS closed, CASE WHEN l.period+3>mp THEN l.period+3 END AS waits_for, m.n_entities, {r('m.weighted_tau', 'weighted_tau')}, {r('m.precision_at_k', 'precision_at_k')}, {r('m.edge_pp', 'edge_pp')}, {r('c.weighted_tau', 'current_tau')}, {r('m.weighted_tau/nullif(c.weighted_tau,0)', 'retention')}, ov.overlap FROM (SELECT DISTINCT run_id, period, (SELECT max(period) FROM panel WHERE rent IS NOT NULL) AS mp FROM runs) l LEFT JOIN metrics m USING (run_id) LEFT JOIN cur c USING (run_id) LEFT JOIN ov USING (run_id)", "scored", "outcome", extra=GRADE), stage=True)
def grade_runs(t):
    runs = registry.read_runs(t.spark, frozen(t)).select("run_id", "entity", "period", "score")
    current = t.norm.select("entity", "period", S("net_migration").alias("score")).filter("score IS NOT NULL")
    return rounded_all(registry.grade_runs(runs, t.panel, "rent", 3, current, bound=t.bound), GC)


INTERIM = RUNS + """,
oc AS (SELECT 'h1' AS read, entity, period, realized FROM outcome WHERE horizon=1 UNION ALL
  SELECT 'ytd', p.entity, p.period-1, p.m/nullif(q.m,0)-1 FROM (SELECT entity, year(date) AS period, avg(rent) AS m FROM monthly WHERE month(date)<=5 GROUP BY ALL) p JOIN (SELECT entity, year(date) AS period, avg(rent) AS m FROM monthly WHERE month(date)<=5 GROUP BY ALL) q ON q.entity=p.entity AND q.period=p.period-1),
ocl AS (SELECT read, period, quantile_cont(realized,0.01) AS lo, quantile_cont(realized,0.99) AS hi FROM oc GROUP BY ALL),
occ AS (SELECT read, entity, period, least(greatest(realized,lo),hi) AS realized FROM oc JOIN ocl USING (read, period) WHERE realized IS NOT NULL),
wr AS (SELECT run_id, read, period, entity, score, realized FROM runs JOIN occ USING (entity, period)),
""" + metrics_sql("wr", ["run_id", "read", "period"], clip=False)


@query("grade_interim", with_parts(f"SELECT run_id, read, period, n_entities, {rs('weighted_tau', 'precision_at_k', 'edge_pp')} FROM metrics", "scored", "outcome", "monthly", extra=INTERIM), stage=True)
def grade_interim(t):
    runs = t.scored.select(F.concat(F.lit("r"), "period").alias("run_id"), "entity", "period", "score")
    h1 = realised(t.panel, "rent", [1]).select(F.lit("h1").alias("read"), "entity", "period", "realized")
    ytd = same_months_growth(t.monthly, "rent", 5).select(F.lit("ytd").alias("read"), "entity", (S("period") - 1).alias("period"), S("ytd_growth").alias("realized"))
    return rounded_all(registry.grade_interim(runs, [h1, ytd], bound=t.bound), ["weighted_tau", "precision_at_k", "edge_pp"])


@query("content_digest", with_parts("""SELECT sum(h)::VARCHAR AS digest, count(*) AS n_rows FROM (SELECT ('0x'||substr(md5('entity'||coalesce('='||entity::VARCHAR,'~')||';period'||coalesce('='||period::VARCHAR,'~')||';rent'||coalesce('='||floor(rent)::BIGINT::VARCHAR,'~')||';'),1,15))::BIGINT AS h FROM panel)""", "panel"))
def content_digest(t):
    return registry.digest(t.panel.select("entity", "period", F.floor("rent").cast("bigint").alias("rent")))
