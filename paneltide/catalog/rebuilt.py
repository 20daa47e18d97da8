"""Queries: editions rebuilt from vintages, boundary-consistent series, the stored membership reference."""
from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.catalog.base import MODEL, comp_sql, query, r, rounded_all, with_parts, z_sql
from paneltide.catalog.build import _span
from paneltide.catalog.validate import _avg_rank
from paneltide.plans import membership, vintages as v
from paneltide.scale import staging_path

S = F.col
MEASURES = ["population", "housing_units", "net_migration", "permits_total", "total_emp", "income_pc", "rent", "home_value", "emp_hhi"]
CURRENT = {
    "net_migration": v.quotient(v.level("net_migration", 1), v.level("population", 1)),
    "job_growth": v.otherwise(v.growth("total_emp", 0), v.growth("total_emp", 1)), "income_growth": v.growth("income_pc", 1),
    "permits_to_stock": v.quotient(v.level("permits_total"), v.first_known("housing_units", (1, 2))),
    "rent_to_income": v.quotient(v.level("rent"), v.level("income_pc", 1), 12.0), "cost_to_own_vs_rent": v.quotient(v.level("home_value"), v.level("rent")),
    "trailing_rent_growth": v.growth("rent"), "employment_diversity": v.complement("emp_hhi", 1)}
VARIANTS = {"current": CURRENT, "multi_year": CURRENT | {"job_growth": v.mean_growth("total_emp", 0, 3, 2), "income_growth": v.mean_growth("income_pc", 1, 3, 2)}}

def _at(m: str, lag: int) -> str:
    return f"p{lag}.{m}" + ("*(1+0.02::DOUBLE*(b.entity%3))" if lag == 0 else "")


def _grow(m: str, lag: int) -> str:
    return f"({_at(m, lag)})/nullif({_at(m, lag + 1)},0)-1"


def _mean(m: str, lag: int) -> str:
    parts = [_grow(m, lag + i) for i in range(3)]
    n = "+".join(f"(({p}) IS NOT NULL)::INT" for p in parts)
    return f"CASE WHEN {n}>=2 THEN ({'+'.join(f'coalesce({p},0)' for p in parts)})/({n}) END"


_SQL = {"net_migration": f"{_at('net_migration', 1)}/nullif({_at('population', 1)},0)", "job_growth": f"coalesce({_grow('total_emp', 0)}, {_grow('total_emp', 1)})",
        "income_growth": _grow("income_pc", 1), "permits_to_stock": f"{_at('permits_total', 0)}/nullif(coalesce({_at('housing_units', 1)},{_at('housing_units', 2)}),0)",
        "rent_to_income": f"{_at('rent', 0)}*12/nullif({_at('income_pc', 1)},0)", "cost_to_own_vs_rent": f"{_at('home_value', 0)}/nullif({_at('rent', 0)},0)",
        "trailing_rent_growth": _grow("rent", 0), "employment_diversity": f"1-{_at('emp_hhi', 1)}"}
_MULTI = _SQL | {"job_growth": _mean("total_emp", 0), "income_growth": _mean("income_pc", 1)}
EDITIONS = ("""cuts AS (SELECT DISTINCT period AS cut FROM panel),
b AS (SELECT DISTINCT cut, entity FROM cuts JOIN panel ON period BETWEEN cut-4 AND cut),
inp AS (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS variant, b.cut, b.entity, " + ", ".join(f"{e} AS {k}" for k, e in cols.items()) + " FROM b " + " ".join(
        f"LEFT JOIN panel p{i} ON p{i}.entity=b.entity AND p{i}.period=b.cut-{i}" for i in range(5)) for n, cols in (("current", _SQL), ("multi_year", _MULTI))) + """),
vn AS (SELECT variant, cut, entity, """ + ", ".join(f"{z_sql(k, MODEL.signs[k], 'variant, cut')} AS {k}" for k in MODEL.names) + f""" FROM inp),
ed AS (SELECT variant, cut, entity, {comp_sql(MODEL.weights)} AS score FROM vn)""")


def store(t):
    """Two vintages a value: a first reading in its own period, off by up to 4 %, and the final one a period later."""
    long = t.panel.select("entity", "period", *MEASURES).unpivot(["entity", "period"], MEASURES, "measure", "final")
    first = F.struct(S("period").alias("vintage"), (S("final") * (1 + 0.02 * (S("entity") % 3))).alias("value"))
    last = F.struct((S("period") + 1).alias("vintage"), S("final").alias("value"))
    return long.select("entity", "measure", "period", F.explode(F.array(first, last)).alias("_v")).select("entity", "measure", "period", "_v.vintage", "_v.value")


def edition_scores(t):
    lo, hi = _span(t.panel)
    return v.editions(v.rebuilt(store(t), range(lo, hi + 1), VARIANTS), MODEL, 2 * t.bound)


@query("rebuilt_editions", with_parts(f"SELECT variant, cut, entity, {r('score')} FROM ed", "panel", extra=EDITIONS), stage=True)
def rebuilt_editions(t):
    return rounded_all(edition_scores(t), ["score"])


@query("variant_edition_stability", with_parts(f"SELECT variant, cut, count(*) AS n, {r('corr(ra,rb)', 'rho')}, corr(ra,rb)>=0.80 AS pass FROM (SELECT variant, cut, {_avg_rank('a', 'variant, cut')} AS ra, {_avg_rank('c', 'variant, cut')} AS rb FROM (SELECT x.variant, x.cut, x.score AS a, y.score AS c FROM ed x JOIN ed y ON y.variant=x.variant AND y.entity=x.entity AND y.cut=x.cut-1)) GROUP BY variant, cut",
                                               "panel", extra=EDITIONS), stage=True)
def variant_edition_stability(t):
    """Every pair of neighbouring rebuilt editions, of the current model and of its multi-year variant."""
    return rounded_all(v.edition_pairs(edition_scores(t), bound=t.bound), ["rho"])


NATIONS = """sp AS (SELECT min(period) AS lo, max(period) AS hi, (min(period)+max(period))//2 AS mid FROM panel),
nat AS (SELECT s_nationkey AS parent, period, sum(population) AS whole, sum(CASE WHEN entity%2=0 THEN population END) AS part FROM panel JOIN supplier ON s_suppkey=entity GROUP BY ALL),
seen AS (SELECT parent, period, whole*f AS whole, part*f AS part FROM (SELECT *, CASE WHEN period+2<=hi THEN 1.0::DOUBLE ELSE 1.1::DOUBLE END AS f FROM nat, sp))"""


@query("boundary_series", with_parts(f"SELECT parent, period, {r('value')}, base FROM (SELECT parent, period, whole AS value, 1 AS base FROM seen, sp WHERE period>=mid UNION ALL SELECT s.parent, s.period, s.part*(b.whole/nullif(b.part,0)), 0 FROM seen s, sp, seen b WHERE s.period<mid AND b.parent=s.parent AND b.period=mid AND b.part IS NOT NULL AND s.part IS NOT NULL)",
                                     "panel", extra=NATIONS), stage=True)
def boundary_series(t):
    """Totals of nations whose boundaries grow in the middle of the span, first readings revised two periods later."""
    lo, hi = _span(t.panel)
    at = (lo + hi) // 2
    rows = t.panel.join(t.nation_of_supplier(), "entity")
    total = rows.groupBy("state", "period").agg(F.sum("population").alias("1"), F.sum(F.when(S("entity") % 2 == 0, S("population"))).alias("0"))
    long = total.unpivot(["state", "period"], ["0", "1"], "base", "final").withColumn("base", S("base").cast("int"))
    long = long.filter(((S("base") == 1) & (S("period") >= at)) | ((S("base") == 0) & (S("period") <= at)))
    both = F.array(F.struct(S("period").alias("vintage"), (S("final") * 1.1).alias("value")), F.struct((S("period") + 2).alias("vintage"), S("final").alias("value")))
    held = long.select(S("state").alias("entity"), "period", "base", F.lit("population").alias("measure"), F.explode(both).alias("_v")).select(
        "entity", "period", "base", "measure", "_v.vintage", "_v.value")
    return rounded_all(v.boundary_series(held, "population", [at], hi).withColumnRenamed("entity", "parent"), ["value"])


@query("membership_lifecycle", """SELECT 1 AS step, NULL::INT AS parent, count(*) AS n_added, 0::BIGINT AS n_removed, 'WARN' AS severity, 'reference initialised' AS note FROM supplier WHERE s_suppkey%7<>0
UNION ALL SELECT 2, s_nationkey, count(CASE WHEN s_suppkey%7=0 THEN 1 END), count(CASE WHEN s_suppkey%5=0 THEN 1 END), CASE WHEN s_nationkey<12 THEN 'BLOCKER' ELSE 'WARN' END, 'membership changed' FROM supplier
  WHERE (s_suppkey%7=0)<>(s_suppkey%5=0) GROUP BY s_nationkey""")
def membership_lifecycle(t):
    """A first run, a run on changed membership, its acceptance, and a run that has nothing to say."""
    root = staging_path(t.spark, "membership")
    m = t.supplier.select(S("s_nationkey").alias("parent"), S("s_suppkey").alias("child"))
    first, later = m.filter("child % 7 <> 0"), m.filter("child % 5 <> 0")
    universe = t.nation.filter("n_nationkey < 12").select(S("n_nationkey").alias("parent"))
    steps = [membership.check(first, root, universe, "1"), membership.check(later, root, universe, "2")]
    membership.accept(later, root, 1, "2")
    steps.append(membership.check(later, root, universe, "3"))
    out = None
    for i, one in enumerate(steps):
        part = one.withColumn("step", F.lit(i + 1))
        out = part if out is None else out.unionByName(part)
    return out
