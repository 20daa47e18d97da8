"""Shared inputs of the registered queries: stand-in panels on the given tables, and their SQL.

The supplier-year panel plays the main panel (complete), the customer-year panel the gappy one.
Column names follow the default model, so its declarations apply unchanged.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.functions.scalar import col, ratio
from paneltide.operators.match import with_dimension
from paneltide.operators.rollup import concentration
from paneltide.plans.model import RENT_MODEL as MODEL
from paneltide.plans.scoring import indicators, normalised, scored
from paneltide.scale import staged

REGIMES = {"early": (1995, 1997), "middle": (1998, 1999), "late": (2000, 2099)}
HORIZONS = (1, 2, 3)
WIDE = 1 << 40  # a declared bound that makes an operator take its split plan
MEASURES = ["population", "housing_units", "net_migration", "permits_total", "permits_mf", "total_emp",
            "income_pc", "avg_pay", "rent", "home_value", "emp_hhi"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_ROWS: dict[str, int] = {}


def query(name: str, sql: str | None = None, stage: bool = False):
    """Register ``fn(t)`` under a name, with the SQL that must give the same rows.

    ``stage``: the panel and the scores are used several times, so write them first.
    """
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder).stage() if stage else Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Row count of a table (answered from file footers): bounds the entities of one period."""
        key = f"{self.folder}/{name}"
        if key not in _ROWS:
            _ROWS[key] = getattr(self, name).count()
        return _ROWS[key]

    @cached_property
    def bound(self) -> int:
        return self.rows("supplier")

    def _panel(self, fact: DataFrame) -> DataFrame:
        """One scan, summed map-side to cells, then to (entity, period).

        The cells of an entity are few, so they move once, on the entity alone: the second sum and
        every later window over the entity's history find their rows in place.
        """
        signed = F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).when(
            F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(0.0)
        cells = fact.groupBy("entity", F.year("l_shipdate").alias("period"), F.col("l_linenumber").alias("cell")).agg(
            F.sum("l_quantity").alias("q"), F.sum(signed).alias("flow"), F.count(F.lit(1)).cast("double").alias("n"),
            F.sum("l_extendedprice").alias("ext"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"),
            F.sum(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
            F.sum(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)).alias("open_n"))
        total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0.0))
        return cells.repartition("entity").groupBy("entity", "period").agg(
            F.sum("q").alias("population"), F.sum("n").alias("housing_units"), F.sum("flow").alias("net_migration"),
            total(F.col("cell") <= 2).alias("permits_total"), total(F.col("cell") >= 5).alias("permits_mf"),
            F.sum("open_n").alias("total_emp"), ratio(F.sum("rev"), F.sum("q")).alias("income_pc"),
            ratio(F.sum("rev"), F.sum("n")).alias("avg_pay"), ratio(F.sum("unit"), F.sum("n")).alias("rent"),
            ratio(F.sum("ext"), F.sum("n")).alias("home_value"), concentration("rev").alias("emp_hhi"))

    def rated(self, panel: DataFrame) -> DataFrame:
        """The panel with the national rate of each period, a dimension joined without moving the panel."""
        rate = self.lineitem.groupBy(F.year("l_shipdate").alias("period")).agg((F.avg("l_tax") * 100.0).alias("mortgage_rate"))
        return with_dimension(panel, rate, ["period"])

    FACT = ["l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]

    @cached_property
    def panel(self) -> DataFrame:
        return self._panel(self.lineitem.select(F.col("l_suppkey").alias("entity"), *self.FACT))

    @cached_property
    def customer_panel(self) -> DataFrame:
        """Customer by year of shipment: not every customer buys every year."""
        li = self.lineitem.select("l_orderkey", *self.FACT)
        o = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity"))
        return self._panel(li.join(o, "l_orderkey").drop("l_orderkey"))

    @cached_property
    def ind(self) -> DataFrame:
        return indicators(self.rated(self.panel), MODEL)

    @cached_property
    def norm(self) -> DataFrame:
        return normalised(self.ind, MODEL, self.bound)

    def stage(self) -> Tables:
        """For queries that use the panel and the scores many times: each is computed once."""
        self.panel = staged(self.panel, "panel")
        self.norm = staged(self.norm, "norm")
        return self

    @cached_property
    def scored(self) -> DataFrame:
        return scored(self.norm, MODEL, self.bound)

    @cached_property
    def monthly(self) -> DataFrame:
        """Supplier by month."""
        li = self.lineitem
        return li.groupBy(F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "month").alias("date")).agg(
            F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("rent"), F.avg("l_extendedprice").alias("home_value"),
            F.sum("l_quantity").alias("jobs"), F.count(F.lit(1)).cast("double").alias("units"))

    def nation_of_supplier(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("state"))


# ---- SQL of the same inputs ------------------------------------------------------------------

def _panel_sql(name: str, source: str, entity: str) -> str:
    return f"""
{name}_cells AS (SELECT {entity} AS entity, year(l_shipdate) AS period, l_linenumber AS cell, sum(l_quantity) AS q,
  sum(CASE l_returnflag WHEN 'N' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0.0 END) AS flow,
  count(*)::DOUBLE AS n, sum(l_extendedprice) AS ext, sum(l_extendedprice*(1-l_discount)) AS rev,
  sum(l_extendedprice/l_quantity) AS unit, sum(l_tax) AS tax,
  sum(CASE WHEN l_linestatus='O' THEN 1.0::DOUBLE ELSE 0 END) AS open_n FROM {source} GROUP BY ALL),
{name}_base AS (SELECT entity, period, sum(q) AS population, sum(n) AS housing_units, sum(flow) AS net_migration,
  sum(CASE WHEN cell<=2 THEN n ELSE 0 END) AS permits_total, sum(CASE WHEN cell>=5 THEN n ELSE 0 END) AS permits_mf,
  sum(open_n) AS total_emp, sum(rev)/nullif(sum(q),0) AS income_pc, sum(rev)/nullif(sum(n),0) AS avg_pay,
  sum(unit)/nullif(sum(n),0) AS rent, sum(ext)/nullif(sum(n),0) AS home_value,
  sum(CASE WHEN rev>0 THEN rev*rev END)/nullif(pow(sum(CASE WHEN rev>0 THEN rev END),2),0) AS emp_hhi, sum(tax) AS tax
  FROM {name}_cells GROUP BY entity, period),
{name} AS (SELECT b.* EXCLUDE (tax), r.mortgage_rate FROM {name}_base b JOIN
  (SELECT period, sum(tax)*100/nullif(sum(housing_units),0) AS mortgage_rate FROM {name}_base GROUP BY period) r USING (period))"""


def _ind_sql() -> str:
    return """
ind AS (SELECT p.entity, p.period, p.net_migration/nullif(p.population,0) AS net_migration,
  p.total_emp/nullif(q.total_emp,0)-1 AS job_growth, p.income_pc/nullif(q.income_pc,0)-1 AS income_growth,
  p.permits_total/nullif(p.housing_units,0) AS permits_to_stock, p.rent/nullif(p.income_pc,0)*12 AS rent_to_income,
  p.home_value*(p.mortgage_rate/1200)*pow(1+p.mortgage_rate/1200,360)/(pow(1+p.mortgage_rate/1200,360)-1)/nullif(p.rent,0) AS cost_to_own_vs_rent,
  p.rent/nullif(q.rent,0)-1 AS trailing_rent_growth, 1-p.emp_hhi AS employment_diversity
  FROM panel p LEFT JOIN panel q ON q.entity=p.entity AND q.period=p.period-1)"""


def z_sql(col: str, sign: int = 1, part: str = "period", sample: bool = False) -> str:
    std = f"{'stddev_samp' if sample else 'stddev_pop'}({col}) OVER (PARTITION BY {part})"
    z = f"({col}-avg({col}) OVER (PARTITION BY {part}))/nullif({std},0)"
    z = z if sample else f"CASE WHEN {std}=0 THEN 0 ELSE {z} END"
    return f"({sign})*({z})"


def norm_sql(source: str = "ind", name: str = "norm") -> str:
    cols = ", ".join(f"{z_sql(k, MODEL.signs[k])} AS {k}" for k in MODEL.names)
    return f"{name} AS (SELECT entity, period, {cols} FROM {source})"


def comp_sql(weights: dict[str, float], prefix: str = "") -> str:
    return "(" + "+".join(f"{w!r}*coalesce({prefix}{k},0)" for k, w in weights.items()) + ")"


def scored_sql(source: str = "norm", name: str = "scored") -> str:
    n = "+".join(f"({k} IS NOT NULL)::INT" for k in MODEL.names)
    buckets = ", ".join(f"{comp_sql({k: MODEL.weights[k] for k in ks})} AS bucket_{b}" for b, ks in MODEL.buckets.items())
    return (f"{name} AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY score DESC)::INT AS rank FROM "
            f"(SELECT entity, period, {n} AS n_indicators, {comp_sql(MODEL.weights)} AS score, {buckets} FROM {source}))")


PARTS = {
    "panel": _panel_sql("panel", "lineitem", "l_suppkey"),
    "customer_panel": _panel_sql("customer_panel", "(SELECT * FROM lineitem JOIN orders ON l_orderkey=o_orderkey)", "o_custkey"),
    "ind": _ind_sql(), "norm": norm_sql(), "scored": scored_sql(),
    "usable": "usable AS (SELECT period FROM scored GROUP BY period HAVING median(n_indicators)>=8)",
    "outcome": """outcome AS (SELECT h.horizon, a.entity, a.period, b.rent/a.rent-1 AS realized FROM panel a
  CROSS JOIN (VALUES (1),(2),(3)) h(horizon) JOIN panel b ON b.entity=a.entity AND b.period=a.period+h.horizon WHERE a.rent>0)""",
    "monthly": """monthly AS (SELECT l_suppkey AS entity, date_trunc('month', l_shipdate)::DATE AS date,
  avg(l_extendedprice/l_quantity) AS rent, avg(l_extendedprice) AS home_value, sum(l_quantity) AS jobs,
  count(*)::DOUBLE AS units FROM lineitem GROUP BY 1,2)""",
}
NEEDS = {"ind": ["panel"], "norm": ["panel", "ind"], "scored": ["panel", "ind", "norm"],
         "usable": ["panel", "ind", "norm", "scored"], "outcome": ["panel"]}


def with_parts(select: str, *parts: str, extra: str = "") -> str:
    """WITH clause of the named shared parts (and what they need) plus extra CTE text, then the select."""
    wanted: list[str] = []
    for p in parts:
        for q in [*NEEDS.get(p, []), p]:
            if q not in wanted:
                wanted.append(q)
    ctes = [PARTS[p] for p in wanted] + ([extra] if extra else [])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select


def nudge(digits: int) -> float:
    """Decimal means often end exactly halfway; this puts such ties on one side in both engines."""
    return float(f"1.3e-{digits + 3}")


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(col(c).cast("double") + F.lit(nudge(digits)), digits) + F.lit(0.0)


def rounded_all(df: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names})


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE+{nudge(digits)!r}::DOUBLE,{digits})+0.0 AS {name or expr}"


def rs(*names: str, digits: int = 6, prefix: str = "") -> str:
    return ", ".join(r(f"{prefix}{n}", n, digits) for n in names)


def regime_sql(c: str = "period") -> str:
    whens = " ".join(f"WHEN {c} BETWEEN {lo} AND {hi} THEN '{n}'" for n, (lo, hi) in REGIMES.items())
    return f"CASE {whens} ELSE 'unknown' END"


def tau_sql(src: str, name: str, g: list[str], copies: str | None = None, at_least: int = 0) -> str:
    """CTE ``name``(g..., tau, n): brute-force pair sums, the definition itself."""
    gl = ", ".join(g)
    eq = " AND ".join(f"a.{c}=b.{c}" for c in g)
    m = copies or "1"
    start = f"(sum({m}) OVER (PARTITION BY {gl} ORDER BY realized DESC, entity)-{m})"
    placed = f"(SELECT {gl}, entity, score, realized, ({m})::BIGINT AS m, ({start})::BIGINT AS s FROM {src})"
    weighed = f"SELECT *, 1.0::DOUBLE/(s+1) AS w FROM {placed}" if copies is None else (
        f"SELECT {gl}, entity, score, realized, m, s, sum(1.0::DOUBLE/(s+k)) AS w FROM {placed} JOIN range(1,200) kk(k) ON k<=m GROUP BY ALL")
    return f"""
{name}_w AS ({weighed}),
{name}_n AS (SELECT {gl}, sum(m)::BIGINT AS n FROM {name}_w GROUP BY {gl}),
{name}_p AS (SELECT {', '.join('a.' + c for c in g)}, (a.w*b.m+b.w*a.m) AS pw, sign(a.score-b.score) AS sx, sign(a.realized-b.realized) AS sy
  FROM {name}_w a JOIN {name}_w b ON {eq} AND a.entity<b.entity),
{name} AS (SELECT {gl}, n, sum(pw*sx*sy)/nullif(sqrt(sum(pw*abs(sx))*sum(pw*abs(sy))),0) AS tau
  FROM {name}_p JOIN {name}_n USING ({gl}) WHERE n>={at_least} GROUP BY {gl}, n)"""


def metrics_sql(src: str, g: list[str], k: int = 10, clip: bool = True, name: str = "metrics") -> str:
    """CTEs up to ``name``(g..., n_entities, weighted_tau, precision_at_k, edge_pp)."""
    gl = ", ".join(g)
    value = "least(greatest(realized,lo),hi)" if clip else "realized"
    return f"""
{name}_lim AS (SELECT {gl}, quantile_cont(realized,0.01) AS lo, quantile_cont(realized,0.99) AS hi FROM {src} GROUP BY {gl} HAVING count(*)>=10),
{name}_c AS (SELECT {gl}, entity, score, {value} AS realized FROM {src} JOIN {name}_lim USING ({gl})),
{tau_sql(name + '_c', name + '_t', g)},
{name}_q AS (SELECT {gl}, quantile_cont(realized,0.75) AS cut, median(realized) AS mid, count(*) AS n_entities FROM {name}_c GROUP BY {gl}),
{name}_k AS (SELECT {gl}, avg((realized>=cut)::INT) AS hits, avg(realized) AS best FROM (
  SELECT *, row_number() OVER (PARTITION BY {gl} ORDER BY score DESC, entity) AS place FROM {name}_c JOIN {name}_q USING ({gl})) WHERE place<={k} GROUP BY {gl}),
{name} AS (SELECT {gl}, n_entities, tau AS weighted_tau, CASE WHEN n_entities>={k} THEN hits END AS precision_at_k, (best-mid)*100 AS edge_pp
  FROM {name}_q JOIN {name}_k USING ({gl}) LEFT JOIN {name}_t USING ({gl}))"""


def strategies_sql(scores: dict[str, str], source: str = "norm", name: str = "ranked") -> str:
    one = " UNION ALL ".join(f"SELECT '{n}' AS strategy, entity, period, ({e})::DOUBLE AS score FROM {source}" for n, e in scores.items())
    return f"{name} AS ({one})"


WF = "wf AS (SELECT strategy, horizon, period, entity, score, realized FROM ranked JOIN outcome USING (entity, period) WHERE score IS NOT NULL AND period IN (SELECT period FROM usable))"


def metrics_select(g: str = "strategy, horizon, period", name: str = "metrics") -> str:
    return f"SELECT {g}, n_entities, {rs('weighted_tau','precision_at_k','edge_pp')} FROM {name}"


def summary_sql(src: str = "metrics", keys: str = "strategy, horizon") -> str:
    return f"""summ AS (SELECT {keys}, coalesce(regime,'POOLED') AS regime, count(*) AS n_windows, avg(weighted_tau) AS mean_tau,
  avg(precision_at_k) AS mean_precision FROM (SELECT *, {regime_sql()} AS regime FROM {src}) GROUP BY GROUPING SETS (({keys}, regime),({keys})))"""
