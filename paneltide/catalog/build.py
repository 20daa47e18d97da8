"""Queries: scans, reshaping, cleaning, joins, roll-ups and time shifts.

Scan queries first land files of the wanted shape, derived from the given tables, in the shared
folder, and then read them back.
"""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.catalog.base import MEASURES, WIDE, query, r, rounded, rounded_all, rs, with_parts
from paneltide.functions.scalar import annuity_payment, interval_name, present_count, present_mean, primary_state, ratio
from paneltide.operators import clean, growth, match, reshape, rollup
from paneltide.operators.order import latest_per_group
from paneltide.scale import staged, staging_path
from paneltide.sources import readers, sinks

S = F.col


def land_csv(t, df, name, header=True, **options):
    path = staging_path(t.spark, name)
    df.write.option("header", header).options(**options).csv(path)
    return path


def land_text(t, lines, name, by=None):
    path = staging_path(t.spark, name)
    writer = lines.repartition(by).write.partitionBy(by) if by else lines.write
    writer.text(path)
    return path


# ---- scans -------------------------------------------------------------------------------------

@query("scan_delimited_latin1", "SELECT lpad(s_nationkey::VARCHAR,2,'0') AS state, lpad((s_suppkey%1000)::VARCHAR,3,'0') AS county, s_name||'é' AS name, round(s_acctbal,2) AS balance FROM supplier")
def scan_delimited_latin1(t):
    src = t.supplier.select(F.lpad(S("s_nationkey").cast("string"), 2, "0").alias("state"), F.lpad((S("s_suppkey") % 1000).cast("string"), 3, "0").alias("county"),
                            F.concat("s_name", F.lit("é")).alias("name"), F.round("s_acctbal", 2).alias("balance"))
    path = land_csv(t, src, "latin1", encoding="ISO-8859-1")
    schema = T.StructType([*readers.text_schema(["state", "county", "name"]).fields, T.StructField("balance", T.DoubleType())])
    return readers.read_delimited(t.spark, path, schema, "ISO-8859-1")


QUARTERS = """quarters AS (SELECT entity, period, quarter, CASE WHEN (entity+quarter+period)%5<>0 THEN round(v,2) END AS hpi FROM
  (SELECT l_suppkey AS entity, year(l_shipdate) AS period, quarter(l_shipdate) AS quarter, sum(l_quantity) AS v FROM lineitem GROUP BY 1,2,3))"""


def _quarters(t):
    q = t.lineitem.groupBy(S("l_suppkey").alias("entity"), F.year("l_shipdate").alias("period"), F.quarter("l_shipdate").alias("quarter")).agg(F.sum("l_quantity").alias("v"))
    keep = (S("entity") + S("quarter") + S("period")) % 5 != 0
    text = q.select(F.concat(F.lit("Area "), "entity").alias("name"), S("entity").cast("string"), S("period").cast("string"), S("quarter").cast("string"),
                    F.when(keep, F.round("v", 2).cast("string")).otherwise("-").alias("hpi"))
    path = land_csv(t, text, "quarters", header=False)
    got = readers.read_headerless(t.spark, path, ["name", "entity", "period", "quarter", "hpi"], ["hpi"])
    return got.select(S("entity").cast("bigint"), S("period").cast("int"), S("quarter").cast("int"), "hpi")


@query("scan_headerless_missing", "WITH " + QUARTERS + " SELECT * FROM quarters")
def scan_headerless_missing(t):
    return _quarters(t)


@query("complete_quarters", "WITH " + QUARTERS + f" SELECT entity, period, {r('avg(hpi)', 'hpi')} FROM quarters WHERE hpi IS NOT NULL GROUP BY ALL HAVING count(DISTINCT quarter)=4")
def complete_quarters(t):
    return rounded_all(rollup.complete_periods(_quarters(t), ["entity", "period"], "hpi", "quarter", 4), ["hpi"])


@query("scan_positional", "SELECT s_nationkey::VARCHAR AS state, s_suppkey::VARCHAR AS county, (1+2+s_suppkey%7+4)::DOUBLE AS units, (s_suppkey%7)::DOUBLE AS reported FROM supplier")
def scan_positional(t):
    row = F.concat_ws(",", S("s_nationkey").cast("string"), S("s_suppkey").cast("string"), F.lit("x"), F.lit("1"), F.lit("2"), (S("s_suppkey") % 7).cast("string"), F.lit(" 4 "))
    preamble = t.region.filter("r_regionkey < 3").select(F.concat(F.lit("Preamble,line,"), "r_name").alias("value"))
    path = land_text(t, preamble.unionByName(t.supplier.select(row.alias("value"))), "positional")
    return readers.read_positional(t.spark, path, 7, {"state": 0, "county": 1}, {"units": [3, 4, 5, 6], "reported": [5]})


NATION_YEAR = """ny AS (SELECT s_nationkey AS nation, year(l_shipdate) AS period, count(*) AS n, round(sum(l_quantity),0) AS q FROM lineitem JOIN supplier ON s_suppkey=l_suppkey GROUP BY ALL)"""


def _nation_year(t):
    s = t.supplier.select(S("s_suppkey").alias("l_suppkey"), S("s_nationkey").alias("nation"))
    return t.lineitem.join(s, "l_suppkey").groupBy("nation", F.year("l_shipdate").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 0).alias("q"))


MATRIX = "WITH " + NATION_YEAR + " SELECT 'Nation '||nation AS area_name, nation::VARCHAR AS code, CASE WHEN nation%6<>0 THEN n::DOUBLE END AS n FROM ny"
RECORDS = "WITH " + NATION_YEAR + " SELECT lpad((nation%5)::VARCHAR,2,'0')||lpad((nation%4)::VARCHAR,3,'0') AS area, 'Nation '||nation AS area_name, period::VARCHAR AS period, CASE WHEN nation%6<>0 THEN q END AS value FROM ny WHERE nation%4<>0"


def _matrix(t, lines):
    # One document per year; its rows are nations, a dimension of fixed size.
    cells = F.array(F.concat(F.lit("Nation "), "nation"), F.when(S("nation") % 6 != 0, S("n").cast("string")).otherwise("N/A"), S("nation").cast("string"))
    docs = _nation_year(t).groupBy("period").agg(F.collect_list(cells).alias("rows"))
    doc = docs.select("period", F.to_json(F.concat(F.array(F.array(F.lit("NAME"), F.lit("B01"), F.lit("geo"))), "rows")).alias("value"))
    if lines:
        doc = doc.withColumn("value", F.replace("value", F.lit("],["), F.lit("],\n[")))
    got = readers.read_json_matrix(t.spark, land_text(t, doc, "matrix", "period"), ["NAME", "geo", "B01"], ["B01"], lines)
    return got.select(S("NAME").alias("area_name"), S("geo").alias("code"), S("B01").alias("n"))


@query("scan_json_matrix", MATRIX)
def scan_json_matrix(t):
    return _matrix(t, False)


@query("scan_json_matrix_lines", MATRIX)
def scan_json_matrix_lines(t):
    return _matrix(t, True)


def _records(t, lines):
    rec = F.struct(F.concat(F.lpad((S("nation") % 5).cast("string"), 2, "0"), F.lpad((S("nation") % 4).cast("string"), 3, "0")).alias("GeoFips"),
                   F.concat(F.lit("Nation "), "nation").alias("GeoName"), S("period").cast("string").alias("TimePeriod"),
                   F.when(S("nation") % 6 != 0, F.format_number("q", 0)).otherwise("(NA)").alias("DataValue"))
    docs = _nation_year(t).groupBy("period").agg(F.collect_list(rec).alias("rows")).select("period", F.to_json("rows").alias("value"))
    if lines:
        docs = docs.withColumn("value", F.replace("value", F.lit("},{"), F.lit("},\n{")))
    return readers.read_json_records(t.spark, land_text(t, docs, "records", "period"), lines=lines)


@query("scan_json_records", RECORDS)
def scan_json_records(t):
    return _records(t, False)


@query("scan_json_records_lines", RECORDS)
def scan_json_records_lines(t):
    return _records(t, True)


@query("scan_padded_tsv", "SELECT s_suppkey::VARCHAR AS \"GEOID\", s_acctbal AS \"LAT\", s_nationkey::DOUBLE AS \"LONG\" FROM supplier")
def scan_padded_tsv(t):
    src = t.supplier.select(S("s_suppkey").cast("string").alias("GEOID"), S("s_acctbal").cast("string").alias("LAT"), S("s_nationkey").cast("string").alias("LONG          "))
    path = land_csv(t, src, "padded", sep="\t", ignoreTrailingWhiteSpace=False)
    return readers.read_padded_tsv(t.spark, path, {"GEOID": "string", "LAT": "double", "LONG": "double"})


@query("scan_area_year_files", "WITH " + NATION_YEAR + " SELECT n, q, 'N'||nation AS area, period FROM ny")
def scan_area_year_files(t):
    src = _nation_year(t).select("n", "q", F.concat(F.lit("N"), "nation", F.lit("_"), "period", F.lit(".csv")).alias("file"))
    path = staging_path(t.spark, "area-year")
    src.repartition("file").write.partitionBy("file").option("header", True).csv(path)
    return readers.read_area_year_files(t.spark, path, T.StructType([T.StructField("n", T.LongType()), T.StructField("q", T.DoubleType())]))


RATES = "rates AS (SELECT 'RATE'||(s_nationkey%3) AS series_id, l_shipdate::DATE AS date, round(avg(l_tax*100),6) AS value FROM lineitem JOIN supplier ON s_suppkey=l_suppkey GROUP BY ALL)"


def _series(t):
    s = t.supplier.select(S("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rates = t.lineitem.join(s, "l_suppkey").groupBy(F.concat(F.lit("RATE"), S("s_nationkey") % 3, F.lit(".csv")).alias("file"), F.to_date("l_shipdate").alias("date")).agg(
        F.round(F.avg(S("l_tax") * 100), 6).cast("string").alias("value"))
    gap = rates.select("file").distinct().select("file", F.lit("1990-01-01").cast("date").alias("date"), F.lit(".").alias("value"))
    path = staging_path(t.spark, "series")
    rates.unionByName(gap).repartition("file").write.partitionBy("file").option("header", True).csv(path)
    return readers.read_series_files(t.spark, path)


@query("scan_series_files", "WITH " + RATES + f" SELECT series_id, year(date) AS period, count(*) AS n_obs, {r('avg(value)', 'value')} FROM rates GROUP BY ALL")
def scan_series_files(t):
    g = _series(t).groupBy("series_id", F.year("date").alias("period")).agg(F.count("value").alias("n_obs"), F.avg("value").alias("value"))
    return rounded_all(g, ["value"])


@query("collapse_last", f"SELECT user_id, year(ts) AS period, {r('arg_max(value, ts)', 'value')} FROM events GROUP BY ALL")
def collapse_last(t):
    return rounded_all(rollup.collapse(t.events, ["user_id"], "ts", "value", "last"), ["value"])


@query("collapse_mean", f"SELECT user_id, year(ts) AS period, {r('avg(value)', 'value')} FROM events GROUP BY ALL")
def collapse_mean(t):
    return rounded_all(rollup.collapse(t.events, ["user_id"], "ts", "value", "mean"), ["value"])


def _span(panel):
    """First and last period of a panel."""
    return tuple(panel.agg(F.min("period"), F.max("period")).first())


SPAN = "(SELECT unnest(range(min(period),max(period)+1)) AS y FROM {})"


def _wide(t):
    m = t.monthly.select(S("entity").cast("string").alias("region_id"), F.date_format("date", "yyyy-MM-dd").alias("month"), rounded("rent", 4).alias("v"))
    months = [x["month"] for x in m.select("month").distinct().orderBy("month").collect()]  # one value a calendar month
    return readers.read_wide_monthly(t.spark, land_csv(t, reshape.pivot_first(m, ["region_id"], "month", "v", months), "wide"))


@query("unpivot_wide_monthly", with_parts(f"SELECT entity::VARCHAR AS region_id, date, {r('rent', 'value', 4)} FROM monthly", "monthly"))
def unpivot_wide_monthly(t):
    return reshape.unpivot_dates(_wide(t), ["region_id"])


@query("annual_mean_min_obs", with_parts(f"SELECT * FROM (SELECT region_id, period, {r('avg(rent)', 'value')}, count(*) AS n_obs FROM (SELECT entity::VARCHAR AS region_id, year(date) AS period, {r('rent', 'rent', 4)} FROM monthly) GROUP BY 1,2) WHERE n_obs>=11 AND period>=1996", "monthly"))
def annual_mean_min_obs(t):
    long = reshape.unpivot_dates(_wide(t), ["region_id"])
    return rounded_all(rollup.period_mean(long, ["region_id"], "date", "value", 11, 1996), ["value"])


@query("scan_bridge", "SELECT lpad(s_nationkey::VARCHAR,2,'0')||lpad((s_suppkey%1000)::VARCHAR,3,'0') AS child, 'P'||s_nationkey AS parent, 'Parent '||s_nationkey AS parent_title FROM supplier WHERE s_suppkey%3<>0")
def scan_bridge(t):
    kind = F.when(S("s_suppkey") % 3 != 0, "Metropolitan Area").otherwise("Micropolitan Area")
    rows = t.supplier.select(S("s_nationkey").cast("string").alias("st"), (S("s_suppkey") % 1000).cast("string").alias("ct"), F.concat(F.lit("P"), "s_nationkey").alias("parent"),
                             F.concat(F.lit("Parent "), "s_nationkey").alias("title"), kind.alias("kind"))
    notes = t.region.select(F.concat(F.lit("Note "), "r_name").alias("st"), *[F.lit(None).cast("string").alias(c) for c in ("ct", "parent", "title", "kind")])
    return readers.read_bridge(t.spark, land_csv(t, rows.unionByName(notes), "bridge"), ["st", "ct", "parent", "title", "kind"], "st", "ct", "parent", "title", "kind")


@query("table_round_trip", with_parts(f"SELECT entity, period, {rs('rent', 'home_value', digits=4)} FROM panel WHERE period>=1998", "panel"))
def table_round_trip(t):
    path = staging_path(t.spark, "panel")
    sinks.write_table(t.panel, path, partition_by=["period"])
    got = readers.read_columns(t.spark, path, ["entity", "period", "rent", "home_value"]).filter("period >= 1998")
    return rounded_all(got, ["rent", "home_value"], 4)


@query("csv_sink", with_parts(f"SELECT entity, period, {rs('rent', digits=4)} FROM panel", "panel"))
def csv_sink(t):
    path = staging_path(t.spark, "panel-csv")
    sinks.write_table(rounded_all(t.panel.select("entity", "period", "rent"), ["rent"], 4), path, "csv")
    return readers.read_delimited(t.spark, path, T.StructType([T.StructField("entity", T.LongType()), T.StructField("period", T.IntegerType()), T.StructField("rent", T.DoubleType())]))


@query("append_sink", "SELECT l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def append_sink(t):
    path = staging_path(t.spark, "index")
    open_ = S("l_returnflag").eqNullSafe("N")
    for part in (open_, ~open_):
        sinks.append_rows(t.lineitem.filter(part).groupBy(S("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n")), path)
    return readers.read_columns(t.spark, path, ["kind", "n"])


# ---- reshape -----------------------------------------------------------------------------------

@query("unpivot_family", "SELECT s_suppkey AS entity, p AS period, s_acctbal+p AS pop FROM supplier, (VALUES (2020),(2022)) v(p)")
def unpivot_family(t):
    wide = t.supplier.select(S("s_suppkey").alias("entity"), (S("s_acctbal") + 2020).alias("POP2020"), (S("s_acctbal") + 2022).alias("POP2022"))
    return reshape.unpivot_family(wide, ["entity"], "POP", "pop")


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("pivot_mean", "SELECT user_id, " + ", ".join(r(f"avg(value) FILTER (event_type='{k}')", k) for k in KINDS) + " FROM events GROUP BY user_id")
def pivot_mean(t):
    return rounded_all(reshape.pivot_mean(t.events, ["user_id"], "event_type", "value", KINDS), KINDS)


@query("pivot_periods", with_parts(f"SELECT * FROM (PIVOT (SELECT entity, 'y'||period AS p, {r('rent', 'rent')} FROM customer_panel) ON p USING max(rent) GROUP BY entity)", "customer_panel"))
def pivot_periods(t):
    p = reshape.pivot_first(t.customer_panel, ["entity"], "period", "rent")
    return p.select("entity", *[rounded(c).alias(f"y{c}") for c in p.columns[1:]])


@query("golden_long", with_parts(" UNION ALL ".join(f"SELECT entity, period, '{c}' AS \"column\", {r(c, 'value', 3)} FROM panel" for c in MEASURES), "panel"))
def golden_long(t):
    return rounded_all(reshape.golden_long(t.panel, ["entity", "period"], MEASURES), ["value"], 3)


@query("stack_periods", with_parts(f"SELECT entity, period, {rs('rent')} FROM panel", "panel"))
def stack_periods(t):
    lo, hi = _span(t.panel)
    return rounded_all(reshape.stack([t.panel.filter(S("period") == y).select("entity", "period", "rent") for y in range(lo, hi + 1)]), ["rent"])


@query("panel_spine", with_parts(f"SELECT c.c_custkey AS entity, y::INT AS period, {r('p.rent', 'rent')} FROM customer c CROSS JOIN {SPAN.format('customer_panel')} s(y) LEFT JOIN customer_panel p ON p.entity=c.c_custkey AND p.period=y", "customer_panel"))
def panel_spine(t):
    grid = reshape.spine(t.customer.select(S("c_custkey").alias("entity")), *_span(t.customer_panel))
    return rounded_all(match.star_join(grid, [t.customer_panel.select("entity", "period", "rent")]), ["rent"])


STAR = """vol AS (SELECT o_custkey AS entity, year(o_orderdate) AS period, count(*) AS n_orders FROM orders GROUP BY ALL),
val AS (SELECT o_custkey AS entity, year(o_orderdate) AS period, max(o_totalprice) AS top_order FROM orders WHERE o_orderstatus='O' GROUP BY ALL)"""


@query("star_join", with_parts(f"SELECT c.c_custkey AS entity, y::INT AS period, {r('p.rent', 'rent')}, v.n_orders, w.top_order FROM customer c CROSS JOIN {SPAN.format('customer_panel')} s(y) LEFT JOIN customer_panel p ON p.entity=c.c_custkey AND p.period=y "
                               "LEFT JOIN vol v ON v.entity=c.c_custkey AND v.period=y LEFT JOIN val w ON w.entity=c.c_custkey AND w.period=y", "customer_panel", extra=STAR))
def star_join(t):
    grid = reshape.spine(t.customer.select(S("c_custkey").alias("entity")), *_span(t.customer_panel))
    key = [S("o_custkey").alias("entity"), F.year("o_orderdate").alias("period")]
    vol = t.orders.groupBy(*key).agg(F.count(F.lit(1)).alias("n_orders"))
    val = t.orders.filter("o_orderstatus = 'O'").groupBy(*key).agg(F.max("o_totalprice").alias("top_order"))
    return rounded_all(match.star_join(grid, [t.customer_panel.select("entity", "period", "rent"), vol, val]), ["rent"])


@query("scalar_functions", """SELECT event_id, (strftime(ts,'%Y%m%d')::INT // 10000)::INT AS year_part, strftime(ts,'%Y')||'Q'||quarter(ts) LIKE '%Q1' AS first_quarter, greatest(least(round(value,1),20.0::DOUBLE),1.0::DOUBLE)+0.0 AS clipped,
  round(sqrt(abs(value)),6)+0.0 AS root, lower(event_type) AS kind, (props->>'k')::INT AS k, strftime(ts + INTERVAL 12 MONTH,'%Y-%m') AS next_year FROM events""")
def scalar_functions(t):
    day = F.date_format("ts", "yyyyMMdd").cast("int")
    return t.events.select(
        "event_id", F.expr("int(date_format(ts, 'yyyyMMdd')) div 10000").cast("int").alias("year_part"),
        F.concat(F.date_format("ts", "yyyy"), F.lit("Q"), F.quarter("ts")).endswith("Q1").alias("first_quarter"),
        (F.greatest(F.least(F.round("value", 1), F.lit(20.0)), F.lit(1.0)) + 0.0).alias("clipped"), (F.round(F.sqrt(F.abs("value")), 6) + 0.0).alias("root"),
        F.lower("event_type").alias("kind"), F.from_json("props", "k int")["k"].alias("k"),
        F.date_format(F.add_months(F.to_date(day.cast("string"), "yyyyMMdd"), 12), "yyyy-MM").alias("next_year"))


@query("row_means", with_parts(f"""SELECT entity, period, {r('CASE WHEN n>=1 THEN s/n END', 'mean_any')}, {r('CASE WHEN n>=2 THEN s/n END', 'mean_two')}, n AS n_present FROM (SELECT entity, period,
  (job_growth IS NOT NULL)::INT+(income_growth IS NOT NULL)::INT+(permits_to_stock IS NOT NULL)::INT AS n, coalesce(job_growth,0)+coalesce(income_growth,0)+coalesce(permits_to_stock,0) AS s FROM ind)""", "ind"))
def row_means(t):
    cols = ["job_growth", "income_growth", "permits_to_stock"]
    return t.ind.select("entity", "period", rounded(present_mean(cols)).alias("mean_any"), rounded(present_mean(cols, 2)).alias("mean_two"), present_count(cols).alias("n_present"))


# ---- filters and cleaning ----------------------------------------------------------------------

@query("gap_free_entities", with_parts("SELECT entity, min(period) AS first_period, max(period) AS last_period, count(DISTINCT period) AS n_periods FROM customer_panel GROUP BY entity "
                                       "HAVING count(DISTINCT period)=max(period)-min(period)+1 AND max(period)=(SELECT max(period) FROM customer_panel) AND min(period)<=1997", "customer_panel"))
def gap_free_entities(t):
    return clean.gap_free(staged(t.customer_panel.select("entity", "period"), "panel"), latest_start=1997)


UNIVERSE = """cov AS (SELECT entity, 'R'||entity AS region, count(*)=7 AS full_coverage FROM customer_panel WHERE entity%4<>0 GROUP BY entity),
judged AS (SELECT c.c_custkey AS entity, c.c_acctbal AS size, v.region, CASE WHEN v.region IS NULL THEN 'no matching region' WHEN NOT v.full_coverage THEN 'incomplete series' END AS reason FROM customer c LEFT JOIN cov v ON v.entity=c.c_custkey WHERE c.c_acctbal>=1000)"""


def _universe(t):
    cov = t.customer_panel.filter(S("entity") % 4 != 0).groupBy("entity").agg((F.count(F.lit(1)) == 7).alias("full_coverage")).withColumn("region", F.concat(F.lit("R"), "entity"))
    return clean.two_gate_universe(t.customer.select(S("c_custkey").alias("entity"), S("c_acctbal").alias("size")), cov, "entity", "size", 1000.0)


@query("universe_members", with_parts("SELECT entity, size, region FROM judged WHERE reason IS NULL", "customer_panel", extra=UNIVERSE))
def universe_members(t):
    return _universe(t)[0]


@query("universe_drop_log", with_parts("SELECT entity, size, reason FROM judged WHERE reason IS NOT NULL", "customer_panel", extra=UNIVERSE))
def universe_drop_log(t):
    return _universe(t)[1]


@query("set_membership", "SELECT c_custkey, c_acctbal, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority='1-URGENT') AS listed FROM customer")
def set_membership(t):
    c, keys = t.customer.select("c_custkey", "c_acctbal"), t.orders.filter("o_orderpriority = '1-URGENT'").select(S("o_custkey").alias("c_custkey"))
    return clean.members_of(c, keys, ["c_custkey"]).withColumn("listed", F.lit(True)).unionByName(
        clean.members_of(c, keys, ["c_custkey"], keep=False).withColumn("listed", F.lit(False)))


@query("name_part_filters", "SELECT p_partkey, p_name FROM part WHERE (p_name LIKE '%widget' OR p_name LIKE 'small%') AND substr(p_brand,7,1)<>'1'")
def name_part_filters(t):
    return t.part.filter((S("p_name").endswith("widget") | S("p_name").startswith("small")) & (F.substring("p_brand", 7, 1) != "1")).select("p_partkey", "p_name")


@query("sentinel_repair", with_parts("SELECT entity, period, CASE WHEN net_migration<0 THEN 0 ELSE net_migration END AS net_migration, CASE WHEN permits_mf<>0 THEN permits_mf END AS permits_mf, CASE WHEN total_emp>=3 THEN total_emp-3 END AS total_emp FROM customer_panel", "customer_panel"))
def sentinel_repair(t):
    p = t.customer_panel.select("entity", "period", "net_migration", "permits_mf", (S("total_emp") - 3).alias("total_emp"))
    return clean.repair_sentinels(p, {"net_migration": "negative_to_zero", "permits_mf": "zero_to_null", "total_emp": "negative_to_null"})


@query("positive_denominator", with_parts(f"SELECT entity, period, {r('CASE WHEN net_migration>0 THEN rent/net_migration END', 'x')} FROM panel", "panel"))
def positive_denominator(t):
    return t.panel.select("entity", "period", rounded(ratio("rent", "net_migration", positive=True)).alias("x"))


@query("code_remap", "SELECT CASE p_brand WHEN 'Brand#1' THEN 'Brand#2' WHEN 'Brand#3' THEN 'Brand#4' ELSE p_brand END AS code, count(*) AS n FROM part GROUP BY 1")
def code_remap(t):
    return clean.remap_codes(t.part.select(S("p_brand").alias("code")), "code", {"Brand#1": "Brand#2", "Brand#3": "Brand#4"}).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_identical", "SELECT DISTINCT o_custkey AS entity, year(o_orderdate) AS period, c_nationkey AS nation FROM orders JOIN customer ON c_custkey=o_custkey")
def dedup_identical(t):
    rows = t.orders.join(t.customer, S("c_custkey") == S("o_custkey")).select(S("o_custkey").alias("entity"), F.year("o_orderdate").alias("period"), S("c_nationkey").alias("nation"))
    return clean.dedup_checked(rows, ["entity", "period"], ["nation"])


@query("dedup_conflicts", "SELECT o_custkey AS entity FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority)>1")
def dedup_conflicts(t):
    return clean.conflicting_keys(t.orders.select(S("o_custkey").alias("entity"), "o_orderpriority"), ["entity"], ["o_orderpriority"])


@query("fallback_fill", with_parts(f"SELECT entity, period, {r('coalesce(job_growth, income_growth, permits_to_stock)', 'x')} FROM ind", "ind"))
def fallback_fill(t):
    return t.ind.select("entity", "period", rounded(clean.preferred(clean.preferred("job_growth", "income_growth"), "permits_to_stock")).alias("x"))


@query("replace_periods", with_parts(f"SELECT entity, period, {r('CASE WHEN period IN (1997,1999) THEN rent*2 ELSE rent END', 'rent')} FROM panel", "panel"))
def replace_periods(t):
    p = t.panel.select("entity", "period", "rent")
    return rounded_all(clean.replace_periods(p, p.filter("period IN (1997, 1999)").withColumn("rent", S("rent") * 2), [1997, 1999]), ["rent"])


@query("override_cells", with_parts(f"SELECT entity, period, {r('CASE WHEN period=1998 AND entity%10=1 THEN home_value ELSE rent END', 'rent')} FROM panel", "panel"))
def override_cells(t):
    o = t.panel.filter("period = 1998 AND entity % 10 = 1").select("entity", "period", S("home_value").alias("fresh"))
    return rounded_all(growth.override_cells(t.panel.select("entity", "period", "rent"), o, "rent", "fresh"), ["rent"])


@query("code_at_period", with_parts("SELECT entity, period, CASE WHEN entity%10=2 AND period>=1998 THEN 'N'||entity WHEN entity%10=3 AND period<=1996 THEN 'O'||entity ELSE 'C'||lpad(entity::VARCHAR,5,'0') END AS code FROM panel", "panel"))
def code_at_period(t):
    e = S("s_suppkey").alias("entity")
    new = t.supplier.filter("s_suppkey % 10 = 2").select(e, F.concat(F.lit("N"), "s_suppkey").alias("code"), F.lit(1998).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"))
    old = t.supplier.filter("s_suppkey % 10 = 3").select(e, F.concat(F.lit("O"), "s_suppkey").alias("code"), F.lit(None).cast("int").alias("valid_from"), F.lit(1996).alias("valid_to"))
    default = F.concat(F.lit("C"), F.lpad(S("entity").cast("string"), 5, "0"))
    return clean.code_at_period(default, new.unionByName(old), t.panel.select("entity", "period"), "entity", "period")


# ---- joins -------------------------------------------------------------------------------------

AS_OF = "SELECT c.entity, c.cut, (SELECT arg_max(p.rent, p.period) FROM customer_panel p WHERE p.entity=c.entity AND p.period<{op}c.cut) AS x FROM (SELECT c_custkey AS entity, cut FROM customer, (VALUES (1996),(1998),(2001)) v(cut)) c"


def _cuts(t):
    return t.customer.select(S("c_custkey").alias("entity"), F.explode(F.array(F.lit(1996), F.lit(1998), F.lit(2001))).alias("cut"))


@query("as_of_before_cut", with_parts(f"SELECT entity, cut, {r('x', 'rent')} FROM ({AS_OF.format(op='')})", "customer_panel"))
def as_of_before_cut(t):
    return rounded_all(match.as_of(_cuts(t), t.customer_panel, "rent"), ["rent"])


@query("as_of_up_to_cut", with_parts(f"SELECT entity, cut, {r('x', 'rent')} FROM ({AS_OF.format(op='=')})", "customer_panel"))
def as_of_up_to_cut(t):
    return rounded_all(match.as_of(_cuts(t), t.customer_panel, "rent", inclusive=True), ["rent"])


@query("as_of_split", with_parts(f"SELECT entity, cut, {r('x', 'rent')} FROM ({AS_OF.format(op='')})", "customer_panel"))
def as_of_split(t):
    return rounded_all(match.as_of(_cuts(t), t.customer_panel, "rent", bound=WIDE), ["rent"])


@query("latest_before_one_cut", with_parts(f"SELECT entity, {r('arg_max(rent, period)', 'rent')} FROM customer_panel WHERE period<1998 GROUP BY entity", "customer_panel"))
def latest_before_one_cut(t):
    return rounded_all(match.latest_before(t.customer_panel, 1998, "rent"), ["rent"])


# Titles "a-b, S-T" come from part names; places are (word, brand digit) pairs.
TITLES = "titles AS (SELECT p_partkey AS entity, replace(p_name,' ','-')||', '||substr(p_brand,7,1)||'-'||(p_size%4) AS title FROM part)"
PLACES = "places AS (SELECT min(p_partkey)+1000000 AS place, split_part(p_name,' ',1) AS city, (p_size%7)::VARCHAR AS state FROM part GROUP BY ALL UNION ALL SELECT min(p_partkey)+2000000, split_part(p_name,' ',2), (p_size%5)::VARCHAR FROM part GROUP BY ALL)"


def _titles(t):
    titles = t.part.select(S("p_partkey").alias("entity"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(", "), F.substring("p_brand", 7, 1), F.lit("-"), S("p_size") % 4).alias("title"))
    word = lambda i, m, add: t.part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(i)).alias("city"), (S("p_size") % m).cast("string").alias("state")).agg((F.min("p_partkey") + add).alias("place"))
    return titles, word(1, 7, 1000000).unionByName(word(2, 5, 2000000))


@query("match_any_place", f"""WITH {TITLES}, {PLACES}, cc AS (SELECT entity, title, lower(trim(u.city)) AS city, u.ci FROM titles, LATERAL (SELECT unnest(string_split(split_part(title,',',1),'-')) AS city, generate_subscripts(string_split(split_part(title,',',1),'-'),1) AS ci) u),
ss AS (SELECT entity, trim(u.st) AS st, u.si FROM titles, LATERAL (SELECT unnest(string_split(split_part(title,',',2),'-')) AS st, generate_subscripts(string_split(split_part(title,',',2),'-'),1) AS si) u),
hit AS (SELECT cc.entity, p.place, row_number() OVER (PARTITION BY cc.entity ORDER BY ci, si, p.place) AS k FROM cc JOIN ss USING (entity) JOIN places p ON lower(p.city)=cc.city AND p.state=ss.st)
SELECT t.entity, t.title, h.place FROM titles t LEFT JOIN (SELECT * FROM hit WHERE k=1) h USING (entity)""")
def match_any_place(t):
    titles, places = _titles(t)
    return match.match_any_place(titles, places, "entity", "title", "place", "city", "state")


@query("match_first_place", f"""WITH {TITLES}, {PLACES} SELECT t.entity, t.title, p.place FROM titles t LEFT JOIN (SELECT lower(city) AS city, state, min(place) AS place FROM places GROUP BY ALL) p
  ON p.city=lower(split_part(split_part(title,',',1),'-',1)) AND p.state=trim(split_part(split_part(title,',',2),'-',1))""")
def match_first_place(t):
    titles, places = _titles(t)
    return match.match_first_place(titles, places, "entity", "title", "place", "city", "state")


@query("primary_state", f"WITH {TITLES} SELECT entity, trim(split_part(split_part(title,',',2),'-',1)) AS state FROM titles")
def primary_state_of_title(t):
    return _titles(t)[0].select("entity", primary_state("title").alias("state"))


@query("interval_names", "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN 'first' WHEN year(o_orderdate) BETWEEN 1998 AND 1999 THEN 'second' ELSE 'unknown' END AS name FROM orders")
def interval_names(t):
    return t.orders.select("o_orderkey", interval_name(F.year("o_orderdate"), {"first": (1995, 1996), "second": (1998, 1999)}).alias("name"))


@query("aligned_rankings", with_parts("SELECT strategy, period, entity FROM (SELECT *, count(*) OVER (PARTITION BY period, entity) AS c FROM (SELECT 'a' AS strategy, period, entity FROM panel WHERE entity%3<>0 UNION ALL SELECT 'b', period, entity FROM panel WHERE entity%4<>0)) WHERE c=2", "panel"))
def aligned_rankings(t):
    p = t.panel.select("period", "entity")
    both = p.filter("entity % 3 <> 0").withColumn("strategy", F.lit("a")).unionByName(p.filter("entity % 4 <> 0").withColumn("strategy", F.lit("b")))
    return match.aligned(both, ["period"], "entity", "strategy", 2)


@query("pick_best_candidate", "SELECT c_custkey, o.o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_orderdate, o_orderkey) AS k FROM orders) o ON o.o_custkey=c_custkey AND o.k=1")
def pick_best_candidate(t):
    cand = t.orders.select(S("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderdate")
    return match.pick_best(t.customer.select("c_custkey"), cand, ["c_custkey"], [S("o_orderstatus").desc(), S("o_orderdate"), S("o_orderkey")]).select("c_custkey", "o_orderkey")


@query("lookup_by_name", "SELECT s_suppkey, s_suppkey+500000 AS code FROM supplier WHERE s_suppkey%3<>1")
def lookup_by_name(t):
    names = t.supplier.filter("s_suppkey % 3 <> 1").select(F.upper(F.replace("s_name", F.lit("#"), F.lit(" - "))).alias("full_name"), (S("s_suppkey") + 500000).alias("code"))
    return match.lookup_by_name(t.supplier.select("s_suppkey", "s_name"), names, "s_name", "full_name", "code").select("s_suppkey", "code")


@query("membership_changes", "SELECT s_nationkey AS parent, s_suppkey AS child, CASE WHEN s_suppkey%7=0 THEN 'added' ELSE 'removed' END AS change FROM supplier WHERE (s_suppkey%7=0)<>(s_suppkey%5=0)")
def membership_changes(t):
    m = t.supplier.select(S("s_nationkey").alias("parent"), S("s_suppkey").alias("child"))
    return match.membership_changes(m.filter("child % 5 <> 0 OR child % 7 = 0"), m.filter("child % 7 <> 0 OR child % 5 = 0"), "parent", "child")


@query("key_set_intersection", "SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal>5000)")
def key_set_intersection(t):
    return t.customer.select(S("c_nationkey").alias("nation")).intersect(t.supplier.filter("s_acctbal > 5000").select(S("s_nationkey").alias("nation")))


# ---- roll-ups ----------------------------------------------------------------------------------

def _rolled(how):
    f = {"mean": "avg", "median": "median"}.get(how, how)
    return with_parts(f"SELECT n_nationkey AS parent, period, {r(f + '(population)', 'population')}, {r(f + '(housing_units)', 'housing_units')} FROM panel JOIN supplier ON s_suppkey=entity JOIN nation ON n_nationkey=s_nationkey WHERE entity%6<>0 GROUP BY ALL", "panel")


def _roll(t, how):
    bridge = t.supplier.filter("s_suppkey % 6 <> 0").select(S("s_suppkey").alias("entity"), S("s_nationkey").alias("parent"))
    return rounded_all(rollup.roll_up(t.panel, bridge, "entity", ["parent"], ["population", "housing_units"], how, ["period"]), ["population", "housing_units"])


for _how in ("sum", "mean", "min", "max", "median", "count"):
    query(f"roll_up_{_how}", _rolled(_how))(lambda t, how=_how: _roll(t, how))


@query("complete_membership", with_parts(f"""SELECT s_nationkey AS parent, y::INT AS period, {r('CASE WHEN count(permits_mf)=count(*) THEN sum(permits_mf) END', 'permits_mf')} FROM supplier CROSS JOIN {SPAN.format('panel')} g(y)
  LEFT JOIN (SELECT entity, period, permits_mf FROM panel WHERE entity%11<>0 OR period<1998) p ON p.entity=s_suppkey AND p.period=y GROUP BY ALL""", "panel"))
def complete_membership(t):
    members = t.supplier.select(S("s_suppkey").alias("entity"), S("s_nationkey").alias("parent"))
    lo, hi = _span(t.panel)
    facts = t.panel.select("entity", "period", "permits_mf").filter("entity % 11 <> 0 OR period < 1998")
    return rounded_all(rollup.complete_membership_sum(facts, members, "entity", "parent", "permits_mf", range(lo, hi + 1)), ["permits_mf"])


@query("weighted_rollup_filled", with_parts(f"""SELECT parent, period, {r('sum(w*rent)/nullif(sum(w),0)', 'rent')} FROM (SELECT s_nationkey AS parent, p.entity, p.period, rent, coalesce(last_value(wt IGNORE NULLS) OVER (PARTITION BY p.entity ORDER BY p.period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(wt IGNORE NULLS) OVER (PARTITION BY p.entity ORDER BY p.period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS w FROM (SELECT *, CASE WHEN (entity+period)%3=0 THEN population END AS wt FROM panel) p JOIN supplier ON s_suppkey=p.entity) WHERE w IS NOT NULL GROUP BY ALL""", "panel"))
def weighted_rollup_filled(t):
    rows = t.panel.join(t.nation_of_supplier(), "entity").select("entity", S("state").alias("parent"), "period", "rent", F.when((S("entity") + S("period")) % 3 == 0, S("population")).alias("w"))
    return rounded_all(rollup.weighted_rollup(rows, "entity", "parent", "rent", "w"), ["rent"])


@query("total_and_average", with_parts(f"SELECT s_nationkey AS parent, period, {r('sum(total_emp)', 'total_emp')}, {r('sum(total_emp*avg_pay)/nullif(sum(total_emp),0)', 'avg_pay')} FROM panel JOIN supplier ON s_suppkey=entity GROUP BY ALL", "panel"))
def total_and_average(t):
    rows = t.panel.join(t.nation_of_supplier(), "entity")
    return rounded_all(rows.groupBy(S("state").alias("parent"), "period").agg(*rollup.total_and_average("total_emp", "avg_pay")), ["total_emp", "avg_pay"])


CELLS = "cells AS (SELECT l_suppkey AS entity, year(l_shipdate) AS period, p_type AS cell, sum(l_extendedprice*(1-l_discount)) AS v FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY ALL)"


def _cells(t):
    p = t.part.select(S("p_partkey").alias("l_partkey"), S("p_type").alias("cell"))
    return t.lineitem.join(p, "l_partkey").groupBy(S("l_suppkey").alias("entity"), F.year("l_shipdate").alias("period"), "cell").agg(F.sum(S("l_extendedprice") * (1 - S("l_discount"))).alias("v"))


@query("concentration_index", f"WITH {CELLS} SELECT entity, period, {r('sum(v*v)/nullif(sum(v)*sum(v),0)', 'hhi')} FROM cells WHERE v>0 GROUP BY ALL")
def concentration_index(t):
    return rounded_all(_cells(t).groupBy("entity", "period").agg(rollup.concentration("v").alias("hhi")), ["hhi"])


@query("category_share", f"WITH {CELLS} SELECT entity, period, {r(chr(39).join(['nullif(sum(CASE WHEN cell IN (', 'ECONOMY', ',', 'PROMO', ') THEN v END)/nullif(sum(v),0),0)']), 'share')} FROM cells GROUP BY ALL")
def category_share(t):
    return rounded_all(_cells(t).groupBy("entity", "period").agg(rollup.set_share("v", S("cell").isin("ECONOMY", "PROMO")).alias("share")), ["share"])


@query("ratio_of_sums", f"SELECT s_nationkey AS nation, {r('sum(l_extendedprice*l_discount)/nullif(sum(l_extendedprice),0)', 'share')} FROM lineitem JOIN supplier ON s_suppkey=l_suppkey GROUP BY 1")
def ratio_of_sums(t):
    rows = t.lineitem.join(t.nation_of_supplier(), S("entity") == S("l_suppkey"))
    return rounded_all(rows.groupBy(S("state").alias("nation")).agg(ratio(F.sum(S("l_extendedprice") * S("l_discount")), F.sum("l_extendedprice")).alias("share")), ["share"])


@query("net_flow", """SELECT entity, period, coalesce(i.orders,0)-coalesce(o.orders,0) AS net_orders, round(coalesce(i.value,0)-coalesce(o.value,0),2)+0.0 AS net_value FROM
  (SELECT o_custkey AS entity, year(o_orderdate) AS period, count(*) AS orders, sum(o_totalprice) AS value FROM orders WHERE o_orderstatus='F' GROUP BY ALL) i FULL JOIN
  (SELECT o_custkey AS entity, year(o_orderdate) AS period, count(*) AS orders, sum(o_totalprice) AS value FROM orders WHERE o_orderstatus='O' GROUP BY ALL) o USING (entity, period)""")
def net_flow(t):
    def side(status):
        return t.orders.filter(S("o_orderstatus") == status).select(S("o_custkey").alias("entity"), F.year("o_orderdate").alias("period"), F.lit(1).cast("bigint").alias("orders"), S("o_totalprice").alias("value"))
    return rollup.net_flow(side("F"), side("O"), ["entity", "period"], ["orders", "value"]).withColumn("net_value", F.round("net_value", 2) + F.lit(0.0))


@query("period_median", with_parts(f"SELECT period, {r('median(rent)', 'median')} FROM customer_panel GROUP BY period", "customer_panel"))
def period_median(t):
    return rounded_all(rollup.period_median(t.customer_panel, "rent", bound=t.rows("customer")), ["median"])


@query("pooled_subtotals", f"SELECT o_orderstatus AS status, coalesce(o_orderpriority,'POOLED') AS priority, count(*) AS n, {r('avg(o_totalprice)', 'mean_price', 3)} FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority),(o_orderstatus))")
def pooled_subtotals(t):
    o = t.orders.select(S("o_orderstatus").alias("status"), S("o_orderpriority").alias("priority"), "o_totalprice")
    return rounded_all(rollup.pooled_summary(o, ["status"], "priority", [F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")]), ["mean_price"], 3)


@query("coverage_profile", with_parts(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(f'avg(({c} IS NOT NULL)::INT)', 'share')} FROM ind" for c in ("job_growth", "income_growth", "rent_to_income")), "ind"))
def coverage_profile(t):
    return rounded_all(rollup.coverage(t.ind, ["job_growth", "income_growth", "rent_to_income"]), ["share"])


@query("coverage_by_period", with_parts(" UNION ALL ".join(f"SELECT period, '{c}' AS measure, count({c}) AS n_entities FROM ind GROUP BY period" for c in ("job_growth", "rent_to_income")), "ind"))
def coverage_by_period(t):
    return rollup.coverage_by_period(t.ind, ["job_growth", "rent_to_income"])


@query("arg_max_name", "SELECT s_nationkey AS nation, arg_max(s_name, s_acctbal) AS s_name, max(s_acctbal) AS s_acctbal FROM supplier GROUP BY 1")
def arg_max_name(t):
    return rollup.arg_max(t.supplier.withColumnRenamed("s_nationkey", "nation"), ["nation"], "s_name", "s_acctbal")


@query("distinct_counts", "SELECT count(DISTINCT l_suppkey) AS n_entities, count(DISTINCT year(l_shipdate)) AS n_periods FROM lineitem")
def distinct_counts(t):
    return t.lineitem.agg(F.count_distinct("l_suppkey").alias("n_entities"), F.count_distinct(F.year("l_shipdate")).alias("n_periods"))


@query("summary_by_group", f"SELECT c_mktsegment, count(*) AS n, {r('min(c_acctbal)', 'lo')}, {r('avg(c_acctbal)', 'mean')}, {r('max(c_acctbal)', 'hi')} FROM customer GROUP BY 1")
def summary_by_group(t):
    g = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("lo"), F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("hi"))
    return rounded_all(g, ["lo", "mean", "hi"])


LEGACY = """bridge AS (SELECT s_suppkey AS entity, s_nationkey%5 AS parent, NULL::INT AS f, 1997 AS u FROM supplier UNION ALL SELECT s_suppkey, s_nationkey%4, 1998, NULL FROM supplier)"""


@query("legacy_membership", with_parts(f"SELECT parent, p.period, {r('sum(population)', 'population')} FROM panel p JOIN bridge b ON b.entity=p.entity AND (f IS NULL OR p.period>=f) AND (u IS NULL OR p.period<=u) GROUP BY ALL", "panel", extra=LEGACY))
def legacy_membership(t):
    n = t.nation_of_supplier()
    none = F.lit(None).cast("int")
    old = n.select("entity", (S("state") % 5).alias("parent"), none.alias("valid_from"), F.lit(1997).alias("valid_to"))
    new = n.select("entity", (S("state") % 4).alias("parent"), F.lit(1998).alias("valid_from"), none.alias("valid_to"))
    rows = rollup.members_at(old.unionByName(new), t.panel.select("entity", "period", "population"), "entity", "period")
    return rounded_all(rows.groupBy("parent", "period").agg(F.sum("population").alias("population")), ["population"])


@query("latest_row_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k=1")
def latest_row_per_group(t):
    return latest_per_group(t.orders, ["o_custkey"], [S("o_orderdate").desc(), S("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


# ---- time shifts -------------------------------------------------------------------------------

SELF = "FROM customer_panel p LEFT JOIN customer_panel q ON q.entity=p.entity AND q.period=p.period-{k}"


@query("exact_growth", with_parts(f"SELECT p.entity, p.period, {r('p.rent/nullif(q.rent,0)-1', 'growth')}, {r('p.rent-q.rent', 'change')} {SELF.format(k=1)}", "customer_panel"))
def exact_growth(t):
    return t.customer_panel.select("entity", "period", rounded(growth.exact_growth("rent")).alias("growth"), rounded(growth.exact_difference("rent")).alias("change"))


@query("trailing_growth", with_parts(f"SELECT p.entity, p.period, {r('p.rent/nullif(q.rent,0)-1', 'growth')} {SELF.format(k=3)}", "customer_panel"))
def trailing_growth(t):
    return t.customer_panel.select("entity", "period", rounded(growth.exact_growth("rent", 3)).alias("growth"))


@query("forward_growth", with_parts(f"SELECT p.entity, p.period, {r('CASE WHEN p.rent>0 THEN q.rent/p.rent-1 END', 'growth')} {SELF.format(k='(-2)')}", "customer_panel"))
def forward_growth(t):
    return t.customer_panel.select("entity", "period", rounded(growth.forward_growth("rent", 2)).alias("growth"))


SPARSE = "sp AS (SELECT entity, period, CASE WHEN permits_mf>0 THEN permits_mf END AS x FROM customer_panel)"


def _sparse(t):
    return t.customer_panel.select("entity", "period", F.when(S("permits_mf") > 0, S("permits_mf")).alias("x"))


@query("guarded_growth", with_parts(f"SELECT p.entity, p.period, {r('p.x/q.x-1', 'g')} FROM sp p JOIN sp q ON q.entity=p.entity AND q.period=p.period-1 WHERE p.x IS NOT NULL AND q.x IS NOT NULL", "customer_panel", extra=SPARSE))
def guarded_growth(t):
    return rounded_all(growth.guarded_change(_sparse(t), "x", "g"), ["g"])


@query("guarded_difference", with_parts(f"SELECT p.entity, p.period, {r('p.x-q.x', 'd')} FROM sp p JOIN sp q ON q.entity=p.entity AND q.period=p.period-1 WHERE p.x IS NOT NULL AND q.x IS NOT NULL", "customer_panel", extra=SPARSE))
def guarded_difference(t):
    return rounded_all(growth.guarded_change(_sparse(t), "x", "d", "difference"), ["d"])


@query("adjacent_growth", with_parts(f"SELECT entity, period, {r('x/nullif(lag(x) OVER (PARTITION BY entity ORDER BY period),0)-1', 'g')} FROM sp", "customer_panel", extra=SPARSE))
def adjacent_growth(t):
    return _sparse(t).select("entity", "period", rounded(growth.adjacent_growth("x")).alias("g"))


_W3 = "OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query("trailing_mean", with_parts(f"SELECT entity, period, {r(f'CASE WHEN count(x) {_W3}>=2 THEN avg(x) {_W3} END', 'm')} FROM sp", "customer_panel", extra=SPARSE))
def trailing_mean(t):
    return _sparse(t).select("entity", "period", rounded(growth.trailing_mean("x")).alias("m"))


@query("same_months_growth", with_parts(f"SELECT p.entity, p.period, {r('p.m', 'ytd_mean')}, {r('p.m/nullif(q.m,0)-1', 'ytd_growth')} FROM yt p LEFT JOIN yt q ON q.entity=p.entity AND q.period=p.period-1", "monthly",
                                        extra="yt AS (SELECT entity, year(date) AS period, avg(rent) AS m FROM monthly WHERE month(date)<=5 GROUP BY ALL)"))
def same_months_growth(t):
    return rounded_all(growth.same_months_growth(t.monthly, "rent", 5), ["ytd_mean", "ytd_growth"])


@query("month_over_year", with_parts("SELECT entity, month, round(yoy,4)+0.0 AS yoy FROM (SELECT * FROM g UNION ALL SELECT 'ALL', month, median(yoy) FROM g GROUP BY month)", "monthly",
                                     extra="g AS (SELECT a.entity::VARCHAR AS entity, a.date AS month, a.rent/b.rent-1 AS yoy FROM monthly a JOIN monthly b ON b.entity=a.entity AND b.date=a.date-INTERVAL 12 MONTH)"))
def month_over_year(t):
    return growth.month_over_year(t.monthly, "rent", "ALL").withColumn("yoy", S("yoy") + F.lit(0.0))


@query("annualised_part_year", with_parts(f"SELECT entity, year(date) AS period, {r('sum(units)*12/5', 'units')} FROM monthly WHERE month(date)<=5 GROUP BY 1,2", "monthly"))
def annualised_part_year(t):
    g = t.monthly.filter("month(date) <= 5").groupBy("entity", F.year("date").alias("period")).agg(F.sum("units").alias("u"))
    return g.select("entity", "period", rounded(growth.annualised("u", 5)).alias("units"))


@query("filled_from_neighbours", with_parts(f"""SELECT entity, period, {r('coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'x')} FROM sp""", "customer_panel", extra=SPARSE))
def filled_from_neighbours(t):
    return _sparse(t).select("entity", "period", rounded(growth.filled_from_neighbours("x")).alias("x"))


@query("filled_split", with_parts(f"""SELECT entity, period, {r('coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'x')} FROM sp""", "customer_panel", extra=SPARSE))
def filled_split(t):
    return growth.filled(_sparse(t), "x", "y", bound=WIDE).select("entity", "period", rounded("y").alias("x"))


@query("growth_backcast", with_parts(f"""SELECT o.entity, o.period, {r('CASE WHEN c=1998-o.period+1 THEN a.rent*o.home_value/nullif(b.home_value,0) END', 'rent')} FROM (SELECT *, count(*) FILTER (home_value<>0) OVER (PARTITION BY entity ORDER BY period DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM customer_panel WHERE period<=1998) o
  JOIN (SELECT * FROM customer_panel WHERE period=1998) a USING (entity) JOIN (SELECT * FROM customer_panel WHERE period=1998) b USING (entity) WHERE o.period<1998""", "customer_panel"))
def growth_backcast(t):
    p = staged(t.customer_panel.select("entity", "period", "rent", "home_value"), "panel")
    return rounded_all(growth.backcast(p.select("entity", "period", "rent"), p.select("entity", "period", "home_value"), 1998, "rent", "home_value"), ["rent"])


@query("chained_splice", with_parts(f"SELECT p.entity, p.period, {r('CASE WHEN p.entity%10=4 AND p.period=1998 THEN coalesce(q.rent*(1+g.trailing_rent_growth), p.rent) ELSE p.rent END', 'rent')} FROM panel p LEFT JOIN panel q ON q.entity=p.entity AND q.period=p.period-1 LEFT JOIN ind g ON g.entity=p.entity AND g.period=p.period", "ind"))
def chained_splice(t):
    cells = t.panel.filter("entity % 10 = 4 AND period = 1998").select("entity", "period")
    g = t.ind.select("entity", "period", S("income_growth").alias("_u"), S("trailing_rent_growth").alias("g"))
    return rounded_all(growth.chained_splice(t.panel.select("entity", "period", "rent"), g, "rent", "g", cells), ["rent"])


@query("two_step_chain", with_parts(f"SELECT entity, period, {r('1000*(1+coalesce(job_growth,0))*(1+coalesce(income_growth,0))', 'level')} FROM ind", "ind"))
def two_step_chain(t):
    return t.ind.select("entity", "period", rounded(growth.chain_step(growth.chain_step(F.lit(1000.0), "job_growth"), "income_growth")).alias("level"))


@query("last_periods", with_parts(f"SELECT entity, period, {rs('rent')} FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS k FROM customer_panel) WHERE k<=3", "customer_panel"))
def last_periods(t):
    return rounded_all(growth.last_n(t.customer_panel.select("entity", "period", "rent"), 3), ["rent"])


@query("change_since_first", with_parts(f"""SELECT entity, {r('a', 'first_value')}, {r('b', 'last_value')}, span::INT AS span, {r('b/a-1', 'total_change')}, {r('CASE WHEN span>0 THEN pow(b/a,1.0::DOUBLE/span)-1 END', 'compound_growth')} FROM
  (SELECT entity, arg_min(rent, period) AS a, arg_max(rent, period) AS b, max(period)-min(period) AS span FROM customer_panel GROUP BY entity)""", "customer_panel"))
def change_since_first(t):
    return rounded_all(growth.change_since_first(t.customer_panel, "rent"), ["first_value", "last_value", "total_change", "compound_growth"])


@query("amortised_payment", "SELECT o_orderkey, " + r("o_totalprice*(0.065::DOUBLE/12)*pow(1+0.065::DOUBLE/12,360)/(pow(1+0.065::DOUBLE/12,360)-1)", "payment", 4) + " FROM orders")
def amortised_payment(t):
    return t.orders.select("o_orderkey", rounded(annuity_payment("o_totalprice", F.lit(6.5)), 4).alias("payment"))


# Parents with key below 3 are rebuilt from members on current borders and carried back along the
# older membership; all other parents take the sum of the older or newer vintage as published.
BOUNDARY = """old AS (SELECT s_nationkey AS parent, period, sum(population) AS v FROM panel JOIN supplier ON s_suppkey=entity WHERE entity%2=0 GROUP BY ALL),
cur AS (SELECT s_nationkey AS parent, period, sum(population) AS v FROM panel JOIN supplier ON s_suppkey=entity GROUP BY ALL)"""


@query("boundary_consistent_series", with_parts(f"""SELECT parent, period, {r('v')} FROM (SELECT parent, period, v FROM cur WHERE parent>=3 UNION ALL SELECT parent, period, v FROM cur WHERE parent<3 AND period>=1998
  UNION ALL SELECT o.parent, o.period, a.v*o.v/b.v FROM old o JOIN cur a ON a.parent=o.parent AND a.period=1998 JOIN old b ON b.parent=o.parent AND b.period=1998 WHERE o.parent<3 AND o.period<1998)""", "panel", extra=BOUNDARY))
def boundary_consistent_series(t):
    m = t.supplier.select(S("s_suppkey").alias("entity"), S("s_nationkey").alias("parent"))
    facts = t.panel.select("entity", "period", S("population").alias("v"))
    lo, hi = _span(t.panel)
    current = rollup.complete_membership_sum(facts, m, "entity", "parent", "v", range(lo, hi + 1))
    legacy = rollup.complete_membership_sum(facts, m.filter("parent < 3 AND entity % 2 = 0"), "entity", "parent", "v", range(lo, hi + 1))
    back = growth.backcast(current.filter("parent < 3"), legacy.withColumnRenamed("v", "w"), 1998, "v", "w", entity="parent")
    return rounded_all(current.filter("parent >= 3 OR period >= 1998").unionByName(back), ["v"])
