"""Queries: bootstraps, rank intervals and gates."""
from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.catalog.base import (
    MODEL, WF, comp_sql, metrics_sql, query, r, rounded_all, rs, strategies_sql, summary_sql, tau_sql, with_parts, z_sql)
from paneltide.catalog.validate import (
    CAT_SQL, EQUAL, FULL, G, _avg_rank, category, evaluated, outcome, periods)
from paneltide.plans import gates, rankings as rk, resample as rs_, walkforward as wf
from paneltide.plans.model import LEADING_LOW, TIERS
from paneltide.plans.scoring import composite, with_trailing_means

# Draws of the uncertainty queries, and of the gates.
B, GATE_B = 1000, 800
BITS = "cast('0x'||substr(md5({m}),{p},8) AS BIGINT)"
WIDE_BITS = "cast('0x'||substr(md5({m}),1,15) AS BIGINT)"


def drawn_sql(units: str, b: int = B, unit: str = "entity", seed: str = "boot", name: str = "drawn") -> str:
    bits = WIDE_BITS.format(m=f"'{seed}:'||rep||':'||slot")
    return f"""{name}_u AS (SELECT {unit}, row_number() OVER (ORDER BY {unit}) AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT {unit} FROM {units})),
{name} AS (SELECT d.rep AS replicate, u.{unit}, count(*) AS copies FROM (SELECT rep, {bits}%n+1 AS slot FROM {name}_u, range({b}) g(rep)) d JOIN {name}_u u USING (slot) GROUP BY ALL)"""


def frame_sql(scores: dict[str, str], source: str = "norm", ranked: str | None = None) -> str:
    """CTE frame: outcome clipped before the join, entities shared by all strategies."""
    return f"""olim AS (SELECT horizon, period, quantile_cont(realized,0.01) AS lo, quantile_cont(realized,0.99) AS hi FROM outcome GROUP BY ALL),
oclip AS (SELECT o.horizon, o.period, o.entity, least(greatest(realized,lo),hi) AS realized FROM outcome o JOIN olim USING (horizon, period)),
{ranked or strategies_sql(scores, source)},
frame AS (SELECT * FROM (SELECT strategy, horizon, period, entity, score, realized, count(*) OVER (PARTITION BY horizon, period, entity) AS ns FROM ranked JOIN oclip USING (entity, period)
  WHERE score IS NOT NULL AND period IN (SELECT period FROM usable)) WHERE ns={len(scores)})"""


def boot_sql(drawn: str = "drawn") -> str:
    return f"""{tau_sql('frame', 'pt', ['strategy', 'horizon', 'period'], at_least=10)},
point AS (SELECT strategy, avg(tau) AS tau FROM pt GROUP BY strategy),
brows AS (SELECT d.replicate, f.strategy, f.horizon, f.period, f.entity, f.score, f.realized, d.copies FROM frame f JOIN {drawn} d USING (entity)),
{tau_sql('brows', 'bt', ['replicate', 'strategy', 'horizon', 'period'], 'copies', 10)},
reps AS (SELECT replicate, strategy, avg(tau) AS tau FROM bt GROUP BY ALL)"""


OUT3 = """outcome AS (SELECT 3 AS horizon, a.entity, a.period, b.rent/a.rent-1 AS realized FROM panel a JOIN panel b ON b.entity=a.entity AND b.period=a.period+3 WHERE a.rent>0)"""
TWO = FULL | EQUAL
BASE = OUT3 + ",\n" + frame_sql(TWO) + ",\n" + drawn_sql("frame") + ",\n" + boot_sql()


def two(t):
    return rk.full_model(MODEL) | rk.equal_weight(MODEL)


def frame(t, scores, source=None):
    src = t.norm if source is None else source
    return wf.outcome_frame(rk.strategies(src, scores), outcome(t, [3]), len(scores), periods(t), t.bound)


def gaps_sql(ref: str) -> str:
    return f"""gaps AS (SELECT p.strategy, f.strategy AS reference, p.tau, f.tau-p.tau AS gap, i.lo AS gap_lo, i.hi AS gap_hi FROM point p, {ref} f,
  (SELECT a.strategy, quantile_cont(c.tau-a.tau,0.025) AS lo, quantile_cont(c.tau-a.tau,0.975) AS hi FROM reps a JOIN reps c USING (replicate), {ref} f WHERE c.strategy=f.strategy GROUP BY a.strategy) i WHERE i.strategy=p.strategy)"""


@query("bootstrap_draws", with_parts("SELECT * FROM drawn", extra=drawn_sql("(SELECT s_suppkey AS entity FROM supplier)")))
def bootstrap_draws(t):
    from pyspark.sql.functions import col
    return rs_.draws(t.supplier.select(col("s_suppkey").alias("entity")), "entity", B, bound=t.bound)


@query("bootstrap_tau", with_parts(f"SELECT strategy, {r('p.tau', 'tau')}, {r('quantile_cont(reps.tau,0.025)', 'lo')}, {r('quantile_cont(reps.tau,0.975)', 'hi')} FROM point p JOIN reps USING (strategy) GROUP BY strategy, p.tau", "usable", extra=BASE), stage=True)
def bootstrap_tau(t):
    f = frame(t, two(t))
    point, reps = rs_.bootstrap(f, B, bound=t.bound)
    return rounded_all(rs_.tau_intervals(point, reps), ["tau", "lo", "hi"])


GAPC = ["tau", "gap", "gap_lo", "gap_hi"]


@query("paired_gap", with_parts(f"SELECT strategy, reference, {rs(*GAPC)}, gap_lo>0 OR gap_hi<0 AS excludes_zero, gap_lo>0 AS reliably_worse FROM gaps", "usable",
                                extra=BASE + ",\n" + gaps_sql("(SELECT * FROM point WHERE strategy='full')")), stage=True)
def paired_gap(t):
    f = frame(t, two(t))
    point, reps = rs_.bootstrap(f, B, bound=t.bound)
    return rounded_all(rs_.paired_gaps(point, reps, "full"), GAPC)


CLUSTER = "members AS (SELECT s_suppkey AS entity, s_nationkey AS cluster FROM supplier),\n" + drawn_sql("members", GATE_B, unit="cluster", name="cd") + ",\ndrawn AS (SELECT replicate, entity, copies FROM cd JOIN members USING (cluster))"


@query("cluster_bootstrap", with_parts(f"SELECT strategy, {r('p.tau', 'tau')}, {r('quantile_cont(reps.tau,0.025)', 'lo')}, {r('quantile_cont(reps.tau,0.975)', 'hi')} FROM point p JOIN reps USING (strategy) GROUP BY strategy, p.tau",
                                       "usable", extra=OUT3 + ",\n" + frame_sql(TWO) + ",\n" + CLUSTER + ",\n" + boot_sql()), stage=True)
def cluster_bootstrap(t):
    f = frame(t, two(t))
    members = t.nation_of_supplier().withColumnRenamed("state", "cluster")
    point, reps = rs_.bootstrap(f, GATE_B, members=members, cluster="cluster", bound=t.bound)
    return rounded_all(rs_.tau_intervals(point, reps), ["tau", "lo", "hi"])


SCHEMES = {"current": MODEL.weights, "equal": rk.tilted_weights(MODEL, None), "two": {"net_migration": 0.5, "permits_to_stock": 0.5}}
SCHEME_SQL = {n: comp_sql(w) for n, w in SCHEMES.items()}
BEST = "(SELECT * FROM point ORDER BY tau DESC, strategy LIMIT 1)"
SBASE = OUT3 + ",\n" + frame_sql(SCHEME_SQL) + ",\n" + drawn_sql("frame") + ",\n" + boot_sql() + ",\n" + gaps_sql(BEST)


def scheme_gaps(t):
    f = frame(t, rk.weight_schemes(SCHEMES))
    point, reps = rs_.bootstrap(f, B, bound=t.bound)
    return rs_.paired_gaps(point, reps)


@query("scheme_comparison", with_parts(f"SELECT strategy, reference, {rs(*GAPC)}, gap_lo>0 OR gap_hi<0 AS excludes_zero, gap_lo>0 AS reliably_worse FROM gaps", "usable", extra=SBASE), stage=True)
def scheme_comparison(t):
    return rounded_all(scheme_gaps(t), GAPC)


@query("simplest_scheme", with_parts("SELECT strategy, CASE strategy WHEN 'two' THEN 2 ELSE 8 END::INT AS n_indicators FROM gaps WHERE NOT gap_lo>0 ORDER BY 2, gap, strategy LIMIT 1", "usable", extra=SBASE), stage=True)
def simplest_scheme(t):
    return rs_.simplest_acceptable(scheme_gaps(t), {n: len(w) for n, w in SCHEMES.items()})


RHO = {"net_migration": 0.8, "job_growth": 0.9}
_EPS = "sqrt(-2*ln(({a}+0.5)/4294967296.0::DOUBLE))*cos(2*pi()*({b}+0.5)/4294967296.0::DOUBLE)"


def _eps(k):
    m = f"'noise-{k}:'||edition||':'||rep||':'||entity"
    return _EPS.format(a=BITS.format(m=m, p=1), b=BITS.format(m=m, p=9))


def hundredths_sql(percent: int, b: int = B) -> str:
    i, part = divmod((b - 1) * percent, 100)
    return f"(ks[{i + 1}]*{100 - part}+ks[{min(i + 2, b)}]*{part})"


def half_even_sql(x: str) -> str:
    return f"(({x})//100+CASE WHEN ({x})%100>50 OR (({x})%100=50 AND ({x})//100%2=1) THEN 1 ELSE 0 END)::INT"


TIER_SQL = "CASE " + " ".join(
    f"ELSE '{n}'" if cut is None else f"WHEN rank_median<={cut!r}" + f" AND rank_lo<={LEADING_LOW}" * (i == 0) + f" THEN '{n}'" for i, (n, cut) in enumerate(TIERS)) + " END"
NOISE = f"""ed AS (SELECT *, 'e'||period AS edition, {comp_sql(MODEL.weights)} AS base FROM norm),
dr AS (SELECT edition, rep, entity, base+""" + "+".join(
    f"{MODEL.weights[k]!r}*({rho!r}*coalesce({k},0)+{(1 - rho * rho) ** 0.5!r}*{_eps(k)}-coalesce({k},0))" for k, rho in RHO.items()) + f""" AS s FROM ed, range({B}) g(rep)),
rkk AS (SELECT edition, entity, row_number() OVER (PARTITION BY edition, rep ORDER BY s DESC, entity) AS k FROM dr),
kss AS (SELECT edition, entity, list_sort(list(k)) AS ks FROM rkk GROUP BY ALL),
iv0 AS (SELECT edition, entity, {half_even_sql(hundredths_sql(5))} AS rank_lo, {hundredths_sql(50)}/100.0::DOUBLE AS rank_median, {half_even_sql(hundredths_sql(95))} AS rank_hi FROM kss),
iv AS (SELECT *, {TIER_SQL} AS tier FROM iv0)"""


def intervals(t, bound=None):
    """Of every edition."""
    ed = t.norm.withColumn("edition", F.concat(F.lit("e"), "period"))
    ranks = rs_.noisy_ranks(ed, composite(MODEL.weights), RHO, MODEL.weights, B, bound=t.bound if bound is None else bound)
    return rs_.rank_intervals(ranks)


@query("rank_intervals", with_parts("SELECT edition, entity, rank_lo, rank_median, rank_hi, tier FROM iv", "norm", extra=NOISE))
def rank_intervals(t):
    return intervals(t)


@query("rank_intervals_split", with_parts("SELECT edition, entity, rank_lo, rank_median, rank_hi, tier FROM iv", "norm", extra=NOISE))
def rank_intervals_split(t):
    return intervals(t, 1 << 40)


@query("tier_counts", with_parts("SELECT edition, tier, count(*) AS n_entities, CASE tier " + " ".join(f"WHEN '{n}' THEN {i + 1}" for i, (n, _) in enumerate(TIERS)) + " END::INT AS tier_order FROM iv GROUP BY ALL", "norm", extra=NOISE))
def tier_counts(t):
    return rs_.tier_counts(intervals(t))


PICK = BITS.format(m="'pick:'||seed||':'||entity||':'||period", p=1)


@query("random_edge", with_parts(f"SELECT horizon, period, {r('avg((b-mid)*100)', 'random_edge_pp')} FROM (SELECT horizon, period, seed, avg(realized) AS b FROM (SELECT *, row_number() OVER (PARTITION BY horizon, period, seed ORDER BY {PICK}, entity) AS k FROM outcome, range(50) g(seed)) WHERE k<=10 GROUP BY ALL) JOIN (SELECT horizon, period, median(realized) AS mid FROM outcome GROUP BY ALL) USING (horizon, period) GROUP BY horizon, period", "outcome"))
def random_edge(t):
    return rounded_all(rs_.random_edge(outcome(t), 50, 10, bound=t.bound), ["random_edge_pp"])


# ---- gates -------------------------------------------------------------------------------------

CANDS = {"density": ("population", 1), "pay": ("avg_pay", -1)}
AUG = {"full": "score"} | {f"{n}@{w:g}": f"{1 - w!r}*score+{w!r}*coalesce({n},0)*turn_{n}" for n in CANDS for w in (0.05, 0.1)}
CAND_SQL = f"""cz AS (SELECT entity, period, {', '.join(z_sql(c, s, 'period', True) + ' AS ' + n for n, (c, s) in CANDS.items())} FROM panel),
nc AS (SELECT n.*, {', '.join('c.' + n for n in CANDS)} FROM norm n LEFT JOIN cz c USING (entity, period)),
{strategies_sql({n: n for n in CANDS}, 'nc')}, {WF}, {metrics_sql('wf', G)},
alone AS (SELECT strategy AS candidate, abs(avg(weighted_tau)) AS standalone_tau, avg(weighted_tau)<0 AS flipped FROM metrics GROUP BY strategy),
mc AS ({' UNION ALL '.join(f"SELECT '{n}' AS candidate, greatest({', '.join(f'abs(corr({n},{k}))' for k in MODEL.names)}) AS max_abs_corr FROM nc" for n in CANDS)}),
src AS (SELECT entity, period, {comp_sql(MODEL.weights)} AS score, {', '.join(CANDS)}, {', '.join(f"(SELECT CASE WHEN flipped THEN -1.0 ELSE 1.0 END FROM alone WHERE candidate='{n}') AS turn_{n}" for n in CANDS)} FROM nc)"""
GATE = OUT3 + ",\n" + CAND_SQL + ",\n" + frame_sql(AUG, ranked=strategies_sql(AUG, "src", "ranked2")).replace("FROM ranked JOIN", "FROM ranked2 JOIN") + ",\n" + drawn_sql("frame", GATE_B) + ",\n" + boot_sql() + ",\n" + gaps_sql("(SELECT * FROM point WHERE strategy='full')") + """,
gate AS (SELECT a.candidate, split_part(g.strategy,'@',2)::DOUBLE AS weight, -gap AS delta_tau, -gap_hi AS delta_lo, -gap_lo AS delta_hi, standalone_tau, flipped, max_abs_corr,
  standalone_tau>0.10 AND max_abs_corr<0.70 AND -gap_hi>0 AS adopt FROM gaps g JOIN alone a ON a.candidate=split_part(g.strategy,'@',1) JOIN mc ON mc.candidate=a.candidate WHERE g.strategy<>'full')"""
GATEC = ["delta_tau", "delta_lo", "delta_hi", "standalone_tau", "max_abs_corr"]


def gate(t):
    cand = gates.candidate_scores(t.panel, CANDS, t.bound)
    return gates.candidate_gate(t.norm, cand, list(CANDS), MODEL, outcome(t, [3]), periods(t), (0.05, 0.1), GATE_B, t.bound)


@query("candidate_gate", with_parts(f"SELECT candidate, weight, flipped, adopt, {rs(*GATEC)} FROM gate", "usable", extra=GATE), stage=True)
def candidate_gate(t):
    return rounded_all(gate(t), GATEC)


@query("candidate_correlations", with_parts(f"SELECT candidate, place, indicator, {r('corr')} FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY abs(corr) DESC, indicator)::INT AS place FROM pc WHERE corr IS NOT NULL) WHERE place<=3",
                                           "norm", extra=f"""cz AS (SELECT entity, period, {', '.join(z_sql(c, s, 'period', True) + ' AS ' + n for n, (c, s) in CANDS.items())} FROM panel),
nc AS (SELECT n.*, {', '.join('c.' + n for n in CANDS)} FROM norm n LEFT JOIN cz c USING (entity, period)),
pc AS ({' UNION ALL '.join(f"SELECT '{n}' AS candidate, '{k}' AS indicator, corr({n},{k}) AS corr FROM nc" for n in CANDS for k in MODEL.names)})"""), stage=True)
def candidate_correlations(t):
    cand = gates.candidate_scores(t.panel, CANDS, t.bound)
    return rounded_all(gates.candidate_correlations(t.norm, cand, list(CANDS), MODEL), ["corr"])


@query("conjunctive_verdict", with_parts("SELECT coalesce((SELECT 'add:'||min(candidate) FROM (SELECT candidate FROM gate GROUP BY candidate HAVING bool_and(adopt))), 'reject all') AS verdict", "usable", extra=GATE), stage=True)
def conjunctive_verdict(t):
    replacement = t.spark.createDataFrame([("variant", False)], "name string, pass boolean")
    return gates.conjunctive_verdict(gate(t), sorted(CANDS), replacement)


@query("candidate_frames", with_parts(f"SELECT candidate, entity, period, {r('cand')} FROM (SELECT 'level' AS candidate, entity, period, permits_mf AS cand FROM customer_panel UNION ALL SELECT 'change', p.entity, p.period, p.rent-q.rent FROM customer_panel p JOIN customer_panel q ON q.entity=p.entity AND q.period=p.period-1)", "customer_panel"))
def candidate_frames(t):
    return rounded_all(gates.guarded_candidates(t.customer_panel, {"level": "permits_mf"}, {"change": "rent"}), ["cand"])


@query("coverage_kill_rule", with_parts("""SELECT measure, coalesce(min(CASE WHEN n>0 THEN n END),0) AS min_covered, count(CASE WHEN n>0 THEN 1 END) AS periods_with_data, count(*) AS periods_total,
  count(CASE WHEN n>0 THEN 1 END)>0 AND coalesce(min(CASE WHEN n>0 THEN n END),0)>=100 AS ok FROM (SELECT 'job_growth' AS measure, period, count(job_growth) AS n FROM ind GROUP BY period UNION ALL SELECT 'odd', period, count(CASE WHEN entity%2=1 THEN 1 END) FROM ind GROUP BY period) GROUP BY measure""", "ind"))
def coverage_kill_rule(t):
    return gates.coverage_kill(t.ind.withColumn("odd", F.when(F.col("entity") % 2 == 1, 1.0)), ["job_growth", "odd"], 100)


VARIANT = {"current": comp_sql(MODEL.weights), "variant": comp_sql(MODEL.weights, "v_")}
_T = "CASE WHEN count({c}) OVER w>=2 THEN avg({c}) OVER w END AS {c}"
VAR_SQL = ("vind AS (SELECT entity, period, " + ", ".join(_T.format(c=k) if k in ("job_growth", "income_growth") else k for k in MODEL.names)
           + " FROM ind WINDOW w AS (PARTITION BY entity ORDER BY period RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),\nvnorm AS (SELECT entity, period, "
           + ", ".join(f"{z_sql(k, MODEL.signs[k])} AS v_{k}" for k in MODEL.names) + " FROM vind),\nboth2 AS (SELECT * FROM norm JOIN vnorm USING (entity, period))")


def variant_norm(t):
    from paneltide.plans.scoring import normalised
    return normalised(with_trailing_means(t.ind, ["job_growth", "income_growth"]), MODEL, t.bound)


def both_norms(t):
    v = variant_norm(t)
    v = v.select("entity", "period", *[F.col(k).alias(f"v_{k}") for k in MODEL.names])
    return t.norm.join(v, ["entity", "period"])


@query("variant_prong_a", with_parts(f"SELECT strategy, {r('tau', 'tau_variant')}, {r('tau+gap', 'tau_current')}, {r('-gap', 'gap')}, {r('-gap_hi', 'gap_lo')}, {r('-gap_lo', 'gap_hi')}, gap_lo<=0 AS pass FROM gaps WHERE strategy='variant'", "usable",
       extra=OUT3 + ",\n" + VAR_SQL + ",\n" + frame_sql(VARIANT, "both2") + ",\n" + drawn_sql("frame", GATE_B) + ",\n" + boot_sql() + ",\n" + gaps_sql("(SELECT * FROM point WHERE strategy='current')")), stage=True)
def variant_prong_a(t):
    weights = {f"v_{k}": w for k, w in MODEL.weights.items()}
    f = frame(t, {"current": composite(MODEL.weights), "variant": composite(weights)}, both_norms(t))
    point, reps = rs_.bootstrap(f, GATE_B, bound=t.bound)
    v = gates.variant_verdict(rs_.paired_gaps(point, reps, "current"), "variant")
    return rounded_all(v, ["tau_variant", "tau_current", "gap", "gap_lo", "gap_hi"])


PAIR_SQL = f"""(SELECT corr(a,b)>=0.80 FROM (SELECT {_avg_rank('x.score', '1')} AS a, {_avg_rank('y.score', '1')} AS b FROM (SELECT entity, period, {VARIANT['variant']} AS score FROM both2) x
  JOIN (SELECT entity, period, {VARIANT['variant']} AS score FROM both2) y ON y.entity=x.entity AND y.period=x.period+1 WHERE y.period=(SELECT max(period) FROM both2)))"""
REPLACES = "(WITH " + VAR_SQL + ",\n" + frame_sql(VARIANT, "both2") + ",\n" + drawn_sql("frame", GATE_B) + ",\n" + boot_sql() + ",\n" + gaps_sql("(SELECT * FROM point WHERE strategy='current')") \
    + f"\nSELECT gap_hi<0 AND {PAIR_SQL} FROM gaps WHERE strategy='variant')"


@query("replacement_verdict", with_parts(f"SELECT CASE WHEN {REPLACES} THEN 'replace:variant' ELSE coalesce((SELECT 'add:'||min(candidate) FROM (SELECT candidate FROM gate GROUP BY candidate HAVING bool_and(adopt))), 'reject all') END AS verdict",
                                         "usable", extra=GATE), stage=True)
def replacement_verdict(t):
    """The replacement comes from its own two gates: reliably better windows, and its last two editions agree."""
    weights = {f"v_{k}": w for k, w in MODEL.weights.items()}
    norms = both_norms(t)
    point, reps = rs_.bootstrap(frame(t, {"current": composite(MODEL.weights), "variant": composite(weights)}, norms), GATE_B, bound=t.bound)
    better = gates.variant_verdict(rs_.paired_gaps(point, reps, "current"), "variant", "better")
    scores = norms.select("entity", "period", composite(weights).alias("score"))
    last = scores.agg(F.max("period")).scalar()
    stable = gates.edition_stability(scores.filter(F.col("period") == last - 1), scores.filter(F.col("period") == last), bound=t.bound)
    return gates.conjunctive_verdict(gate(t), sorted(CANDS), gates.replacement(better, stable, "variant"))


@query("edition_stability", with_parts(f"SELECT count(*) AS n, {r('corr(a,b)', 'rho')}, corr(a,b)>=0.80 AS pass FROM (SELECT {_avg_rank('x.score', '1')} AS a, {_avg_rank('y.score', '1')} AS b FROM (SELECT * FROM scored WHERE period=1999) x JOIN (SELECT * FROM scored WHERE period=2000) y USING (entity))", "scored"), stage=True)
def edition_stability(t):
    return rounded_all(gates.edition_stability(t.scored.filter("period = 1999"), t.scored.filter("period = 2000"), bound=t.bound), ["rho"])


PROXY = {"final": comp_sql(MODEL.weights), "proxy": comp_sql({k: w for k, w in MODEL.weights.items() if k != "job_growth"})}
AGREE = f"""sc AS (SELECT entity, period, {PROXY['final']} AS a, {PROXY['proxy']} AS b FROM norm),
ag AS (SELECT period, count(*) AS n, corr(ra,rb) AS rho, count(*) FILTER (ka<=10 AND kb<=10)::INT AS overlap FROM (SELECT period, {_avg_rank('a')} AS ra, {_avg_rank('b')} AS rb,
  row_number() OVER (PARTITION BY period ORDER BY a DESC, entity) AS ka, row_number() OVER (PARTITION BY period ORDER BY b DESC, entity) AS kb FROM sc) GROUP BY period HAVING count(*)>=10)"""


def _proxy_cols():
    return {"final": composite(MODEL.weights), "proxy": composite({k: w for k, w in MODEL.weights.items() if k != "job_growth"})}


def agreed(t):
    cols = _proxy_cols()
    a = t.norm.select("entity", "period", cols["final"].alias("score"))
    return gates.agreement(a, t.norm.select("entity", "period", cols["proxy"].alias("score")), bound=t.bound)


@query("agreement_per_period", with_parts(f"SELECT period, n, {r('rho')}, overlap FROM ag", "norm", extra=AGREE), stage=True)
def agreement_per_period(t):
    return rounded_all(agreed(t), ["rho"])


PSUM = strategies_sql(PROXY) + ",\n" + WF + ",\n" + metrics_sql("wf", G) + ",\n" + summary_sql()


@query("retention_gate", with_parts(f"SELECT {r('f', 'tau_final')}, {r('p', 'tau_proxy')}, {r('mo', 'mean_overlap')}, {r('p/nullif(f,0)', 'retention')}, p/nullif(f,0)>=0.85 AND mo>=7 AS pass FROM (SELECT max(CASE WHEN strategy='final' THEN mean_tau END) AS f, max(CASE WHEN strategy='proxy' THEN mean_tau END) AS p FROM summ WHERE horizon=3 AND regime='POOLED'), (SELECT avg(overlap) AS mo FROM ag WHERE period IN (SELECT period FROM usable))",
                                    "usable", "outcome", extra=AGREE + ",\n" + PSUM), stage=True)
def retention_gate(t):
    summ = wf.summarise(evaluated(t, rk.strategies(t.norm, _proxy_cols())))
    g = gates.retention_gate(summ, agreed(t).join(periods(t), "period", "left_semi"), "final", "proxy", 3)
    return rounded_all(g, ["tau_final", "tau_proxy", "mean_overlap", "retention"])


@query("side_by_side_summary", with_parts(f"SELECT a.horizon, a.regime, {r('a.mean_tau', 'mean_tau_a')}, {r('a.mean_precision', 'mean_precision_a')}, {r('b.mean_tau', 'mean_tau_b')}, {r('b.mean_precision', 'mean_precision_b')} FROM summ a JOIN summ b ON a.horizon=b.horizon AND a.regime=b.regime WHERE a.strategy='final' AND b.strategy='proxy'",
                                          "usable", "outcome", extra=PSUM), stage=True)
def side_by_side_summary(t):
    summ = wf.summarise(evaluated(t, rk.strategies(t.norm, _proxy_cols())))
    return rounded_all(gates.side_by_side(summ, "final", "proxy"), ["mean_tau_a", "mean_precision_a", "mean_tau_b", "mean_precision_b"])


LOSS = {f"final:{k}": comp_sql({n: w for n, w in MODEL.weights.items() if n in keep}) for k, keep in {
    "none": ["trailing_rent_growth", "cost_to_own_vs_rent"], "jobs": ["trailing_rent_growth", "cost_to_own_vs_rent", "job_growth"],
    "migration": ["trailing_rent_growth", "cost_to_own_vs_rent", "net_migration"], "all": MODEL.names}.items()}


@query("composite_subsets", with_parts(f"SELECT strategy, {r('avg(weighted_tau)', 'tau')} FROM metrics WHERE horizon=3 GROUP BY strategy", "usable", "outcome", extra=strategies_sql(LOSS) + ",\n" + WF + ",\n" + metrics_sql("wf", G)), stage=True)
def composite_subsets(t):
    keep = {"none": ["trailing_rent_growth", "cost_to_own_vs_rent"], "jobs": ["trailing_rent_growth", "cost_to_own_vs_rent", "job_growth"],
            "migration": ["trailing_rent_growth", "cost_to_own_vs_rent", "net_migration"], "all": MODEL.names}
    cols = {f"final:{k}": composite({n: w for n, w in MODEL.weights.items() if n in names}) for k, names in keep.items()}
    m = evaluated(t, rk.strategies(t.norm, cols), [3]).groupBy("strategy").agg(F.avg("weighted_tau").alias("tau"))
    return rounded_all(m, ["tau"])


@query("category_index_gap", with_parts(f"SELECT strategy, reference, {rs(*GAPC)}, gap_lo>0 OR gap_hi<0 AS excludes_zero, gap_lo>0 AS reliably_worse FROM gaps", "usable",
       extra=OUT3 + ",\n" + CAT_SQL + ",\n" + frame_sql({"full": "", "category_index": ""}, ranked=strategies_sql(FULL, name="r0") + ",\nranked AS (SELECT * FROM r0 UNION ALL SELECT 'category_index', entity, period, score FROM cat)")
       + ",\n" + drawn_sql("frame", GATE_B) + ",\n" + boot_sql() + ",\n" + gaps_sql("(SELECT * FROM point WHERE strategy='full')")), stage=True)
def category_index_gap(t):
    ranking = rk.strategies(t.norm, rk.full_model(MODEL)).unionByName(category(t))
    f = wf.outcome_frame(ranking, outcome(t, [3]), 2, periods(t), t.bound)
    point, reps = rs_.bootstrap(f, GATE_B, bound=t.bound)
    return rounded_all(rs_.paired_gaps(point, reps, "full"), GAPC)
