"""Order statistics and the rank correlation against brute force, in both plans."""
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.operators import concordance, growth, match, order
from paneltide.operators.concordance import weighted_tau
from paneltide.scale import largest_group


def _frame(spark, n=60, groups=3, seed=5, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        for e in range(n):
            x = None if rng.random() < 0.05 else (0.0 if rng.random() < hot else round(rng.gauss(0, 1), 1))
            y = 0.25 if rng.random() < hot else round(rng.gauss(0, 1), 2)
            rows.append((g, e, x, y, rng.choice([1, 1, 2, 4])))
    return spark.createDataFrame(rows, "g int, e int, x double, y double, m int")


def brute_tau(p):
    p = p.sort_values(["y", "e"], ascending=[False, True])
    xs, ys, ws, start = [], [], [], 0
    for _, r in p.iterrows():
        for _k in range(int(r.m)):
            xs.append(r.x), ys.append(r.y), ws.append(1.0 / (start + 1))
            start += 1
    num = dx = dy = 0.0
    for i in range(len(xs)):
        for j in range(i):
            w = ws[i] + ws[j]
            sx, sy = np.sign(xs[i] - xs[j]), np.sign(ys[i] - ys[j])
            num += w * sx * sy
            dx += w * (sx != 0)
            dy += w * (sy != 0)
    return num / math.sqrt(dx * dy) if dx * dy else None


def _check_all(spark):
    df = _frame(spark)
    pdf = df.toPandas()
    got = order.add_ranks(df, ["g"], "x", low="lo", average="av", percent="pc").toPandas().sort_values(["g", "e"])
    want = pdf.sort_values(["g", "e"])
    by = want.groupby("g")["x"]
    np.testing.assert_allclose(got.lo.astype(float), by.rank(ascending=False, method="min"))
    np.testing.assert_allclose(got.av, by.rank(ascending=False))
    np.testing.assert_allclose(got.pc, by.rank(ascending=False, pct=True) * 100)
    q = order.quantiles(df, ["g"], "x", {"a": 0.01, "b": 0.5, "c": 0.99}).toPandas().set_index("g").sort_index()
    for name, p in (("a", 0.01), ("b", 0.5), ("c", 0.99)):
        np.testing.assert_allclose(q[name], by.quantile(p))
    w = order.winsorise(df, ["g"], "x", (0.05, 0.9), out="w").toPandas().sort_values(["g", "e"])
    np.testing.assert_allclose(w.w, by.transform(lambda s: s.clip(s.quantile(0.05), s.quantile(0.9))))
    pos = order.add_positions(df, ["g"], [F.col("y").desc(), F.col("e")], "p").toPandas()
    pos = pos.sort_values(["g", "y", "e"], ascending=[True, False, True])
    assert (pos.groupby("g").cumcount() + 1 == pos.p).all()
    pre = order.add_prefix_sum(df, ["g"], [F.col("y").desc(), F.col("e")], F.col("m"), "s").toPandas()
    pre = pre.sort_values(["g", "y", "e"], ascending=[True, False, True])
    np.testing.assert_allclose(pre.s, pre.groupby("g").m.cumsum() - pre.m)
    full = df.filter("x is not null")
    for copies in (None, "m"):
        tau = weighted_tau(full, ["g"], "x", "y", "e", copies=copies).toPandas().set_index("g").tau
        for g, p in full.toPandas().groupby("g"):
            assert tau[g] == pytest.approx(brute_tau(p if copies else p.assign(m=1)), abs=1e-12)


def test_one_task_plans(spark):
    _check_all(spark)


def test_split_plans(spark, split_plans):
    _check_all(spark)


def test_tau_extremes(spark):
    df = spark.createDataFrame([(0, e, float(e), float(-e)) for e in range(20)], "g int, e int, x double, y double")
    assert weighted_tau(df, ["g"], "x", "x", "e").first().tau == pytest.approx(1.0)
    assert weighted_tau(df, ["g"], "x", "y", "e").first().tau == pytest.approx(-1.0)
    flat = df.withColumn("x", F.lit(1.0))
    assert weighted_tau(flat, ["g"], "x", "y", "e").first().tau is None


@pytest.fixture
def keyed(spark):
    """A NULL group key, NULL values and ties."""
    rows = [(None if i % 3 == 0 else i % 3, float(i % 5) if i % 7 else None, i) for i in range(60)]
    return spark.createDataFrame(rows, "g int, v double, id int")


def both_plans(fn):
    return [sorted(map(str, fn(bound).collect())) for bound in (1, 10 ** 9)]


def test_null_groups_are_groups_in_both_plans(keyed):
    wide, narrow = both_plans(lambda b: order.add_ranks(keyed, ["g"], "v", low="lo", average="av", percent="pc", bound=b).select("g", "v", "id", "lo", "av", "pc"))
    assert wide == narrow and len(wide) == 60
    wide, narrow = both_plans(lambda b: order.add_prefix_sum(keyed, ["g"], [F.col("id")], F.lit(1.0), "s", b).select("g", "id", "s"))
    assert wide == narrow and len(wide) == 60
    wide, narrow = both_plans(lambda b: order.quantiles(keyed, ["g"], "v", {"q": 0.5}, b))
    assert wide == narrow and len(wide) == 3
    wide, narrow = both_plans(lambda b: order.winsorise(keyed, ["g"], "v", (0.2, 0.8), "w", b).select("g", "v", "id", "w"))
    assert wide == narrow and len(wide) == 60


@pytest.mark.parametrize("n", [110, 1000])
def test_constant_side_is_null_in_both_plans(spark, n):
    rows = spark.range(n).selectExpr("cast(null as int) as g", "1.5D as score", "cast(id as double) as outcome", "id")
    for bound in (1, 10 ** 9):
        got = weighted_tau(rows, ["g"], "score", "outcome", "id", bound=bound).collect()
        assert len(got) == 1 and got[0][-1] is None


def test_quantiles_between_brackets_equal_brute_force(spark):
    """Groups beyond the size of the brackets: ties, a geometric spread, few rows, no values at all, a NULL key."""
    rng = np.random.default_rng(3)
    frames = {1: rng.normal(size=30_000), 2: np.round(rng.normal(size=20_000), 1), 3: 10.0 ** rng.integers(-200, 200, 9_000),
              4: np.full(6_000, 2.5), 5: np.array([3.0, 1.0])}
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in frames.items()])
    df = spark.createDataFrame(pdf, "g int, v double").unionByName(spark.sql("SELECT 6 AS g, cast(null AS double) AS v")).withColumn(
        "g", F.when(F.col("g") != 2, F.col("g")))
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.5004, "e": 0.999, "f": 1.0}
    got = {r.g: r for r in order.quantiles(df, ["g"], "v", probs, bound=1 << 40).collect()}
    assert set(got) == {1, None, 3, 4, 5, 6} and all(got[6][n] is None for n in probs)
    for g, v in frames.items():
        for name, p in probs.items():
            assert got[None if g == 2 else g][name] == pytest.approx(float(np.quantile(v, p)), rel=1e-12), (g, name)
    plan = order._selected(df, ["g"], "v", probs)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_lines_are_carried_across_slices(spark, split_plans):
    """One entity with most of the facts; NULL values, a NULL key, ties of cut and fact, cuts before the first fact."""
    rng = random.Random(8)
    facts = [(None if e == 2 else e, t, None if rng.random() < 0.4 else float(rng.randrange(1000))) for e, n in ((1, 300), (2, 40), (3, 3)) for t in range(5, 5 + n)]
    cuts = sorted({(e, rng.randrange(0, 310)) for e in (1, 3, 4) for _ in range(60)})
    df = spark.createDataFrame(facts, "entity int, period int, x double")
    asks = spark.createDataFrame(cuts, "entity int, cut int")
    for inclusive in (False, True):
        got = {(r.entity, r.cut): r.x for r in match.as_of(asks, df, "x", inclusive=inclusive).collect()}
        assert len(got) == len(cuts)
        for e, c in cuts:
            known = [(t, x) for k, t, x in facts if k == e and x is not None and (t <= c if inclusive else t < c)]
            assert got[(e, c)] == (max(known)[1] if known else None)
    wide = sorted(map(str, growth.filled(df, "x", "y").select("entity", "period", "y").collect()))
    assert wide == sorted(map(str, df.select("entity", "period", growth.filled_from_neighbours("x").alias("y")).collect()))


def test_a_tied_score_does_not_fill_one_window(spark):
    """Half of the rows share one score: blocks are cut by their rows, so no stretch holds more than a task may."""
    rows = spark.range(3000).selectExpr("1 as g", "cast(if(id % 2 = 0, 7, id) as double) as x", "cast((id * 7919) % 3001 as double) as y", "id as e")
    spark.conf.set("spark.paneltide.maxTaskRows", "100")
    try:
        got = weighted_tau(rows, ["g"], "x", "y", "e").first().tau
        named = rows.selectExpr("g", "x as _x", "y as _y", "e as _tie", "1L as _m")
        cells = concordance._stretches(concordance._digits(concordance._codes_wide(named, ["g"]), ["g"]), ["g"])
        assert largest_group(cells, ["g", "_level", "_block", "_stretch"]) <= 100
    finally:
        spark.conf.unset("spark.paneltide.maxTaskRows")
    assert got == pytest.approx(weighted_tau(rows, ["g"], "x", "y", "e", bound=3000).first().tau, abs=1e-12)
