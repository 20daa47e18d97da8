"""Null, tie and gap rules of the panel operators on hand-written tables."""
import json

import pytest
from pyspark.sql import functions as F

from paneltide.functions import scalar
from paneltide.operators import clean, growth, match, reshape, rollup, stats
from paneltide.sources import readers


def rows(df, *keys):
    return sorted(tuple(r[k] for k in keys) for r in df.collect())


@pytest.fixture(scope="module")
def panel(spark):
    # entity a has no period 3; b has a NULL and a zero level
    return spark.createDataFrame(
        [("a", 1, 10.0), ("a", 2, 12.0), ("a", 4, 18.0), ("a", 5, 9.0), ("b", 1, 0.0), ("b", 2, 5.0), ("b", 3, None), ("b", 4, 6.0)],
        "entity string, period int, x double")


def by_key(df, col):
    return {(r.entity, r.period): r[col] for r in df.collect()}


def test_growth_never_jumps_a_gap(panel):
    g = by_key(panel.withColumn("g", growth.exact_growth("x")), "g")
    assert g[("a", 2)] == pytest.approx(0.2) and g[("a", 5)] == pytest.approx(-0.5)
    assert g[("a", 4)] is None and g[("b", 2)] is None and g[("b", 3)] is None and g[("b", 4)] is None
    adjacent = by_key(panel.withColumn("g", growth.adjacent_growth("x")), "g")
    assert adjacent[("a", 4)] == pytest.approx(0.5)
    assert by_key(panel.withColumn("g", growth.forward_growth("x", 2)), "g")[("a", 2)] == pytest.approx(0.5)
    assert by_key(panel.withColumn("g", growth.forward_growth("x", 1)), "g")[("b", 1)] is None
    assert rows(growth.guarded_change(panel, "x", "d", "difference"), "entity", "period", "d") == [
        ("a", 2, 2.0), ("a", 5, -9.0), ("b", 2, 5.0)]


def test_trailing_mean_needs_two_parts(panel):
    m = by_key(panel.withColumn("m", growth.trailing_mean("x")), "m")
    assert m[("a", 1)] is None and m[("a", 2)] == 11.0 and m[("a", 4)] == 15.0 and m[("b", 4)] == 5.5


def test_carry_looks_strictly_back(panel):
    c = by_key(panel.withColumn("c", growth.carried("x")), "c")
    assert c[("a", 1)] is None and c[("a", 4)] == 12.0 and c[("b", 4)] == 5.0
    assert by_key(panel.withColumn("c", growth.carried("x", -2)), "c")[("a", 5)] == 12.0


def test_fill_both_ways(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 3.0), ("a", 3, None), ("b", 1, None)], "entity string, period int, x double")
    assert by_key(df.withColumn("f", growth.filled_from_neighbours("x")), "f") == {("a", 1): 3.0, ("a", 2): 3.0, ("a", 3): 3.0, ("b", 1): None}


def test_backcast_telescopes_and_stops_at_a_hole(spark):
    anchor = spark.createDataFrame([("a", 5, 100.0), ("b", 5, 100.0)], "entity string, period int, v double")
    legacy = spark.createDataFrame([("a", 3, 40.0), ("a", 4, 50.0), ("a", 5, 80.0), ("b", 3, 40.0), ("b", 4, None), ("b", 5, 80.0)],
                                   "entity string, period int, w double")
    got = by_key(growth.backcast(anchor, legacy, 5, "v", "w"), "v")
    assert got[("a", 4)] == pytest.approx(62.5) and got[("a", 3)] == pytest.approx(50.0)
    assert got[("b", 4)] is None and got[("b", 3)] is None


def test_two_z_scores_differ_on_flat_groups(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, None), (2, 1.0), (2, 3.0), (2, None), (3, None)], "period int, x double")
    pop = rows(stats.zscores(df, ["period"], {"z": "x"}).na.fill(-9.0, ["z"]), "period", "z")
    assert pop == [(1, 0.0), (1, 0.0), (1, 0.0), (2, -9.0), (2, -1.0), (2, 1.0), (3, -9.0)]
    sample = stats.zscores(df, ["period"], {"z": "x"}, sample=True)
    assert sample.filter("period = 1 AND z IS NOT NULL").count() == 0
    assert sample.filter("period = 2").agg(F.max("z")).first()[0] == pytest.approx(2 ** -0.5)


def test_split_z_scores_agree(spark, split_plans):
    df = spark.range(40).selectExpr("int(id % 2) AS period", "double(id * id % 17) AS x")
    split = [z for _, z in rows(stats.zscores(df, ["period"], {"z": "x"}), "period", "z")]
    plain = [z for _, z in rows(stats.zscores(df, ["period"], {"z": "x"}, bound=1), "period", "z")]
    assert split == pytest.approx(plain)


def test_spearman_minimum_and_partial(spark):
    df = spark.createDataFrame([(1, float(i), float(i * i), float((i * 7) % 11)) for i in range(11)], "period int, a double, b double, c double")
    assert stats.spearman(df, ["period"], "a", "b").first().rho == pytest.approx(1.0)
    assert stats.spearman(df, ["period"], "a", "b", at_least=12).first().rho is None
    got = stats.rank_orthogonality(df, ["period"], "a", "c", "b").first()
    assert got.partial_spearman == pytest.approx(1.0) and got.error_correlation is None


def test_dedup_keeps_identical_and_refuses_conflicts(spark):
    same = spark.createDataFrame([("k", 1.0), ("k", 1.0), ("m", None)], "k string, v double")
    assert clean.dedup_checked(same, ["k"], ["v"]).count() == 2
    bad = spark.createDataFrame([("k", 1.0), ("k", 2.0)], "k string, v double")
    with pytest.raises(Exception, match="conflicting duplicates"):
        clean.dedup_checked(bad, ["k"], ["v"]).collect()


def test_gap_free_runs(panel):
    assert clean.gap_free(panel).count() == 0
    assert rows(clean.gap_free(panel.filter("period <= 4")), "entity") == [("b",)]
    assert clean.gap_free(panel.filter("period <= 4"), latest_start=0).count() == 0


def test_titles_match_in_city_order(spark):
    titles = spark.createDataFrame([(1, "Alpha-Beta/Gamma, XX-YY"), (2, "Delta, ZZ"), (3, "No comma")], "entity int, title string")
    places = spark.createDataFrame([(10, "gamma", "XX"), (11, "Beta", "yy"), (12, "Delta", "XX")], "place int, city string, state string")
    got = match.match_any_place(titles, places, "entity", "title", "place", "city", "state")
    assert {r.entity: r.place for r in got.collect()} == {1: 11, 2: None, 3: None}
    assert titles.select(scalar.primary_state("title").alias("s")).first().s == "XX"


def test_as_of_join_strict_and_inclusive(spark, panel):
    cuts = spark.createDataFrame([("a", 2), ("a", 9), ("b", 3), ("c", 5)], "entity string, cut int")
    got = lambda **k: {(r.entity, r.cut): r.x for r in match.as_of(cuts, panel, "x", **k).collect()}
    assert got() == {("a", 2): 10.0, ("a", 9): 9.0, ("b", 3): 5.0, ("c", 5): None}
    assert got(inclusive=True)[("a", 2)] == 12.0


def test_complete_membership(spark):
    members = spark.createDataFrame([("x", "P"), ("y", "P"), ("z", "Q")], "child string, parent string")
    facts = spark.createDataFrame([("x", 1, 1.0), ("y", 1, 2.0), ("x", 2, 1.0), ("z", 2, None)], "child string, period int, v double")
    got = rollup.complete_membership_sum(facts, members, "child", "parent", "v", [1, 2])
    assert {(r.parent, r.period): r.v for r in got.collect()} == {("P", 1): 3.0, ("P", 2): None, ("Q", 1): None, ("Q", 2): None}


def test_roll_up_refuses_unknown_reducers(spark, panel):
    with pytest.raises(ValueError):
        rollup.roll_up(panel, panel, "entity", ["period"], ["x"], "mode")
    with pytest.raises(ValueError):
        rollup.collapse(panel, ["entity"], "period", "x", "first")


def test_pooled_rows_do_not_mix_with_null_labels(spark):
    df = spark.createDataFrame([(1, "u", 1.0), (1, "v", 3.0), (1, None, 5.0)], "h int, regime string, t double")
    got = rollup.pooled_summary(df, ["h"], "regime", [F.avg("t").alias("m")])
    assert {r.regime: r.m for r in got.collect()} == {"u": 1.0, "v": 3.0, None: 5.0, "POOLED": 3.0}


def test_net_flow_one_sided_keys(spark):
    a = spark.createDataFrame([("x", 3), ("y", 2)], "k string, n int")
    b = spark.createDataFrame([("y", 5), ("z", 1)], "k string, n int")
    assert rows(rollup.net_flow(a, b, ["k"], ["n"]), "k", "net_n") == [("x", 3), ("y", -3), ("z", -1)]


def test_share_and_concentration(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", -2.0)], "cell string, v double")
    got = df.agg(rollup.concentration("v").alias("h"), rollup.set_share("v", F.col("cell") == "zz").alias("s")).first()
    assert got.h == pytest.approx(10 / 16) and got.s is None


def test_spine_and_family(spark):
    ents = spark.createDataFrame([("a",)], "entity string")
    assert rows(reshape.spine(ents, 3, 5), "entity", "period") == [("a", 3), ("a", 4), ("a", 5)]
    wide = spark.createDataFrame([("a", 1.0, 2.0, 9.0)], "entity string, POP2020 double, POP2021 double, POPX double")
    assert rows(reshape.unpivot_family(wide, ["entity"], "POP", "pop"), "period", "pop") == [(2020, 1.0), (2021, 2.0)]


def test_scalars(spark):
    df = spark.createDataFrame([("1,234", 100000.0, 6.0)], "s string, v double, r double")
    got = df.select(scalar.text_to_double("s").alias("n"), scalar.annuity_payment("v", "r").alias("p"),
                    scalar.annuity_payment("v", F.lit(0.0)).alias("p0"), scalar.stable_id(F.lit("c"), F.lit("e"), F.lit(2020), F.lit("m")).alias("i"),
                    scalar.text_to_double(F.lit("(NA)")).alias("bad"), scalar.area_code(F.lit("1"), F.lit("7")).alias("code")).first()
    import hashlib
    assert got.n == 1234.0 and got.p == pytest.approx(599.55, abs=0.01) and got.p0 == pytest.approx(100000 / 360)
    assert got.i == hashlib.sha1(b"c|e|2020|m").hexdigest()[:10] and got.bad is None and got.code == "01007"


def test_json_arrays_are_split_at_line_ends(spark, tmp_path):
    """One large file is read by several tasks; any number of items a line, brackets on lines of their own, escapes, other column order."""
    n = 4000
    rows = [[f"Place [{i}], \"x\"\n", str(i), f"{i:,}"] for i in range(n)]
    (tmp_path / "m").mkdir()
    big = ",\n".join(json.dumps(r) for r in [["NAME", "geo", "B01"], *rows])
    (tmp_path / "m" / "big.json").write_text(f"[{big}]\n")
    (tmp_path / "m" / "two.json").write_text('[\n["B01", "NAME", "geo"],\n["7", "a", "z"], ["8", "b]]", "y"]\n]\n')
    (tmp_path / "m" / "one.json").write_text('[["geo","NAME","B01"],["q","c","N/A"]]')
    (tmp_path / "r").mkdir()
    fields = lambda i: {"GeoFips": "00000" if i == 3 else f"{i:05d}"[:2] + "001", "GeoName": f"[n{i}]", "TimePeriod": "2001", "DataValue": f"{i:,}"}
    (tmp_path / "r" / "a.json").write_text("[" + ",\n".join(json.dumps(fields(i)) for i in range(n)) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.read_json_matrix(spark, str(tmp_path / "m"), ["NAME", "geo", "B01"], ["B01"], lines=True)
        assert got.rdd.getNumPartitions() > 5
        have = sorted((r.geo, r.NAME, r.B01) for r in got.collect())
        records = readers.read_json_records(spark, str(tmp_path / "r"), lines=True)
        assert records.rdd.getNumPartitions() > 5
        assert sorted(r.value for r in records.collect()) == [float(i) for i in range(n) if i != 3]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(r[1], r[0], float(r[2].replace(",", ""))) for r in rows] + [("z", "a", 7.0), ("y", "b]]", 8.0), ("q", "c", None)]
    assert have == sorted(want, key=lambda w: (w[0], w[1]))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.json").write_text('[["NAME",\n"geo"],["a","b"]]')
    with pytest.raises(Exception, match="no whole JSON items"):
        readers.read_json_matrix(spark, str(tmp_path / "bad"), ["NAME"], [], lines=True).collect()
