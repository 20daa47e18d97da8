"""Work is dealt by its cost, not by its bytes: plans of the steps that used to run in one task."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paneltide.operators import concordance, match, replicates
from paneltide.plans import resample, walkforward


def plan(df):
    return df._jdf.queryExecution().toString()


def test_units_are_dealt_before_they_draw(spark):
    units = spark.range(30).select(F.col("id").alias("entity"))
    drawn = resample.draws(units, "entity", 7, bound=30)
    assert "REPARTITION_BY_NUM" in plan(drawn)
    assert {r["n"] for r in drawn.groupBy("replicate").agg(F.sum("copies").alias("n")).collect()} == {30}


def small_frame(spark):
    rng = random.Random(8)
    rows = [(s, 3, p, e, float(rng.randrange(9)), float(rng.randrange(9))) for s in "ab" for p in (1, 2) for e in range(40)]
    return spark.createDataFrame(rows, "strategy string, horizon int, period int, entity int, score double, realized double")


def test_blocks_are_dealt_and_carry_all_strategies(spark):
    frame = small_frame(spark)
    drawn = resample.draws(frame, "entity", 60)
    got = replicates.taus(frame, replicates.folded(drawn, block=20), ["strategy", "horizon", "period"], "score", "realized", block=20)
    assert "REPARTITION_BY_NUM" in plan(got)
    assert got.select("strategy", "period", "replicate").distinct().count() == got.count() == 2 * 2 * 60


def test_large_windows_keep_blocks():
    assert replicates.fits(360_000, 2_000_000) and not replicates.fits(2_000_001, 2_000_000)
    assert replicates.block_size(360_000) * 360_000 <= replicates.MAX_CELLS


@pytest.mark.parametrize("tile, cells, steps", [(4, 50, 0), (4, 10_000, 10_000), (64, 10_000, 10_000)])
def test_tiles_and_bits_agree(monkeypatch, tile, cells, steps):
    rng = np.random.default_rng(5)
    x, y, copies = rng.integers(0, 150, 200).astype(float), rng.integers(0, 90, 200).astype(float), rng.poisson(1, (200, 9))
    monkeypatch.setattr(replicates, "TILE", 1 << 20)  # tiles wider than the group: one matrix of signs
    want, _ = replicates.matrix_taus(x, y, np.arange(200), copies)
    one = [replicates.matrix_taus(x, y, np.arange(200), copies[:, [i]])[0][0] for i in range(9)]  # bit by bit
    for name, value in (("TILE", tile), ("CELLS", cells), ("MAX_STEPS", steps)):
        monkeypatch.setattr(replicates, name, value)
    got, _ = replicates.matrix_taus(x, y, np.arange(200), copies)
    assert got == pytest.approx(want, abs=1e-12) and one == pytest.approx(want, abs=1e-12)


def test_ties_rank_nulls_first():
    assert replicates.dense_ranks(pa.chunked_array([["b", None], ["a", "b"]])).tolist() == [2, 0, 1, 2]


def test_rank_correlation_of_a_group_emits_no_row_a_level(spark):
    rows = small_frame(spark)
    got = concordance.weighted_tau(rows, ["strategy", "period"], "score", "realized", "entity", bound=40, also={"n": (F.count, F.col("score"))})
    assert "Generate" not in plan(got) and "Window" not in plan(got)
    assert [r["n"] for r in got.collect()] == [40] * 4


def test_split_rank_correlation_emits_only_upper_levels(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(1, e, float(rng.choice([0, 0, 0, rng.randrange(300)])), float(rng.randrange(200))) for e in range(600)]
    frame = spark.createDataFrame(rows, "g int, e int, x double, y double")
    want = concordance.weighted_tau(frame, ["g"], "x", "y", "e", bound=600).first()["tau"]
    monkeypatch.setattr(concordance, "MAX_BLOCK", 64)  # the tie run of zeros is longer than a block
    emitted, digits = [], concordance._digits
    monkeypatch.setattr(concordance, "_digits", lambda *a: emitted.append(digits(*a)) or emitted[-1])
    assert concordance.weighted_tau(frame, ["g"], "x", "y", "e", bound=1 << 40).first()["tau"] == pytest.approx(want, abs=1e-12)
    assert emitted[0].count() < 600 * 4  # four levels of eight ranks in all


def test_titles_are_dealt_before_they_are_taken_apart(spark):
    titles = spark.createDataFrame([(1, "a-b, X-Y"), (2, "c, X"), (None, "b, Y")], "entity int, title string")
    places = spark.createDataFrame([(7, "b", "Y"), (5, "b", "x"), (9, "a", "y")], "place int, city string, state string")
    got = match.match_any_place(titles, places, "entity", "title", "place", "city", "state")
    assert "REPARTITION_BY_NUM" in plan(got)
    assert {r["entity"]: r["place"] for r in got.collect()} == {1: 9, 2: None, None: None}


def test_outcomes_never_pass_through_the_driver(spark):
    frame = small_frame(spark)
    rows = walkforward.window_rows(frame.select("strategy", "entity", "period", "score"), frame.filter("strategy = 'a'").select("horizon", "entity", "period", "realized"))
    assert "BroadcastHashJoin" not in plan(rows) and "SortMergeJoin" in plan(rows)
