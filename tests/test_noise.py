"""Noisy ranks in blocks: draws against hashlib, both plans against a row a draw, the queries on rows of their own."""
import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from oracle_check import compare
from paneltide.functions.scalar import standard_normal
from paneltide.operators import noise
from paneltide.plans import resample

RHO, WEIGHTS = {"a": 0.8, "b": 0.9}, {"a": 0.3, "b": 0.2, "c": 0.5}
DRAWS = 60


def plan(df):
    return df._jdf.queryExecution().toString()


def test_digests_of_all_lengths(monkeypatch):
    monkeypatch.setattr(noise, "TILE", 5)  # several tiles of rows
    texts = ["", ":", ":7", ":é", ":123", ":4567", ":89", *(f":{i}" for i in range(30)), ":" + "x" * 70]
    for label in ("", "q", "noise-a:e1998", "x" * 47, "x" * 54, "x" * 62, "x" * 63, "y" * 130):
        for some in ([5], [7, 8, 9], [998, 999]):
            heads = np.array([list(f"{label}:{i}".encode()) for i in some], np.uint8)
            for e in noise.ends_by_length(pa.array(texts)):
                rows = np.arange(len(texts))[e.rows]
                for at, first, second in e.digests(heads):
                    for r, i in enumerate(some):
                        for c, row in enumerate(rows[at]):
                            want = hashlib.md5(f"{label}:{i}{texts[row]}".encode()).hexdigest()
                            assert (first[r, c], second[r, c]) == (int(want[:8], 16), int(want[8:16], 16))


def test_keys_order_scores_descending():
    scores = np.array([[1.0, -math.inf, -0.0, math.nan, 2.5, 0.0, math.inf, -3.0, 9.0]])
    keys = noise.descending(scores, np.array([8]))[0]
    assert noise.order_of(keys).tolist() == [3, 6, 4, 0, 2, 5, 7, 1, 8] and keys[2] == keys[5]


@pytest.mark.parametrize("kind", [None, np.uint8, np.uint16])
def test_ranks_as_bytes(kind):
    ranks = np.array([1, 65535, 7, 9] if kind is None else [1, 65536, 70_000, 1 << 23] if kind is np.uint8 else [1, 1 << 24, (1 << 31) - 1, 5], np.uint32)
    assert noise.high_type(int(ranks.max())) is kind
    low, high = np.empty(4, np.uint16), np.empty(4, kind or np.uint8)
    low[:], high[:] = ranks & 0xFFFF, ranks >> 16
    parts = np.array([1, 0, 3])
    lows, highs = noise.binaries(low, parts).to_pylist(), noise.binaries(high, parts).to_pylist() if kind else [None] * 3
    assert [noise.whole_ranks(x, y).tolist() for x, y in zip(lows, highs)] == [[1], [], ranks[1:].tolist()]


def by_rows(norm):
    """A row a draw: the definition."""
    score = F.lit(0.0) + sum((F.lit(w) * F.coalesce(F.col(k), F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0)) + F.col("shift")
    rows = norm.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    for k, rho in RHO.items():
        z = F.coalesce(F.col(k), F.lit(0.0))
        eps = standard_normal(F.lit(f"noise-{k}"), "edition", "replicate", "entity")
        score = score + F.lit(WEIGHTS[k]) * (F.lit(rho) * z + F.lit((1.0 - rho * rho) ** 0.5) * eps - z)
    drawn = rows.select("edition", "replicate", "entity", score.alias("_score"))
    line = Window.partitionBy("edition", "replicate").orderBy(F.col("_score").desc(), "entity")
    return resample.rank_intervals(drawn.withColumn("rank", F.row_number().over(line)))


def in_blocks(norm, bound, rho=RHO):
    base = F.lit(0.0) + sum((F.lit(w) * F.coalesce(F.col(k), F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0)) + F.col("shift")
    return resample.noisy_ranks(norm, base, rho, WEIGHTS, DRAWS, bound=bound)


def norms(spark, entity):
    """Entities that repeat or are NULL, missing, infinite and undefined scores, editions of NULL and of one row."""
    rng = random.Random(11)
    name = (lambda i: f"é{i}") if entity == "string" else (lambda i: i - 3)
    value = lambda: rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1)])
    rows = [(e, name(i), value(), value(), value(), 0.0) for e in ("e1", "e2", None) for i in range(40)]
    rows += [("e1", None, 0.1, 0.2, 0.3, 0.0), ("e1", name(5), 0.4, 0.1, -0.2, 0.0), ("e1", name(5), 0.4, 0.1, -0.2, 0.0), ("e4", name(1), 0.0, 0.0, 0.0, 0.0)]
    rows += [("e2", name(50 + i), 0.1, 0.1, 0.1, s) for i, s in enumerate((None, None, math.nan, math.nan, math.inf, -math.inf, -math.inf))]
    return spark.createDataFrame(rows, f"edition string, entity {entity}, a double, b double, c double, shift double")


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("entity", ["bigint", "string"])
def test_split_plan_agrees_with_a_row_a_draw(spark, split_plans, entity):
    norm = norms(spark, entity)
    ranks = in_blocks(norm, None)  # seven rows a task: seven slices and buckets an edition
    assert ranks.filter("_at IS NOT NULL").count() == ranks.count()
    assert listed(resample.rank_intervals(ranks)) == listed(by_rows(norm))


def test_split_plan_moves_blocks_not_draws(spark):
    norm = norms(spark, "bigint")
    assert noise.is_blocks(ranks := in_blocks(norm, 1 << 40))
    held = ranks.collect()
    assert len(held) <= 4 * 2 * math.ceil(DRAWS / noise.SPLIT_BLOCK) * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(len(r["_low"]) for r in held) == 2 * DRAWS * norm.count()
    assert listed(resample.rank_intervals(ranks)) == listed(by_rows(norm))


def test_tied_scores_are_dealt_over_buckets(spark, split_plans):
    norm = spark.createDataFrame([("e1", i, 0.0, 0.0, 0.0, 0.0) for i in range(50)], "edition string, entity int, a double, b double, c double, shift double")
    ranks = in_blocks(norm, None, {"a": 1.0})  # no noise: all tied, ranks in the order of entities
    assert [tuple(r) for r in resample.rank_intervals(ranks).orderBy("entity").select("entity", "rank_lo", "rank_hi").collect()] == [(i, i + 1, i + 1) for i in range(50)]
    # each slice has its part of the tied rows in few buckets, and no bucket has more than a share of them
    counts = [np.frombuffer(r["_counts"], np.int32) for r in ranks.filter("_block = 0").collect()]
    assert sum(c[0] for c in counts) == 50 and sum(1 for c in counts if c[0]) >= 50 / 7


# ---- the queries --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Some suppliers over four years, one of them new in the last."""
    rng, at = random.Random(5), tmp_path_factory.mktemp("tables")
    suppliers, lines = list(range(1, 46)), []
    for s in suppliers:
        for year in range(1995 if s != 45 else 1998, 1999):
            for i in range(rng.randrange(3, 9)):
                quantity = float(rng.randrange(1, 50))
                lines.append({"l_orderkey": len(lines), "l_partkey": i, "l_suppkey": s, "l_linenumber": i % 7 + 1, "l_quantity": quantity,
                              "l_extendedprice": round(quantity * rng.uniform(900, 2000), 2), "l_discount": rng.randrange(11) / 100, "l_tax": rng.randrange(9) / 100,
                              "l_returnflag": rng.choice("ANR"), "l_linestatus": rng.choice("OF"), "l_shipdate": np.datetime64(f"{year}-{rng.randrange(1, 13):02d}-15", "us")})
    pq.write_table(pa.Table.from_pylist(lines), at / "lineitem.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array(suppliers, pa.int64()), "s_nationkey": pa.array([s % 25 for s in suppliers], pa.int32())}), at / "supplier.parquet")
    return str(at)


def agrees(spark, folder, name):
    con = duckdb.connect()
    for table in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    query = queries()[name]
    assert "replicate" not in plan(query(spark, folder))  # no row a draw
    ok, note = compare(spark, con, name, query, oracle_sql()[name], folder)
    assert ok, note


def test_rank_intervals_split(spark, folder):
    agrees(spark, folder, "rank_intervals_split")


@pytest.mark.parametrize("entity", ["bigint", "string"])
def test_block_plan_agrees_with_a_row_a_draw(spark, entity):
    norm = norms(spark, entity)
    ranks = in_blocks(norm, None)
    assert ranks.filter("_at IS NULL").count() == ranks.count()
    assert listed(resample.rank_intervals(ranks)) == listed(by_rows(norm))


@pytest.mark.parametrize("cells, high", [(60, None), (1 << 24, np.uint8), (1 << 24, np.uint16)])
def test_blocks_of_any_size_and_wide_ranks(spark, monkeypatch, cells, high):
    norm = norms(spark, "bigint")
    monkeypatch.setattr(noise, "MAX_CELLS", cells)  # 60: a replicate a block
    if high:
        monkeypatch.setattr(noise, "high_type", lambda largest: high)
    assert listed(resample.rank_intervals(in_blocks(norm, None))) == listed(resample.rank_intervals(in_blocks(norm, 1 << 40))) == listed(by_rows(norm))


def test_rank_intervals(spark, folder):
    agrees(spark, folder, "rank_intervals")


def test_tier_counts(spark, folder):
    agrees(spark, folder, "tier_counts")
    rows = queries()["tier_counts"](spark, folder).collect()
    assert sum(r["n_entities"] for r in rows) == 44 * 3 + 45


def test_rank_outside_interval(spark, folder):
    agrees(spark, folder, "rank_outside_interval")
