"""Joins that are more than an equi-join: names, as-of cuts, alignment, candidates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.functions.scalar import title_places
from paneltide.operators.order import carry_last, top_k
from paneltide.scale import small_side, spread


def star_join(spine: DataFrame, tables: Sequence[DataFrame], keys: Sequence[str] = ("entity", "period")) -> DataFrame:
    """Left-join measure tables on one key; every table is partitioned alike, so exchanges are shared."""
    out = spine
    for table in tables:
        out = out.join(table, list(keys), "left")
    return out


def with_dimension(df: DataFrame, dimension: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Attach a dimension by key. It is computed once and counted: a small one is broadcast, so the
    large side keeps its place; a large one is joined by shuffle."""
    return df.join(small_side(dimension), list(on), how)


def latest_before(facts: DataFrame, cut: int, value: str, entity: str = "entity", period: str = "period",
                  inclusive: bool = False) -> DataFrame:
    """Latest non-NULL value per entity before (or up to) a cut, one partial aggregation."""
    limit = F.col(period) <= cut if inclusive else F.col(period) < cut
    return facts.filter(limit & F.col(value).isNotNull()).groupBy(entity).agg(
        F.max_by(value, period).alias(value))


def as_of(cuts: DataFrame, facts: DataFrame, value: str, entity: str = "entity", cut: str = "cut",
          period: str = "period", inclusive: bool = False, bound: int | None = None) -> DataFrame:
    """Latest non-NULL value for every (entity, cut): facts and cuts interleaved on one time line.

    No range join: both sides are stacked, ordered by time within the entity, and the last fact is
    carried onto each cut; a long line is carried slice by slice. A cut sorts before equal-time facts
    unless ``inclusive``; of several facts of one time the largest value counts. ``bound``: rows a line holds at most.
    """
    side = F.lit(1 if inclusive else 0)
    asks = cuts.select(entity, F.col(cut).alias("_t"), (side * 2).alias("_side"), F.lit(None).cast(facts.schema[value].dataType).alias("_v"),
                       F.lit(True).alias("_ask"))
    have = facts.filter(F.col(value).isNotNull()).select(
        entity, F.col(period).alias("_t"), F.lit(1).alias("_side"), F.col(value).alias("_v"),
        F.lit(False).alias("_ask"))
    line = carry_last(asks.unionByName(have), [entity], ["_t", "_side", "_v"], "_v", value, bound)
    return line.filter("_ask").select(entity, F.col("_t").alias(cut), value)


def match_any_place(titles: DataFrame, places: DataFrame, entity: str, title: str, place: str, city: str,
                    state: str) -> DataFrame:
    """Match multi-city, multi-state titles to places on any (city, state) pair.

    Of several hits the first city in title order wins (then the first state, then the smallest
    place key). Entities without a hit keep a NULL place. Titles are dealt over all partitions by entity before
    they are taken apart, so that no task sorts the pairs of one input file.
    """
    keyed = spread(titles.select(entity, F.col(title).alias("_title")), entity).select(entity, F.posexplode(title_places("_title")).alias("_at", "_key"))
    near = places.select(F.col(place), F.struct(F.lower(F.trim(F.col(city))).alias("city"),
                                                F.upper(F.trim(F.col(state))).alias("state")).alias("_key")).groupBy("_key").agg(F.min(place).alias(place))
    hits = keyed.join(near, "_key").groupBy(entity).agg(
        F.min(F.struct("_at", place)).getField(place).alias(place))
    return titles.join(hits, entity, "left")


def match_first_place(titles: DataFrame, places: DataFrame, entity: str, title: str, place: str, city: str,
                      state: str) -> DataFrame:
    """Coarse match on the first city and first state only."""
    first = titles.withColumn("_key", F.try_element_at(title_places(title), F.lit(1)))
    near = places.select(F.col(place), F.struct(F.lower(F.trim(F.col(city))).alias("city"),
                                                F.upper(F.trim(F.col(state))).alias("state")).alias("_key"))
    one = near.groupBy("_key").agg(F.min(place).alias(place))
    return first.join(one, "_key", "left").drop("_key")


def aligned(df: DataFrame, window: Sequence[str], entity: str, strategy: str, strategies: int) -> DataFrame:
    """Keep the entities that every ranking covers within a window.

    A window function over (window, entity): at most one row per strategy in each group.
    """
    w = Window.partitionBy(*window, entity)
    return df.withColumn("_s", F.count(F.lit(1)).over(w)).filter(F.col("_s") == strategies).drop("_s")


def pick_best(df: DataFrame, candidates: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join, then keep the best candidate of each row."""
    best = top_k(candidates, list(on), list(order), 1)
    return df.join(best, list(on), "left")


def normalised_name(c: str) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.col(c)), r"[^A-Za-z0-9]+", " "))


def lookup_by_name(df: DataFrame, names: DataFrame, name: str, ref_name: str, code: str) -> DataFrame:
    """Full-name to code lookup; unmatched rows are dropped, and of equal names the smallest code counts."""
    right = names.groupBy(normalised_name(ref_name).alias("_n")).agg(F.min(code).alias(code))
    return df.withColumn("_n", normalised_name(name)).join(right, "_n").drop("_n")


def membership_changes(current: DataFrame, reference: DataFrame, parent: str, child: str) -> DataFrame:
    """One row per child added to or removed from a parent between two versions of a bridge.

    The changes stay as rows: the list of one parent is never gathered into a single cell.
    """
    now = current.select(parent, child).distinct().withColumn("_side", F.lit(1))
    then = reference.select(parent, child).distinct().withColumn("_side", F.lit(-1))
    net = now.unionByName(then).groupBy(parent, child).agg(F.sum("_side").alias("_net")).filter("_net != 0")
    return net.select(parent, child, F.when(F.col("_net") == 1, F.lit("added")).otherwise(
        F.lit("removed")).alias("change"))
