"""Embedding near-duplicates by a pivot-permutation index.

Vectors that are equal in every component form a class, compared as one vector with its number of copies. Pivots are a
bounded sample of the classes, about 2 * sqrt(classes), MAX_PIVOTS at most, so lists grow as the square root of the input. A class
is described by its PREFIX nearest pivots in order, and stands in the inverted list of each. Two classes are candidates if they
share at least SHARED pivots; they are compared in the list of the lowest pivot that they share, so once. Candidates are
verified by their cosine in double precision.

Where pivots are crowded, linked classes need not share any of their nearest. So a class whose last prefix pivot lies within CROWDED
times the angle of the threshold is crowded: it stands in no list, and is compared with every class that can reach it. Leaders, pivots
further apart than SPREAD such angles, cut space into cells; a crowded class lives in the cell of its nearest leader, and whoever can
be linked with a class of a cell (distance to the plane between two leaders, triangle inequality) visits that cell. No link of a
crowded class is missed. The work is quadratic in the classes of a crowd, as its links are.

Lists and cells are cut into blocks, and every pair of blocks is a group of its own, so no task holds a
long list. A group gives one row a linked class (copies linked, smallest class reached inside the group), not its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths never link; rows with a null vec_id link, but their component is the smallest non-null id or null, and
they are kept only if none is smaller; repeated rows are copies; an empty table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.common import hash_sample
from paneltide.llm.components import components
from paneltide.scale import small_side, staged

MAX_PIVOTS, PREFIX, SHARED, BLOCK = 16_384, 8, 2, 1024
CROWDED, SPREAD, SLACK = 2.5, 3.5, 1e-9
#: A cell has about CELL_BLOCKS blocks; they hold LEAST_BLOCK classes or more, and BLOCK_BYTES of vectors at most.
CELL_BLOCKS, LEAST_BLOCK, BLOCK_BYTES, CHUNK = 16, 256, 16 << 20, 1 << 22


def unit(values: np.ndarray | None) -> np.ndarray | None:
    if values is None or not len(values):
        return None
    v = np.array([np.nan if x is None else x for x in values] if values.dtype == object else values, np.float64)
    with np.errstate(all="ignore"):
        v = v / np.abs(v).max()
        v = v / np.sqrt(v @ v)
    return v if np.isfinite(v).all() else None


def normalised(vectors: DataFrame) -> DataFrame:
    """vec_id, digest of the components (null if not comparable), unit vector."""
    narrow = vectors.select("vec_id", "embedding")
    schema = T.StructType([narrow.schema["vec_id"], T.StructField("digest", T.BinaryType()), T.StructField("vec", T.BinaryType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            units = [unit(v) for v in part["embedding"]]
            raw = [None if u is None else xxhash.xxh3_128_digest((np.asarray(v, np.float64) + 0.0).tobytes())
                   for u, v in zip(units, part["embedding"])]
            yield pd.DataFrame({"vec_id": part["vec_id"], "digest": raw, "vec": [None if u is None else u.tobytes() for u in units]})

    return narrow.mapInPandas(run, schema)


def pivots_of(classes: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, the reference points. A bounded sample; lengths that it misses get fixed random directions."""
    rows = classes.count()
    wanted = min(MAX_PIVOTS, max(64, 2 * math.isqrt(rows)))
    found = hash_sample(classes.select("digest", "vec"), "digest", wanted).orderBy("digest").limit(2 * wanted).collect()
    out: dict[int, list] = {}
    for r in found:
        out.setdefault(len(r["vec"]) // 8, []).append(np.frombuffer(r["vec"], np.float64))
    return {n: np.array(v) for n, v in out.items()}


class Points:
    """By vector length, the pivots and those of them that lead a cell."""

    def __init__(self, pivots: dict[int, np.ndarray], apart: float) -> None:
        self.pivots, self.apart, self.lead = pivots, apart, {}
        for dim in list(pivots):
            self.leaders(dim)

    def of(self, dim: int) -> np.ndarray:
        if dim not in self.pivots:
            points = np.random.default_rng(dim).normal(size=(64, dim))
            self.pivots[dim] = points / np.linalg.norm(points, axis=1, keepdims=True)
        return self.pivots[dim]

    def leaders(self, dim: int) -> np.ndarray:
        if dim not in self.lead:
            self.lead[dim] = spread(self.of(dim), self.apart)
        return self.lead[dim]


def spread(points: np.ndarray, apart: float) -> np.ndarray:
    """Points in order, without those within that angle of one taken before."""
    near, taken = math.cos(apart), points[:0]
    for at in range(0, len(points), 512):
        some = points[at:at + 512]
        if len(taken):
            some = some[(some @ taken.T).max(1) < near]
        among, free, chosen = some @ some.T >= near, np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                chosen.append(i)
                free &= ~among[i]
        taken = np.concatenate([taken, some[chosen]])
    return taken


def by_length(part: pd.DataFrame, most: int = 2048) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """Length, rows and vectors, a bounded number of rows at once."""
    for dim, rows in part.groupby(part["vec"].map(len) // 8):
        for at in range(0, len(rows), most):
            some = rows.iloc[at:at + most]
            yield int(dim), some, np.frombuffer(b"".join(some["vec"]), np.float64).reshape(len(some), int(dim))


def placed(classes: DataFrame, points: Points, prefix: int, angle: float) -> DataFrame:
    """A row a class: rep, copies, vec, kind (2 crowded, 1 within reach of crowded ones, 0 neither), its lists and nearest pivots
    unless crowded, cell and angle to the leader of it unless 0."""
    crowded, reached = (math.cos(min(x, math.pi)) - SLACK for x in (CROWDED * angle, (CROWDED + 1) * angle))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, some, vec in by_length(part):
                pivots = points.of(dim)
                k, near = min(prefix, len(pivots)), vec @ pivots.T
                top = np.argpartition(-near, k - 1, 1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(some), 1))
                order = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), 1, kind="stable"), 1).astype(np.int32)
                last = np.take_along_axis(near, order[:, -1:], 1)[:, 0]
                kind = np.where(last >= crowded, 2, np.where(last >= reached, 1, 0))
                to = vec @ points.leaders(dim).T
                home = to.argmax(1)
                yield pd.DataFrame({
                    "rep": some["rep"].to_numpy(), "copies": some["copies"].to_numpy(), "vec": some["vec"].to_numpy(), "kind": kind.astype(np.int32),
                    "lists": [o + (dim << 20) if n < 2 else [] for o, n in zip(order.astype(np.int64), kind)],
                    "nearest": [o.tobytes() if n < 2 else b"" for o, n in zip(order, kind)],
                    "cell": home.astype(np.int64) + (dim << 20), "reach": np.arccos(np.clip(to[np.arange(len(to)), home], -1, 1))})

    return classes.select("rep", "copies", "vec").mapInPandas(
        run, "rep long, copies long, vec binary, kind int, lists array<long>, nearest binary, cell long, reach double")


def seated(found: DataFrame, points: Points, reach: dict[int, float], angle: float) -> DataFrame:
    """list (cell), rep, copies, own, vec: crowded classes in their own cell, and classes in the cells that they have to visit. Two
    crowded classes of different cells meet in the lower one. reach: by cell with crowded classes, their largest angle to its leader."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, some, vec in by_length(part, 256):
                leaders = points.leaders(dim)
                limit = np.array([reach.get(i + (dim << 20), -np.inf) for i in range(len(leaders))]) + angle
                to, home = vec @ leaders.T, some["cell"].to_numpy() - (dim << 20)
                core = some["kind"].to_numpy() == 2
                visits = np.arccos(np.clip(to, -1, 1)) <= limit + 1e-6
                if angle < math.pi / 2:  # classes of another cell lie beyond the plane between both leaders
                    gap = np.sqrt(np.maximum(2 - 2 * (leaders[home] @ leaders.T), 0))
                    visits &= to[np.arange(len(to)), home][:, None] - to <= math.sin(angle) * gap + SLACK
                visits &= ~core[:, None] | (np.arange(len(leaders)) < home[:, None])
                visits[np.flatnonzero(core), home[core]] = True
                row, cell = np.nonzero(visits)
                yield pd.DataFrame({
                    "list": cell + (dim << 20), "rep": some["rep"].to_numpy()[row], "copies": some["copies"].to_numpy()[row],
                    "own": core[row] & (cell == home[row]), "vec": some["vec"].to_numpy()[row]})

    return found.select("rep", "copies", "vec", "kind", "cell").mapInPandas(run, "list long, rep long, copies long, own boolean, vec binary")


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable, for the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(entries: DataFrame, threshold: float, shared: int) -> DataFrame:
    """rep, links (copies of other classes linked), root: one row per linked class and group."""
    sizes = entries.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = entries.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "list", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "nearest", "vec")

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        one, low, high = key
        part = part.sort_values("rep", ignore_index=True)
        n = len(part)
        vec = np.frombuffer(b"".join(part["vec"]), np.float64).reshape(n, -1)
        near = np.frombuffer(b"".join(part["nearest"]), np.int32).reshape(n, -1)
        names, at = np.unique(near, return_inverse=True)
        has = np.zeros((n, len(names)), np.float32)
        has[np.arange(n)[:, None], at.reshape(near.shape)] = 1
        before = has[:, :int(np.searchsorted(names, one & ((1 << 20) - 1)))]
        adjacent = (has @ has.T >= min(shared, near.shape[1])) & (before @ before.T == 0)
        adjacent &= vec @ vec.T >= threshold
        block = part["block"].to_numpy()
        adjacent &= (block[:, None] != block[None, :]) if low != high else ~np.eye(n, dtype=bool)
        links = adjacent @ part["copies"].to_numpy()
        a, b = np.nonzero(np.triu(adjacent))
        label, rep = roots(a, b, n), part["rep"].to_numpy()
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some].astype(np.int64), "root": rep[label[some]]})

    return pairs.groupBy("list", "low", "high").applyInPandas(compare, "rep long, links long, root long")


def crowds(seats: DataFrame, threshold: float) -> DataFrame:
    """rep, links, root as in linked(): classes of a cell compared with all in it, visitors not among themselves."""
    block_rows = F.least(F.greatest(F.col("n") / CELL_BLOCKS, F.lit(LEAST_BLOCK)), F.greatest(F.lit(BLOCK_BYTES) / F.col("bytes"), F.lit(LEAST_BLOCK)))
    sizes = seats.groupBy("list").agg(F.count("*").alias("n"), F.max(F.length("vec")).alias("bytes")).select(
        "list", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    cut = seats.join(small_side(sizes), "list").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "list", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "own", "vec")

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        part = part.sort_values("rep", ignore_index=True)
        n, own, block = len(part), part["own"].to_numpy(bool), part["block"].to_numpy()
        vec = np.frombuffer(b"".join(part["vec"]), np.float64).reshape(n, -1)
        copies, links, label = part["copies"].to_numpy(np.float64), np.zeros(n), np.arange(n)
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        step = max(1, CHUNK // max(1, len(right)))
        for at in range(0, len(left) if own.any() else 0, step):
            a = left[at:at + step]
            adjacent = vec[a] @ vec[right].T >= threshold
            adjacent &= own[a][:, None] | own[right]
            if low == high:
                adjacent[np.arange(len(a)), np.arange(at, at + len(a))] = False
            some = adjacent.astype(np.float64)
            links[a] += some @ copies[right]
            if low != high:
                links[right] += copies[a] @ some
            while True:  # one edge a row and column joins parts until all linked ones are one
                apart = adjacent & (label[a][:, None] != label[right])
                rows, columns = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
                if not len(rows):
                    break
                u = np.concatenate([a[rows], a[apart[:, columns].argmax(0)]])
                v = np.concatenate([right[apart[rows].argmax(1)], right[columns]])
                label = roots(label[u], label[v], n)[label]
        some, rep = links > 0, part["rep"].to_numpy()
        return pd.DataFrame({"rep": rep[some], "links": links[some].astype(np.int64), "root": rep[label[some]]})

    return pairs.groupBy("list", "low", "high").applyInPandas(compare, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = staged(normalised(vectors), "vectors")
    classes = staged(rows.where("digest is not null").groupBy("digest").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "classes")
    # a class is known by its smallest vec_id; classes of null ids only, or that share their smallest id, by a hash below all ids
    twice = classes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null").select(F.col("id").alias("_id"))
    marked = classes.join(twice, F.col("id") == F.col("_id"), "left")
    hashed = F.shiftrightunsigned(F.xxhash64("digest"), 2) * -1 - F.lit(1 << 61)
    classes = staged(marked.withColumn("rep", F.when(F.col("id").isNull() | F.col("_id").isNotNull(), hashed).otherwise(
        F.col("id").cast("long"))).drop("_id"), "classes")
    angle = math.acos(min(max(threshold, -1.0), 1.0))
    points = Points(pivots_of(classes), min(SPREAD * angle, math.pi))
    places = staged(placed(classes, points, prefix, angle), "places")
    entries = places.where("kind < 2").select(F.explode("lists").alias("list"), "rep", "copies", "nearest", "vec")
    found = linked(entries, threshold, shared)
    reach = {r["cell"]: r["reach"] for r in places.where("kind = 2").groupBy("cell").agg(F.max("reach").alias("reach")).collect()}
    if reach:
        seats = staged(seated(places.where("kind > 0"), points, reach, angle), "seats")
        found = found.unionByName(crowds(seats, threshold))
    found = staged(found, "links")
    node = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    named = classes.select("digest", "rep", "id", "copies").join(
        found.groupBy(F.col("rep").alias("_rep")).agg(F.sum("links").alias("links")), F.col("rep") == F.col("_rep"), "left").drop("_rep")
    named = staged(named.join(node.withColumnRenamed("node", "_rep"), F.col("rep") == F.col("_rep"), "left").withColumn(
        "component", F.coalesce("component", "rep")).drop("_rep"), "named")
    smallest = named.groupBy(F.col("component").alias("_component")).agg(F.min("id").alias("component_id"))
    named = staged(named.join(smallest, F.col("component") == F.col("_component")).select("digest", "copies", "links", "component_id"), "named")
    out = rows.select("vec_id", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
