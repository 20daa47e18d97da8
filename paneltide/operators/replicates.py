"""Blocks of bootstrap replicates: one row a unit with an array of multiplicities, one rank correlation for a whole block.

A row a replicate copies the frame once for every draw. Here the draws of a unit are folded to arrays of at most BLOCK multiplicities, the
frame meets one row a block with all its strategies, and the replicates of a block are the columns of a matrix: ranks, weights, tie
sums and the walk over the bits of the score's rank are then running sums over rows, for all columns at once. Runs of
TILE ranks are left to matrix products, whose signs are the same for every replicate.

A group here is the units of one window. Up to the rows a task may hold it is one task's matrix, its columns taken CELLS numbers at a time;
callers take the plan with a row a replicate beyond that (`concordance.weighted_tau`), which splits a group. Both give the same values.
Little data makes much work here, so blocks are dealt over all shuffle partitions and never merged by size.
"""
from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.scale import spread

BLOCK = 50
MAX_CELLS = 20_000_000  # multiplicities in one group
CELLS = 2_000_000  # numbers in one matrix
MAX_STEPS = 10_000_000  # rows times bits whose order is kept between matrices
TILE = 64

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module


def folded(drawn: DataFrame, unit: str = "entity", block: int = BLOCK) -> DataFrame:
    """(replicate, unit, copies) to (unit, block, copies): an array with one multiplicity a replicate of the block."""
    at = F.struct((F.col("replicate") % block).cast("int").alias("at"), F.col("copies").cast("int").alias("n"))
    held = drawn.groupBy(unit, F.floor(F.col("replicate") / block).cast("int").alias("block")).agg(
        F.map_from_entries(F.collect_list(at)).alias("_held"))  # a block's replicates at most
    each = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.coalesce(F.try_element_at("_held", i), F.lit(0)))
    return held.select(unit, "block", each.alias("copies"))


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Place at which the run of equal keys begins, for each row of sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def run_ends(first: np.ndarray) -> np.ndarray:
    """Place after the run of each row, from the places at which the runs begin."""
    heads = np.flatnonzero(first == np.arange(len(first)))
    return np.repeat(np.append(heads[1:], len(first)), np.diff(np.append(heads, len(first))))


def running(values: np.ndarray) -> np.ndarray:
    """Sums along each row of the numbers before each place, the end included."""
    total = np.zeros((values.shape[0], values.shape[1] + 1))
    np.cumsum(values, axis=1, out=total[:, 1:])
    return total


def tile_sums(code: np.ndarray, by_y: np.ndarray, bits: int, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs inside runs of 2 ** bits score ranks, as products with their matrix of signs."""
    order = np.argsort(code >> bits, kind="stable")
    heads = np.flatnonzero(run_starts((code >> bits)[order]) == np.arange(len(order)))
    sizes, out = np.diff(np.append(heads, len(order))), np.zeros(len(m))
    wide, step = int(sizes.max()), max(1, CELLS // (int(sizes.max()) * max(int(sizes.max()), len(m))))
    m, w = np.ascontiguousarray(m.T), np.ascontiguousarray(w.T)
    for at in range(0, len(heads), step):
        there = heads[at:at + step, None] + np.arange(wide)
        real = np.arange(wide) < sizes[at:at + step, None]
        rows = order[np.where(real, there, 0)]
        x, y = code[rows], by_y[rows]
        signs = np.sign(x[:, :, None] - x[:, None, :]) * np.sign(y[:, None, :] - y[:, :, None])
        signs *= real[:, :, None] & real[:, None, :]
        met = signs.astype(np.float64) @ np.take(w, rows, axis=0)
        out += np.einsum("ijk,ijk->k", met, np.take(m, rows, axis=0))
    return out


def pair_walk(code: np.ndarray, by_y: np.ndarray):
    """Prepares the signed pair sums of rows in the order of outcomes: a function of multiplicities and weights, each replicate a row of them.

    `code` is the rank of the score, `by_y` the place at which the run of the outcome begins. Two codes that differ do so first at one bit;
    inside the block that shares the higher bits a row with the bit meets those without it, later outcomes for it and earlier ones against it.
    """
    bits = int(code.max(initial=0)).bit_length()
    # a few replicates are cheaper bit by bit, and a long tie run of the score fills a tile of any width
    low = min(TILE.bit_length() - 1, bits)
    tiled = bool(len(code)) and int(np.bincount(code >> low).max()) <= 2 * TILE
    held = {}

    def step(level: int):
        if level in held:
            return held[level]
        block, bit = code >> (level + 1), (code >> level & 1).astype(bool)
        inside = np.argsort(block, kind="stable")  # outcomes stay in order inside a block
        head, first = run_starts(block[inside]), run_starts(block[inside], by_y[inside])
        own = np.flatnonzero(bit[inside])
        # rows with the bit add nothing to each other: for and against cancel over all of their pairs
        got = [i.astype(np.int32) for i in (inside, inside[own], run_ends(head)[own], head[own], run_ends(first)[own], first[own])]
        if len(code) * bits <= MAX_STEPS:
            held[level] = got
        return got

    def sums(m: np.ndarray, w: np.ndarray) -> np.ndarray:
        by_tile = tiled and len(m) >= 8
        out = tile_sums(code, by_y, low, m, w) if by_tile else np.zeros(len(m))
        for level in range(low if by_tile else 0, bits):
            inside, own, *ends = step(level)
            for mine, other in ((w, m), (m, w)):
                total = running(np.take(other, inside, axis=1))
                after, head, last, first = (np.take(total, e, axis=1) for e in ends)
                after += head
                after -= last
                after -= first
                out += np.einsum("ij,ij->i", after, np.take(mine, own, axis=1))
        return out
    return sums


def dense_ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Rank code of every value from 0, equal values alike, NULL first."""
    return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) - 1


def matrix_taus(x: np.ndarray, y: np.ndarray, tie: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Top-weighted rank correlation of every column of multiplicities, NaN where a side is constant, and the rows drawn."""
    n, columns = copies.shape
    drawn = copies.sum(axis=0, dtype=np.int64)
    if not n:
        return np.full(columns, np.nan), drawn
    order = np.lexsort((tie, -y))
    code = np.unique(x[order], return_inverse=True)[1]
    by_y, by_x = run_starts(y[order]), np.argsort(code, kind="stable")
    y_heads = np.unique(by_y)
    x_heads = np.unique(run_starts(code[by_x]))
    walk = pair_walk(code, by_y)
    harmonic = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, int(drawn.max(initial=0)) + 1))])
    out, step = np.full(columns, np.nan), max(1, CELLS // n)
    for at in range(0, columns, step):
        # a row a replicate from here on, so that sums run along memory
        whole, d = np.ascontiguousarray(copies[:, at:at + step].T.astype(np.int64)[:, order]), drawn[at:at + step]
        start = np.cumsum(whole, axis=1) - whole
        w = np.where(whole == 1, 1.0 / (start + 1), harmonic[start + whole] - harmonic[start])
        m = whole.astype(np.float64)
        weight = w.sum(axis=1)
        total, spread, varies = (d - 1) * weight, 1.0, True
        for heads, mr, wr in ((x_heads, np.take(m, by_x, axis=1), np.take(w, by_x, axis=1)), (y_heads, m, w)):
            sums = np.add.reduceat(mr, heads, axis=1)
            spread = spread * np.maximum(total - (np.einsum("ij,ij->i", sums, np.add.reduceat(wr, heads, axis=1)) - weight), 0)
            varies = varies & (sums.max(axis=1) < d)
        varies = varies & (spread > 0)
        out[at:at + step] = np.where(varies, walk(m, w) / np.sqrt(np.where(varies, spread, 1.0)), np.nan)
    return out, drawn


def block_size(units: int) -> int:
    """Replicates in one group of so many units."""
    return max(1, min(BLOCK, MAX_CELLS // max(units, 1)))


def taus(frame: DataFrame, blocks: DataFrame, group: Sequence[str], score: str, outcome: str, unit: str = "entity", block: int = BLOCK) -> DataFrame:
    """(group, replicate, tau, n) of every window and replicate; n is the number of rows drawn.

    The multiplicities of a unit travel once for all strategies of a window.
    """
    windows = [g for g in group if g != "strategy"]
    inner = [g for g in group if g == "strategy"]
    each = F.struct(*inner, F.col(score).cast("double").alias("_x"), F.col(outcome).cast("double").alias("_y"))
    rows = frame.groupBy(*windows, unit).agg(F.collect_list(each).alias("_each")).join(blocks, unit)
    keys = [*windows, "block"]
    fields = [T.StructField(k, rows.schema[k].dataType) for k in keys] + [T.StructField(g, frame.schema[g].dataType) for g in inner]
    schema = T.StructType([*fields, T.StructField("_taus", T.ArrayType(T.DoubleType())), T.StructField("_ns", T.ArrayType(T.LongType()))])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tie = dense_ranks(table.column(unit))
        copies = table.column("copies").combine_chunks().flatten().to_numpy().reshape(len(tie), block)
        held = table.column("_each").combine_chunks()
        at, flat = np.repeat(np.arange(len(tie)), pc.list_value_length(held).to_numpy()), held.flatten()
        x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y"))
        names = flat.field("strategy").dictionary_encode() if inner else None
        which = names.indices.to_numpy() if inner else np.zeros(len(at), np.int64)
        parts = []
        for i in range(len(names.dictionary) if inner else 1):
            mine = np.flatnonzero(which == i)
            tau, drawn = matrix_taus(x[mine], y[mine], tie[at[mine]], copies if len(mine) == len(tie) and (at[mine] == np.arange(len(tie))).all() else copies[at[mine]])
            parts.append({**{k: table.column(k)[0] for k in keys}, **({"strategy": names.dictionary[i]} if inner else {}),
                          "_taus": [None if np.isnan(t) else t for t in tau.tolist()], "_ns": drawn.tolist()})
        types = {**{k: table.schema.field(k).type for k in keys}, **({"strategy": pa.string()} if inner else {}),
                 "_taus": pa.list_(pa.float64()), "_ns": pa.list_(pa.int64())}
        return pa.table({c: pa.array([p[c].as_py() if isinstance(p[c], pa.Scalar) else p[c] for p in parts], t) for c, t in types.items()})

    out = spread(rows, *keys).groupBy(*keys).applyInArrow(run, schema)
    one = out.select(*group, "block", F.posexplode(F.arrays_zip("_taus", "_ns")).alias("_at", "_one"))
    return one.select(*group, (F.col("block") * block + F.col("_at")).cast("int").alias("replicate"), F.col("_one._taus").alias("tau"), F.col("_one._ns").alias("n"))


def group_taus(rows: DataFrame, group: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of every group of (_x, _y, _tie, _m) rows, a group a matrix of one column: (group, _tau), a row a group.

    With ``also`` every row comes back with these columns, and the first of a group holds the correlation.
    """
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in (*group, *also)], T.StructField("_tau", T.DoubleType())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y, m = (table.column(c).to_numpy() for c in ("_x", "_y", "_m"))
        tau = float(matrix_taus(x, y, dense_ranks(table.column("_tie")), m[:, None])[0][0])
        kept = table.select([*group, *also]) if also else table.select(list(group)).slice(0, 1)
        first = pa.concat_arrays([pa.array([None if np.isnan(tau) else tau], pa.float64()), pa.nulls(kept.num_rows - 1, pa.float64())])
        return kept.append_column("_tau", first)

    return rows.groupBy(*group).applyInArrow(run, schema)


def block_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed pair sums inside blocks of coded rows (_dx, _dy, _m, _wt), a block a matrix of one column: (keys, _term)."""
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in keys], T.StructField("_term", T.DoubleType())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y, m, w = (table.column(c).to_numpy() for c in ("_dx", "_dy", "_m", "_wt"))
        order = np.argsort(y, kind="stable")
        walk = pair_walk(np.unique(x[order], return_inverse=True)[1], run_starts(y[order]))
        term = walk(m[order].astype(np.float64)[None], w[order][None])[0]
        return table.select(list(keys)).slice(0, 1).append_column("_term", pa.array([float(term)]))

    return rows.groupBy(*keys).applyInArrow(run, schema)


def fits(units: int, limit: int) -> bool:
    """True if the units of one window are one task's matrix: no more rows than a task may hold."""
    return units <= min(limit, MAX_CELLS)
