"""Ranks of noisy scores, all draws of a cross-section in few blocks, and their percentiles.

A row a draw sorts and moves every entity once a draw, twice. Here the rows of a group lie in slices of some thousand, ordered by entity, an
array a column. A block of replicates meets a whole group as matrices: the normals of a draw come from the MD5 of its text
(`functions.scalar.standard_normal`), computed for a tile of rows at once, and ranks leave as two or three bytes a draw,
a row a slice and block. Percentiles gather the blocks of a slice.

That is for groups of no more rows than a task may hold. In a larger one a task draws the scores of a slice and sends each to the bucket of its range,
with the number of its rows in the buckets before; a task a bucket and block ranks them and the ranks go to their slices. Cut
points between buckets come from some of the rows; they decide how even the buckets are, never a rank. Rows tied at a
cut are dealt over the buckets beside it in their order. Both plans give the same ranks.
"""
from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.functions.scalar import standard_normal
from paneltide.scale import is_wide, join_groups, small_side, staged, task_row_limit

BLOCK = 50  # replicates in one block at most
SPLIT_BLOCK = 25  # in the plan for large groups, which moves scores
MAX_CELLS = 1 << 24  # draws in one block
SLICE_ROWS = 4096
SLICES = 16  # that draw together in the plan for large groups
BUCKET_ROWS = 1 << 17
TILE = 1 << 16  # draws whose digests are computed at once
CUT_ROWS = 1 << 12  # rows of a group that place its cut points
CUT_DRAWS = 2
TASK_DRAWS = 1 << 22  # draws that are worth a task

def word(x: int) -> np.ndarray:
    return np.array(x & 0xFFFFFFFF, np.uint32)


# MD5: constants, word and turns of each of its 64 steps
SINES = [word(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
TURNS = [((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i >> 4][i & 3] for i in range(64)]
LEFT, RIGHT = [word(s) for s in TURNS], [word(32 - s) for s in TURNS]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SCORES = "_base"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module


# ---- draws -------------------------------------------------------------------------------------

def md5_block(start: Sequence[np.ndarray], words: Sequence[np.ndarray], size: int) -> list[np.ndarray]:
    """MD5 state after one block of 16 words.

    Words and state hold a number a replicate where all rows have the same, else ``size`` numbers, a replicate's rows behind the other;
    words of all are single. Steps before the first word that differs are made once a replicate.
    """
    xor, both, either, add, left, right = np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.add, np.left_shift, np.right_shift
    count = start[0].size
    a, b, c, d = start
    shared = next((i for i in range(16) if words[i].size == size), 64) if count < size else 0
    for i in range(shared):
        f = (d ^ (b & (c ^ d)), c ^ (d & (b ^ c)), b ^ c ^ d, c ^ (b | ~d))[i >> 4]
        x = a + f + SINES[i] + words[PLACES[i]]
        a, d, c, b = d, c, b, b + (x << LEFT[i] | x >> RIGHT[i])
    if shared < 64:
        a, b, c, d = (np.repeat(x, size // len(x)) for x in (a, b, c, d))
        t = np.empty(size, np.uint32)
        words = [np.repeat(x, size // count) if 1 < x.size < size else x.reshape(()) if x.size == 1 < size else x for x in words]
    for i in range(shared, 64):  # in place: the first word of a state is not used again
        if i < 16:
            xor(c, d, t)
            both(t, b, t)
            xor(t, d, t)
        elif i < 32:
            xor(b, c, t)
            both(t, d, t)
            xor(t, c, t)
        elif i < 48:
            xor(b, c, t)
            xor(t, d, t)
        else:
            np.invert(d, t)
            either(t, b, t)
            xor(t, c, t)
        add(a, t, a)
        w = words[PLACES[i]]
        if w.ndim:
            add(a, w, a)
            add(a, SINES[i], a)
        else:
            add(a, word(int(w) + int(SINES[i])), a)
        left(a, LEFT[i], t)
        right(a, RIGHT[i], a)
        either(a, t, a)
        add(a, b, a)
        a, d, c, b = d, c, b, a
    return [x + (np.repeat(s, x.size // s.size) if s.size < x.size else s) for s, x in zip(start, (a, b, c, d))]


class Ends:
    """Ends of one length of the texts of some rows, as the 32-bit words they fill behind a beginning."""

    def __init__(self, rows: np.ndarray, ends: np.ndarray):
        first = int(rows[0])
        self.rows = slice(first, first + len(rows)) if (np.diff(rows) == 1).all() else rows
        self.ends, self.held = ends, {}

    def words(self, at: int) -> np.ndarray:
        if at not in self.held:
            n, size = self.ends.shape
            wide = np.zeros((n, (at + size) // 4 * 4 + 4), np.uint8)
            wide[:, at:at + size] = self.ends
            wide[:, at + size] = 0x80
            self.held[at] = np.ascontiguousarray(wide.view("<u4").T.astype(np.uint32))
        return self.held[at]

    def digests(self, heads: np.ndarray):
        """(place, first numbers, second numbers) of 32 bits of the MD5 of every beginning (a row of bytes) with every end, a tile at a time."""
        n, size = self.ends.shape
        count, long = heads.shape
        whole, at = divmod(long, 4)
        shared = np.zeros((count, whole * 4 + 4), np.uint8)
        shared[:, :long] = heads
        shared = shared.view("<u4").astype(np.uint32)
        tail, blocks, bits = self.words(at), (long + size + 8) // 64 + 1, 8 * (long + size)
        for lo in range(0, n, TILE):
            part = tail[:, lo:lo + TILE]
            m = part.shape[1]
            mixed = (part[0] | shared[:, [whole]]).reshape(-1)
            words = [*(shared[:, i] for i in range(whole)), mixed, *(np.tile(x, count) if count > 1 else x for x in part[1:])]
            words += [word(0)] * (16 * blocks - 2 - len(words)) + [word(bits), word(bits >> 32)]
            state = [np.full(count, x, np.uint32) for x in START]
            for i in range(blocks):
                state = md5_block(state, words[16 * i:16 * i + 16], count * m)
            yield slice(lo, lo + m), *(x.byteswap(inplace=True).reshape(count, m) for x in state[:2])


def ends_by_length(texts: pa.Array) -> list[Ends]:
    """The bytes of the texts of all rows, rows of one length together."""
    raw = [t.encode() for t in texts.to_pylist()]
    sizes = np.array([len(x) for x in raw], np.int64)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        ends = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), size)
        out.append(Ends(rows, ends))
    return out


def uniforms(bits: np.ndarray) -> np.ndarray:
    out = bits + 0.5
    out *= 2.0 ** -32
    return out


def normals(label: str, replicates: Sequence[int], ends: Sequence[Ends], n: int) -> np.ndarray:
    """Box-Muller from two numbers of a digest, a row a replicate; all numbers of the replicates have equally many digits."""
    heads = np.array([list(f"{label}:{i}".encode()) for i in replicates], np.uint8)
    out = np.empty((len(heads), n))
    for e in ends:
        for at, first, second in e.digests(heads):
            size, turn = np.log(uniforms(first)), uniforms(second)
            size *= -2.0
            turn *= 2.0 * math.pi
            np.sqrt(size, size)
            size *= np.cos(turn, turn)
            out[:, slice(e.rows.start + at.start, e.rows.start + at.stop) if isinstance(e.rows, slice) else e.rows[at]] = size
    return out


def batches(lo: int, hi: int, rows: int):
    """Replicates that are drawn at once: as many as fill a tile, all with equally many digits."""
    step = max(1, TILE // max(rows, 1))
    while lo < hi:
        end = min(hi, lo + step, 10 ** len(str(lo)))
        yield range(lo, end)
        lo = end


def descending(scores: np.ndarray, absent: np.ndarray | None = None) -> np.ndarray:
    """Whole numbers in the order of descending scores: equal for equal scores, NaN first, absent ones last."""
    bits = np.where(np.isnan(scores), np.nan, scores + 0.0).view(np.int64)
    keys = ~(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))
    if absent is not None:
        keys[:, absent] = np.iinfo(np.int64).max
    return keys


def drawn_keys(table: dict[str, np.ndarray], absent: np.ndarray | None, ends: Sequence[Ends], of: str, noise: Sequence[tuple[str, float, float]], lo: int, hi: int):
    """(replicates, keys) of all draws of some rows: a matrix a batch, in the order of descending scores."""
    n = len(table[SCORES])
    for some in batches(lo, hi, n):
        score = np.broadcast_to(table[SCORES], (len(some), n))
        for i, (label, rho, weight) in enumerate(noise):
            z = table[f"_z{i}"]
            moved = rho * z + (1.0 - rho * rho) ** 0.5 * normals(label + of, some, ends, n)
            score = score + weight * (moved - z)
        yield some, descending(score, absent)


def order_of(keys: np.ndarray) -> np.ndarray:
    """Places in ascending order, equal keys in the order they have."""
    order = np.argsort(keys)
    ordered = keys[order]
    return np.argsort(keys, kind="stable") if (ordered[1:] == ordered[:-1]).any() else order


# ---- bytes -------------------------------------------------------------------------------------

def high_type(largest: int):
    """Type of the bits of a rank above the lower sixteen, None if it has none."""
    return None if largest < 1 << 16 else np.uint8 if largest < 1 << 24 else np.uint16


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive parts of an array as binary values."""
    ends = np.concatenate([[0], np.cumsum(lengths * data.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def numbers(value: bytes | None, kind) -> np.ndarray:
    return np.frombuffer(value or b"", kind)


def whole_ranks(low: bytes, high: bytes | None) -> np.ndarray:
    ranks = numbers(low, np.uint16).astype(np.int32)
    if high and len(ranks):
        ranks |= numbers(high, np.uint8 if len(high) == len(ranks) else np.uint16).astype(np.int32) << 16
    return ranks


def columns_of(lists: pa.Table, noise: Sequence) -> tuple[dict[str, np.ndarray], np.ndarray | None, list[Ends]]:
    """Numbers, rows without a score and texts of the slices of a table, one behind the other."""
    flat = {c: lists.column(c).combine_chunks().flatten() for c in (SCORES, *(f"_z{i}" for i in range(len(noise))), "_text")}
    texts = flat.pop("_text")
    absent = np.flatnonzero(flat[SCORES].is_null().to_numpy(zero_copy_only=False))
    return {c: v.to_numpy(zero_copy_only=False) for c, v in flat.items()}, absent if len(absent) else None, ends_by_length(texts)


# ---- plans -------------------------------------------------------------------------------------

def sliced(rows: DataFrame, group: str, columns: Sequence[str], parts: int, most: int) -> DataFrame:
    """(group, _of, _slice, arrays): rows in the order of entities in slices of some rows, equal entities in one slice; slices have the order of entities, too."""
    inside = Window.partitionBy("_part", group).orderBy("entity")
    placed = rows.repartitionByRange(parts, group, "entity").withColumn("_part", F.spark_partition_id().cast("bigint"))
    numbered = placed.withColumn("_slice", F.col("_part") * (1 << 32) + F.floor((F.dense_rank().over(inside) - 1) / most))
    held = numbered.groupBy(group, "_of", "_slice").agg(F.sort_array(F.collect_list(F.struct("entity", "_text", *columns))).alias("_rows"))
    return held.select(group, "_of", "_slice", F.col("_rows.entity").alias("_entities"), *[F.col(f"_rows.{c}").alias(c) for c in ("_text", *columns)])


def noisy_ranks(rows: DataFrame, noise: Sequence[tuple[str, float, float]], replicates: int, group: str, bound: int | None = None) -> DataFrame:
    """Ranks of all draws of (group, entity, _base, _z0, ...) rows: a row a slice, block and bucket.

    ``noise`` names the label, reliability and weight of each input. Columns: entities of the slice in order (once a slice), first replicate,
    ranks as bytes, a replicate behind the other; with ``_at`` and ``_counts`` only the rows that these name, else all.
    """
    spark = rows.sparkSession
    inputs = [f"_z{i}" for i in range(len(noise))]
    rows = staged(rows.select(group, F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("")).alias("_of"), "entity",
                              F.coalesce(F.concat(F.lit(":"), F.col("entity").cast("string")), F.lit("")).alias("_text"), SCORES, *inputs), "noise")
    size = rows.groupBy(group).count().agg(F.max("count").alias("n"), F.sum("count").alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    largest, total, groups = size["n"] or 0, size["rows"] or 0, size["groups"]
    limit, least = task_row_limit(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = sliced(rows, group, [SCORES, *inputs], max(least, math.ceil(total / limit)), min(SLICE_ROWS, limit))
    if is_wide(rows, [group], max(bound or 0, largest)):
        return bucket_ranks(staged(slices, "slices"), rows, noise, replicates, group, largest, total)
    block = max(1, min(BLOCK, MAX_CELLS // max(largest, 1)))
    tasks = min(2 * groups * math.ceil(replicates / block), math.ceil(total * replicates / TASK_DRAWS))
    dealt = in_blocks(slices, block, replicates).repartition(max(least, tasks), group, "_block")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_slice")
        sizes = np.diff(table.column("_text").combine_chunks().offsets.to_numpy())
        ends, n, lo = np.cumsum(sizes), int(sizes.sum()), table.column("_block")[0].as_py()
        hi = min(lo + block, replicates)
        kind, cells = high_type(n), sizes * (hi - lo)
        low, high = np.empty(n * (hi - lo), np.uint16), np.empty(n * (hi - lo) if kind else 0, kind or np.uint8)
        numbers_, absent, texts = columns_of(table, noise)
        starts, ranks, steps = np.cumsum(cells) - cells, np.empty(n, np.uint32), np.arange(1, n + 1, dtype=np.uint32)
        for some, keys in drawn_keys(numbers_, absent, texts, table.column("_of")[0].as_py(), noise, lo, hi):
            for i, mine in zip(some, keys):
                ranks[order_of(mine)] = steps
                for start, m, end in zip(starts, sizes, ends):
                    to = slice(start + (i - lo) * m, start + (i - lo + 1) * m)
                    low[to] = ranks[end - m:end]  # the lower bits
                    if kind:
                        high[to] = ranks[end - m:end] >> 16
        nothing = pa.nulls(len(sizes), pa.binary())
        return pa.table([table.column(group), table.column("_slice"), table.column("_block"), table.column("_entities"),
                         nothing, nothing, binaries(low, cells), binaries(high, cells) if kind else nothing], names=schema.names)

    schema = ranks_schema(slices, group)
    return dealt.groupBy(group, "_block").applyInArrow(run, schema)


def in_blocks(slices: DataFrame, block: int, replicates: int) -> DataFrame:
    """A row a block of replicates, named by its first; the first block has the entities."""
    each = slices.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(block))))
    return each.withColumn("_entities", F.when(F.col("_block") == 0, F.col("_entities")))


def ranks_schema(slices: DataFrame, group: str) -> T.StructType:
    fields = [slices.schema[group], slices.schema["_slice"], T.StructField("_block", T.IntegerType()), slices.schema["_entities"]]
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField(c, T.BinaryType()) for c in ("_counts", "_at", "_low", "_high")])


def cut_points(rows: DataFrame, noise: Sequence[tuple[str, float, float]], replicates: int, group: str, largest: int, buckets: int) -> DataFrame:
    """(group, _cuts): scores between the buckets, from a few draws of some of the rows."""
    some = rows.filter(F.pmod(F.xxhash64(F.lit("cuts"), "entity"), F.lit(max(1, largest // CUT_ROWS))) == 0)
    some = some.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(min(CUT_DRAWS, replicates) - 1))))
    score = F.col(SCORES)
    for i, (label, rho, weight) in enumerate(noise):
        moved = F.lit(rho) * F.col(f"_z{i}") + F.lit((1.0 - rho * rho) ** 0.5) * standard_normal(F.lit(label), group, "replicate", "entity")
        score = score + F.lit(weight) * (moved - F.col(f"_z{i}"))
    at = F.array(*[F.lit(1 - i / buckets) for i in range(1, buckets)])
    known = some.select(group, score.alias("_score")).filter("_score IS NOT NULL AND NOT isnan(_score)")
    return known.groupBy(group).agg(F.percentile_approx("_score", at, 10_000).alias("_cuts"))


def bucket_ranks(slices: DataFrame, rows: DataFrame, noise: Sequence[tuple[str, float, float]], replicates: int, group: str, largest: int, total: int) -> DataFrame:
    """The plan of `noisy_ranks` for groups of more rows than a task may hold."""
    spark = rows.sparkSession
    limit, least = task_row_limit(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2, math.ceil(largest / min(BUCKET_ROWS, limit)))
    block = min(SPLIT_BLOCK, replicates)
    line = Window.partitionBy(group)
    place = F.row_number().over(line.orderBy("_slice")) - 1
    places = slices.select(group, "_slice", (place / F.count(F.lit(1)).over(line)).alias("_share"), F.floor(place / SLICES).alias("_several"))
    where = join_groups(places, cut_points(rows, noise, replicates, group, largest, buckets), [group], "left")
    dealt = in_blocks(join_groups(slices, small_side(where), [group, "_slice"]), block, replicates)
    tasks = max(least, math.ceil(total * replicates / TASK_DRAWS))
    dealt = dealt.repartition(tasks, group, "_several", "_block")
    final = ranks_schema(slices, group)
    sent = T.StructType([*final.fields[:4], T.StructField("_bucket", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("_counts", "_ahead", "_at", "_keys")]])

    def send(key: tuple, table: pa.Table) -> pa.Table:
        numbers_, absent, texts = columns_of(table, noise)
        sizes = np.diff(table.column("_text").combine_chunks().offsets.to_numpy())
        lo = table.column("_block")[0].as_py()
        hi = min(lo + block, replicates)
        cuts = np.sort(descending(np.array([table.column("_cuts")[0].as_py() or []], np.float64))[0])
        share = np.repeat(table.column("_share").to_numpy(), sizes)
        counts = np.zeros((len(sizes), buckets, hi - lo), np.int32)
        kept, at = ([[[] for _ in range(buckets)] for _ in sizes] for _ in range(2))
        small = np.uint16 if sizes.max() <= 1 << 16 else np.uint32
        for some, keys in drawn_keys(numbers_, absent, texts, table.column("_of")[0].as_py(), noise, lo, hi):
            for i, mine in zip(some, keys):
                first = np.searchsorted(cuts, mine)
                if (mine == cuts[np.minimum(first, len(cuts) - 1)]).any() if len(cuts) else False:
                    tied = np.searchsorted(cuts, mine, "right") - first
                    first += (share * (tied + 1)).astype(np.int64)
                first = first.astype(np.uint16)
                for s, end in enumerate(np.cumsum(sizes)):
                    bucket, own = first[end - sizes[s]:end], mine[end - sizes[s]:end]
                    for b in range(buckets):
                        there = np.flatnonzero(bucket == b)
                        counts[s, b, i - lo] = len(there)
                        kept[s][b].append(own[there])
                        at[s][b].append(there.astype(small))
        ahead = np.cumsum(counts, axis=1, dtype=np.int32) - counts
        rows = []
        for s in range(len(sizes)):
            alike = [pa.array([table.column(c)[s].as_py()] * buckets, table.schema.field(c).type) for c in (group, "_slice", "_block")]
            names = pa.concat_arrays([table.column("_entities").slice(s, 1).combine_chunks(), pa.nulls(buckets - 1, table.schema.field("_entities").type)])
            bytes_ = [[x.tobytes() for x in counts[s]], [x.tobytes() for x in ahead[s]], *([np.concatenate(x).tobytes() for x in y[s]] for y in (at, kept))]
            rows.append(pa.table([*alike, names, pa.array(range(buckets), pa.int32()), *(pa.array(x, pa.binary()) for x in bytes_)], names=sent.names))
        return pa.concat_tables(rows)

    def rank(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_slice")
        counts = np.array([numbers(x, np.int32) for x in table.column("_counts").to_pylist()]).reshape(table.num_rows, -1)
        before = np.array([numbers(x, np.int32) for x in table.column("_ahead").to_pylist()]).reshape(counts.shape).sum(axis=0, dtype=np.int64)
        keys = [np.frombuffer(x.as_buffer(), np.int64) for x in table.column("_keys")]
        ends, cells = np.cumsum(counts, axis=1), counts.sum(axis=1)
        starts, kind = np.cumsum(cells) - cells, high_type(int((before + counts.sum(axis=0)).max(initial=0)))
        low, high = np.empty(cells.sum(), np.uint16), np.empty(cells.sum() if kind else 0, kind or np.uint8)
        for i in range(counts.shape[1]):
            mine = np.concatenate([k[e[i] - c[i]:e[i]] for k, e, c in zip(keys, ends, counts)])
            ranks = np.empty(len(mine), np.uint32)
            ranks[order_of(mine)] = np.arange(1, len(mine) + 1, dtype=np.uint32) + np.uint32(before[i])
            done = 0
            for start, e, c in zip(starts, ends, counts):
                to, got = slice(start + e[i] - c[i], start + e[i]), ranks[done:done + c[i]]
                low[to], done = got, done + c[i]
                if kind:
                    high[to] = got >> 16
        return pa.table([*(table.column(c) for c in (group, "_slice", "_block", "_entities", "_counts", "_at")), binaries(low, cells),
                         binaries(high, cells) if kind else pa.nulls(len(cells), pa.binary())], names=final.names)

    met = dealt.groupBy(group, "_several", "_block").applyInArrow(send, sent)
    return met.repartition(tasks, group, "_block", "_bucket").groupBy(group, "_block", "_bucket").applyInArrow(rank, final)


def is_blocks(ranks: DataFrame) -> bool:
    return {"_block", "_low", "_high"} <= set(ranks.columns)


def percentiles(ranks: DataFrame, group: str, percents: Mapping[str, int]) -> DataFrame:
    """(group, entity, a column a name): percentiles of all ranks of an entity, in hundredths and interpolated, whole numbers."""
    entity = ranks.schema["_entities"].dataType.elementType
    schema = T.StructType([T.StructField(group, ranks.schema[group].dataType), T.StructField("entity", entity), *[T.StructField(c, T.LongType()) for c in percents]])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        held = table.column("_entities").combine_chunks()
        names = held.flatten()
        n = len(names)
        drawn = np.empty((sum(len(x.as_buffer()) for x in table.column("_low")) // (2 * n), n), np.int32)
        flat = drawn.reshape(-1)
        for lo, counts, at, low, high in zip(*(table.column(c).to_pylist() for c in ("_block", "_counts", "_at", "_low", "_high"))):
            got = whole_ranks(low, high)
            if counts is None:
                flat[lo * n:lo * n + len(got)] = got
            elif len(got):
                counts, at = numbers(counts, np.int32), numbers(at, np.uint16 if len(at) == 2 * len(got) else np.uint32)
                flat[np.repeat((lo + np.arange(len(counts), dtype=np.int64)) * n, counts) + at] = got
        drawn = np.ascontiguousarray(drawn.T)
        codes = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))  # rows of an entity lie together
        sizes = np.diff(np.append(heads, n))
        out = {c: np.empty(len(heads), np.int64) for c in percents}
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            rows = drawn if size == 1 and len(mine) == n else drawn[heads[mine, None] + np.arange(size)].reshape(len(mine), -1)
            rows.sort(axis=1)
            for c, percent in percents.items():
                i, part = divmod((rows.shape[1] - 1) * percent, 100)
                out[c][mine] = rows[:, i].astype(np.int64) * (100 - part) + rows[:, min(i + 1, rows.shape[1] - 1)].astype(np.int64) * part
        of = pa.array([table.column(group)[0].as_py()] * len(heads), table.schema.field(group).type)
        return pa.table([of, names.take(pa.array(heads)), *(pa.array(out[c]) for c in percents)], names=schema.names)

    return ranks.groupBy(group, "_slice").applyInArrow(run, schema)
