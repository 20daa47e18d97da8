"""Minimax contiguous sharding: binary search for the smallest capacity, checked greedily, then cut there.

Equal texts form an atomic group. Groups stand in the order of a 64-bit hash of their text (groups
whose hashes collide count as one), and the sequence is cut into k runs so that the heaviest run is as light
as it can be in that order. The driver never sees the groups: it holds sums over hash ranges, and asks
for finer ranges only where a cut can fall. Bounds that do not grow with the data: 2^BITS ranges, at most
2^BITS heavy groups (each holds over 1/2^BITS of all bytes) and at most k giants (each over its fair share;
a giant has a shard of its own). Documents find their shard by comparing their hash with k - 1 cuts; no join.

Defined cases: null text is an empty group of its own; a shard can be empty if there are fewer groups than
shards; repeated rows stay together; an empty table gives an empty result.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.llm.common import numbered
from paneltide.scale import staged, staging_path

BITS, FINER_BITS = 14, 6
ROW_BYTES = 8
SLICE_BYTES = 32 << 20


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


class Cuts:
    """k - 1 places in the order (range, light after heavy, hash), and the groups with a shard of their own."""

    def __init__(self, giants: list[int], places: list[tuple[int, int, int]], heavy: list[int]):
        self.giants, self.places, self.heavy = giants, places, heavy

    def shard(self, hashed: Column) -> Column:
        near = {p[0] for p in self.places}
        named = [h for h in self.heavy if h >> (64 - BITS) in near]
        light = F.when(hashed.isin(named), 0).otherwise(1) if named else F.lit(1)
        at = F.struct(F.shiftright(hashed, 64 - BITS), light, hashed)
        shard = F.lit(len(self.giants))
        for p in self.places:
            shard = shard + (at >= F.struct(F.lit(p[0]).cast("long"), F.lit(p[1]), F.lit(p[2]).cast("long"))).cast("int")
        for i, h in enumerate(self.giants):
            shard = F.when(hashed == F.lit(h), F.lit(i)).otherwise(shard)
        return shard.cast("int")


def greedy(ends: np.ndarray, capacity: int, k: int) -> list[int]:
    """Positions reached by filling k runs one after another up to the capacity."""
    at, out = 0, []
    for _ in range(k):
        at = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        out.append(at)
    return out


def smallest_capacity(ends: np.ndarray, k: int) -> int:
    low, high = max(1, math.ceil(int(ends[-1]) / k)), max(1, int(ends[-1]))
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(ends, middle, k)[-1] == len(ends) - 1 else (middle + 1, high)
    return low


def balanced(ends: np.ndarray, capacity: int, k: int) -> list[int]:
    """Cuts under the capacity, each as near to an equal share as both neighbours allow."""
    late = greedy(ends, capacity, k)
    back = [len(ends) - 1 - p for p in greedy(ends[-1] - ends[::-1], capacity, k)]
    early = back[::-1][1:] + [len(ends) - 1]
    cuts, at = [], 0
    for i in range(k - 1):
        reach = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        want = ends[-1] * (i + 1) / k
        j = int(np.searchsorted(ends, want))
        if j > 0 and want - ends[j - 1] <= ends[min(j, len(ends) - 1)] - want:
            j -= 1
        at = max(at, min(max(j, early[i]), reach, late[i] if late[i] < early[i] else reach))
        cuts.append(at)
    return cuts


def find_cuts(groups: DataFrame, k: int) -> Cuts:
    """groups: hash, bytes. The exact minimax cut of the sequence into k runs (giants set apart)."""
    total = int(groups.agg(F.sum("bytes")).first()[0] or 0)
    heavy = [(int(r["hash"]), int(r["bytes"])) for r in
             groups.where(F.col("bytes") * (1 << BITS) > F.lit(total)).select("hash", "bytes").collect()]
    heavy.sort(key=lambda x: (-x[1], x[0]))
    giants: list[int] = []
    while heavy and k - len(giants) > 1 and heavy[0][1] * (k - len(giants)) > total:
        giants.append(heavy[0][0])
        total -= heavy.pop(0)[1]
    runs = k - len(giants)
    named = giants + [h for h, _ in heavy]
    light = groups.where(~F.col("hash").isin(named)) if named else groups
    # a segment: (range, light, first hash), bytes, True if it is one group, shift of its light range
    segments = [((h >> (64 - BITS), 0, h), b, True, 0) for h, b in heavy]
    segments += ranges(light, 64 - BITS)
    while segments:
        segments.sort()
        ends = np.concatenate([[0], np.cumsum([s[1] for s in segments])])
        capacity = smallest_capacity(ends, runs)
        first = greedy(ends, math.ceil(total / runs), runs)
        wanted: set[int] = set()
        for i in range(runs - 1):
            last = int(np.searchsorted(ends, min(ends[-1], (i + 1) * capacity), "right"))
            wanted |= {j for j in range(first[i], min(last, len(segments))) if not segments[j][2]}
        if not wanted:
            places = [segments[j][0] if j < len(segments) else (1 << BITS, 0, 0) for j in balanced(ends, capacity, runs)]
            return Cuts(giants, places, [h for h, _ in heavy])
        finer = []
        for shift in {segments[j][3] for j in wanted}:
            starts = [segments[j][0][2] >> shift for j in wanted if segments[j][3] == shift]
            finer += ranges(light.where(F.shiftright("hash", shift).isin(starts)), max(0, shift - FINER_BITS))
        segments = [s for j, s in enumerate(segments) if j not in wanted] + finer
    return Cuts(giants, [(1 << BITS, 0, 0)] * (runs - 1), [])


def ranges(light: DataFrame, shift: int) -> list:
    """Sums over hash ranges: as many rows as ranges were asked for."""
    found = light.groupBy(F.shiftright("hash", shift).alias("r")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    return [((r["r"] << shift >> (64 - BITS), 1, r["r"] << shift), int(r["b"]), r["n"] == 1 or shift == 0, shift) for r in found]


def assigned(docs: DataFrame, k: int = 24) -> DataFrame:
    """doc_id, text, size, shard, slot: slots number the documents of a shard without a gap from 0."""
    narrow = docs.select("doc_id", "text").withColumn("size", row_size(F.col("text"))).withColumn("_hash", text_hash(F.col("text")))
    groups = staged(narrow.groupBy(F.col("_hash").alias("hash")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")).sortWithinPartitions("hash"), "shard_groups")
    sums = groups.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    rows, total = int(sums["rows"] or 0), int(sums["bytes"] or 0)
    placed = narrow.withColumn("shard", find_cuts(groups, k).shard(F.col("_hash")))
    slices = max(1, math.ceil(total / k / SLICE_BYTES), math.ceil(rows / k / 200_000))
    placed = placed.withColumn("_tie", F.xxhash64("text", F.lit(1)))
    return numbered(placed, ["shard"], ["doc_id", "_hash", "_tie"], "slot", rows, max(1, rows // slices)).drop("_hash", "_tie")


def write_shards(docs: DataFrame, path: str, k: int = 24) -> DataFrame:
    """Write the shards as Parquet folders shard=0, shard=1, ... and return them as read back."""
    assigned(docs, k).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(
        docs.select("doc_id", "text").withColumn("size", F.lit(0).cast("long")).withColumn("slot", F.lit(0).cast("long"))
        .withColumn("shard", F.lit(0)).schema).parquet(path)


def shards(docs: DataFrame, k: int = 24) -> DataFrame:
    """write_shards() into the shared folder."""
    return write_shards(docs, staging_path(docs.sparkSession, "shards"), k)
