"""Prefix trie of conversations, balanced parentheses per shard.

A node is a distinct sequence of first turns. A turn is known by a digest of role and text (DIGEST bytes) and the code points of the
text; the conversation's path is these, one behind the other, so byte order is the order of a walk through the trie.

Conversations are range-partitioned by (path, id), so neither a common first turn nor a group of copies is one task's. A shard
encodes its part of the trie as balanced parentheses and answers everything from them:

* the excess (depth) of blocks of BLOCK parentheses has its minimum in a tree of minima; `findclose` goes up and down in it,
  for all opening parentheses at once, and delimits every subtree;
* rank: a leaf is a pair "()", so a running count of pairs gives the leaves of a subtree as a difference, and running counts of opening
  parentheses translate places to nodes;
* cumulative arrays over nodes in walk order give the subtree's conversations and savings as differences.

Shards are contiguous, so a node can occur in two of them only if it lies on the first or last path of both: those spines are
merged by node. A shard gives for a spine node what hangs off it outside the spines; sums by node and one walk over the merged spines, whose number is
bounded by shards times path length, give its values.

The digest of the conversations that end at a node runs over their ids in order. Inside a shard they are at hand; the ids of a node on a spine
leave their shard as joined text in chunks of IDS_AT_ONCE ids, and the chunks of a node are hashed one after the other, in order.

Defined cases: rows without conv_id belong to no conversation; turns with equal numbers stand in order of the digest of role and text;
repeated rows are turns of their own; null role or text is empty; an empty table has no sequence and so no node;
one conversation's digests are one row (20 bytes a turn), texts never are; other columns are not read, whatever their names.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneltide.scale import staged

DIGEST, ENTRY = 16, 20
BLOCK = 64
#: Turns that a shard holds.
SHARD_TURNS = 1_000_000
#: Ids in one chunk of joined text.
IDS_AT_ONCE = 50_000
NOTHING = hashlib.sha256(b"").hexdigest()


def entry(role: Column, text: Column) -> Column:
    """A turn as hexadecimal text: digest, then code points of the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    return F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0"))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path: an array of entries in the order of turns."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", entry(F.col("role"), F.col("text")).alias("entry")).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "entry"))), lambda x: x["entry"]).alias("path"))


def with_shared_heads(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """conv_id, path with its first turns replaced by those of the conversation at the last multiple of `every`: crc32(id) % most of them."""
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("path", 1, most - 1).alias("_head"))
    n = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    based = convs.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("_base"), "left")
    head = F.slice(F.coalesce("_head", F.array().cast("array<string>")), F.lit(1), n)
    return based.select("conv_id", F.concat(head, F.slice("path", n + 1, F.greatest(F.size("path"), F.lit(1)))).alias("path"))


class Excess:
    """Range min-max tree over the excess of a parenthesis sequence."""

    def __init__(self, opens: np.ndarray):
        self.n = len(opens)
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = -(-self.n // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[:self.n] = self.excess
        self.rows = padded.reshape(blocks, BLOCK)
        self.levels = [self.rows.min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = np.append(low, np.iinfo(np.int64).max)
            self.levels.append(low.reshape(-1, 2).min(axis=1))

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Places of the closing parentheses: the first place behind with an excess below that at the opening one."""
        out = np.empty(len(opens), np.int64)
        for a in range(0, len(opens), 1 << 16):
            out[a:a + (1 << 16)] = self._findclose(opens[a:a + (1 << 16)])
        return out

    def _findclose(self, at: np.ndarray) -> np.ndarray:
        below = self.excess[at]
        block = at // BLOCK
        hit = (self.rows[block] < below[:, None]) & (np.arange(BLOCK) > (at % BLOCK)[:, None])
        found = hit.any(axis=1)
        out = block * BLOCK + hit.argmax(axis=1)
        far = np.flatnonzero(~found)
        if len(far):
            node, limit = block[far], below[far]
            level = np.zeros(len(far), np.int64)
            climbing = np.ones(len(far), bool)
            for k, low in enumerate(self.levels):  # up, until a right neighbour holds a smaller excess
                right = np.minimum(node + 1, len(low) - 1)
                stop = climbing & (node % 2 == 0) & (node + 1 < len(low)) & (low[right] < limit)
                level[stop], node[stop] = k, node[stop] + 1
                climbing &= ~stop
                node[climbing] //= 2
            if climbing.any():
                raise ValueError("not a balanced sequence")
            for k in range(len(self.levels) - 1, 0, -1):  # down, to the leftmost block
                down = level >= k
                if down.any():
                    left = 2 * node[down]
                    node[down] = np.where(self.levels[k - 1][left] < limit[down], left, left + 1)
            out[far] = node * BLOCK + (self.rows[node] < limit[:, None]).argmax(axis=1)
        return out


def range_min(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Smallest of values[start:stop], stop > start, by a table of minima over powers of two."""
    tables = [values]
    while 2 << (len(tables) - 1) <= len(values):
        half = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    level = np.frexp((stop - start).astype(np.float64))[1] - 1
    out = np.empty(len(start), values.dtype)
    for k in np.unique(level).tolist():
        own = level == k
        out[own] = np.minimum(tables[k][start[own]], tables[k][stop[own] - (1 << k)])
    return out


class Trie:
    """Trie of paths in byte order. Nodes are numbered in walk order, the root is 0."""

    def __init__(self, sorted_paths: list[bytes]):
        depths = np.array([len(p) // ENTRY for p in sorted_paths], np.int64)
        starts = np.concatenate([[0], np.cumsum(depths)])
        entries = np.frombuffer(b"".join(sorted_paths), np.uint8).reshape(-1, ENTRY)
        digests = np.ascontiguousarray(entries[:, :DIGEST]).view("<u8").reshape(-1, 2)
        row = np.repeat(np.arange(len(depths)), depths)
        place = np.arange(len(row)) - starts[row]
        other = np.where((row > 0) & (place < depths[row - 1]), starts[row - 1] + place, -1)
        equal = (other >= 0) & (digests == digests[other]).all(axis=1) if len(row) else np.zeros(0, bool)
        shared = depths.copy()  # turns in common with the path before
        broken = np.flatnonzero(~equal)
        if len(broken):
            first = broken[np.concatenate([[True], row[broken][1:] != row[broken][:-1]])]
            shared[row[first]] = place[first]
        shared[:1] = 0
        closes = np.concatenate([[0], depths[:-1] - shared[1:]]) if len(depths) else depths
        opened = depths - shared
        last = int(depths[-1]) if len(depths) else 0
        signs = np.repeat(np.tile([False, True], len(depths)), np.stack([closes, opened], axis=1).ravel()) if len(depths) else np.zeros(0, bool)
        self.opens = np.concatenate([[True], signs, np.zeros(last + 1, bool)])
        self.at = np.flatnonzero(self.opens)
        tree = Excess(self.opens)
        self.depth = tree.excess[self.at] - 1
        self.nodes = len(self.at)
        until = tree.findclose(self.at)
        before = np.concatenate([[0], np.cumsum(self.opens)])
        #: A node's subtree is the nodes from it to `stop`, excluded.
        self.stop = before[until]
        pairs = np.concatenate([[0], np.cumsum(self.opens[:-1] & ~self.opens[1:])])
        self.leaves = pairs[until] - pairs[self.at]
        new = np.repeat(np.arange(len(depths)), opened)
        of = starts[new] + shared[new] + np.arange(len(new)) - np.repeat(np.cumsum(opened) - opened, opened)
        self.size = np.concatenate([[0], np.ascontiguousarray(entries[of, DIGEST:]).view(">u4")[:, 0].astype(np.int64)]) if len(new) else np.zeros(1, np.int64)
        #: The path at which a node first occurs, and the node at which each path ends.
        self.first = np.concatenate([[0], new])
        key = self.depth * self.nodes + np.arange(self.nodes)
        order = np.argsort(key)
        self._sorted, self._order = key[order], order
        self.parent = self.ancestor(np.arange(self.nodes), self.depth - 1)
        self.parent[0] = -1
        reached = np.cumsum(opened)  # the last node opened up to each path, from which its end is an ancestor
        self.ends = self.ancestor(reached, depths) if len(depths) else depths
        self.children = np.bincount(self.parent[1:], minlength=self.nodes)

    def ancestor(self, nodes: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The node at a depth on the way to each node: the last one at that depth that began before it."""
        return self._order[np.searchsorted(self._sorted, np.maximum(depth, 0) * self.nodes + nodes, "right") - 1]

    def below(self, per_node: np.ndarray) -> np.ndarray:
        """Sum over each node's subtree."""
        run = np.concatenate([[0], np.cumsum(per_node)])
        return run[self.stop] - run[:self.nodes]


INNER = "conv_id long, depth long, parent_conv_id long, parent_key string, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE = f"kind int, key string, size long, ids string, {INNER}"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(columns: dict[str, object]) -> pa.RecordBatch:
    types = dict(x.rsplit(" ", 1) for x in NODE.split(", "))
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(n, kinds[t]) for c, t in types.items()], names=list(types))


def spine_keys(path: bytes) -> list[str]:
    """Keys of the nodes on a path, from the root."""
    state, out = hashlib.sha256(), []
    for at in range(0, len(path) + 1, ENTRY):
        out.append(state.copy().hexdigest())
        state.update(path[at:at + DIGEST])
    return out


def joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def of_shard(raw: list[bytes], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted (path, id): kind 0 whole nodes, kind 1 spine nodes, kind 2 chunks of ids that end at a spine node."""
    edge = np.flatnonzero(np.concatenate([[True], [a != b for a, b in zip(raw, raw[1:])]]))
    trie = Trie([raw[i] for i in edge])
    stops = np.append(edge[1:], len(raw))
    at_end = np.zeros(trie.nodes, np.int64)
    at_end[trie.ends] = stops - edge
    n_convs = trie.below(at_end)
    # every path but the empty one opens a node, so a subtree's paths are a range; ids ascend inside a path
    smallest = range_min(ids[edge], trie.first, np.append(trie.first, len(edge))[trie.stop])
    spine = np.zeros(trie.nodes, bool)
    keys: dict[int, str] = {}
    for path in {0, len(edge) - 1}:
        node, names = int(trie.ends[path]), spine_keys(raw[edge[path]])
        while node >= 0:
            keys[node] = names.pop()
            spine[node] = True
            node = int(trie.parent[node])
    saved_here = (n_convs - 1) * trie.size
    saved, whole = trie.below(saved_here), np.flatnonzero(~spine)
    digest = np.full(trie.nodes, NOTHING, object)
    for path, node in enumerate(trie.ends.tolist()):
        if not spine[node]:
            digest[node] = hashlib.sha256(joined(ids[edge[path]:stops[path]]).encode()).hexdigest()
    for a in range(0, len(whole), 100_000):
        at = whole[a:a + 100_000]
        up = trie.parent[at]
        yield table({"kind": np.zeros(len(at), np.int32), "conv_id": smallest[at], "depth": trie.depth[at],
                     "parent_conv_id": np.where(spine[up], 0, smallest[up]), "parent_key": [keys.get(u) for u in up.tolist()], "n_convs": n_convs[at],
                     "n_children": trie.children[at], "n_leaves": trie.leaves[at], "saved_tokens": saved[at], "ends_sha256": digest[at].tolist()})
    hangs = whole[spine[trie.parent[whole]]]
    up = trie.parent[hangs]
    nodes = np.flatnonzero(spine)
    leaves_out, saved_out = np.zeros(trie.nodes, np.int64), np.zeros(trie.nodes, np.int64)
    np.add.at(leaves_out, up, trie.leaves[hangs])
    np.add.at(saved_out, up, saved[hangs])
    yield table({"kind": np.ones(len(nodes), np.int32), "key": [keys[n] for n in nodes.tolist()], "size": trie.size[nodes], "conv_id": smallest[nodes],
                 "depth": trie.depth[nodes], "parent_key": [keys.get(int(trie.parent[n])) for n in nodes], "n_convs": n_convs[nodes],
                 "n_children": np.bincount(up, minlength=trie.nodes)[nodes], "n_leaves": leaves_out[nodes], "saved_tokens": saved_out[nodes]})
    for path, node in enumerate(trie.ends.tolist()):
        if spine[node]:
            own = ids[edge[path]:stops[path]]
            for a in range(0, len(own), IDS_AT_ONCE):
                yield table({"kind": [2], "key": [keys[node]], "conv_id": own[a:a + 1], "ids": [joined(own[a:a + IDS_AT_ONCE])]})


def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (key, first id) to one digest a key, holding one chunk at a time."""
    key = state = None
    for part in parts:
        for k, text in zip(part.column("key").to_pylist(), part.column("ids")):
            if k != key:
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.as_py().encode())
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spines of all shards, each node once: one walk from the deepest nodes up."""
    held = [p for p in parts if p.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).sort_by("depth").to_pydict()
    n, at = len(rows["key"]), {k: i for i, k in enumerate(rows["key"])}
    children, leaves, saved = rows["n_children"], rows["n_leaves"], rows["saved_tokens"]
    parent = [None] * n
    for i in range(n - 1, -1, -1):
        if not children[i]:
            leaves[i] += 1
        saved[i] += (rows["n_convs"][i] - 1) * rows["size"][i]
        up = at.get(rows["parent_key"][i])
        if up is not None:
            children[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]
            parent[i] = rows["conv_id"][up]
    yield table({"kind": [1] * n, "key": rows["key"], "conv_id": rows["conv_id"], "depth": rows["depth"], "parent_conv_id": parent, "n_convs": rows["n_convs"],
                 "n_children": children, "n_leaves": leaves, "saved_tokens": saved})


def trie(convs: DataFrame) -> DataFrame:
    """convs: conv_id, path (array of entries). One row a node: COLUMNS."""
    spark = convs.sparkSession
    rows = staged(convs.select("conv_id", F.unhex(F.array_join("path", "")).alias("path")), "paths")
    turns = rows.agg(F.sum(F.length("path") + ENTRY)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // (ENTRY * SHARD_TURNS)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, ids = [], []
        for part in parts:
            raw += part.column("path").to_pylist()
            ids.append(part.column("conv_id").to_numpy())
        if raw:
            yield from of_shard(raw, np.concatenate(ids))

    nodes = staged(rows.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "path").mapInArrow(run, NODE), "nodes")
    chunks = nodes.where("kind = 2").select("key", "conv_id", "ids")
    digests = chunks.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids").mapInArrow(hashed, "key string, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spines = nodes.where("kind = 1").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("size").alias("size"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), *sums)
    spines = staged(spines.repartition(1).mapInArrow(merged, NODE).drop("ends_sha256").join(digests, "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "spines")
    tops = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    inner = nodes.where("kind = 0")
    under = inner.where("parent_key is not null").join(tops, "parent_key").withColumn("parent_conv_id", F.col("_parent"))
    return inner.where("parent_key is null").select(*COLUMNS).unionByName(under.select(*COLUMNS)).unionByName(spines.select(*COLUMNS))


def of_turns(turns: DataFrame) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text) as it is."""
    return trie(paths(turns))
