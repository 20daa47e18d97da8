"""MinHash near-duplicates: universal hash minima, banding, verification, large-star/small-star components.

1. A text becomes the set of 64-bit hashes of its word shingles. Texts with equal sets form a class; from here on a class
   stands for all its copies, so copies are never paired.
2. HASHES minima of multiply-add hashes give BANDS keys of ROWS minima each; classes sharing a key form a bucket.
   At similarity 0.8 a pair shares no key with probability (1 - 0.8^6)^38 = 1e-5.
3. In every bucket each class is compared with one of it. Pairs whose signatures (a byte of each minimum) agree in less than
   threshold - SLACK (over four standard deviations) are dropped; the rest is confirmed on full sets.
4. Components of the confirmed links. Buckets that now lie inside one component are done. In the others the classes outside
   the bucket's most frequent component are compared with HUBS classes of that component, in HUB_ROUNDS rounds.
5. What is still open is compared in full, a block of the classes outside the bucket's most frequent component with a block of
   its classes in one task, by signature and then by set. A task skips what is connected meanwhile and returns a
   link for each two components that it joins, not its pairs. So every pair that shares a key is confirmed,
   rejected, or known to be connected.

Defined cases: texts that are null or without words have an empty set and link with nothing, and so do rows
with a null doc_id (their component is null, they are kept); rows with one doc_id count as one document; an
empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.common import WordHash, shingle_hashes, words
from paneltide.llm.components import components
from paneltide.scale import staged

BANDS, ROWS = 38, 6
HASHES = BANDS * ROWS
SLACK = 0.12
HUBS, HUB_ROUNDS = 3, 2
OUTER, INNER = 256, 1024
BLOCK = 4096
_RNG = np.random.default_rng(3)
TIMES = (_RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
PLUS = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)[:, None]
BAND_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, n: int, memo: WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes of the text with A-Z in lower case."""
    return np.unique(shingle_hashes(memo.of(words(text and text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))), n))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        block = TIMES * shingles[None, at:at + BLOCK]
        block += PLUS
        np.minimum(low, block.min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = (sig.reshape(BANDS, ROWS).astype(np.uint64) * BAND_MIX).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    keys ^= keys >> np.uint64(31)
    return (keys * BAND_MIX[0, 0]).view(np.int64)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature, band keys."""
    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
                           T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for part in parts:
            out: dict[str, list] = {"n_shingles": [], "digest": [], "sig": [], "bands": []}
            for text in part["text"]:
                s = shingle_set(text, n, memo)
                sig = signature(s) if len(s) else None
                for name, value in zip(out, (len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None,
                                             sig.astype(np.uint8).tobytes() if len(s) else None, band_keys(sig) if len(s) else None)):
                    out[name].append(value)
            yield pd.DataFrame({"doc_id": part["doc_id"], **out})

    return narrow.mapInPandas(run, schema)


def agreeing(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs a, b whose signatures agree in at least that share of the minima."""
    both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")

    @F.pandas_udf("boolean")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        table = [np.frombuffer(b"".join(s), np.uint8).reshape(len(s), HASHES) for s in (x, y)]
        return pd.Series((table[0] == table[1]).mean(1) >= least)

    return both.where(agree("sig_a", "sig_b")).select("a", "b")


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """rep, shingles (sorted 64-bit hashes) of the documents in ids: rep. The one stage that moves texts."""
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(ids, "rep", "left_semi")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for part in parts:
            yield pd.DataFrame({"rep": part["rep"], "shingles": [shingle_set(t, n, memo).tobytes() for t in part["text"]]})

    return staged(texts.mapInPandas(run, "rep long, shingles binary").where(F.octet_length("shingles") > 0), "sets")


def reaches(s: bytes, t: bytes, percent: int) -> bool:
    s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * shared >= percent * (len(s) + len(t) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b").join(
        sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a")

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([reaches(s, t, percent) for s, t in zip(x, y)], dtype=bool)

    return both.where(similar("set_a", "set_b")).select("a", "b").distinct()


def compared(open_: DataFrame, sigs: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """open_: key, rep, component, main. Links a, b that join the components of a bucket as far as its pairs do."""
    sizes = open_.groupBy("key").agg(F.ceil(F.count_if(F.col("component") != F.col("main")) / OUTER).cast("int").alias("outer"),
                                     F.ceil(F.count("*") / INNER).cast("int").alias("inner"))
    rows = open_.join(sizes, "key").withColumns({"o": F.pmod(F.xxhash64("rep"), F.col("outer")), "i": F.pmod(F.xxhash64("rep", "key"), F.col("inner"))})
    outside = rows.where("component <> main").select("key", "o", F.explode(F.sequence(F.lit(0), F.col("inner") - 1)).alias("i"),
                                                     "rep", "component", F.lit(True).alias("outside"))
    inside = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("o"), "i", "rep", "component", F.lit(False).alias("outside"))
    blocks = outside.select("key", "o", F.col("i").cast("int").alias("i"), "rep", "component", "outside").unionByName(
        inside.select("key", "o", F.col("i").cast("int").alias("i"), "rep", "component", "outside"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["outside", "rep"], ignore_index=True)
        sig = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(len(part), HASHES)
        sets, comp = part["shingles"].tolist(), part["component"].to_numpy()
        outer = np.flatnonzero(part["outside"].to_numpy(bool))
        inner = np.flatnonzero(~part["outside"].to_numpy(bool))
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while c in parent:
                c = parent[c]
            return c

        links = []
        for x in outer:
            alike = (sig[inner] == sig[x]).mean(1)
            near = inner[(alike >= least) & (comp[inner] != comp[x])]
            for y in near[np.argsort(-alike[np.isin(inner, near)], kind="stable")]:
                u, v = root(int(comp[x])), root(int(comp[y]))
                if u != v and reaches(sets[x], sets[y], percent):
                    parent[max(u, v)] = min(u, v)
                    links.append((part["rep"].iat[x], part["rep"].iat[y]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return blocks.join(sigs, "rep").join(sets, "rep").groupBy("key", "o", "i").applyInPandas(run, "a long, b long")


def class_components(classes: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """classes: rep, sig, bands. Returns node, component for the classes with a link."""
    sigs, tested, percent = classes.select("rep", "sig"), [], round(threshold * 100)

    def linked(pairs: DataFrame) -> DataFrame:
        """The confirmed ones of the pairs that were not tested before."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested:
            pairs = pairs.join(_union(tested), ["a", "b"], "left_anti")
        tested.append(staged(agreeing(pairs, sigs, threshold - SLACK), "tested"))
        return staged(confirmed(tested[-1], sets, percent), "links")

    keyed = classes.select("rep", F.explode("bands").alias("key"))
    centre = F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep"))["rep"]
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), centre.alias("centre")).where("size > 1")
    members = staged(keyed.join(buckets, "key"), "members")
    sets = sets_of(docs, members.select("rep").distinct(), n)
    star = members.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b"))
    found = staged(components(linked(star).select(F.col("a").alias("u"), F.col("b").alias("v"))), "found")
    rest = members.where("size > 2").select("key", "rep")  # buckets of two are done
    for step in range(HUB_ROUNDS + 1):
        here = staged(rest.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")), "rest")
        main = here.groupBy("key", "component").count().groupBy("key").agg(
            F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        open_ = staged(here.join(main.drop("parts"), "key"), "open")
        if open_.isEmpty():
            break
        if step < HUB_ROUNDS:
            by = Window.partitionBy("key").orderBy(F.xxhash64("rep", F.lit(step)), "rep")
            hubs = open_.where("component = main").withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= HUBS)
            links = linked(open_.where("component <> main").join(hubs.select("key", F.col("rep").alias("hub")), "key").select(
                F.col("rep").alias("a"), F.col("hub").alias("b")))
        else:
            links = staged(compared(open_, sigs, sets, threshold - SLACK, percent), "links")
        found = joined(found, links)
        rest = open_.select("key", "rep")
    return found


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: components of the graph of components, carried over to the nodes."""
    if links.isEmpty():
        return found
    a, b = (found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    edges = staged(links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("of_a", "a").alias("u"), F.coalesce("of_b", "b").alias("v")), "edges")
    moved = staged(components(edges), "moved")
    nodes = found.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(
        found, "node", "left_anti").withColumn("component", F.col("node")))
    return staged(nodes.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select(
        "node", F.coalesce("to", "component").alias("component")), "found")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    narrow = docs.select("doc_id", "text")
    all_rows = staged(sketches(narrow, n), "sketches")
    real = all_rows.where("doc_id is not null and n_shingles > 0")
    classes = staged(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"),
                                                F.first("bands").alias("bands")), "classes")
    found = class_components(classes, narrow, n, threshold)
    # documents that share an id count as one, whatever class each of their texts is in
    twice = staged(real.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("doc_id"), "twice")
    if not twice.isEmpty():
        found = joined(found, staged(real.join(twice, "doc_id").select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").where(
            "doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "links"))
    of_class = staged(classes.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id")), "of_class")
    out = all_rows.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the documents that are not the smallest of their component."""
    gone = staged(near_duplicates(docs, n, threshold).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
