"""Alignment of two tokenizers over the same bytes.

Both tokenizers give spans: character offsets of the tokenizers library (A), spans of sentencepiece's proto result (B). They are coarse
cuts: tokens that hold a part of a character share its span, and byte-fallback tokens have none of their own. Inside such a run the
places come from the lengths of the tokens' decoded bytes. What all tokens decode to is held against the bytes of the text.

Where tokens of both end, the text is cut into groups. A link is a pair of token occurrences that share a byte; as the tokens
of each side follow one another, every place where any token ends closes exactly one link.

How often an id pair is linked over the corpus comes from the links of every document, which are written once (four bytes a link for
vocabularies of these sizes), counted inside tasks and then summed by pair. The counts go back to the documents' links by a broadcast array
if there are at most MAX_PAIRS pairs (16 bytes each), else by a join on the pair. Both ways give the same rows.

Defined cases: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and an
empty digest; repeated rows are rows; a text of any length is one row, in one task's memory; an empty table gives an empty result; other
columns are not read, whatever their names.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.chunks import MARKS, Kept, loaded, runs
from paneltide.scale import SHUFFLE_CLEANUP, staged, staging_path

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MAX_PAIRS = 4_000_000
#: Links counted at once in a task.
AT_ONCE = 1 << 22


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def places(text: str) -> np.ndarray:
    """Byte at which each character begins, and the end."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])


def gives_back(side: SideA | SideB, tokens: tuple[np.ndarray, np.ndarray], raw: bytes) -> bool:
    ids, ends = tokens
    return b"".join(map(side.bytes.__getitem__, ids.tolist())) == raw and np.array_equal(ends, np.cumsum(side.lengths[ids]))


def refined(coarse: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens. coarse: (begin, end) in bytes, of which parts of a character share one or have none of their own."""
    by_bytes = np.cumsum(lengths)
    return np.where(coarse[:, 1] - coarse[:, 0] == lengths, coarse[:, 1], by_bytes)


class SideA:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.size = 1 + max(self.model.get_vocab().values())
        self.bytes = [b""] * self.size
        for token, i in self.model.get_vocab().items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids and byte ends of a text that begins with a space."""
        found = self.model.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        spans = np.array(found.offsets, np.int64).reshape(-1, 2)
        return ids, refined(spans if text.isascii() else places(text)[spans], self.lengths[ids])


class SideB:
    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)
        plain = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        #: No piece crosses a cut of `chunks`, and line ends are pieces of their own.
        self.cuts_hold = not any("▁" in p.lstrip("▁") or "\n" in p for p in plain)
        #: Marks may be cut from the letters before them.
        self.marks_hold = not any(a.isalpha() and b in MARKS for p in plain for a, b in pairwise(p))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids and byte ends in the text with the space that stands before it."""
        found = self.model.encode(text, return_type="proto").pieces
        ids = np.array([p.id for p in found], np.int64)
        spans = np.array([(p.begin, p.end) for p in found], np.int64).reshape(-1, 2)
        if not text.isascii() and spans[-1, 1] == len(text):  # some releases count characters, others bytes
            spans = places(text)[spans]
        spans = spans + 1
        spans[:1, 0] = 0  # the space before the text
        return ids, refined(spans, self.lengths[ids])


class Aligner:
    """Aligned tokens of a text. Chunks that both tokenizers give back are kept; a text with any other is aligned as a whole."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SideA(path_a), SideB(path_b)
        self.key = np.uint32 if self.a.size * self.b.size < 1 << 32 else np.uint64
        self.kept = Kept(self.make, self.add if self.b.marks_hold else None)

    def parts(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], stops: np.ndarray) -> list[tuple[int, bytes, str]]:
        """A text's tokens cut at `stops`, where tokens of both end: counts (n_a, n_b, n_groups in 40 bits each), link keys and groups as text, by part."""
        ends = np.union1d(a[1], b[1])
        at_a, at_b = np.searchsorted(a[1], ends), np.searchsorted(b[1], ends)
        raw, size = (a[0][at_a] * self.b.size + b[0][at_b]).astype(self.key).tobytes(), np.dtype(self.key).itemsize
        both = (a[1][at_a] == ends) & (b[1][at_b] == ends)
        ids_a, ids_b = list(map(str, a[0].tolist())), list(map(str, b[0].tolist()))
        upto_a, upto_b = (at_a[both] + 1).tolist(), (at_b[both] + 1).tolist()
        groups, i, j = [], 0, 0
        for x, y in zip(upto_a, upto_b):
            groups.append(f"{ids_a[i]}|{ids_b[j]}" if x - i == 1 == y - j else f"{','.join(ids_a[i:x])}|{','.join(ids_b[j:y])}")
            i, j = x, y
        out, g, li, i, j = [], 0, 0, 0, 0
        for h, n in zip((np.searchsorted(ends[both], stops) + 1).tolist(), (np.searchsorted(ends, stops) + 1).tolist()):
            x, y = upto_a[h - 1], upto_b[h - 1]
            out.append(((x - i) | (y - j) << 40 | (h - g) << 80, raw[size * li:size * n], groups[g] if h - g == 1 else ";".join(groups[g:h])))
            g, li, i, j = h, n, x, y
        return out

    def whole(self, text: str) -> tuple[int, bytes, str] | None:
        """Of space + text; None if a side does not give it back."""
        raw, a, b = b" " + text.encode(), self.a.encode(" " + text), self.b.encode(text)
        return self.parts(a, b, a[1][-1:])[0] if gives_back(self.a, a, raw) and gives_back(self.b, b, raw) else None

    def make(self, chunks: list[str]) -> list:
        """Values of chunks; False where the whole text has to be looked at."""
        inner, _ = runs(chunks)
        inner.sort(key=lambda c: c[0] != " ")  # a line end stands behind another chunk; what else begins a chunk would need another space before it
        if inner and inner[0][0] != " ":
            inner = []
        together = set(inner)
        got = {c: self.line(c) for c in chunks if c[0] == "\n" and c not in together or not c.strip(MARKS)}
        if inner:
            text = "".join(inner)
            raw, a, b = text.encode(), self.a.encode(text), self.b.encode(text[1:])
            stops = np.cumsum([len(c.encode()) for c in inner])
            at_a, at_b = np.searchsorted(a[1], stops), np.searchsorted(b[1], stops)
            if gives_back(self.a, a, raw) and gives_back(self.b, b, raw) and (a[1][at_a] == stops).all() and (b[1][at_b] == stops).all():
                got |= zip(inner, self.parts(a, b, stops), strict=True)
            else:
                got |= {c: self.line(c) if c[0] == "\n" else self.whole(c[1:]) or False for c in inner}
        return [got.get(c, False) for c in chunks]

    @staticmethod
    def add(one, other):
        return (one[0] + other[0], one[1] + other[1], f"{one[2]};{other[2]}") if one and other else False

    def line(self, chunk: str):
        """A chunk that begins with a line end, or marks behind a letter: aligned behind a letter, whose tokens are taken away again."""
        a, b = self.a.encode(" a" + chunk), self.b.encode("a" + chunk)
        raw = (" a" + chunk).encode()
        if not (gives_back(self.a, a, raw) and gives_back(self.b, b, raw) and a[1][0] == b[1][0] == 2):
            return False
        return self.parts((a[0][1:], a[1][1:]), (b[0][1:], b[1][1:]), a[1][-1:])[0]

    def aligned(self, text: str | None) -> tuple[int, bytes, str]:
        if not text:
            return 0, b"", ""
        if self.b.cuts_hold and "\0" not in text:
            found = self.kept.of(" " + text)
            if False not in found:
                counts, keys, groups = zip(*found)
                return sum(counts), b"".join(keys), ";".join(groups)
        return self.whole(text) or (0, b"", "")


def aligner(path_a: str | None, path_b: str | None) -> Aligner:
    import public_tokenizers
    a, b = path_a or public_tokenizers.path(TOKENIZER_A), path_b or public_tokenizers.path(TOKENIZER_B)
    return loaded(("aligned", a, b), lambda: Aligner(a, b))


LOW = (1 << 40) - 1


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The alignment itself: doc_id and groups, an array of (end, a, b): the byte of space + text at which a group ends and its ids."""
    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("groups", T.StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([own.aligned(t.as_py())[2] for t in part.column("text")], pa.string())], names=schema.names)

    ids = lambda x: F.transform(F.split(x, ","), lambda i: i.cast("int"))
    one = lambda g: F.struct(ids(F.split_part(g, F.lit("|"), F.lit(1))).alias("a"), ids(F.split_part(g, F.lit("|"), F.lit(2))).alias("b"))
    out = narrow.mapInArrow(run, schema)
    return out.select("doc_id", F.when(F.col("groups") == "", F.expr("cast(array() as array<struct<a:array<int>,b:array<int>>>)")).otherwise(
        F.transform(F.split("groups", ";"), one)).alias("groups"))


def linked(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links (binary, a key a link), written once."""
    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                           T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        size = np.dtype(own.key).itemsize
        for part in parts:
            texts = part.column("text")
            for start in range(0, part.num_rows, 500):
                counts, keys, digests = [], [], []
                for text in texts.slice(start, 500):
                    n, links, text_groups = own.aligned(text.as_py())
                    counts.append((n & LOW, n >> 40 & LOW, n >> 80, len(links) // size))
                    keys.append(links)
                    digests.append(hashlib.sha256(text_groups.encode()).hexdigest() if n else "")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").slice(start, 500), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(digests), pa.array(keys, pa.binary())],
                    names=schema.names)

    spark = docs.sparkSession
    at, before = staging_path(spark, "links"), spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        narrow.mapInArrow(run, schema).write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(schema).parquet(at)


def key_type(path_a: str | None, path_b: str | None) -> tuple[type, int]:
    own = aligner(path_a, path_b)
    return own.key, own.b.size


def pair_counts(links: DataFrame, key: type, size_b: int) -> DataFrame:
    """pair, n: how many links of the corpus hold each id pair; and whether that is the highest count of its B id (ties included)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def counted() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for part in parts:
            for one in part.column("links"):
                found = np.frombuffer(one.as_py(), key)
                waiting.append(found)
                held += len(found)
                if held >= AT_ONCE:
                    yield counted()
                    waiting, held = [], 0
        if held:
            yield counted()

    pairs = staged(links.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    of_b = F.pmod("pair", F.lit(size_b)).alias("b")
    top = pairs.groupBy(of_b).agg(F.max("n").alias("top"))
    return staged(pairs.withColumn("b", F.pmod("pair", F.lit(size_b))).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")


def scored(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    key, size_b = key_type(path_a, path_b)
    links = linked(docs, path_a, path_b)
    counts = pair_counts(links, key, size_b)
    names = [c for c in links.columns if c != "links"]
    sums = ["n_best", "count_sum"]
    wide = T.StructType([*links.select(*names).schema, *(T.StructField(c, T.LongType()) for c in sums)])
    if counts.limit(max_pairs + 1).count() <= max_pairs:
        table = counts.toArrow()
        order = np.argsort(pairs := table.column("pair").to_numpy())
        shared = docs.sparkSession.sparkContext.broadcast(
            (pairs[order].astype(key), table.column("n").to_numpy()[order], table.column("best").to_numpy(zero_copy_only=False)[order]))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, n, best = shared.value
            for part in parts:
                out = []
                for one in part.column("links"):
                    at = np.searchsorted(pairs, np.frombuffer(one.as_py(), key))
                    out.append((int(best[at].sum()), int(n[at].sum())))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(c, pa.int64()) for c in zip(*out))], names=wide.names)

        return links.mapInArrow(run, wide).select(*names[:-1], *sums, names[-1])

    def distinct(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, one in zip(part.column("_row").to_pylist(), part.column("links")):
                pairs, times = np.unique(np.frombuffer(one.as_py(), key), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row)), pa.array(pairs.astype(np.int64)), pa.array(times.astype(np.int64))],
                                                 names=["_row", "pair", "times"])

    rows = staged(links.withColumn("_row", F.monotonically_increasing_id()), "links")
    per = rows.select("_row", "links").mapInArrow(distinct, "_row long, pair long, times long").join(counts, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.drop("links").join(per, "_row", "left").select(*names[:-1], *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums), names[-1])
