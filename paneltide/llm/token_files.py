"""Token ids in files of patched frame-of-reference blocks.

Documents are put in ascending order of id by range partitioning, encoded there, and each task writes its run of ids to one
file. A file is a row of blocks of BLOCK ids. A block holds its smallest id and a width; every id less the smallest is packed at
that width, the one at PERCENTILE of the block's widths, so that a few large ids do not widen all others. Their high bits stand in an exception
list (position, high bits) behind the packed bits. The file ends with the index of block starts, so any range of ids is read
by range: two reads of the index, one of the blocks.

The table of documents (file, first id and number of ids in it) is written as a table; only what it names is ever read, so a failed or
repeated task leaves unread files at most. Offsets in the whole corpus are sums over files, in order.

Layout, little-endian: blocks; index of n + 1 unsigned 64-bit block starts; n as unsigned 64-bit; number of ids as unsigned 64-bit; b"PFOR1".
A block: smallest id u32, number of ids u16, width u8, width of high bits u8, number of exceptions u16, packed low bits,
positions u16, packed high bits.

Defined cases: null and empty texts are one end mark; rows with equal ids stand in order of a checksum of the text, equal rows in any order, which is the same bytes; null ids come first; an empty table writes no file and gives an empty result; a text of any length is
one run of ids in one task's memory; other columns are not read, whatever their names.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.alignment import byte_alphabet
from paneltide.llm.chunks import Kept, loaded, runs
from paneltide.llm.warc import filesystem
from paneltide.scale import staged, staging_path

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
BLOCK, PERCENTILE = 4096, 98
TAIL = b"PFOR1"
#: Ids that a writer gathers before it packs them, and that a reader holds at once.
AT_ONCE = 1 << 20
#: Ids that a task reads back.
TASK_IDS = 8_000_000


def bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1]


def pack(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits at most, one behind the other."""
    if not width:
        return b""
    size = 2 if width <= 16 else 4
    split = np.unpackbits(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size), axis=1, bitorder="little")[:, :width]
    return np.packbits(split, bitorder="little").tobytes()


def unpack(raw: memoryview, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    split = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n * width // 8)), count=n * width, bitorder="little").reshape(n, width)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :width] = split
    return np.packbits(whole, axis=1, bitorder="little").view("<u4")[:, 0]


def block(ids: np.ndarray) -> bytes:
    """One block of 1 to 65,535 ids."""
    low = int(ids.min())
    rest = ids - np.uint32(low)
    need = bits(rest)
    width = int(np.searchsorted(np.cumsum(np.bincount(need)) * 100, PERCENTILE * len(ids)))
    out = np.flatnonzero(need > width)
    high = rest[out] >> np.uint32(width) if len(out) else rest[:0]
    wide = int(need.max()) - width if len(out) else 0
    head = np.array([low], "<u4").tobytes() + np.array([len(ids)], "<u2").tobytes() + bytes([width, wide]) + np.array([len(out)], "<u2").tobytes()
    kept = rest & np.uint32((1 << width) - 1)
    return head + pack(kept, width) + out.astype("<u2").tobytes() + pack(high, wide)


def unblock(raw: memoryview) -> np.ndarray:
    low, n, out = (int(np.frombuffer(raw[a:b], kind)[0]) for a, b, kind in ((0, 4, "<u4"), (4, 6, "<u2"), (8, 10, "<u2")))
    width, wide = raw[6], raw[7]
    at = 10 + -(-n * width // 8)
    ids = unpack(raw[10:at], n, width)
    if out:
        places = np.frombuffer(raw[at:at + 2 * out], "<u2")
        ids[places] |= unpack(raw[at + 2 * out:], out, wide) << np.uint32(width)
    return ids + np.uint32(low)


class Writer:
    """Appends ids to one file."""

    def __init__(self, stream):
        self.stream, self.starts, self.at, self.ids, self.waiting, self.held = stream, [], 0, 0, [], 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= AT_ONCE:
            self.flush(self.held - self.held % BLOCK)

    def flush(self, upto: int) -> None:
        run = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for a in range(0, upto, BLOCK):
            raw = block(run[a:min(a + BLOCK, upto)])
            self.stream.write(raw)
            self.starts.append(self.at)
            self.at += len(raw)
        self.waiting, self.held, self.ids = [run[upto:]], len(run) - upto, self.ids + upto

    def close(self) -> None:
        self.flush(self.held)
        self.stream.write(np.array([*self.starts, self.at, len(self.starts), self.ids], "<u8").tobytes() + TAIL)
        self.stream.close()


class Reader:
    """Reads ranges of ids of one file."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = file.read_at(16 + len(TAIL), size - 16 - len(TAIL))
        if tail[16:] != TAIL:
            raise ValueError("not a token file, or cut short")
        blocks, self.ids = (int(x) for x in np.frombuffer(tail[:16], "<u8"))
        self.starts = np.frombuffer(file.read_at(8 * (blocks + 1), size - 16 - len(TAIL) - 8 * (blocks + 1)), "<u8").astype(np.int64)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n - 1; neighbouring blocks are one read."""
        if start < 0 or start + n > self.ids:
            raise ValueError("range outside the file")
        if not n:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        base = int(self.starts[first])
        raw = memoryview(self.file.read_at(int(self.starts[last + 1]) - base, base))
        ids = np.concatenate([unblock(raw[int(self.starts[b]) - base:int(self.starts[b + 1]) - base]) for b in range(first, last + 1)])
        return ids[start - first * BLOCK:start - first * BLOCK + n]


class Encoder:
    """Ids of a text by the tokenizers library, kept by chunk. A chunk not met yet that is one pre-token (Latin letters behind a space or a line end)
    goes to the library's model at once; others are encoded as lines of one text and told apart by the line end's id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.line = self.ids("\n")
        form = json.loads(self.full.to_str())
        by_bytes = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        #: Nothing but the byte-level pre-tokenizer stands before the model.
        self.plain = not form["normalizer"] and by_bytes.items() <= (form["pre_tokenizer"] or {}).items() and form["model"]["type"] == "BPE"
        self.tokenize = self.full.model.tokenize
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.kept = Kept(self.make, bytes.__add__)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.full.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def pre_token(self, text: str) -> bytes:
        spelt = text.replace(" ", "Ġ") if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
        found = [t.id for t in self.tokenize(spelt)]
        return pack_ids(f"<{len(found)}I", *found)

    def make(self, chunks: list[str]) -> list[bytes]:
        got, rest = {}, []
        for c in chunks:
            word = c[1:]
            if self.plain and c[0] in " \n" and word.isalpha() and (c.isascii() or max(word) < "\u0250"):
                got[c] = self.pre_token(c) if c[0] == " " else self.line.tobytes() + self.pre_token(word)
            else:
                rest.append(c)
        inner, other = runs(rest)
        got |= {c: self.ids(c).tobytes() for c in other}
        if inner:
            found = self.ids("".join([c if c[0] == "\n" else "\n" + c for c in inner]))
            lines = np.flatnonzero(found == self.line[0])
            if len(self.line) == 1 and len(lines) == len(inner):
                raw, ends = found.tobytes(), [*(4 * lines[1:]).tolist(), 4 * len(found)]
                got |= {c: raw[a if c[0] == "\n" else a + 4:b] for c, a, b in zip(inner, (4 * lines).tolist(), ends)}
            else:
                got |= {c: self.ids(c).tobytes() for c in inner}
        return [got[c] for c in chunks]

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.ids(text).tobytes()
        return b"".join(self.kept.of(text))


PLACES = [T.StructField("file", T.StringType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType())]


def written(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all ids; returns the committed table of documents: doc_id, file, at, n_tokens, part (of the order, as file names are random)."""
    narrow = docs.select("doc_id", "text")
    # equal ids are told apart by a checksum of the text and equal rows by their place, so neither is one task's
    keyed = narrow.withColumns({"_sum": F.xxhash64("text"), "_nth": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("_sum"), F.col("_nth")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], *PLACES])
    end = np.array([end_id], "<u4").tobytes()
    where = filesystem(folder)
    where[0].create_dir(where[1], recursive=True)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        source = path or public_tokenizers.path(TOKENIZER)
        encoder = loaded(("ids", source), lambda: Encoder(source))
        where, out, name, total = filesystem(folder), None, f"ids-{uuid.uuid4().hex}.pfor", 0
        for part in parts:
            at, sizes = [], []
            if out is None:
                out = Writer(where[0].open_output_stream(f"{where[1]}/{name}", compression=None))
            for text in part.column("text"):
                text = text.as_py()
                ids = np.frombuffer((encoder.encode(text) if text else b"") + end, "<u4")
                out.add(ids)
                at.append(total)
                sizes.append(len(ids))
                total += len(ids)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([name] * len(at)), pa.array(at, pa.int64()), pa.array(sizes, pa.int64())],
                                             names=schema.names)
        if out is not None:
            out.close()

    return staged(ranged.mapInArrow(run, schema).withColumn("part", F.spark_partition_id()), "token_files")


def placed(table: DataFrame) -> DataFrame:
    """`start`, the ids of all documents before: one row a file is summed in order, documents add their place in it."""
    files = table.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    return table.join(files, "part").withColumn("start", F.col("_before") + F.col("at")).drop("_before", "part")


def read_back(table: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit), read from the files."""
    spark = table.sparkSession
    total = table.agg(F.sum("n_tokens")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_IDS))
    rows = table.select("doc_id", "start", "file", "at", "n_tokens").repartitionByRange(tasks, "file", "at").sortWithinPartitions("file", "at")
    schema = T.StructType([table.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, name, reader = filesystem(folder), None, None
        for part in parts:
            files, at, sizes = (part.column(c).to_pylist() for c in ("file", "at", "n_tokens"))
            i = 0
            while i < len(files):
                if files[i] != name:
                    name, reader = files[i], Reader(where[0].open_input_file(f"{where[1]}/{files[i]}"))
                j = i + 1
                while j < len(files) and files[j] == name and at[j] == at[j - 1] + sizes[j - 1] and at[j] + sizes[j] - at[i] <= AT_ONCE:
                    j += 1
                ids = reader.read(at[i], at[j - 1] + sizes[j - 1] - at[i]).astype("<u4")
                found = [ids[at[k] - at[i]:at[k] - at[i] + sizes[k]].tobytes() for k in range(i, j)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").slice(i, j - i), part.column("start").slice(i, j - i), pa.array([len(x) // 4 for x in found], pa.int64()),
                     pa.array(found, pa.binary())], names=schema.names)
                i = j

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files and read every document from them: doc_id, start, n_tokens, ids."""
    folder = staging_path(docs.sparkSession, "ids")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return read_back(placed(written(docs, folder, path, end_id)), folder)


def digests(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    return round_trip(docs, path, end_id).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
