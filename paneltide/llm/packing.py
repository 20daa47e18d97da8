"""Best-fit packing by the configuration linear program over the length histogram.

Documents become token ids and an end mark; only those longer than a sequence are cut, the short piece first. What
decides the packing is the histogram of piece lengths, at most `capacity` numbers, so the driver solves it whole:

* the configuration program asks for the fewest sequences, each filled by one pattern (a multiset of lengths),
  that cover every length's count;
* multiplicative weights: each length has a weight that falls as its count is covered; a knapsack dynamic
  program over the capacity prices, for every length at once, the heaviest pattern that holds it, and all patterns
  within EPSILON of the heaviest are used in one step;
* rounding: the fractional use of each pattern is rounded down, never beyond what is left of a length; what
  remains, a number that depends on the patterns and not on the data, is packed by best fit over the
  histogram.

Pieces of a length are numbered without a gap (no task holds a length), and a piece finds its sequence and offset from its
number and the pattern table by binary search. The number of (pattern, length) entries is bounded by the solver.

Defined cases: null and empty texts are one end mark; repeated rows are packed separately; an empty table gives an
empty result; other columns are not read.
"""
from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.common import numbered, trimmed
from paneltide.scale import staged

CAPACITY, END_ID = 2048, 0
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
EPSILON, STEP, COVER = 0.02, 0.25, 6.0
MAX_STEPS = 150
CHUNKS_KEPT = 120_000
#: Documents whose pieces leave a task in one frame.
ROWS_AT_ONCE = 500
MARKS = ".,;:!?%&*$#|"


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokens never cross a single space between two other characters, so a text is cut
    there and the ids of a chunk are kept for the next time. Texts with other white space around a cut, or
    with the text of the special token, are encoded whole.
    """

    def __init__(self, path: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.path, self.full, self.kept, self.older = path or public_tokenizers.path(TOKENIZER), None, {}, {}

    def whole(self, text: str) -> bytes:
        if self.full is None:
            from tokenizers import Tokenizer
            self.full = Tokenizer.from_file(self.path)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "<|endoftext|>" in text:
            return self.whole(text)
        if "\0" in text:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        chunks = text.replace(" ", "\0 ").split("\0")
        found = list(map(self.kept.get, chunks))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    chunk = chunks[i]
                    if chunk.rstrip() != chunk or i and (len(chunk) < 2 or chunk[1].isspace()):
                        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
                    found[i] = self.missed(chunk)
        return b"".join(found)

    def missed(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        head = chunk.rstrip(MARKS)
        if ids is None and head != chunk and head[-1:].isalpha():  # letters and marks never share a pre-token
            ids = b"".join(self.kept.get(part) or self.missed(part) for part in (head, chunk[len(head):]))
        if ids is None:
            ids = np.array(self.fast.encode_ordinary(chunk), "<u4").tobytes()
        if len(self.kept) >= CHUNKS_KEPT:  # the chunks not met since the last change of tables go
            self.older, self.kept = self.kept, {}
        if len(chunk) <= 40:
            self.kept[chunk] = ids
        return ids


def narrowed(ids: bytes) -> bytes:
    """16-bit ids if all fit: half the bytes to write and to exchange."""
    values = np.frombuffer(ids, "<u4")
    return values.astype("<u2").tobytes() if values.max(initial=0) < 1 << 16 else ids


def widened(ids: Column, length: Column) -> Column:
    """Ids as `pieces` gives them, back as 32-bit integers; hexadecimal digits, so that ids stay out of Python."""
    return F.when(F.octet_length(ids) == 2 * length, F.unhex(F.regexp_replace(F.hex(ids), "(....)", "$10000"))).otherwise(ids)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), ids (binary, little-endian
    unsigned: 16-bit if all ids of the piece fit, else 32-bit; the number of bytes tells)."""
    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = np.array([END_ID], "<u4").tobytes()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, ranks)
        for part in (p.iloc[a:a + ROWS_AT_ONCE] for p in parts for a in range(0, len(p), ROWS_AT_ONCE)):
            out: dict[str, list] = {c: [] for c in schema.names}
            for doc_id, text in zip(part["doc_id"].array, part["text"]):
                ids = (encoder.encode(text) if text else b"") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    piece = ids[4 * a:4 * b]
                    for c, value in zip(schema.names, (doc_id, i, a, b - a, zlib.crc32(piece), narrowed(piece))):
                        out[c].append(value)
            frame = pd.DataFrame(out)
            frame["doc_id"] = pd.array(out["doc_id"], dtype=part["doc_id"].dtype)
            yield frame
        encoder = None
        trimmed()

    return narrow.mapInPandas(run, schema)


def priced(weight: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the greatest weight of a multiset of lengths that fits into each capacity, and a length to start with."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(weight)
    values = weight[lengths]
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, c, "right"))
        best[c] = best[c - 1]
        if k:
            worth = best[c - lengths[:k]] + values[:k]
            j = int(worth.argmax())
            if worth[j] > best[c]:
                best[c], last[c] = worth[j], lengths[j]
    return best, last


def pattern_of(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
            room -= last[room]
        else:
            room -= 1
    return out


def fractional(need: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """Multiplicative weights for the covering program: uses of patterns that cover `need` about once."""
    lengths = np.flatnonzero(need)
    covered, used = np.zeros(capacity + 1), defaultdict(float)
    for _ in range(MAX_STEPS):
        open_ = lengths[covered[lengths] < COVER]
        if not len(open_):
            break
        weight = np.zeros(capacity + 1)
        low = covered[open_].min()
        weight[open_] = np.exp(-(covered[open_] - low) / STEP) / need[open_] ** 0.5
        # a sequence is worth its tokens: weights fall on lengths that are behind, not on short ones
        weight[open_] *= open_ / capacity
        best, last = priced(weight, capacity)
        total = weight[open_] + best[capacity - open_]
        for length in open_[total >= (1 - EPSILON) * best[capacity]]:
            pattern = tuple(sorted([int(length), *pattern_of(last, capacity - int(length))], reverse=True))
            kinds, times = np.unique(pattern, return_counts=True)
            amount = STEP * float((need[kinds] / times).min())
            used[pattern] += amount
            covered[kinds] += times * amount / need[kinds]
    scale = max(1.0, float(covered[lengths].max())) if len(lengths) else 1.0
    return {p: x / scale for p, x in used.items()}


def best_fit(left: np.ndarray, capacity: int, uses: dict[tuple[int, ...], int]) -> None:
    """Pack what is left, longest first, each into the fullest open sequence that takes it; equal sequences move together."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, capacity) if bins.get(r)), None)
            if room is None:
                fit = capacity // length
                for take, pattern in ((n // fit, (length,) * fit), (1 if n % fit else 0, (length,) * (n % fit))):
                    if take:
                        rest = capacity - length * len(pattern)
                        bins[rest][pattern] = bins[rest].get(pattern, 0) + take
                break
            pattern, m = bins[room].popitem()
            take = min(m, n)
            if m > take:
                bins[room][pattern] = m - take
            more = (*pattern, length)
            bins[room - length][more] = bins[room - length].get(more, 0) + take
            n -= take
    for of_room in bins.values():
        for pattern, m in of_room.items():
            uses[tuple(sorted(pattern, reverse=True))] += m


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, number of sequences): every length of the histogram exactly as often as it occurs."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    uses: dict[tuple[int, ...], int] = defaultdict(int)
    if left[capacity]:
        uses[(capacity,)] += int(left[capacity])
        left[capacity] = 0
    for _ in range(2):
        if left.sum() < 64:
            break
        found = fractional(left, capacity)
        for pattern, x in sorted(found.items(), key=lambda p: (-sum(p[0]), -p[1], p[0])):
            if sum(pattern) < capacity:
                continue
            kinds, times = np.unique(pattern, return_counts=True)
            n = min(int(x), int((left[kinds] // times).min()))
            if n:
                uses[pattern] += n
                left[kinds] -= times * n
    best_fit(left, capacity, uses)
    return sorted(uses.items(), key=lambda p: (-p[1], p[0]))


def places(solution: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first number, first sequence, copies in a sequence, offset of the first copy)."""
    out: dict[int, list] = defaultdict(list)
    reached: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in solution:
        at = 0
        kinds, times = np.unique(pattern, return_counts=True)
        for length, copies in zip(kinds.tolist(), times.tolist()):
            out[length].append((reached[length], sequence, copies, at))
            reached[length] += n * copies
            at += length * copies
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces with ids, ids_crc32, sequence_id and offset. Callers that drop ids do not move them."""
    spark, rows_a_batch = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_a_batch)
    spark.conf.set(rows_a_batch, str(min(int(before), 2 * ROWS_AT_ONCE) if int(before) > 0 else 2 * ROWS_AT_ONCE))  # rows are whole texts
    try:
        cut = staged(pieces(docs, capacity, path, ranks), "pieces")
    finally:
        spark.conf.set(rows_a_batch, before)
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(solve(histogram, capacity))
    rows = sum(histogram.values())
    ranked = numbered(cut.withColumn("_ids", F.xxhash64("ids")), ["length"], ["doc_id", "piece", "_ids"], "_nth", rows).drop("_ids")

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
        n, lengths = nth.to_numpy(np.int64), length.to_numpy(np.int64)
        for at in np.split(order := np.argsort(lengths, kind="stable"), np.flatnonzero(np.diff(lengths[order])) + 1):
            if len(at):
                kind = int(lengths[at[0]])
                row = table[kind][np.searchsorted(table[kind][:, 0], n[at], "right") - 1]
                inside = n[at] - row[:, 0]
                sequence[at] = row[:, 1] + inside // row[:, 2]
                offset[at] = row[:, 3] + inside % row[:, 2] * kind
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = ranked.withColumn("_at", place("length", "_nth"))
    return out.select("doc_id", "piece", "start", "length", widened(F.col("ids"), F.col("length")).alias("ids"), "ids_crc32", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
