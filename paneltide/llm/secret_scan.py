"""Secret scan: pattern rules, and character Markov models of random strings and ordinary identifiers.

The base rules find assigned passwords, access keys and long hex strings. The method adds other long runs of key
characters: two first-order character models, one of random strings and one of ordinary identifiers, are trained
from labelled samples, and a run whose mean log-likelihood ratio is above a margin is a secret.

Labelled samples: about TRAIN_DOCS documents, chosen by the hash of their id, are the only ones used for training. The strings
that the base rules mark in them are random strings; their other runs of key characters without a digit are
ordinary identifiers. Both get fixed pseudo-random and joined-word examples too, so that a table without secrets still
gives a model. Counts are made on the executors; the driver gets two tables of 66 x 66 counts.

Spans are in code points, end exclusive. Added spans (kind `markov`) do not overlap base spans. Defined
cases: null and empty texts have no spans; repeated rows have the same spans; an empty table gives an
empty result and the model of the fixed examples.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.common import hash_sample

TRAIN_DOCS = 2_000
MARGIN = 0.35  # nats a character
MIN_RUN = 20
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
PLAIN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]{4,}(?![A-Za-z0-9+/_=-])")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODES = np.full(128, -1, np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
SIZE = len(ALPHABET)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules. Greedy runs make the length limits of access and hex part of the pattern."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def coded(run: str) -> np.ndarray:
    return CODES[np.frombuffer(run.encode("ascii"), np.uint8)]


def counted(runs: list[str]) -> np.ndarray:
    table = np.zeros((SIZE, SIZE), np.int64)
    for run in runs:
        c = coded(run)
        np.add.at(table, (c[:-1], c[1:]), 1)
    return table


def fixed_examples() -> tuple[np.ndarray, np.ndarray]:
    """Counts of pseudo-random strings in three alphabets, and of joined words in three spellings."""
    rng = np.random.default_rng(7)
    strings = ["".join(rng.choice(list(ALPHABET[a:b]), 32)) for a, b in ((0, 62), (0, 36), (26, 62)) for _ in range(300)]
    names = ("user", "name", "value", "index", "total", "count", "default", "config", "request", "response", "handler",
             "buffer", "length", "manager", "internal", "public", "static", "parameter", "document", "content")
    joined = ["".join(rng.choice(names, 4)) for _ in range(100)] + ["_".join(rng.choice(names, 4)) for _ in range(100)]
    joined += ["".join(w.title() for w in rng.choice(names, 4)) for _ in range(100)]
    joined += ["-".join([*rng.choice(names, 3), str(n)]) for n in range(1900, 2100, 2)]
    return counted(strings), counted(joined)


def train(docs: DataFrame, sample: int = TRAIN_DOCS) -> np.ndarray:
    """Log-likelihood ratio of every character pair, random against ordinary."""
    rows = hash_sample(docs.select("doc_id", "text"), "doc_id", sample).where(F.col("text").isNotNull())

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        random, plain = np.zeros((SIZE, SIZE), np.int64), np.zeros((SIZE, SIZE), np.int64)
        for part in parts:
            for text in part["text"]:
                spans, rest, at = base_spans(text), [], 0
                for start, kind, end in spans:
                    value = text[start:end] if kind else ASSIGN.match(text, start)[2]
                    random += counted(RUN.findall(value))
                    rest.append(text[at:max(at, start)])
                    at = max(at, end)
                plain += counted(PLAIN.findall(" ".join([*rest, text[at:]])))
        for kind, table in (("random", random), ("plain", plain)):
            at = np.nonzero(table)
            yield pd.DataFrame({"kind": kind, "a": at[0], "b": at[1], "n": table[at]})

    random, plain = fixed_examples()
    for r in rows.select("text").mapInPandas(count, "kind string, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        (random if r["kind"] == "random" else plain)[r["a"], r["b"]] += r["n"]
    log = [np.log((t + 0.5) / (t + 0.5).sum(1, keepdims=True)) for t in (random, plain)]
    return (log[0] - log[1]).astype(np.float32)


def spans(text: str | None, ratio: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """All spans of a text, (start, kind number, end), by start and kind."""
    if not text:
        return []
    base = base_spans(text)
    found = list(base)
    for m in RUN.finditer(text):
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        c = coded(m[0])
        if float(ratio[c[:-1], c[1:]].mean()) > margin:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    ratio = train(docs) if ratio is None else ratio
    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [spans(t, ratio) for t in part["text"]]
            out = {"doc_id": part["doc_id"]}
            out |= {f"n_{k}": np.array([sum(x[1] == i for x in f) for f in found], np.int64) for i, k in enumerate(KINDS)}
            out["base_sha256"] = [hashlib.sha256(joined([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
            out["spans"] = [joined(f) for f in found]
            yield pd.DataFrame(out)

    return narrow.mapInPandas(run, schema)


def masked(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """docs with every secret replaced by [SECRET]; overlapping spans become one; n_chars follows the text."""
    ratio = train(docs) if ratio is None else ratio

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            out, at = [], 0
            for start, _, end in spans(text, ratio):
                if start >= at:
                    out += [text[at:start], "[SECRET]"]
                at = max(at, end)
            return "".join([*out, text[at:]]) if out else text

        return texts.map(one)

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
