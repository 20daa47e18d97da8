"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's letters (ASCII letters in lower case, and all bytes from 0x80) are read as runs, at most SEGMENT bytes each. Two gated
recurrent units read every run in both directions, and a softmax over their states labels every byte. The
document's probabilities are the normalised geometric mean over all its bytes. As a run's labels do
not depend on the rest of the text, they are kept for the next occurrence, so the cost follows the distinct runs.

Training, by backpropagation through time on the driver, learns every language of the training rows. Its labelled sample is bounded:
about DOCS_PER_LANGUAGE documents a language, chosen by the hash of their id, or fewer (at least LEAST_DOCS) where more than LANGUAGES
languages share LANGUAGES * DOCS_PER_LANGUAGE documents; the executors count their runs, and the RUNS_PER_LANGUAGE most frequent ones
(or fewer, likewise) with their counts are the training set. All limits hold at every size. A letter is what Unicode calls one
(categories L*): digits, superscripts, fractions and number letters are none.

Defined cases: null text and texts without a letter are `und` with score 0, and so is everything if there
is no training row; repeated rows are predicted alike; an empty table gives an empty result.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.scale import small_side

LANGUAGES, DOCS_PER_LANGUAGE, RUNS_PER_LANGUAGE, LEAST_DOCS, LEAST_RUNS = 64, 600, 8_000, 40, 200
SEGMENT, HIDDEN, STEPS, BATCH, RATE = 32, 16, 900, 256, 0.01
RUNS_KEPT = 300_000
LETTER = regex.compile(r"\p{L}")
_TO = bytearray(range(256))
for _b in range(128):
    _TO[_b] = _b if 97 <= _b <= 122 else _b + 32 if 65 <= _b <= 90 else 32
FOLD = bytes(_TO)


def runs(text: str) -> list[bytes]:
    out = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    if any(len(r) > SEGMENT for r in out):
        out = [r[i:i + SEGMENT] for r in out for i in range(0, len(r), SEGMENT)]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters: per direction a byte table (256, 3H) and a recurrent matrix (H, 3H); output matrix and bias."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.languages = languages
        self.p = {"out": rng.normal(0, 0.2, (2 * h, len(languages))), "bias": np.zeros(len(languages))}
        for d in "fb":
            self.p |= {f"in_{d}": rng.normal(0, 0.3, (256, 3 * h)), f"re_{d}": rng.normal(0, h ** -0.5, (h, 3 * h))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: (n, length) bytes of runs of one length; returns (n, length, H)."""
        h, size = np.zeros((len(x), HIDDEN), np.float32), HIDDEN
        out = np.empty((*x.shape, size), np.float32)
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a, b = self.p[f"in_{d}"][x[:, t]], h @ self.p[f"re_{d}"]
            gates = sigmoid(a[:, :2 * size] + b[:, :2 * size])
            z, r = gates[:, :size], gates[:, size:]
            new = np.tanh(a[:, 2 * size:] + r * b[:, 2 * size:])
            if keep is not None:
                keep.append((t, h, z, r, new, b[:, 2 * size:]))
            h = new + z * (h - new)
            out[:, t] = h
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        s = np.concatenate([self.states(x, "f"), self.states(x, "b")], 2) @ self.p["out"] + self.p["bias"]
        s -= s.max(2, keepdims=True)
        return s - np.log(np.exp(s).sum(2, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions."""
        kept: dict[str, list] = {"f": [], "b": []}
        s = np.concatenate([self.states(x, d, kept[d]) for d in "fb"], 2)
        logits = s @ self.p["out"] + self.p["bias"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        error = e / e.sum(2, keepdims=True)
        error[np.arange(len(x)), :, y] -= 1
        error /= x.size
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = np.einsum("nts,ntk->sk", s, error), error.sum((0, 1))
        into = error @ self.p["out"].T
        size = HIDDEN
        for d, at in (("f", 0), ("b", size)):
            back = np.zeros((len(x), size), np.float32)
            for t, h, z, r, new, rec in reversed(kept[d]):
                back = back + into[:, t, at:at + size]
                d_new = back * (1 - z) * (1 - new * new)
                d_z = back * (h - new) * z * (1 - z)
                d_r = d_new * rec * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_new], 1)
                d_rec = np.concatenate([d_z, d_r, d_new * r], 1)
                np.add.at(g[f"in_{d}"], x[:, t], d_in)
                g[f"re_{d}"] += h.T @ d_rec
                back = back * z + d_rec @ self.p[f"re_{d}"].T
        return g

    def fit(self, samples: dict[int, list[tuple[bytes, int, float]]], steps: int = STEPS, seed: int = 9) -> None:
        """samples: by length, (run, language number, weight). Adam with a falling rate."""
        rng = np.random.default_rng(seed)
        by = {n: (np.array([np.frombuffer(r, np.uint8) for r, _, _ in v]), np.array([k for _, k, _ in v]),
                  np.array([w for *_, w in v])) for n, v in samples.items()}
        lengths = np.array(sorted(by))
        mass = np.array([by[n][2].sum() for n in lengths])
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            x, y, w = by[int(rng.choice(lengths, p=mass / mass.sum()))]
            pick = rng.choice(len(x), BATCH, p=w / w.sum())
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in self.gradients(x[pick], y[pick]).items():
                np.clip(g, -1, 1, out=g)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (rate * m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def shares(languages: int) -> tuple[int, int]:
    """Documents and runs that each of so many languages may give to the training sample."""
    part = min(1.0, LANGUAGES / languages)
    return max(LEAST_DOCS, int(DOCS_PER_LANGUAGE * part)), max(LEAST_RUNS, int(RUNS_PER_LANGUAGE * part))


def train(docs: DataFrame, held_out: int = 2, steps: int = STEPS) -> Network | None:
    """Fit on labelled rows outside the held-out fold; None if there are none."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != held_out))
    counts = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    found = counts.count()
    if not found:
        return None
    docs_each, runs_each = shares(found)
    chance = F.least(F.lit(1.0), F.lit(float(docs_each)) / F.col("_n"))
    some = rows.join(small_side(counts), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) < chance * (1 << 30))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = Counter((lang, r) for lang, text in zip(part["lang"], part["text"]) for r in runs(text))
            yield pd.DataFrame({"lang": [k[0] for k in n], "run": [k[1] for k in n], "n": list(n.values())})

    best = Window.partitionBy("lang").orderBy(F.desc("n"), "run")
    kept = some.select("lang", "text").mapInPandas(count, "lang string, run binary, n long").groupBy("lang", "run").agg(
        F.sum("n").alias("n")).withColumn("at", F.row_number().over(best)).where(F.col("at") <= runs_each).collect()
    languages = sorted({r["lang"] for r in kept})
    if not languages:
        return None
    total = Counter()
    for r in kept:
        total[r["lang"]] += r["n"]
    samples: dict[int, list] = {}
    for r in sorted(kept, key=lambda r: (r["lang"], bytes(r["run"]))):
        run = bytes(r["run"])
        samples.setdefault(len(run), []).append((run, languages.index(r["lang"]), r["n"] / total[r["lang"]]))
    network = Network(languages)
    network.fit(samples, steps)
    return network


class Labeller:
    """Sums of the log-probabilities over the bytes of a run, kept for the runs met most recently."""

    def __init__(self, network: Network):
        self.network, self.rows = network, {}
        part = min(1.0, LANGUAGES / len(network.languages))  # tables are as large with many languages as with LANGUAGES
        self.kept, self.at_once = int(RUNS_KEPT * part), max(1, int(4096 * part))
        self.sums = np.zeros((self.kept, len(network.languages)), np.float32)

    def label(self, texts: list[list[bytes]]) -> None:
        """Make sure that the runs of the texts are kept."""
        new = sorted({r for t in texts for r in t} - self.rows.keys(), key=lambda r: (len(r), r))
        if len(self.rows) + len(new) > len(self.sums):
            self.rows.clear()
            new = sorted({r for t in texts for r in t}, key=lambda r: (len(r), r))
        if len(new) > len(self.sums):
            self.sums = np.zeros((len(new), self.sums.shape[1]), np.float32)
        at = 0
        while at < len(new):
            end = at + 1
            while end < len(new) and end - at < self.at_once and len(new[end]) == len(new[at]):
                end += 1
            x = np.frombuffer(b"".join(new[at:end]), np.uint8).reshape(end - at, len(new[at]))
            first = len(self.rows)
            self.sums[first:first + end - at] = self.network.log_probabilities(x).sum(1)
            for r in new[at:end]:
                self.rows[r] = len(self.rows)
            at = end

    def probabilities(self, text: list[bytes]) -> np.ndarray:
        rows = np.fromiter(map(self.rows.__getitem__, text), np.int64, len(text))
        mean = self.sums[rows].sum(0, dtype=np.float64) / sum(map(len, text))
        e = np.exp(mean - mean.max())
        return e / e.sum()


def predicted(docs: DataFrame, held_out: int = 2, network: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    network = network or train(docs, held_out)
    narrow = docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id")) == held_out, F.lit(False)).alias("held_out"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(network) if network else None
        for part in parts:
            texts = [runs(t) if labeller and t and LETTER.search(t) else [] for t in part["text"]]
            langs, scores = [], []
            for at in range(0, len(texts), 500):
                some = texts[at:at + 500]
                if labeller:
                    labeller.label(some)
                for t in some:
                    p = labeller.probabilities(t) if t else None
                    langs.append(network.languages[int(p.argmax())] if t else "und")
                    scores.append(float(p.max()) if t else 0.0)
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": langs, "score": scores})

    return narrow.mapInPandas(run, schema)
