"""Line-first cleaning: rules per line, failing lines removed, then documents that lose too much rejected.

Hard-wrapped lines are judged as the one line that they were: a line runs on into the next one if that is not blank, the line does not
end in a sentence mark, and the next word would not have fitted into the longest line of its block (lines between blank ones). The
lines of such a run stay or go together, so no line is cut out of a running sentence.

Line rules (a line without a word passes):
* punctuation: no sentence mark at the end of the line nor inside it (marks of all scripts; not asked of lines mostly in a script that has none);
* navigation: at least 3 separators (| » › • ·) and one for every 5 words or more;
* symbols: more than one of the characters # * $ % & | < > for every 4 words;
* shouting: at least 4 words, letters among them and none in lower case;
* repetition: at least 8 words, 3 of 10 equal to the word before;
* boilerplate: a fixed phrase of site furniture in a line of at most 25 words.

A document is rejected by the base rules (too few words, or too many words in repeated three-word windows), or
if the removed lines hold more than half of its words. Whole texts are read, one row at a time, so memory
follows the longest text. Defined cases: null and empty texts have no words and are rejected;
repeated rows are judged alike; other columns pass through untouched.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.common import words

MIN_WORDS, MAX_REPEAT_PCT, MAX_LOST = 50, 50, 0.5
SYMBOLS = re.compile(r"[#*$%&|<>]+")
SEPARATORS = re.compile(r"[|»›•·]")
#: Unicode's Sentence_Terminal characters of the scripts in use, and the ellipsis.
TERMINALS = ("!.?…։؝؞؟۔܀܁܂߹।॥၊။።፧፨᙮᜵᜶។៕᠃᠉᥄᥅᪨᪩᪪᪫᭚᭛᭞᭟᰻᰼᱾᱿‼‽⁇⁈⁉⸮。꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫﹒﹖﹗！．？｡།༎")
SENTENCE_MARK = re.compile(rf"[{TERMINALS}](?:[\"'”’»)\]」』]|\s|$)|[:;؛：；]$")
SENTENCE_END = re.compile(rf"[{TERMINALS}][\"'”’»)\]」』]*$")
#: Thai, Lao and the Tai scripts end sentences without a mark.
UNMARKED = re.compile("[\u0e01-\u0e4e\u0e81-\u0ecd\u0edc-\u0edf\u1950-\u1974\u1980-\u19c9\u1a20-\u1a7c\uaa80-\uaadd]")
#: Letters that are written without spaces between words: those, Khmer, Burmese, Tibetan, kana and Han; a line can break at any of them.
UNSPACED = re.compile("[\u0e01-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\uaa80-\uaadf\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
BOILERPLATE = re.compile(
    r"(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|accept cookies"
    r"|enable javascript|click here|sign in|log in|subscribe now|share on (?:facebook|twitter)|back to top|skip to content|lorem ipsum")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(tokens: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(tokens) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.int64, len(tokens))
    pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1].astype(np.int64)
    _, which, n = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    twice = n[which] > 1
    inside = np.zeros(len(w), bool)
    for shift in range(3):
        inside[shift:len(w) - 2 + shift] |= twice
    return int(inside.sum())


def unmarked(line: str) -> bool:
    """True if the line is mostly in a script without sentence marks."""
    n = len(UNMARKED.findall(line))
    return n > 0 and 2 * n > sum(c.isalpha() or "M" == unicodedata.category(c)[0] for c in line)


def running(lines: list[str], tokens: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Start and end (exclusive) of the runs of lines that are one line, hard-wrapped."""
    widths = [len(line.rstrip()) for line in lines]
    start, widest, until = 0, 0, 0
    for i in range(len(lines)):
        if i >= until and tokens[i]:  # the block that starts here
            until = i
            while until < len(lines) and tokens[until]:
                until += 1
            widest = max(widths[i:until])
        if tokens[i] and i + 1 < until:
            first = lines[i + 1].lstrip()
            # a mark may not begin a line, so an unspaced line can break up to two characters before the edge
            need = 3 if UNSPACED.match(first) else 1 + len(first.split(None, 1)[0]) if first else 0
            if widths[i] + need > widest and not SENTENCE_END.search(lines[i].rstrip()):
                continue
        yield start, i + 1
        start = i + 1


def line_fails(line: str, tokens: list[bytes]) -> bool:
    n = len(tokens)
    if not n:
        return False
    if not SENTENCE_MARK.search(line.rstrip()) and not unmarked(line):
        return True
    marks = sum(map(len, SYMBOLS.findall(line)))
    if marks * 4 > n:
        return True
    bars = len(SEPARATORS.findall(line))
    if bars >= 3 and bars * 5 >= n:
        return True
    if n >= 8 and sum(a == b for a, b in zip(tokens, tokens[1:])) * 10 >= n * 3:
        return True
    if n >= 4 and line.upper() == line and line.lower() != line:
        return True
    return n <= 25 and bool(BOILERPLATE.search(line))


def judge(text: str | None) -> tuple[tuple[int, int, int, int, int], bool, bool, str | None]:
    """The measures, base_failed, kept, and the text without its failing lines."""
    text = text or ""
    tokens = words(text)
    n = len(tokens)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\f\r"))
    repeats = repeated_words(tokens)
    seen: set[str] = set()
    good, copies, lost = [], 0, 0
    lines = text.split("\n")
    found = [words(line) for line in lines]
    for line, here in zip(lines, found):
        if here:
            copies += line in seen
            seen.add(line)
    for a, b in running(lines, found):
        here = found[a] if b == a + 1 else [t for some in found[a:b] for t in some]
        if line_fails(lines[a] if b == a + 1 else " ".join(lines[a:b]), here):
            lost += len(here)
        else:
            good += lines[a:b]
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PCT * n
    kept = not failed and lost <= MAX_LOST * n
    return (n, chars, sum(map(len, SYMBOLS.findall(text))), copies, repeats), failed, kept, "\n".join(good)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the five measures, base_failed, kept."""
    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in MEASURES],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [judge(t) for t in part["text"]]
            out = pd.DataFrame([r[0] for r in rows], columns=list(MEASURES), dtype="int64")
            out.insert(0, "doc_id", part["doc_id"].array)
            yield out.assign(base_failed=[r[1] for r in rows], kept=[r[2] for r in rows])

    return narrow.mapInPandas(run, schema)


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their failing lines removed; n_chars follows the text if there is one."""

    @F.pandas_udf("struct<kept:boolean,text:string>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = [judge(t) for t in texts]
        return pd.DataFrame({"kept": [r[2] for r in rows], "text": [r[3] for r in rows]})

    judged = judged.asNondeterministic()  # else the filter and the new text would each run it
    names = docs.columns  # they travel in one struct, so no name clashes
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), judged("text").alias("_clean")).where("_clean.kept")
    out = held.select(*[F.col("_clean.text").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in names])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
