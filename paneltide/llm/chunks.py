"""Texts cut into chunks that a tokenizer encodes alike wherever they stand.

A cut is set before a single space or line end between two other characters: the byte-level vocabulary's pre-tokens never cross
such a place, and no piece of the piece vocabulary does (checked when it is loaded). What is kept for a chunk is bounded by
entries and by the length of a chunk. The tables live as long as the Python worker, so tasks after the first find them filled.
"""
from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable
from types import ModuleType

CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Marks that may be cut from a Latin letter before them.
MARKS = ".,;:!?%&*$#|"
#: Chunks kept in one table; there are two, and the one not used lately goes.
KEPT, LONGEST = 350_000, 40


def whole_only(text: str) -> bool:
    """True if the text holds a character that engines do not agree on being white space, or that cuts use."""
    return "\0" in text or "᠎" in text


class Kept:
    """Values of chunks. `make` gets a list of chunks not known yet and returns their values; `add`, if given, makes the value of letters
    with marks behind them from those of both (`make` then gets marks as chunks of their own)."""

    def __init__(self, make: Callable[[list[str]], list], add: Callable | None = None, limit: int = KEPT):
        self.make, self.add, self.limit, self.new, self.old = make, add, limit, {}, {}

    def of(self, text: str) -> list:
        """The values of a text's chunks, in order."""
        if whole_only(text):
            return self.make([text])
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        if not parts[0]:
            del parts[0]
        found = list(map(self.new.get, parts))
        missing = {p for p, v in zip(parts, found) if v is None}
        if missing:
            even = all(map(cut_even, missing))  # so are the parts that are kept: the text may be cut before each of its spaces and line ends
            if not even:
                parts = CUT.split(text)
                found = list(map(self.new.get, parts))
                missing = {p for p, v in zip(parts, found) if v is None}
            got = self.made(missing)
            self.new.update(got if even and len(max(got, key=len, default="")) <= LONGEST else {p: v for p, v in got.items() if len(p) <= LONGEST and cut_well(p)})
            found = [got[p] if v is None else v for p, v in zip(parts, found)]
        return found

    def made(self, missing: set[str]) -> dict:
        got, new, split, old = {}, [], [], self.old.get
        for p in missing:
            v = old(p)
            if v is not None:
                got[p] = v
            elif p[-1] in MARKS and self.add and (head := p.rstrip(MARKS)) != p and "A" <= head[-1:] <= "\u024f" and head[-1].isalpha():
                split.append((p, head, p[len(head):]))
            else:
                new.append(p)
        if split:
            parts = {x for _, *both in split for x in both if x not in got and x not in missing}
            for x in parts:
                v = self.new.get(x) or self.old.get(x)
                if v is None:
                    new.append(x)
                else:
                    got[x] = v
        if new:
            got |= zip(new, self.make(new), strict=True)
        for p, head, tail in split:
            got[p] = self.add(got[head], got[tail])
        return got


def cut_even(part: str) -> bool:
    """A part of a text cut before each space and line end: no other white space stands beside the cuts."""
    return not part[-1].isspace() and not (part[0] in " \n" and part[1:2].isspace())


def cut_well(part: str) -> bool:
    """A chunk of which any text may be made: only its first character is white space, if any is at either end."""
    return not part[-1].isspace() and not part[1:2].isspace()


def runs(chunks: list[str]) -> tuple[list[str], list[str]]:
    """Chunks that may stand in one text, as each begins where a cut may be, and the others."""
    inner, other = [], []
    for c in chunks:
        (inner if c[0] in " \n" and cut_well(c) else other).append(c)
    return inner, other


def loaded(key: tuple, make: Callable[[], object]) -> object:
    """One object a Python worker and key; another key replaces it, so that tables of several operators do not add up.

    This package travels to the executors by value, so globals are new in every task: the object hangs on a module of the worker.
    """
    held = sys.modules.setdefault("_paneltide_worker", ModuleType("_paneltide_worker")).__dict__.setdefault("held", {})
    if key not in held:
        held.clear()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held[key] = make()
    return held[key]
