"""Column expressions shared by the operators. All JVM-side, no Python UDF."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column, positive: bool = False) -> Column:
    """num / den, NULL for a zero (or, with ``positive``, non-positive) denominator."""
    d = col(den).cast("double")
    d = F.when(d > 0, d) if positive else d
    return F.try_divide(col(num).cast("double"), d)


def annuity_payment(value: str | Column, rate_pct: str | Column, months: int = 360) -> Column:
    """Monthly payment on a level-payment loan over the full value; zero rate pays linearly."""
    r = col(rate_pct) / F.lit(1200.0)
    growth = F.pow(F.lit(1.0) + r, F.lit(float(months)))
    return F.when(r == 0, col(value) / F.lit(float(months))).otherwise(
        ratio(col(value) * r * growth, growth - F.lit(1.0)))


def area_code(state: str | Column, county: str | Column) -> Column:
    """Two-digit and three-digit code parts joined with leading zeros."""
    return F.concat(F.lpad(F.trim(col(state).cast("string")), 2, "0"),
                    F.lpad(F.trim(col(county).cast("string")), 3, "0"))


def title_places(title: str | Column) -> Column:
    """'A-B/C, X-Y' -> ordered array of (city, state) structs, all pairs, city order first."""
    t = col(title)
    head = F.regexp_extract(t, r"^(.*),[^,]*$", 1)
    tail = F.regexp_extract(t, r"^.*,([^,]*)$", 1)
    cities = F.filter(F.transform(F.split(head, "[-/]"), lambda c: F.lower(F.trim(c))), lambda c: c != "")
    states = F.filter(F.transform(F.split(tail, "-"), lambda s: F.upper(F.trim(s))), lambda s: s != "")
    return F.flatten(F.transform(
        cities, lambda c: F.transform(states, lambda s: F.struct(c.alias("city"), s.alias("state")))))


def primary_state(title: str | Column) -> Column:
    """First state of a title: the part after the last comma, up to the first hyphen."""
    return F.trim(F.substring_index(F.substring_index(col(title), ",", -1), "-", 1))


def text_to_double(c: str | Column) -> Column:
    """'1,234' -> 1234.0; anything that is not a finite number -> NULL."""
    return no_nan(F.regexp_replace(F.trim(col(c)), ",", "").try_cast("double"))


def stable_id(*parts: str | Column, width: int = 10) -> Column:
    """Leading hex digits of the SHA-1 of the parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])),
                       1, width)


def draw_bits(*parts: str | Column, slot: int = 0) -> Column:
    """32 reproducible random bits (bigint) from the MD5 of the parts; four slots per digest."""
    digest = F.md5(F.concat_ws(":", *[col(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1 + 8 * slot, 8), 16, 10).cast("bigint")


def wide_draw_bits(*parts: str | Column) -> Column:
    """60 reproducible random bits (bigint): taken modulo a count of units, no unit is favoured or out of reach."""
    digest = F.md5(F.concat_ws(":", *[col(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def uniform(*parts: str | Column, slot: int = 0) -> Column:
    """Open-interval uniform in (0, 1)."""
    return (draw_bits(*parts, slot=slot) + F.lit(0.5)) / F.lit(4294967296.0)


def standard_normal(*parts: str | Column) -> Column:
    """Box-Muller from two slots of one digest."""
    return F.sqrt(F.lit(-2.0) * F.ln(uniform(*parts, slot=0))) * F.cos(
        F.lit(2.0 * math.pi) * uniform(*parts, slot=1))


def interval_name(c: str | Column, intervals: Mapping[str, tuple[int, int]], default: str = "unknown") -> Column:
    """Name of the first closed interval that holds the value."""
    out = None
    for name, (lo, hi) in intervals.items():
        hit = col(c).between(lo, hi)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def present_count(cols: Sequence[str | Column]) -> Column:
    if all(isinstance(c, str) for c in cols):
        return F.expr(" + ".join(f"int(`{c}` IS NOT NULL)" for c in cols))
    total = F.lit(0)
    for c in cols:
        total = total + col(c).isNotNull().cast("int")
    return total


def present_mean(cols: Sequence[str | Column], at_least: int = 1) -> Column:
    """Mean over the non-NULL columns of a row, NULL unless ``at_least`` are present."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(col(c).cast("double"), F.lit(0.0))
    n = present_count(cols)
    return F.when(n >= at_least, F.try_divide(total, n.cast("double")))


def no_nan(c: str | Column) -> Column:
    """Missing is NULL in this library; NaN and infinities never survive a read."""
    return F.when(~F.isnan(col(c)) & (F.abs(col(c)) < F.lit(float("inf"))), col(c))
