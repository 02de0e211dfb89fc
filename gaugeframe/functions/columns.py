"""Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """True for the texts true, 1 and yes in any case; false for others and null."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def number(c: Column) -> Column:
    """The text as a number, or null."""
    return c.try_cast("double")


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    c = c if low is None else F.greatest(c, F.lit(low))
    return c if high is None else F.least(c, F.lit(high))


def bin_index(c: Column, width: float, origin: float = 0.0) -> Column:
    return F.floor((c - origin) / width).cast("long")


def digitize(c: Column, low: float, high: float, bins: int) -> Column:
    """Bin of [low, high) in equal parts, with values outside in the first or last bin."""
    return clip(F.floor((c - low) / ((high - low) / bins)).cast("long"), 0, bins - 1).cast("long")


def stars(p: Column, cuts: Sequence[float] = (0.0001, 0.001, 0.01, 0.05), strict: bool = False) -> Column:
    """Marks for a P value: one more for each cut it lies under (at or under, unless strict)."""
    out = F.when(p.isNull(), F.lit(None).cast("string"))
    for i, cut in enumerate(cuts):
        out = out.when(p < cut if strict else p <= cut, "*" * (len(cuts) - i))
    return out.otherwise("ns")


def wrap_degrees(c: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(c + 180.0, F.lit(360.0)) - 180.0


def signed_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees from a to b, counter-clockwise."""
    return F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by))


def rotate_shift(x: Column, y: Column, degrees: float, dx: float, dy: float) -> tuple[Column, Column]:
    a = F.radians(F.lit(degrees))
    return F.cos(a) * x - F.sin(a) * y + dx, F.sin(a) * x + F.cos(a) * y + dy


def tertile(c: Column, q1: Column, q2: Column) -> Column:
    return F.when(c.isNull(), "undetermined").when(c <= q1, "low").when(c <= q2, "middle").otherwise("high")


def natural_key(c: Column) -> list[Column]:
    """Sort keys for ids like ``a-b``: both numbers, anything else last, then the text."""
    return [F.coalesce(F.regexp_extract(c, r"^(\d+)-(\d+)$", i).try_cast("int"), F.lit(10**9)) for i in (1, 2)] + [c]


def list_of_ints(c: Column) -> Column:
    """``1,2;5`` as an array; parts that aren't numbers are left out."""
    parts = F.split(F.coalesce(c, F.lit("")), "[;,]")
    return F.filter(F.transform(parts, lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def signature(items: Column) -> Column:
    """16 hex digits that name a set of texts, whatever its order."""
    return F.substring(F.sha1(F.array_join(F.array_sort(F.array_distinct(items)), "\n")), 1, 16)


def dominance(a: Column, b: Column, least: float, margin: float) -> Column:
    """host, donor, mixed or none: which of two signals stands out by a log2 margin."""
    ratio = F.log2((a + 1e-9) / (b + 1e-9))
    return F.when((a < least) & (b < least), "none").when(ratio >= margin, "host").when(ratio <= -margin, "donor").otherwise("mixed")


def cut_edges(c: Column, edges: Sequence[float]) -> Column:
    """The number of the interval [a, b) between given edges, from 0; the last holds its upper end; null outside."""
    inside = (c >= edges[0]) & (c <= edges[-1])
    below = sum(((c >= e).cast("long") for e in edges[1:-1]), F.lit(0).cast("long"))
    return F.when(inside, below)


def threshold_label(c: Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the first cut that a value lies under; the last name beyond all of them; null for null."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for cut, name in zip(cuts, names):
        out = out.when(c < cut, name)
    return out.otherwise(names[len(cuts)])


def padded(c: Column, digits: int) -> Column:
    """An id with leading zeros; longer ids stay whole."""
    text = c.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def log_ratio(a: Column, b: Column, shift: float) -> Column:
    """log2 of a ratio with the same shift above and below."""
    return F.log2((a + shift) / (b + shift))
