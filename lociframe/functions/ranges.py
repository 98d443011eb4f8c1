"""Row-local functions on genomic ranges: 1-based, inclusive, as Column expressions.

Every function takes ``Span`` values, so that the two sides of a join, or the
two ends of a pair of columns, are named once. A null in any coordinate gives
null.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Span(NamedTuple):
    """Columns of one range; ``strand`` is used by stranded tests only."""

    chr: Column
    start: Column
    end: Column
    strand: Column | None = None


def span(prefix: str = "", stranded: bool = False) -> Span:
    """The range in columns ``<prefix>chr``, ``<prefix>start``, ``<prefix>end`` (``<prefix>strand``)."""
    return Span(*(F.col(f"{prefix}{c}") for c in ("chr", "start", "end")), F.col(f"{prefix}strand") if stranded else None)


def length(a: Span) -> Column:
    return a.end - a.start + 1


def same(a: Span, b: Span) -> Column:
    """Equal place; strand does not matter."""
    return (a.chr == b.chr) & (a.start == b.start) & (a.end == b.end)


def adjacent(a: Span, b: Span) -> Column:
    """Touching without a gap and without sharing a base."""
    return (a.chr == b.chr) & ((a.end + 1 == b.start) | (b.end + 1 == a.start))


def padded(a: Span, padding: int | Column) -> Span:
    """Widened on both sides; the left edge stops at 1."""
    return a._replace(start=F.greatest(a.start - padding, F.lit(1)), end=a.end + padding)


def overlaps(a: Span, b: Span, padding: int = 0) -> Column:
    """Whether ranges share a base once ``b`` is widened by ``padding``; ranges with strands must agree in them."""
    b = padded(b, padding) if padding else b
    test = (a.chr == b.chr) & (a.start <= b.end) & (b.start <= a.end)
    return test if a.strand is None or b.strand is None else test & (a.strand == b.strand)


def overlap_size(a: Span, b: Span) -> Column:
    """Bases shared; 0 across chromosomes."""
    return F.when(a.chr == b.chr, F.greatest(F.lit(0), F.least(a.end, b.end) - F.greatest(a.start, b.start) + 1)).otherwise(0)


def hull(a: Span, b: Span) -> Column:
    """Struct of the least range holding both; null across chromosomes."""
    return F.when(a.chr == b.chr, F.struct(a.chr.alias("chr"), F.least(a.start, b.start).alias("start"), F.greatest(a.end, b.end).alias("end")))


def intersection(a: Span, b: Span) -> Column:
    """Struct of the shared piece, or null."""
    return F.when(overlaps(a, b), F.struct(a.chr.alias("chr"), F.greatest(a.start, b.start).alias("start"), F.least(a.end, b.end).alias("end")))


def difference(a: Span, b: Span) -> Column:
    """Array of what is left of ``a`` without ``b``: none, one or two pieces."""
    piece = lambda s, e: F.struct(a.chr.alias("chr"), s.alias("start"), e.alias("end"))
    cut = F.filter(F.array(piece(a.start, F.least(a.end, b.start - 1)), piece(F.greatest(a.start, b.end + 1), a.end)), lambda x: x["start"] <= x["end"])
    return F.when(overlaps(a, b), cut).otherwise(F.array(piece(a.start, a.end)))


def distance(a: Span, b: Span) -> Column:
    """Bases between two ranges: 0 if they touch or overlap, -1 across chromosomes."""
    return F.when(a.chr != b.chr, -1).otherwise(F.greatest(F.lit(0), F.greatest(a.start, b.start) - F.least(a.end, b.end) - 1))


def compare(a: Span, b: Span, padding: int = 0) -> Column:
    """-1, 0 or 1: before, overlapping, after; chromosomes in byte order."""
    before = (a.chr < b.chr) | ((a.chr == b.chr) & (a.end < b.start))
    return F.when(overlaps(a, b, padding), 0).when(before, -1).otherwise(1)


def clip(a: Span, low: int | Column, high: int | Column) -> Column:
    """Struct of the part of ``a`` within ``low``..``high``, or null."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return F.when((low <= a.end) & (high >= a.start), F.struct(a.chr.alias("chr"), F.greatest(a.start, low).alias("start"), F.least(a.end, high).alias("end")))


def to_text(a: Span) -> Column:
    """``chr:start-end``."""
    return F.concat(a.chr, F.lit(":"), a.start.cast("string"), F.lit("-"), a.end.cast("string"))


def from_text(text: Column) -> Column:
    """Struct (chr, start, end) of ``chr:start-end``; null where the text is no range. A chr may hold colons."""
    part = lambda i: F.regexp_extract(text, r"^(.+):(\d+)-(\d+)$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("chr"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end")))
