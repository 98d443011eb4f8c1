"""Row-local functions on exon arrays: array<struct<start,end>>, 1-based, inclusive, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lociframe.functions.sequence import col

EXONS = "array<struct<start:bigint,end:bigint>>"


def exons_of(starts: Column | str, ends: Column | str) -> Column:
    """Exons of arrays of 0-based starts and of ends."""
    return F.zip_with(col(starts), col(ends), lambda s, e: F.struct((s + 1).cast("bigint").alias("start"), e.cast("bigint").alias("end")))


def length(exons: Column | str) -> Column:
    return F.aggregate(col(exons), F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"] + 1)


def junctions(exons: Column | str) -> Column:
    """Array of (left, right): the last base of an exon and the first of the next."""
    x = col(exons)
    pair = F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))),
                      lambda a, b: F.struct(a["end"].alias("left"), b["start"].alias("right")))
    return F.when(F.size(x) > 1, pair).otherwise(F.array().cast("array<struct<left:bigint,right:bigint>>"))


def junction_string(chrom: Column | str, exons: Column | str) -> Column:
    """``chr:left/chr:right`` of each junction, joined by ``;``."""
    c = F.concat(col(chrom), F.lit(":"))
    return F.array_join(F.transform(junctions(exons), lambda j: F.concat(c, j["left"].cast("string"), F.lit("/"), c, j["right"].cast("string"))), ";")


def clip(exons: Column | str, low: Column | int, high: Column | int) -> Column:
    """The parts of exons within ``low``..``high``."""
    low, high = (F.lit(v) if isinstance(v, int) else v for v in (low, high))
    cut = F.transform(col(exons), lambda x: F.struct(F.greatest(x["start"], low).alias("start"), F.least(x["end"], high).alias("end")))
    return F.filter(cut, lambda x: x["start"] <= x["end"])


def slice_sequence(exons: Column | str, strand: Column | str, start: int | Column, stop: int | Column, directionless: bool = False) -> Column:
    """Exons of the transcript's bases ``start`` to ``stop`` (0-based, half-open, along the strand; the end is clamped)."""
    x, size = col(exons), length(exons)
    start, stop = (F.lit(v) if isinstance(v, int) else v for v in (start, stop))
    stop = F.least(stop, size)
    if not directionless:
        back = col(strand) == "-"
        start, stop = F.when(back, size - stop).otherwise(start), F.when(back, size - start).otherwise(stop)
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast(EXONS).alias("out"))

    def step(a, e):
        own = F.struct(F.greatest(e["start"], e["start"] + start - a["n"]).alias("start"), F.least(e["end"], e["start"] + stop - a["n"] - 1).alias("end"))
        return F.struct((a["n"] + e["end"] - e["start"] + 1).alias("n"), F.concat(a["out"], F.array(own)).alias("out"))

    return F.filter(F.aggregate(x, zero, step, lambda a: a["out"]), lambda e: e["start"] <= e["end"])


def smooth(exons: Column | str, min_intron: int, absorb: bool = False) -> Column:
    """Exons with gaps of 0 to under ``min_intron`` bases closed; with ``absorb`` overlapping ones are joined as well."""
    def step(a, e):
        last = F.try_element_at(a, F.lit(-1))
        gap = e["start"] - last["end"] - 1
        near = (gap < min_intron) if absorb else (gap >= 0) & (gap < min_intron)
        joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], e["end"]).alias("end"))))
        return F.when((F.size(a) > 0) & near, joined).otherwise(F.concat(a, F.array(e)))

    typed = F.transform(col(exons), lambda e: F.struct(e["start"].cast("bigint").alias("start"), e["end"].cast("bigint").alias("end")))
    return F.aggregate(typed, F.array().cast(EXONS), step)


def overlap_size(a: Column | str, b: Column | str) -> Column:
    """Bases that the exons of two transcripts of one chromosome share."""
    return F.aggregate(col(a), F.lit(0).cast("bigint"), lambda n, x: n + F.aggregate(
        col(b), F.lit(0).cast("bigint"), lambda m, y: m + F.greatest(F.lit(0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]) + 1)))


def mutual_coverage(a: Column | str, b: Column | str) -> Column:
    """Geometric mean of the shares of both transcripts that overlap."""
    n = overlap_size(a, b)
    return F.sqrt((n / length(a)) * (n / length(b)))
