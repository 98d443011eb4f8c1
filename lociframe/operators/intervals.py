"""Interval algebra over tables of ranges (chr, start, end, ...): 1-based, inclusive.

Sweeps run in two levels: positions are dealt into bins of ``BIN`` bases, each
(chr, bin) is swept on its own, and what reaches a bin from the bins before it
is a prefix over one row per bin. So a chromosome is never one task, and equal
positions are combined before they are shuffled, so neither is a pile of
ranges at one place.

Rows with a null coordinate or with end < start take part in nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.session import spread

#: Bases of a sweep's bin.
BIN = 65_536
#: Type in which real weights are summed.
EXACT = "decimal(38,15)"


def sound(ranges: DataFrame) -> DataFrame:
    return ranges.where("chr IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND start <= end")


def _carry(rows: DataFrame, keys: list, value: Column, total, before: str) -> DataFrame:
    """``rows`` (keys, bin, ...) with ``before``: the aggregate ``total`` of ``value`` over all earlier bins of the keys."""
    sums = rows.groupBy(*keys, "bin").agg(total(value).alias("__own"))
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums.withColumn(before, total("__own").over(w)).drop("__own"), [*keys, "bin"])


def coverage(ranges: DataFrame, keys: tuple = ("chr",), weight: str | None = None, bin_size: int = BIN) -> DataFrame:
    """Maximal runs of equal, non-zero depth: (*keys, start, end, depth).

    Depth is the number of ranges, or the sum of ``weight``, at each base. Real
    weights are summed as decimals of 15 places, so that what opens and closes
    cancels to nothing and equal sums are equal.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1).cast("long")
    real = bool(weight) and ranges.schema[weight].dataType.typeName() in ("float", "double")
    if real:
        w = w.cast(EXACT)
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), w.alias("d")), F.struct((F.col("end") + 1).alias("pos"), (-w).alias("d"))))
    events = (sound(ranges).select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
              .where("d != 0").withColumn("bin", F.floor(F.col("pos") / F.lit(bin_size)).cast("long")).where("bin IS NOT NULL AND " + " AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    # both uses of the events are the same down to their shuffle, which is made once; a bin has at most as many of them as it has bases
    events = spread(events, *keys, "bin")
    bins = events.groupBy(*keys, "bin").agg(F.sum("d").alias("__own"), F.min("pos").alias("__first"))
    whole = Window.partitionBy(*keys).orderBy("bin")
    bins = (bins.withColumn("__before", F.coalesce(F.sum("__own").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("__after", F.lead("__first").over(whole)).drop("__own", "__first"))
    own = Window.partitionBy(*keys, "bin").orderBy("pos")
    return (events.join(bins, [*keys, "bin"])
            .withColumn("depth", F.col("__before") + F.sum("d").over(own.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("end", F.coalesce(F.lead("pos").over(own), F.col("__after")) - 1)
            .where("depth != 0 AND end IS NOT NULL").select(*keys, F.col("pos").alias("start"), "end", (F.col("depth").cast("double") if real else F.col("depth")).alias("depth")))


def islands(ranges: DataFrame, gap: int = 0, keys: tuple = ("chr",), bin_size: int = BIN) -> DataFrame:
    """Hulls of chains of ranges: (*keys, start, end, members).

    A range joins a chain when its start is at most ``gap`` bases past the
    chain's end: 0 for shared bases only, 1 for adjacent ranges too.
    """
    keys = list(keys)
    firsts = spread(sound(ranges).groupBy(*keys, "start").agg(F.max("end").alias("end"), F.count("*").alias("members"))
                    .withColumn("bin", F.floor(F.col("start") / F.lit(bin_size)).cast("long")), *keys, "bin")
    own = Window.partitionBy(*keys, "bin").orderBy("start")
    swept = (_carry(firsts, keys, F.col("end"), F.max, "__before")
             .withColumn("__reach", F.greatest("__before", F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))))
             .withColumn("__new", F.when(F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + gap), 1).otherwise(0)))
    # chains of a bin first, then the part of a bin that continues an earlier bin's chain joins it
    local = (swept.withColumn("__run", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(*keys, "bin", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("members").alias("members")))
    # run 0 of a bin continues; at most one chain of each bin is open at its end: both are one row per bin
    last = Window.partitionBy(*keys, "bin")
    local = local.withColumn("__open", (F.col("__run") == 0) | (F.col("__run") == F.max("__run").over(last)))
    inner = local.where(~F.col("__open")).select(*keys, "start", "end", "members")
    across = Window.partitionBy(*keys).orderBy("bin", "__run").rowsBetween(Window.unboundedPreceding, 0)
    outer = (local.where("__open").withColumn("__chain", F.sum((F.col("__run") > 0).cast("int")).over(across))
             .groupBy(*keys, "__chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("members").alias("members"))
             .drop("__chain"))
    return inner.unionByName(outer)


def merge(ranges: DataFrame, keys: tuple = ("chr",)) -> DataFrame:
    """Union of overlapping or adjacent ranges; strand is not looked at."""
    return islands(ranges, 1, keys).drop("members")


def loci(ranges: DataFrame, overhang: int = 0, stranded: bool = False) -> DataFrame:
    """Single-linkage clusters of ranges at most ``overhang`` bases apart: (chr, [strand,] start, end, members)."""
    return islands(ranges, overhang, ("chr", "strand") if stranded else ("chr",))


def with_locus(ranges: DataFrame, overhang: int = 0, stranded: bool = False, bin_size: int = BIN) -> DataFrame:
    """``ranges`` with the ``locus_start`` and ``locus_end`` of the locus that holds each row.

    A range lies in the locus that covers its start, which is looked up by bin.
    """
    keys = ["chr", "strand"] if stranded else ["chr"]
    return within(ranges, loci(ranges, overhang, stranded), keys, bin_size).withColumnsRenamed({"__start": "locus_start", "__end": "locus_end"})


def within(ranges: DataFrame, islands: DataFrame, keys: list, bin_size: int = BIN) -> DataFrame:
    """``ranges`` with the ends (__start, __end) of the one of disjoint ``islands`` that covers their start, looked up by bin."""
    found = islands.select(*keys, F.col("start").alias("__start"), F.col("end").alias("__end"),
                           F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))).alias("__bin"))
    rows = sound(ranges).withColumn("__bin", F.floor(F.col("start") / bin_size))
    return rows.join(found, [*keys, "__bin"]).where("start BETWEEN __start AND __end").select(*ranges.columns, "__start", "__end")


def multi_loci(sides: dict, bin_size: int = BIN) -> DataFrame:
    """Loci over several tables at once: their rows with ``side`` and the locus that holds them (a full outer co-group)."""
    every = None
    for name, df in sides.items():
        own = sound(df).select("chr", "start", "end", F.lit(name).alias("side"), F.to_json(F.struct(*df.columns)).alias("row"))
        every = own if every is None else every.unionByName(own)
    return with_locus(every, bin_size=bin_size)


def signed_depth(a: DataFrame, b: DataFrame, keys: tuple = ("chr",)) -> DataFrame:
    """Runs over both tables with depth 1 where only ``a`` lies, 2 where only ``b``, 3 where both do."""
    both = merge(a, keys).withColumn("w", F.lit(1).cast("long")).unionByName(merge(b, keys).withColumn("w", F.lit(2).cast("long")))
    return coverage(both, keys, "w")


def subtract(a: DataFrame, b: DataFrame, keys: tuple = ("chr",)) -> DataFrame:
    """Parts of the union of ``a`` outside the union of ``b``."""
    return signed_depth(a, b, keys).where("depth = 1").drop("depth")


def intersect(a: DataFrame, b: DataFrame, keys: tuple = ("chr",)) -> DataFrame:
    """Parts in both unions."""
    return signed_depth(a, b, keys).where("depth = 3").drop("depth")


def pad(ranges: DataFrame, padding: int, bounds: DataFrame | None = None) -> DataFrame:
    """Ranges widened on both sides, within ``bounds`` (chr, low, high) where given, else from 1."""
    if bounds is None:
        return ranges.withColumns({"start": F.greatest(F.col("start") - padding, F.lit(1)), "end": F.col("end") + padding})
    own = bounds.select(F.col("chr").alias("__c"), F.col("low").alias("__low"), F.col("high").alias("__high"))
    return (ranges.join(own, F.col("chr") == F.col("__c"), "left")
            .withColumns({"start": F.greatest(F.col("start") - padding, F.coalesce("__low", F.lit(1))), "end": F.least(F.col("end") + padding, F.col("__high"))})
            .select(*ranges.columns))


def windows(ranges: DataFrame, width: int, keep_last: bool = False) -> DataFrame:
    """Consecutive windows of ``width`` bases from each range's start; what is left over at the end goes.

    A window that would end exactly with its range goes as well, unless ``keep_last``.
    """
    least = F.col("end") - F.col("start") + (1 if keep_last else 0)
    count = F.floor(least / F.lit(width)).cast("long")
    return (sound(ranges).where(count > 0).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
            .withColumn("start", F.col("start") + F.col("__i") * width).withColumn("end", F.col("start") + (width - 1)).drop("__i"))


def bed_merge(ranges: DataFrame, by_feature: str | None = None) -> DataFrame:
    """Merge as on half-open coordinates (touching ranges join), within equal values of ``by_feature`` if given."""
    return islands(ranges, 1, ("chr", by_feature) if by_feature else ("chr",)).drop("members")


def merge_runs(runs: DataFrame, value: str) -> DataFrame:
    """Abutting runs of equal ``value`` joined: (chr, start, end, value). Runs must not overlap."""
    return islands(runs, 1, ("chr", value)).select("chr", "start", "end", value)


def sort_ranges(ranges: DataFrame) -> DataFrame:
    """By chr, start, end and strand, missing values first."""
    keys = ["chr", "start", "end", *(["strand"] if "strand" in ranges.columns else [])]
    return ranges.orderBy(*(F.col(k).asc_nulls_first() for k in keys))
