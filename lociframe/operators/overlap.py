"""Joins of ranges by overlap, as equi joins on (chr, bin).

Both sides are dealt into the bins that they touch; a pair meets in its first
common bin only, so nothing is counted twice and no distinct is needed. Ranges
that would touch more than ``WIDE`` bins are matched in bins of a coarser
size, level by level, so a long range costs few rows. A pair meets on the level
of its longer range alone: coarse bins hold long ranges and their partners,
never two short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 1024
#: Bins that a range touches at most on its level; each level's bins are so many times wider.
WIDE, LEVELS = 8, 4


def _level(length: Column, bin_size: int) -> Column:
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(length <= bin_size * WIDE ** (k + 1), k).otherwise(out)
    return out


def overlap_join(a: DataFrame, b: DataFrame, a_prefix: str = "a_", b_prefix: str = "b_", padding: int = 0, on: tuple = (), bin_size: int = BIN) -> DataFrame:
    """Pairs of rows whose ranges share a base, ``b`` widened by ``padding``; all columns, prefixed.

    ``on`` names further columns that must be equal (strand, sample). Rows with
    null coordinates join nothing. Each pair is found on the level of its
    longer range, in the first bin that both touch.
    """
    left = a.toDF(*(f"{a_prefix}{c}" for c in a.columns))
    right = b.toDF(*(f"{b_prefix}{c}" for c in b.columns))
    keys = ["chr", *on]
    left = left.withColumns({"__s": F.col(f"{a_prefix}start"), "__e": F.col(f"{a_prefix}end")})
    right = right.withColumns({"__s": F.greatest(F.col(f"{b_prefix}start") - padding, F.lit(1)) if padding else F.col(f"{b_prefix}start"),
                               "__e": F.col(f"{b_prefix}end") + padding})

    def dealt(df, tag, first):
        df = df.where("__s <= __e").withColumn("__own", _level(F.col("__e") - F.col("__s") + 1, bin_size))
        # role 0: the left range is as long as its level asks; role 1: only the right one is. So short ranges meet on no coarse level.
        at = lambda levels, role: F.transform(levels, lambda k: F.struct(k.alias("level"), F.lit(role).alias("role")))
        own, above = F.array("__own"), F.when(F.col("__own") < LEVELS - 1, F.sequence(F.col("__own") + 1, F.lit(LEVELS - 1))).otherwise(F.array().cast("array<int>"))
        roles = F.concat(at(own, 0), at(above, 1)) if first else F.concat(at(own, 0), at(above, 0), at(own, 1))
        df = df.withColumn("__at", F.explode(roles)).withColumns({"__level": F.col("__at.level"), "__role": F.col("__at.role")})
        width = F.lit(bin_size).cast("long") * F.pow(F.lit(float(WIDE)), F.col("__level")).cast("long")
        df = df.withColumn("__w", width)
        df = df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__s") / F.col("__w")), F.floor(F.col("__e") / F.col("__w"))))).drop("__at", "__own")
        return df.withColumnsRenamed({c: f"{tag}{c}" for c in ("__s", "__e", "__level", "__role", "__w", "__bin")})

    x, y = dealt(left, "x", True), dealt(right, "y", False)
    test = (F.col("x__level") == F.col("y__level")) & (F.col("x__role") == F.col("y__role")) & (F.col("x__bin") == F.col("y__bin"))
    for k in keys:
        test &= F.col(f"{a_prefix}{k}") == F.col(f"{b_prefix}{k}")
    once = ((F.col("x__s") <= F.col("y__e")) & (F.col("y__s") <= F.col("x__e"))
            & (F.floor(F.greatest("x__s", "y__s") / F.col("x__w")) == F.col("x__bin")))
    return x.join(y, test & once).select(*left.columns[:-2], *right.columns[:-2])


def pieces(a: DataFrame, b: DataFrame, **how) -> DataFrame:
    """Overlapping pairs with the shared piece (chr, start, end) and its ``size``."""
    both = overlap_join(a, b, **how)
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return both.withColumns({"chr": F.col("a_chr"), "start": start, "end": end, "size": end - start + 1})


def covered_by(a: DataFrame, b: DataFrame, key: str, depth: str = "depth", **how) -> DataFrame:
    """For each ``key`` of ``a``, its length, the bases that ``b`` covers, and the mean depth over all its bases; zero rows are kept.

    Rows of ``b`` with a ``depth`` must not overlap each other; they count where the depth is above 0.
    """
    hit = (pieces(a, b, **how).where(F.col(f"b_{depth}") > 0)
           .groupBy(F.col(f"a_{key}").alias(key)).agg(F.sum("size").alias("covered"), F.sum(F.col("size") * F.col(f"b_{depth}")).alias("bases")))
    own = a.groupBy(key).agg(F.sum(F.col("end") - F.col("start") + 1).alias("length"))
    return own.join(hit, key, "left").select(
        key, "length", F.coalesce("covered", F.lit(0)).alias("covered"), (F.coalesce("covered", F.lit(0)) / F.col("length")).alias("fraction"),
        (F.coalesce("bases", F.lit(0)) / F.col("length")).alias("mean_depth"))


def with_overlap(a: DataFrame, b: DataFrame, anti: bool = False, **how) -> DataFrame:
    """Rows of ``a`` that overlap (``anti``: do not overlap) a row of ``b``.

    ``b`` is merged first, so a row of ``a`` is tested once by the union's bins.
    """
    from lociframe.operators.intervals import BIN as SWEEP
    from lociframe.operators.intervals import merge, sound

    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / SWEEP), F.floor(F.col(e) / SWEEP)))
    union = merge(b).select(F.col("chr").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e"), bins("start", "end").alias("__b"))
    rows = sound(a).withColumn("__id", F.monotonically_increasing_id())
    test = (F.col("chr") == F.col("__c")) & (F.col("__k") == F.col("__b")) & (F.col("start") <= F.col("__e")) & (F.col("__s") <= F.col("end"))
    hit = rows.withColumn("__k", bins("start", "end")).join(union, test, "left_semi").select("__id").distinct()
    return rows.join(hit, "__id", "left_anti" if anti else "left_semi").select(*a.columns)
