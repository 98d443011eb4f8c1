"""Seeded simulation of reads from transcripts.

Every draw is a hash of (seed, row, purpose), so results do not depend on
partitions or retries. Strings of the original generator are not reproduced;
distributions are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.functions.sequence import phred_of_rate, rc

#: Lengths of fragments: least, mean, deviation.
LONG, SHORT = (1000, 4000, 500), (150, 290, 290)


def uniform(seed: int, purpose: str, *row) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *row), F.lit(1 << 52)) / float(1 << 52)


def gauss(seed: int, purpose: str, *row) -> Column:
    """Standard normal by Box and Muller."""
    u, v = uniform(seed, purpose + "/r", *row), uniform(seed, purpose + "/a", *row)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)


def draw(items: DataFrame, weight: str, n: int, seed: int, buckets: int = 4096) -> DataFrame:
    """``n`` draws with replacement: (read, columns of ``items``), by weight.

    Cumulative weights are cut into buckets of [0, 1) and draws meet them by an
    equi join on the bucket. Weights of 0 or less are never drawn.
    """
    live = items.where(F.col(weight) > 0).withColumn("__h", F.pmod(F.xxhash64(*items.columns), F.lit(1024)))
    part = live.groupBy("__h").agg(F.sum(weight).alias("__own"))
    w = Window.orderBy("__h")
    part = part.withColumn("__before", F.coalesce(F.sum("__own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("__all", F.sum("__own").over(Window.partitionBy(F.lit(0))))
    own = Window.partitionBy("__h").orderBy(*items.columns)
    placed = (live.join(F.broadcast(part), "__h")
              .withColumn("__hi", (F.col("__before") + F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, 0))) / F.col("__all"))
              .withColumn("__lo", (F.col("__before") + F.coalesce(F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.col("__all"))
              .withColumn("__k", F.explode(F.sequence(F.floor(F.col("__lo") * buckets), F.least(F.floor(F.col("__hi") * buckets), F.lit(buckets - 1))))))
    u = items.sparkSession.range(n).select(F.col("id").alias("read")).withColumn("__u", uniform(seed, "draw", "read"))
    u = u.withColumn("__b", F.floor(F.col("__u") * buckets))
    return u.join(placed, (F.col("__b") == F.col("__k")) & (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi"))).select("read", *items.columns)


def fragments(reads: DataFrame, kind: str, seed: int) -> DataFrame:
    """``reads`` (read, seq) cut to fragments: a length from a normal with a least value, a uniform start."""
    least, mean, spread = LONG if kind == "long" else SHORT
    n = F.length("seq")
    size = F.least(n, F.greatest(F.lit(least), F.round(mean + spread * gauss(seed, "cut", "read")).cast("int")))
    start = F.floor(uniform(seed, "start", "read") * (n - F.col("size") + 1)).cast("int")
    return (reads.withColumn("size", size).withColumn("start", start).withColumn("fragment", F.substring("seq", F.col("start") + 1, F.col("size")))
            .withColumn("flip", uniform(seed, "flip", "read") < 0.5).withColumn("fragment", F.when(F.col("flip"), rc("fragment")).otherwise(F.col("fragment"))).drop("size", "seq"))


def mates(frags: DataFrame, length: int = 150) -> DataFrame:
    """Both ends of fragments: (…, mate1, mate2), the second from the other strand."""
    return frags.withColumn("mate1", F.substring("fragment", 1, length)).withColumn("mate2", F.substring(rc("fragment"), 1, length))


def mutate_one(seq: str, rate: float, rng: np.random.Generator, rates: dict | None = None) -> str:
    """Errors at a flat ``rate`` a base: three in five wrong bases, one insertion, one deletion.

    ``rates`` holds a rate by (base before, base, base after) where errors depend on context.
    """
    out = []
    for i, c in enumerate(seq):
        r = rates.get((seq[i - 1] if i else None, c, seq[i + 1] if i + 1 < len(seq) else None), rate) if rates else rate
        if rng.random() >= r:
            out.append(c)
            continue
        kind = rng.random() * 5
        if kind < 3:
            out.append(str(rng.choice([x for x in "ACGT" if x != c.upper()])))
        elif kind < 4:
            out.extend((c, str(rng.choice(list("ACGT")))))
    return "".join(out)


def mutate(reads: DataFrame, column: str, rate: float, seed: int, key: str = "read", rates: dict | None = None) -> DataFrame:
    """``reads`` with errors in ``column`` and ``qual``, the quality of the flat rate at each base."""
    @F.pandas_udf("string")
    def run(seq: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([mutate_one(s, rate, np.random.default_rng(int(k) & 0x7FFFFFFFFFFFFFFF), rates) for s, k in zip(seq, salt)], dtype=object)

    out = reads.withColumn(column, run(column, F.xxhash64(F.lit(seed), F.lit("errors"), F.col(key))))
    return out.withColumn("qual", F.repeat(phred_of_rate(F.lit(float(rate))), F.length(column)))


def simulate(tx: DataFrame, n: int, kind: str = "long", rate: float = 0.0, seed: int = 1, weight: str | None = None) -> tuple:
    """(reads, truth): ``n`` reads of transcripts (name, gene_name, seq[, weight]) and what was drawn of each.

    Without ``weight`` long reads are uniform over transcripts, short ones by length.
    """
    from lociframe.operators.stats import expression

    w = F.col(weight).cast("double") if weight else F.lit(1.0) if kind == "long" else F.length("seq").cast("double")
    items = tx.where("length(seq) > 0").select("name", "gene_name", w.alias("weight"), F.length("seq").alias("tx_length"))
    drawn = draw(items, "weight", n, seed)
    reads = fragments(drawn.join(tx.select("name", "seq"), "name"), kind, seed)
    if kind == "short":
        reads = mates(reads)
        for m, s in (("mate1", seed), ("mate2", seed + 1)):
            reads = mutate(reads, m, rate, s).withColumnRenamed("qual", f"{m}_qual")
    else:
        reads = mutate(reads, "fragment", rate, seed)
    counts = items.join(drawn.groupBy("name").agg(F.count("*").alias("count")), "name", "left").na.fill(0, ["count"])
    return reads, expression(counts, "name", "tx_length", "count").select("name", "gene_name", "tpm", "fpkm", "count")


def tile(tx: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of ``size`` bases every ``step`` along transcripts (name, seq); a shorter transcript is one window."""
    last = F.greatest(F.length("seq") - size, F.lit(0))
    return tx.where("length(seq) > 0").withColumn("start", F.explode(F.sequence(F.lit(0), last, F.lit(step)))).select("name", "start", F.substring("seq", F.col("start") + 1, F.lit(size)).alias("seq"))
