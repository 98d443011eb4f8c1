"""Reference sequences in chunks, and sequences fetched by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.sequence import motif_strand, rc

CHUNK = 1_000_000


def chunked(sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chr, chunk, seq): sequences in pieces of ``size`` bases, so no join carries a whole chromosome."""
    return (sequences.where("length(seq) > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("seq") - 1) / F.lit(size)))))
            .select(F.col("name").alias("chr"), "chunk", F.substring("seq", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("seq")))


def fetch(ranges: DataFrame, chunks: DataFrame, keys: list, size: int = CHUNK) -> DataFrame:
    """(keys, seq): the bases of ranges (chr, start, end), upper case; several ranges of one key are joined in order of their start."""
    rows = ranges.select(*keys, "chr", "start", "end", F.explode(F.sequence(F.floor((F.col("start") - 1) / F.lit(size)), F.floor((F.col("end") - 1) / F.lit(size)))).alias("chunk"))
    lo = F.greatest(F.col("start") - 1 - F.col("chunk") * size, F.lit(0))
    hi = F.least(F.col("end") - F.col("chunk") * size, F.lit(size))
    parts = rows.join(chunks, ["chr", "chunk"]).select(*keys, "start", "chunk", F.substring("seq", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("s"))
    return parts.groupBy(*keys).agg(F.upper(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "chunk", "s"))), lambda x: x["s"]), "")).alias("seq"))


def spliced(tx: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(name, seq): the exons' bases along the strand."""
    exons = tx.select("name", "strand", "chr", F.explode("exons").alias("e")).select("name", "strand", "chr", F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    return fetch(exons, chunks, ["name", "strand"], size).select("name", F.when(F.col("strand") == "-", rc("seq")).otherwise(F.col("seq")).alias("seq"))


def junction_strands(junctions: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """``junctions`` (chr, left, right, ...) with ``strand`` by splice motif; others go."""
    own = junctions.select("chr", "left", "right").distinct()
    two = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    rows = own.select("chr", "left", "right", F.explode(F.array(two(F.col("left") + 1, F.col("left") + 2), two(F.col("right") - 2, F.col("right") - 1))).alias("e"))
    got = fetch(rows.select("chr", "left", "right", F.col("chr").alias("c"), "e.start", "e.end").select(F.col("c").alias("chr0"), "left", "right", "chr", "start", "end"),
                chunks, ["chr0", "left", "right"], size)
    strand = motif_strand(F.concat(F.substring("seq", 1, 2), F.lit("-"), F.substring("seq", 3, 2)))
    known = got.select(F.col("chr0").alias("chr"), "left", "right", strand.alias("strand")).where("strand IS NOT NULL")
    return junctions.join(known, ["chr", "left", "right"])


def overlay(sequences: DataFrame, variants: DataFrame, size: int = CHUNK) -> DataFrame:
    """Two haplotypes (chr, haplotype, seq) of phased single-base variants (chrom, pos, ref, alt, genotype ``0|1``)."""
    parts = chunked(sequences, size).withColumn("haplotype", F.explode(F.array(F.lit(1), F.lit(2))))
    allele = F.split("genotype", r"\|")
    v = (variants.where("length(ref) = 1 AND length(alt) = 1").select(
            F.col("chrom").alias("chr"), F.floor((F.col("pos") - 1) / F.lit(size)).alias("chunk"), F.posexplode(allele).alias("h", "a"),
            F.pmod(F.col("pos") - 1, F.lit(size)).cast("int").alias("at"), "alt").where("a = '1'")
         .groupBy("chr", "chunk", (F.col("h") + 1).alias("haplotype")).agg(F.array_sort(F.collect_list(F.struct("at", "alt"))).alias("v")))
    put = F.aggregate(F.coalesce("v", F.array().cast("array<struct<at:int,alt:string>>")), F.col("seq"), lambda s, x: F.overlay(s, x["alt"], x["at"] + 1, F.lit(1)))
    return (parts.join(v, ["chr", "chunk", "haplotype"], "left").select("chr", "haplotype", "chunk", put.alias("seq"))
            .groupBy("chr", "haplotype").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("seq")))
