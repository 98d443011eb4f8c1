"""Lines of the text formats (a ``value`` column for ``write.text``) from DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions.sequence import blocks_cigar
from lociframe.sources.text import BED12, PSL, SAM, SAM_NUMBERS


def _tabs(*cols: Column) -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def _list(c: Column | str) -> Column:
    """``1,2,3,``"""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))


def fasta(df: DataFrame, width: int | None = None) -> DataFrame:
    """``>header`` and the sequence, in lines of ``width`` where given."""
    seq = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    return df.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), seq).alias("value"))


def fastq(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("@"), F.col("header"), F.lit("\n"), F.col("seq"), F.lit("\n"), F.coalesce("line3", F.lit("+")), F.lit("\n"), F.col("qual")).alias("value"))


def bed(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(_tabs(F.col("chr"), F.col("start") - 1, F.col("end"), *map(F.col, extra)).alias("value"))


def bed12(df: DataFrame) -> DataFrame:
    lists = {"itemRgb", "blockSizes", "blockStarts"}
    return df.select(_tabs(*[_list(c) if c in lists else F.col(c) for c in BED12]).alias("value"))


def gpd(tx: DataFrame) -> DataFrame:
    """GPD lines of transcripts (gene_name, name, chr, strand, exons); a missing name is a hash of the layout, a missing gene the name."""
    name = F.coalesce("name", F.sha2(F.concat_ws("|", "chr", "strand", F.to_json("exons")), 256))
    start, end = F.element_at("exons", 1)["start"] - 1, F.element_at("exons", -1)["end"]
    return tx.select(_tabs(F.coalesce("gene_name", name), name, F.col("chr"), F.col("strand"), start, end, start, end, F.size("exons"),
                           _list(F.transform("exons", lambda x: x["start"] - 1)), _list(F.transform("exons", lambda x: x["end"]))).alias("value"))


def fake_psl(tx: DataFrame, target_size: Column | None = None) -> DataFrame:
    """A transcript as a perfect alignment of itself: PSL columns."""
    from lociframe.functions.transcripts import length

    size = length("exons")
    sizes = F.transform("exons", lambda x: x["end"] - x["start"] + 1)
    starts = F.transform(sizes, lambda x, i: F.aggregate(F.slice(sizes, 1, i), F.lit(0).cast("bigint"), lambda a, y: a + y))
    zero = F.lit(0).cast("bigint")
    end = F.element_at("exons", -1)["end"]
    values = dict(matches=size, strand=F.col("strand"), qName=F.col("name"), qSize=size, qStart=zero, qEnd=size, tName=F.col("chr"),
                  tSize=end if target_size is None else target_size, tStart=F.element_at("exons", 1)["start"] - 1, tEnd=end,
                  blockCount=F.size("exons").cast("bigint"), blockSizes=sizes, qStarts=starts, tStarts=F.transform("exons", lambda x: x["start"] - 1))
    return tx.select(*[values.get(c, zero).alias(c) for c in PSL])


def psl(df: DataFrame) -> DataFrame:
    return df.select(_tabs(*[_list(c) if c in ("blockSizes", "qStarts", "tStarts") else F.col(c) for c in PSL]).alias("value"))


def sam(df: DataFrame) -> DataFrame:
    """SAM lines; nulls become ``*``, 0, or 255 for mapq. ``tags`` in order of their names."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("255" if c == "mapq" else "0" if c in SAM_NUMBERS else "*")) for c in SAM]
    tags = (F.transform(F.array_sort(F.map_keys("tags")), lambda k: F.concat_ws(":", k, F.col("tags")[k]["type"], F.col("tags")[k]["value"]))
            if "tags" in df.columns else F.array().cast("array<string>"))
    return df.select(F.concat_ws("\t", *cols, tags).alias("value"))


def psl_to_sam(df: DataFrame) -> DataFrame:
    """SAM columns of PSL rows with ``blocks``; seq and qual stay missing."""
    none = F.lit(None).cast("string")
    return df.select(F.col("qName").alias("qname"), F.when(F.col("strand") == "-", 16).otherwise(0).cast("bigint").alias("flag"), F.col("tName").alias("rname"),
                     (F.col("tStart") + 1).alias("pos"), F.lit(None).cast("bigint").alias("mapq"), blocks_cigar("blocks", "qSize").alias("cigar"), none.alias("rnext"),
                     F.lit(None).cast("bigint").alias("pnext"), F.lit(None).cast("bigint").alias("tlen"), none.alias("seq"), none.alias("qual"))


def gtf_exons(tx: DataFrame, source: str = "lociframe") -> DataFrame:
    """Exon lines with gene_id, transcript_id and exon_number in order of coordinates."""
    rows = tx.select("gene_name", "name", "chr", "strand", F.posexplode("exons").alias("i", "e"))
    note = F.format_string('gene_id "%s"; transcript_id "%s"; exon_number "%s";', "gene_name", "name", (F.col("i") + 1).cast("string"))
    dot = F.lit(".")
    return rows.select(F.concat_ws("\t", "chr", F.lit(source), F.lit("exon"), F.col("e.start").cast("string"), F.col("e.end").cast("string"), dot, "strand", dot, note).alias("value"))


def gpd_bed12(tx: DataFrame, color: str = "0,0,0", name: str = "name") -> DataFrame:
    """BED12 columns of transcripts, with a fixed score of 1000."""
    start, end = F.element_at("exons", 1)["start"] - 1, F.element_at("exons", -1)["end"]
    values = dict(chrom=F.col("chr"), chromStart=start, chromEnd=end, name=F.col(name), score=F.lit(1000).cast("bigint"), strand=F.col("strand"), thickStart=start, thickEnd=end,
                  itemRgb=F.transform(F.split(F.lit(color), ","), lambda x: x.cast("bigint")), blockCount=F.size("exons").cast("bigint"),
                  blockSizes=F.transform("exons", lambda x: x["end"] - x["start"] + 1), blockStarts=F.transform("exons", lambda x: x["start"] - 1 - start))
    return tx.select(*[values[c].alias(c) for c in BED12])


def fasta_to_tsv(df: DataFrame) -> DataFrame:
    return df.select(_tabs(F.col("header"), F.col("seq")).alias("value"))


def fastq_to_tsv(df: DataFrame) -> DataFrame:
    return df.select(_tabs(F.col("header"), F.col("seq"), F.col("line3"), F.col("qual")).alias("value"))


def fake_fastq(df: DataFrame, quality: str = "I") -> DataFrame:
    """Reads of one constant quality from sequences."""
    return df.select("name", "header", "seq", F.lit("+").alias("line3"), F.repeat(F.lit(quality), F.length("seq")).alias("qual"))


def unmapped_sam(reads: DataFrame) -> DataFrame:
    """Reads as unaligned SAM rows (flag 4)."""
    text, number = (lambda n: F.lit(None).cast("string").alias(n)), (lambda n: F.lit(None).cast("bigint").alias(n))
    return reads.select(F.col("name").alias("qname"), F.lit(4).cast("bigint").alias("flag"), text("rname"), number("pos"), number("mapq"), text("cigar"), text("rnext"),
                        number("pnext"), number("tlen"), "seq", "qual")


def write_lines(df: DataFrame, path: str, compress: bool = False) -> None:
    """Write ``value`` lines; one header or track line belongs in a file of its own."""
    (df.select("value").write.option("compression", "gzip") if compress else df.select("value").write).text(path)
