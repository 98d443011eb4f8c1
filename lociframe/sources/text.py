"""Text formats as DataFrames: ``parse_x`` works on a column of lines (or records), ``read_x`` on paths.

Coordinates become 1-based and inclusive here. Lines that do not fit a format
are dropped by the readers. Compressed files (gzip) are read like plain ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.functions.sequence import let, once
from lociframe.functions.transcripts import EXONS, exons_of

LINE = "value"

BED12 = "chrom chromStart chromEnd name score strand thickStart thickEnd itemRgb blockCount blockSizes blockStarts".split()
GPD = "gene_name name chrom strand txStart txEnd cdsStart cdsEnd exonCount exonStarts exonEnds".split()
GTF = "seqname source feature start end score strand frame".split()
PSL = ("matches misMatches repMatches nCount qNumInsert qBaseInsert tNumInsert tBaseInsert strand qName qSize qStart qEnd tName tSize tStart tEnd "
       "blockCount blockSizes qStarts tStarts").split()
PSL_TEXT, PSL_LISTS = {"strand", "qName", "tName"}, {"blockSizes", "qStarts", "tStarts"}
SAM = "qname flag rname pos mapq cigar rnext pnext tlen seq qual".split()
SAM_NUMBERS = {"flag", "pos", "mapq", "pnext", "tlen"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def fields(df: DataFrame, sep: str = "\t", limit: int = -1) -> DataFrame:
    """``df`` with a line's fields as ``__f``, which is split once for all that reads it."""
    return df.where(F.col(LINE) != "").withColumn("__f", once(F.split(F.regexp_replace(LINE, r"[\r\n]+$", ""), sep, limit)))


def _at(i: int) -> Column:
    return F.get("__f", F.lit(i))


def _long(c: Column) -> Column:
    return c.try_cast("bigint")


def _longs(c: Column) -> Column:
    """``1,2,3,`` to an array."""
    return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.try_cast("bigint"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines with their number in their file, from 0.

    Lines are numbered within the block of a file that a task reads; block
    counts, one row a block, give where each starts. No line is shuffled.
    """
    raw = (spark.read.text(path).select(LINE, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
           .withColumn("id", F.monotonically_increasing_id()))
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).select("file", "block", "first", "before")
    return raw.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), LINE)


# sequences ------------------------------------------------------------------------------------------

def parse_fasta(records: DataFrame) -> DataFrame:
    """(name, header, seq) of records ``>header\\nsequence lines``; the first ``>`` may be missing."""
    text = F.regexp_replace(LINE, "^>", "")
    header = F.regexp_replace(F.substring_index(text, "\n", 1), "\r$", "")
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.substring(text, F.instr(text, "\n") + 1, F.length(text)), r"\s+", "")).otherwise("")
    return records.where(F.trim(LINE) != "").select(F.regexp_extract(header, r"^(\S+)", 1).alias("name"), header.alias("header"), body.alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, header, seq, line3, qual) of 4-line records; an incomplete last record goes."""
    every = numbered_lines(spark, path).withColumn("record", F.floor(F.col("line") / 4)).withColumn("k", F.col("line") % 4)
    part = lambda k: F.max(F.when(F.col("k") == k, F.regexp_replace(LINE, "\r$", "")))
    return (every.groupBy("file", "record").agg(part(0).alias("h"), part(1).alias("seq"), part(2).alias("line3"), part(3).alias("qual"))
            .where("h LIKE '@%' AND qual IS NOT NULL").withColumn("header", F.expr("substring(h, 2)"))
            .select(F.regexp_extract("header", r"^(\S+)", 1).alias("name"), "header", "seq", "line3", "qual"))


def fai(spark: SparkSession, path: str) -> DataFrame:
    """FASTA index: (name, length, offset, linebases, linewidth); records with lines of uneven length are errors."""
    every = numbered_lines(spark, path).withColumn("bytes", F.octet_length(LINE) + 1)
    # bytes before a line: sums of blocks of lines, then within
    every = every.withColumn("part", F.floor(F.col("line") / 65536))
    sums = every.groupBy("file", "part").agg(F.sum("bytes").alias("own"), F.sum(F.col(LINE).startswith(">").cast("int")).alias("heads"))
    w = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "part", F.coalesce(F.sum("own").over(w), F.lit(0)).alias("b0"), F.coalesce(F.sum("heads").over(w), F.lit(0)).alias("h0"))
    own = Window.partitionBy("file", "part").orderBy("line")
    placed = (every.join(sums, ["file", "part"])
              .withColumn("offset", F.col("b0") + F.coalesce(F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("rec", F.col("h0") + F.sum(F.col(LINE).startswith(">").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))))
    head = F.col(LINE).startswith(">")
    width = F.when(~head, F.length(LINE))
    out = placed.groupBy("file", "rec").agg(
        F.max(F.when(head, F.regexp_extract(LINE, r"^>(\S+)", 1))).alias("name"), F.coalesce(F.sum(width), F.lit(0)).alias("length"),
        F.min(F.when(~head, F.col("offset"))).alias("offset"), F.max(width).alias("linebases"), (F.max(width) + 1).alias("linewidth"),
        F.count(width).alias("__n"), F.max_by(width, "line").alias("__last"))
    even = (F.col("__n") == 0) | (F.col("length") == (F.col("__n") - 1) * F.col("linebases") + F.col("__last"))
    return out.where(F.when(even, True).otherwise(F.raise_error(F.concat(F.lit("uneven lines in "), F.col("name"))).cast("boolean"))).select(
        "name", "length", "offset", "linebases", "linewidth")


# ranges ---------------------------------------------------------------------------------------------

def parse_bed(df: DataFrame) -> DataFrame:
    """(chr, start, end, extra): start from 0-based; what follows the third field is ``extra``."""
    return (fields(df, "\t", 4).where(~F.col(LINE).rlike("^(track|browser|#)"))
            .select(_at(0).alias("chr"), (_long(_at(1)) + 1).alias("start"), _long(_at(2)).alias("end"), _at(3).alias("extra")).where("end IS NOT NULL AND start IS NOT NULL"))


def parse_depth(df: DataFrame) -> DataFrame:
    """(chr, start, end, depth) of BED rows with a depth."""
    return parse_bed(df).select("chr", "start", "end", F.substring_index("extra", "\t", 1).try_cast("double").alias("depth")).where("depth IS NOT NULL")


def parse_bed12(df: DataFrame) -> DataFrame:
    """BED12 columns as in the file (0-based starts), lists as arrays, and ``exons`` (1-based)."""
    f = fields(df).where((F.size("__f") >= 12) & ~F.col(LINE).rlike("^(track|browser|#)"))
    numbers = {"chromStart", "chromEnd", "score", "thickStart", "thickEnd", "blockCount"}
    cols = [(_longs(_at(i)) if n in ("blockSizes", "blockStarts", "itemRgb") else _long(_at(i)) if n in numbers else _at(i)).alias(n) for i, n in enumerate(BED12)]
    exons = F.zip_with("blockStarts", "blockSizes", lambda s, n: F.struct((F.col("chromStart") + s + 1).alias("start"), (F.col("chromStart") + s + n).alias("end")))
    return f.select(*cols).withColumn("exons", exons.cast(EXONS))


def parse_gpd(df: DataFrame) -> DataFrame:
    """GPD columns as in the file, lists as arrays, and chr, start, end, ``exons`` (1-based); ``line`` stays where there is one."""
    f = fields(df).where((F.size("__f") >= 11) & ~F.col(LINE).startswith("#"))
    numbers = {"txStart", "txEnd", "cdsStart", "cdsEnd", "exonCount"}
    cols = [(_longs(_at(i)) if n in ("exonStarts", "exonEnds") else _long(_at(i)) if n in numbers else _at(i)).alias(n) for i, n in enumerate(GPD)]
    cols += ["line"] if "line" in df.columns else []
    return f.select(*cols).withColumns({"chr": F.col("chrom"), "start": F.col("txStart") + 1, "end": F.col("txEnd"), "exons": exons_of("exonStarts", "exonEnds")})


def last_of_each(pairs: Column) -> Column:
    """Map of (k, v) pairs; of a repeated key the last value stays, null keys go."""
    last = lambda all: F.filter(all, lambda p, i: p["k"].isNotNull() & ~F.exists(F.slice(all, i + 2, F.size(all)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(let(pairs, last))


def attributes(text: Column | str) -> Column:
    """Map of ``key "value";`` pairs; of a repeated key the last value stays."""
    c = F.col(text) if isinstance(text, str) else text
    part = lambda i: F.regexp_extract_all(c, F.lit(r'\s*([^\s;"]+)\s+"?([^";]*)"?\s*(?:;|$)'), F.lit(i))
    return last_of_each(F.zip_with(part(1), part(2), lambda k, v: F.struct(k.alias("k"), v.alias("v"))))


def parse_gtf(df: DataFrame) -> DataFrame:
    """GTF columns (``.`` is null), ``attribute`` as a map."""
    f = fields(df).where((F.size("__f") >= 9) & ~F.col(LINE).startswith("#"))
    own = lambda i: F.nullif(_at(i), F.lit("."))
    cols = [(_long(own(i)) if n in ("start", "end") else own(i)).alias(n) for i, n in enumerate(GTF)]
    return f.select(*cols, once(attributes(_at(8))).alias("attribute"))


def gtf_transcripts(gtf: DataFrame, gene: str = "gene_id", transcript: str = "transcript_id") -> DataFrame:
    """Transcripts (gene_name, name, chr, strand, start, end, exons) of a GTF's exon rows; of exons with one start the last end stays."""
    rows = (gtf.where("feature = 'exon'").select(F.col("attribute")[gene].alias("gene_name"), F.col("attribute")[transcript].alias("name"),
                                                  F.col("seqname").alias("chr"), "strand", "start", "end").where("gene_name IS NOT NULL AND name IS NOT NULL"))
    one = rows.groupBy("gene_name", "name", "chr", "strand", "start").agg(F.max("end").alias("end"))
    return (one.groupBy("gene_name", "name", "chr", "strand").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"))
            .select("gene_name", "name", "chr", "strand", F.element_at("exons", 1)["start"].alias("start"), F.element_at("exons", -1)["end"].alias("end"), "exons"))


def parse_gff3(df: DataFrame) -> DataFrame:
    """GTF columns with the attributes ``key=value;`` of GFF3."""
    f = fields(df).where((F.size("__f") >= 9) & ~F.col(LINE).startswith("#"))
    own = lambda i: F.nullif(_at(i), F.lit("."))
    cols = [(_long(own(i)) if n in ("start", "end") else own(i)).alias(n) for i, n in enumerate(GTF)]
    pairs = F.transform(F.filter(F.split(_at(8), ";"), lambda x: F.instr(x, "=") > 0),
                        lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    return f.select(*cols, once(last_of_each(pairs)).alias("attribute"))


def gff3_transcripts(gff: DataFrame) -> DataFrame:
    """Transcripts of gene / mRNA / exon rows linked by ID and Parent."""
    a = lambda k: F.col("attribute")[k]
    genes = gff.where("feature = 'gene'").select(a("ID").alias("gene"), F.coalesce(a("Name"), a("ID")).alias("gene_name"))
    mrna = gff.where("feature = 'mRNA'").select(a("ID").alias("tx"), a("Parent").alias("gene"), F.coalesce(a("Name"), a("ID")).alias("name"))
    exon = gff.where("feature = 'exon'").select(F.explode(F.split(a("Parent"), ",")).alias("tx"), F.col("seqname").alias("chr"), "strand", "start", "end")
    return (exon.groupBy("tx", "chr", "strand").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("exons")).join(mrna, "tx")
            .join(genes, "gene", "left").select(F.coalesce("gene_name", "gene").alias("gene_name"), "name", "chr", "strand",
                                                F.element_at("exons", 1)["start"].alias("start"), F.element_at("exons", -1)["end"].alias("end"), "exons"))


# alignments -----------------------------------------------------------------------------------------

def parse_psl(df: DataFrame) -> DataFrame:
    """21 PSL columns as in the file, lists as arrays; rows with another number of fields go."""
    f = fields(df).where((F.size("__f") == 21) & _long(_at(0)).isNotNull())
    return f.select(*[(_at(i) if n in PSL_TEXT else _longs(_at(i)) if n in PSL_LISTS else _long(_at(i))).alias(n) for i, n in enumerate(PSL)])


def psl_blocks(psl: DataFrame) -> DataFrame:
    """``psl`` with aligned ``blocks`` (1-based)."""
    block = F.transform("blockSizes", lambda n, i: F.struct((F.get("tStarts", i) + 1).alias("t_start"), (F.get("tStarts", i) + n).alias("t_end"),
                                                            (F.get("qStarts", i) + 1).alias("q_start"), (F.get("qStarts", i) + n).alias("q_end")))
    return psl.withColumn("blocks", block)


def valid_psl(psl: DataFrame) -> DataFrame:
    """Rows whose lists have ``blockCount`` entries and whose ends agree with their blocks."""
    same = lambda c: F.size(c) == F.col("blockCount")
    last = lambda c: F.get(c, F.col("blockCount").cast("int") - 1) + F.get("blockSizes", F.col("blockCount").cast("int") - 1)
    return psl.where(same("blockSizes") & same("qStarts") & same("tStarts") & (F.get("tStarts", F.lit(0)) == F.col("tStart")) & (last("tStarts") == F.col("tEnd")))


def is_header(line: Column | str = LINE) -> Column:
    """Header lines of SAM: ``@`` and at most 9 fields."""
    c = F.col(line) if isinstance(line, str) else line
    return c.startswith("@") & (F.size(F.split(c, "\t")) <= 9)


def parse_sam_header(df: DataFrame) -> DataFrame:
    """(tag, info map) of header lines."""
    f = fields(df.where(is_header()))
    pairs = F.transform(F.filter(F.slice("__f", 2, F.size("__f")), lambda x: F.instr(x, ":") == 3),
                        lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.regexp_replace(x, "^..:", "").alias("v")))
    return f.select(F.expr("substring(__f[0], 2)").alias("tag"), last_of_each(pairs).alias("info"))


def sequence_lengths(header: DataFrame) -> DataFrame:
    return header.where("tag = 'SQ'").select(F.col("info")["SN"].alias("name"), F.col("info")["LN"].try_cast("bigint").alias("length"))


def parse_sam(df: DataFrame) -> DataFrame:
    """11 SAM columns (``*``, and 0 where it means nothing, are null) and ``tags`` as a map of (type, value)."""
    f = fields(df.where(~is_header())).where(F.size("__f") >= 11)
    cols = []
    for i, n in enumerate(SAM):
        c = _long(_at(i)) if n in SAM_NUMBERS else F.nullif(_at(i), F.lit("*"))
        if n in ("pos", "pnext", "tlen"):
            c = F.nullif(c, F.lit(0))
        if n == "mapq":
            c = F.nullif(c, F.lit(255))
        cols.append(c.alias(n))
    tags = F.transform(F.filter(F.slice("__f", 12, F.size("__f")), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")),
                       lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.struct(F.substring(x, 4, 1).alias("type"), F.regexp_replace(x, "^..:.:", "").alias("value")).alias("v")))
    return f.select(*cols, last_of_each(tags).alias("tags"))


def parse_vcf(df: DataFrame) -> DataFrame:
    """(chrom, pos, id, ref, alt, qual, filter, info map, format, samples array)."""
    f = fields(df).where((F.size("__f") >= 8) & ~F.col(LINE).startswith("#"))
    info = last_of_each(F.transform(F.split(_at(7), ";"), lambda x: F.struct(
        F.substring_index(x, "=", 1).alias("k"), F.when(F.instr(x, "=") > 0, F.regexp_replace(x, "^[^=]*=", "")).alias("v"))))
    own = lambda i: F.nullif(_at(i), F.lit("."))
    return f.select(_at(0).alias("chrom"), _long(_at(1)).alias("pos"), own(2).alias("id"), _at(3).alias("ref"), _at(4).alias("alt"), own(5).try_cast("double").alias("qual"),
                    own(6).alias("filter"), info.alias("info"), _at(8).alias("format"), F.slice("__f", 10, F.size("__f")).alias("samples"))


def parse_tsv(df: DataFrame, names: list) -> DataFrame:
    """Rows of exactly ``names`` fields, as text."""
    return fields(df).where(F.size("__f") == len(names)).select(*[_at(i).alias(n) for i, n in enumerate(names)])


def parse_junction_bed(df: DataFrame) -> DataFrame:
    """BED12 junction rows with their support: (chr, left, right, strand, reads, width, positions, unique_reads, multi_reads)."""
    bed = parse_bed12(df)
    part = lambda i: F.regexp_extract("name", r"^\((\d+)\)\[(\d+)_(\d+)\]\((\d+)/(\d+)\)", i).try_cast("bigint")
    return bed.select(F.col("chrom").alias("chr"), F.element_at("exons", 1)["end"].alias("left"), F.element_at("exons", 2)["start"].alias("right"), "strand",
                      part(1).alias("reads"), part(2).alias("width"), part(3).alias("positions"), part(4).alias("unique_reads"), part(5).alias("multi_reads"))


_PARSERS = {"bed": parse_bed, "depth": parse_depth, "bed12": parse_bed12, "gpd": parse_gpd, "gtf": parse_gtf, "gff3": parse_gff3, "psl": parse_psl, "sam": parse_sam,
            "sam_header": parse_sam_header, "vcf": parse_vcf, "junction_bed": parse_junction_bed}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Any text format by name: fasta, fastq or one of the line formats."""
    if kind in ("fasta", "fastq"):
        return {"fasta": read_fasta, "fastq": read_fastq}[kind](spark, path)
    return _PARSERS[kind](lines(spark, path))
