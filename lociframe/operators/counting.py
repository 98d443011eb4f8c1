"""Counts, filters and tables over reads, variants, transcripts and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.functions import sequence as S
from lociframe.functions import transcripts as T
from lociframe.operators import genome, intervals, overlap

# Flag bits of mates, colours of tracks.
PROPER, FIRST, SECOND = 2, 64, 128
COLOURS = {"blue": "67,162,202", "green": "49,163,84", "orange": "254,178,76", "purple": "136,86,167", "red": "240,59,32", "black": "0,0,0"}


# reads ----------------------------------------------------------------------------------------------

def aligned(sam: DataFrame) -> DataFrame:
    return sam.where(~S.has_flag("flag", S.UNALIGNED) & F.col("cigar").isNotNull())


def mate(flag: Column | str = "flag") -> Column:
    """1 or 2 by the mate bits, 0 without either."""
    return F.when(S.has_flag(flag, FIRST), 1).when(S.has_flag(flag, SECOND), 2).otherwise(0)


def distinct_reads(sam: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, reads): read names, each counted once."""
    agg = F.count_distinct("qname").alias("reads")
    return sam.groupBy(*by).agg(agg) if by else sam.agg(agg)


def mapped_mates(sam: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, mates): aligned reads, the two mates of a name counted apart."""
    agg = F.count_distinct("qname", mate()).alias("mates")
    rows = sam.where(~S.has_flag("flag", S.UNALIGNED))
    return rows.groupBy(*by).agg(agg) if by else rows.agg(agg)


def hits(sam: DataFrame) -> Column:
    """Reported number of alignments of a row (tag NH), null where there is none."""
    return F.col("tags")["NH"]["value"].try_cast("bigint")


def mapping_counts(sam: DataFrame) -> DataFrame:
    """(qname, mappings): the larger of a read's aligned rows and its tag NH; 0 for reads without an aligned row."""
    rows = sam.withColumn("__on", (~S.has_flag("flag", S.UNALIGNED) & F.col("cigar").isNotNull()).cast("int")).withColumn("__nh", hits(sam))
    return rows.groupBy("qname").agg(F.sum("__on").alias("n"), F.max(F.when(F.col("__on") == 1, F.col("__nh"))).alias("nh")).select(
        "qname", F.when(F.col("n") == 0, 0).otherwise(F.greatest("n", F.coalesce("nh", F.lit(0)))).alias("mappings"))


def uniquely_mapped(sam: DataFrame) -> DataFrame:
    """Aligned rows whose tag NH is 1."""
    return aligned(sam).where(hits(sam) == 1)


def best_coverage(sam: DataFrame) -> DataFrame:
    """(qname, bases): the most bases that one alignment of a read has aligned."""
    return sam.groupBy("qname").agg(F.coalesce(F.max(S.aligned_bases("cigar")), F.lit(0)).alias("bases"))


def insert_sizes(sam: DataFrame) -> DataFrame:
    """(qname, size) of proper pairs of primary alignments: from the start of one mate to the end of the other, the larger way."""
    rows = aligned(sam).where(~S.has_flag("flag", S.SECONDARY) & ~S.has_flag("flag", S.SUPPLEMENTARY) & S.has_flag("flag", PROPER))
    rows = rows.select("qname", "rname", mate().alias("mate"), F.col("pos").alias("start"), (F.col("pos") + S.target_span("cigar") - 1).alias("end"))
    pair = rows.where("mate > 0").groupBy("qname", "rname").agg(
        *(f(F.when(F.col("mate") == m, F.col(c))).alias(f"{c}{m}") for m in (1, 2) for f, c in ((F.min, "start"), (F.max, "end"))))
    size = F.greatest(F.col("end2") - F.col("start1") + 1, F.col("end1") - F.col("start2") + 1)
    return pair.where("start1 IS NOT NULL AND start2 IS NOT NULL").select("qname", size.alias("size"))


def junction_reads(sam: DataFrame, least: int = 2, min_intron: int = S.MIN_INTRON, overhang: int = 1) -> DataFrame:
    """Rows with an intron of enough overhang that have a junction which ``least`` rows or more have."""
    rows = aligned(sam).where(F.instr("cigar", "N") > 0)
    own = (rows.withColumns({"__s": S.spliced("cigar", overhang, min_intron), "__e": S.cigar_exons("pos", "cigar", min_intron)}).where("__s")
           .withColumn("__j", T.junctions(F.col("__e"))).drop("__s", "__e"))
    places = own.select("rname", F.explode("__j").alias("j")).groupBy("rname", "j").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # a read is joined by each of its junctions, with all its columns, and comes back once
    each = own.withColumn("__row", F.monotonically_increasing_id()).select(*sam.columns, "__row", F.explode("__j").alias("j"))
    return each.join(places, ["rname", "j"]).dropDuplicates(["__row"]).select(*sam.columns)


def quality_grid(reads: DataFrame, lefts: list, rights: list, floors: list, limits: list, least_size: int = 1, offset: int = 33) -> DataFrame:
    """(l_cut, r_cut, q_floor, failure_limit, reads, bases): what trimming and filtering would leave, for each combination.

    A base fails when it is N or its quality is under the floor; a read stays
    with ``failure_limit`` failures or fewer and ``least_size`` bases or more.
    """
    cuts = F.array(*[F.struct(F.lit(a).alias("l_cut"), F.lit(b).alias("r_cut"), F.lit(q).alias("q_floor")) for a in lefts for b in rights for q in floors])
    n = F.length("seq") - F.col("l_cut") - F.col("r_cut")
    part = lambda c: F.substring(F.col(c), F.col("l_cut") + 1, F.greatest(n, F.lit(0)))
    rows = reads.select("seq", "qual", F.explode(cuts).alias("c")).select("seq", "qual", "c.*")
    rows = rows.where(n >= least_size).select("l_cut", "r_cut", "q_floor", n.alias("n"), F.upper(part("seq")).alias("s"), part("qual").alias("q"))
    bad = F.size(F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (F.substring(F.col("s"), i, F.lit(1)) == "N")
                          | (F.ascii(F.substring(F.col("q"), i, F.lit(1))) - offset < F.col("q_floor"))))
    per = rows.where("n > 0").select("l_cut", "r_cut", "q_floor", "n", bad.alias("bad")).groupBy("l_cut", "r_cut", "q_floor", "bad").agg(F.count("*").alias("k"), F.sum("n").alias("b"))
    at = F.explode(F.array(*map(F.lit, limits)))
    return (per.withColumn("failure_limit", at).where("bad <= failure_limit").groupBy("l_cut", "r_cut", "q_floor", "failure_limit")
            .agg(F.sum("k").alias("reads"), F.sum("b").alias("bases")))


def ccs_and_longest(ccs: DataFrame, subreads: DataFrame) -> DataFrame:
    """All consensus reads, and of each other molecule its longest subread, the first by name of equally long ones."""
    own = ccs.select("name", "seq", S.molecule("name").alias("molecule"))
    rest = subreads.select("name", "seq", S.molecule("name").alias("molecule")).join(own.select("molecule").distinct(), "molecule", "left_anti")
    top = rest.groupBy("molecule").agg(F.min_by(F.struct("name", "seq"), F.struct(-F.length("seq"), "name")).alias("r")).select("r.name", "r.seq", "molecule")
    return own.unionByName(top).drop("molecule")


def swap_corrected(corrected: DataFrame, full: DataFrame, share: float) -> DataFrame:
    """(name, seq, swapped): corrected sequences, replaced by the full one of their name (up to ``|``) where it is no shorter and
    ``share`` of its length is no more than the corrected length."""
    key = lambda c: F.substring_index(F.col(c), "|", 1)
    one = full.groupBy(key("name").alias("k")).agg(F.max(F.struct(F.length("seq").alias("n"), "seq")).alias("f"))
    both = corrected.withColumn("k", key("name")).join(one, "k", "left")
    n = F.length("seq")
    swap = F.coalesce((F.col("f.n") >= n) & (F.col("f.n") * share <= n), F.lit(False))
    return both.select(F.when(swap, F.col("k")).otherwise(F.col("name")).alias("name"), F.when(swap, F.col("f.seq")).otherwise(F.col("seq")).alias("seq"), swap.alias("swapped"))


# variants -------------------------------------------------------------------------------------------

def filter_variants(vcf: DataFrame, quality: float | None = None, total_depth: int | None = None, depth: int | None = None,
                    strand_depth: int | None = None, biallelic: bool = False) -> DataFrame:
    """Variants by quality, total depth (DP), depth of the rarer allele and least depth on a strand (DP4), and heterozygous single bases."""
    parts = F.transform(F.split(F.col("info")["DP4"], ","), lambda x: x.try_cast("bigint"))
    at = lambda i: F.get(parts, F.lit(i))
    out = vcf
    if quality is not None:
        out = out.where(F.col("qual") >= quality)
    if total_depth is not None:
        out = out.where(F.col("info")["DP"].try_cast("bigint") >= total_depth)
    if depth is not None:
        out = out.where(F.least(at(0) + at(1), at(2) + at(3)) >= depth)
    if strand_depth is not None:
        out = out.where(F.array_min(parts) >= strand_depth)
    if biallelic:
        one, two = (F.regexp_extract(F.get("samples", F.lit(0)), r"^(\d+)[|/](\d+):", i).try_cast("bigint") for i in (1, 2))
        out = out.where((F.length("ref") == 1) & (F.length("alt") == 1) & (one != two))
    return out


# transcripts ----------------------------------------------------------------------------------------

def transcript_lengths(tx: DataFrame) -> DataFrame:
    """(gene_name, name, length) with exon lengths summed."""
    return tx.select("gene_name", "name", T.length("exons").alias("length"))


def gene_lengths(tx: DataFrame) -> DataFrame:
    """(gene_name, lengths): the distinct lengths of a gene's transcripts, ascending."""
    return transcript_lengths(tx).groupBy("gene_name").agg(F.sort_array(F.collect_set("length")).alias("lengths"))


def mutual_coverage(tx: DataFrame) -> DataFrame:
    """(name, exon_count, length, coverage): mean depth of all transcripts' exons over each transcript's bases."""
    exons = tx.select("name", "chr", F.size("exons").alias("exon_count"), T.length("exons").alias("length"), F.explode("exons").alias("e")).select(
        "name", "chr", "exon_count", "length", F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    depth = intervals.coverage(exons.select("chr", "start", "end"))
    hit = overlap.pieces(exons, depth)
    return (hit.groupBy(F.col("a_name").alias("name"), F.col("a_exon_count").alias("exon_count"), F.col("a_length").alias("length"))
            .agg(F.sum(F.col("size") * F.col("b_depth")).alias("__s")).select("name", "exon_count", "length", (F.col("__s") / F.col("length")).alias("coverage")))


def target_exons(psl: DataFrame, smooth: int = 0) -> DataFrame:
    """(chr, start, end, name): exons of alignments on the target, gaps under ``smooth`` closed."""
    exons = F.transform("blocks", lambda b: F.struct(b["t_start"].alias("start"), b["t_end"].alias("end")))
    rows = psl.select(F.col("tName").alias("chr"), F.col("qName").alias("name"), S.once(T.smooth(exons, smooth) if smooth else exons).alias("exons"))
    return rows.select("chr", "name", F.explode("exons").alias("e")).select("chr", F.col("e.start").alias("start"), F.col("e.end").alias("end"), "name")


def longest_exon(psl: DataFrame, smooth: int = 10) -> DataFrame:
    """(tName, start, end, qName, qSize, tSize, length): the longest exon on the target of each alignment, the first of equal ones, start from 0."""
    exons = F.transform("blocks", lambda b: F.struct(b["t_start"].alias("start"), b["t_end"].alias("end")))
    rows = psl.select("tName", "qName", "qSize", "tSize", S.once(T.smooth(exons, smooth)).alias("exons"))
    top = F.array_max(F.transform("exons", lambda e: F.struct((e["end"] - e["start"] + 1).alias("n"), (-e["start"]).alias("s"), e["end"].alias("e"))))
    return rows.withColumn("t", top).select("tName", (-F.col("t.s") - 1).alias("start"), F.col("t.e").alias("end"), "qName", "qSize", "tSize", F.col("t.n").alias("length"))


def gc_depth(tx: DataFrame, depths: DataFrame, chunks: DataFrame, bins: int = 10, least_known: int = 1, size: int = genome.CHUNK) -> DataFrame:
    """(bin, depth, bases): bases of each depth in the exons of transcripts of each GC bin; ``least_known`` bases must not be N."""
    seqs = genome.spliced(tx, chunks, size)
    named = seqs.where(F.length(F.regexp_replace(F.upper("seq"), "N", "")) >= least_known).select("name", S.gc_bin("seq", bins).alias("bin"))
    exons = tx.select("name", "chr", F.explode("exons").alias("e")).select("name", "chr", F.col("e.start").alias("start"), F.col("e.end").alias("end")).join(named, "name")
    return (overlap.pieces(exons.select("bin", "chr", "start", "end"), depths).groupBy(F.col("a_bin").alias("bin"), F.col("b_depth").alias("depth"))
            .agg(F.sum("size").alias("bases")))


# samples --------------------------------------------------------------------------------------------

def merged_layouts(tx: DataFrame, made: str = r"^[^:]+:\d+-\d+") -> DataFrame:
    """Transcripts of several samples (sample, name, gene_name, chr, start, end, exons, expression) in one row each layout of junctions.

    (chr, junctions, name, gene_name, start, end, samples: map of sample to
    expression). The name is the least that is not ``made`` from a place, or else
    chr:start-end; a name that several layouts would share is numbered ``.1``, ``.2``, ... from the second on.
    """
    own = lambda c: F.min(F.when(~F.col(c).rlike(made), F.col(c)))
    rows = tx.withColumn("junctions", F.array_join(F.transform(T.junctions(F.col("exons")), lambda j: F.concat(j["left"].cast("string"), F.lit("-"), j["right"].cast("string"))), ";"))
    per = rows.groupBy("chr", "junctions", "sample").agg(F.sum("expression").alias("x"), own("name").alias("n"), own("gene_name").alias("g"), F.min("start").alias("s"), F.max("end").alias("e"))
    one = per.groupBy("chr", "junctions").agg(F.min("n").alias("n"), F.min("g").alias("g"), F.min("s").alias("start"), F.max("e").alias("end"),
                                              F.map_from_entries(F.sort_array(F.collect_list(F.struct("sample", "x")))).alias("samples"))
    place = F.concat("chr", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    named = one.withColumn("base", F.coalesce("n", place))
    k = F.row_number().over(Window.partitionBy("base").orderBy("chr", "junctions")) - 1
    return named.withColumn("k", k).select("chr", "junctions", F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat("base", F.lit("."), F.col("k").cast("string"))).alias("name"),
                                           F.coalesce("g", "base").alias("gene_name"), "start", "end", "samples")


def sample_table(merged: DataFrame, by: str, samples: list) -> DataFrame:
    """(by, a column each sample): expression summed over the rows of ``by``, 0 where a sample has none."""
    return merged.groupBy(by).agg(*[F.sum(F.coalesce(F.col("samples")[F.lit(s)], F.lit(0.0))).alias(s) for s in samples])


def expressed_genes(genes: DataFrame, isoforms: DataFrame, least: float = 0.0, shortest: int | None = None, longest: int | None = None) -> DataFrame:
    """(gene_name, lengths) of genes (name, fpkm) with ``least`` or more: of their isoforms (gene_name, length, fpkm) the length of
    the most expressed one and of all with ``least`` or more; with bounds, genes that have a length within them."""
    live = genes.where(F.col("fpkm") >= least).select(F.col("name").alias("gene_name")).distinct()
    rows = isoforms.join(live, "gene_name", "left_semi")
    top = rows.groupBy("gene_name").agg(F.max_by("length", F.struct("fpkm", -F.col("length"))).alias("length"))
    out = (top.unionByName(rows.where(F.col("fpkm") >= least).select("gene_name", "length")).where("length IS NOT NULL")
           .groupBy("gene_name").agg(F.sort_array(F.collect_set("length")).alias("lengths")))
    if shortest is None and longest is None:
        return out
    return out.where(F.exists("lengths", lambda n: (n >= F.lit(shortest or 0)) & (n <= F.lit(longest if longest is not None else 1 << 62))))


def assembled_expression(gtf: DataFrame) -> DataFrame:
    """(gene, transcript, tpm, gene_tpm, coverage, reference) of an assembler's transcript rows."""
    a = lambda k: F.col("attribute")[k]
    rows = gtf.where("feature = 'transcript'").select(F.coalesce(a("gene_id"), a("ref_gene_id"), a("ref_gene_name")).alias("gene"), a("transcript_id").alias("transcript"),
                                                      a("TPM").try_cast("double").alias("tpm"), a("cov").try_cast("double").alias("coverage"), a("reference_id").alias("reference"))
    return rows.join(rows.groupBy("gene").agg(F.sum("tpm").alias("gene_tpm")), "gene").select("gene", "transcript", "tpm", "gene_tpm", "coverage", "reference")


def identification_rate(lengths: DataFrame, expressed: DataFrame, detected: DataFrame, predicted: DataFrame, width: int = 500, last: int = 5000) -> DataFrame:
    """(low, genes, detected, predicted) by length bin: expressed genes with a transcript in the bin, and those also detected or predicted.

    ``lengths``: (gene_name, length) of transcripts; the others: (gene_name). Lengths from ``last`` on are one bin.
    """
    low = F.least(F.floor(F.col("length") / width) * width, F.lit(last)).cast("bigint")
    rows = lengths.select("gene_name", low.alias("low")).distinct().join(expressed.select("gene_name").distinct(), "gene_name")
    for name, df in (("detected", detected), ("predicted", predicted)):
        rows = rows.join(df.select("gene_name").distinct().withColumn(name, F.lit(1)), "gene_name", "left")
    return rows.groupBy("low").agg(F.count("*").alias("genes"), F.count("detected").alias("detected"), F.count("predicted").alias("predicted"))


# tracks ---------------------------------------------------------------------------------------------

def browser_url(chrom: Column | str, start: Column | str, end: Column | str, db: str, session: str | None = None) -> Column:
    """Genome browser address of a BED range (start from 0)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    head = f"http://genome.ucsc.edu/cgi-bin/hgTracks?db={db}" + (f"&hgsid={session}" if session else "") + "&position="
    return F.concat(F.lit(head), c(chrom), F.lit("%3A"), (c(start) + 1).cast("string"), F.lit("-"), c(end).cast("string"))


def recoloured(bed: DataFrame, colour: str, column: str = "itemRgb") -> DataFrame:
    """BED12 rows in one of five named colours."""
    return bed.withColumn(column, F.array(*[F.lit(int(x)) for x in COLOURS[colour].split(",")]))


def track_line(name: str, description: str | None = None) -> str:
    """Header line of a coloured track; white space of the name becomes ``_``."""
    plain = "_".join(name.split())
    return f'track\tname={plain}\tdescription="{description or plain + " GenePred Entries"}"\titemRgb="On"'
