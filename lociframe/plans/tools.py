"""Command-line tools over paths: ``python -m lociframe.plans.tools TOOL INPUT... OUTPUT [key=value ...]``.

Each tool is a plan from readers to lines or Parquet; ``TOOLS`` is open to new
ones.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.functions import sequence as S
from lociframe.functions import transcripts as T
from lociframe.operators import alignment, assembly, compare, genome, intervals, selection, simulation, stats, transcriptome
from lociframe.sources import bgzf, sinks, text

TOOLS: dict = {}


def tool(f):
    TOOLS[f.__name__] = f
    return f


def _sam(spark, path) -> DataFrame:
    df = bgzf.read_bam(spark, path) if path.endswith(".bam") else text.read(spark, path, "sam")
    return df.where(~S.has_flag("flag", S.UNALIGNED) & F.col("pos").isNotNull())


def _tx(spark, path) -> DataFrame:
    return text.read(spark, path, "gpd")


def aligned_transcripts(sam: DataFrame, min_intron: int = S.MIN_INTRON) -> DataFrame:
    """Transcripts of aligned reads: gaps under ``min_intron`` closed."""
    rows = sam.select(F.col("qname").alias("gene_name"), F.col("qname").alias("name"), F.col("rname").alias("chr"),
                      F.when(S.has_flag("flag", S.REVERSE), "-").otherwise("+").alias("strand"), S.cigar_exons("pos", "cigar", min_intron).alias("exons"))
    return rows.where(F.size("exons") > 0).withColumns({"start": F.element_at("exons", 1)["start"], "end": F.element_at("exons", -1)["end"]})


def exon_rows(tx: DataFrame) -> DataFrame:
    return tx.select("name", "chr", "strand", F.explode("exons").alias("e")).select("name", "chr", "strand", F.col("e.start").alias("start"), F.col("e.end").alias("end"))


@tool
def bam_bgzf_index(spark, path):
    return bgzf.index(bgzf.read_bam(spark, path))


@tool
def bam_to_bed_depth(spark, path, min_intron=68):
    return sinks.bed(intervals.coverage(exon_rows(aligned_transcripts(_sam(spark, path), int(min_intron)))), "depth")


@tool
def bed_depth_to_stratified_coverage(spark, path, minimum_coverage=50, unique_scale=0.0, seed=1):
    return sinks.bed(stats.strata(text.read(spark, path, "depth"), int(minimum_coverage), float(unique_scale), int(seed)), "strata")


@tool
def fasta_to_fake_fastq(spark, path, quality="I"):
    return sinks.fastq(sinks.fake_fastq(text.read_fasta(spark, path), quality))


@tool
def fasta_to_tsv(spark, path):
    return sinks.fasta_to_tsv(text.read_fasta(spark, path))


@tool
def tsv_to_fasta(spark, path):
    return sinks.fasta(text.parse_tsv(text.lines(spark, path), ["header", "seq"]))


@tool
def fastq_to_fasta(spark, path):
    return sinks.fasta(text.read_fastq(spark, path))


@tool
def fastq_to_tsv(spark, path):
    return sinks.fastq_to_tsv(text.read_fastq(spark, path))


@tool
def tsv_to_fastq(spark, path):
    return sinks.fastq(text.parse_tsv(text.lines(spark, path), ["header", "seq", "line3", "qual"]))


def gene_quantities(quant: DataFrame, genes: DataFrame) -> DataFrame:
    """Quantities (name, tpm, ...) with the gene of each transcript and its total, the largest genes first."""
    q = quant.join(genes.select("name", "gene_name"), "name")
    total = q.groupBy("gene_name").agg(F.sum("tpm").alias("gene_tpm"))
    return q.join(total, "gene_name").orderBy(F.col("gene_tpm").desc(), F.col("tpm").desc(), "name")


def failing_transcripts(quant: DataFrame, least_tpm: float, least_share: float) -> DataFrame:
    """Transcripts under ``least_tpm`` or under ``least_share`` of their gene: the ones that a re-quantification leaves out."""
    return quant.where((F.col("tpm") < least_tpm) | (F.col("tpm") < least_share * F.col("gene_tpm")))


@tool
def fastq_to_salmon_quant(spark, quant_path, gpd_path):
    """The part after the external quantifier: its table (Name, Length, EffectiveLength, TPM, NumReads) by gene."""
    q = spark.read.option("sep", "\t").option("header", True).csv(quant_path)
    q = q.select(F.col("Name").alias("name"), F.col("TPM").cast("double").alias("tpm"), F.col("NumReads").cast("double").alias("count"))
    return gene_quantities(q, _tx(spark, gpd_path))


@tool
def iterate_salmon(spark, quant_path, gpd_path, min_tpm=1.0, min_fraction=0.01):
    """One round after the external quantifier: transcripts that stay for the next one."""
    q = fastq_to_salmon_quant(spark, quant_path, gpd_path)
    return q.join(failing_transcripts(q, float(min_tpm), float(min_fraction)).select("name"), "name", "left_anti")


@tool
def gpd_annotate(spark, path, reference):
    lined = lambda p: text.parse_gpd(text.numbered_lines(spark, p))
    return compare.annotate(lined(path), lined(reference))


@tool
def gpd_filter(spark, path, min_length=0, max_length=1 << 62, names=None, genes=None, min_exons=1, invert=False):
    tx = _tx(spark, path)
    test = T.length("exons").between(int(min_length), int(max_length)) & (F.size("exons") >= int(min_exons))
    out = tx.where(~test if invert else test)
    for key, listed in (("name", names), ("gene_name", genes)):
        if listed:
            out = selection.in_list(out, key, text.lines(spark, listed), "value", bool(invert))
    return sinks.gpd(out)


@tool
def gpd_reannotate(spark, path, reference):
    return sinks.gpd(compare.reannotate(_tx(spark, path), _tx(spark, reference)))


@tool
def gpd_rename(spark, path):
    return sinks.gpd(compare.rename(_tx(spark, path).select("gene_name", "name", "chr", "strand", "start", "end", "exons")))


@tool
def gpd_to_UCSC_bed12(spark, path, color="0,0,0", minintron=0, namefield="name"):  # noqa: N802
    tx = _tx(spark, path)
    tx = tx.withColumn("exons", T.smooth("exons", int(minintron))) if int(minintron) else tx
    return sinks.bed12(sinks.gpd_bed12(tx, color, namefield))


@tool
def gpd_to_bed_depth(spark, path):
    return sinks.bed(intervals.coverage(exon_rows(_tx(spark, path))), "depth")


@tool
def gpd_to_fasta(spark, path, fasta):
    seqs = genome.spliced(_tx(spark, path), genome.chunked(text.read_fasta(spark, fasta)))
    return sinks.fasta(seqs.withColumn("header", F.col("name")))


@tool
def gpd_to_gtf_exons(spark, path, source="lociframe"):
    return sinks.gtf_exons(_tx(spark, path), source)


@tool
def gpd_to_nonredundant(spark, path, tolerance=20, minimum_support=2, downsample=250):
    return sinks.gpd(assembly.nonredundant(_tx(spark, path), int(tolerance), int(minimum_support), downsample=int(downsample)))


@tool
def gtf_to_gpd(spark, path):
    return sinks.gpd(text.gtf_transcripts(text.read(spark, path, "gtf")))


@tool
def gtf_to_tsv(spark, path, attribute_prefix=""):
    """One column per attribute name, by name; the names, a few dozen, are a distinct over the file."""
    gtf = text.read(spark, path, "gtf")
    names = [r[0] for r in gtf.select(F.explode(F.map_keys("attribute")).alias("k")).distinct().orderBy("k").collect()]
    return gtf.select(*text.GTF, *[F.col("attribute")[k].alias(f"{attribute_prefix}{k}") for k in names])


@tool
def lr_to_transcriptome(spark, path, reference, tolerance=20, minimum_support=2, downsample=50):
    """Detected references and families of reads, in three passes."""
    return sinks.gpd(transcriptome.transcriptome(_tx(spark, path), _tx(spark, reference), int(tolerance), int(minimum_support), int(minimum_support), int(downsample)))


def best_molecules(rows: DataFrame) -> DataFrame:
    """Rows (tier, qname, ...) of each molecule in its best tier; aligned rows of any tier come before unaligned ones.

    Tiers named ``sub`` keep the read of most aligned bases (unaligned: the
    longest); other tiers keep all their reads.
    """
    aligned = ~S.has_flag("flag", S.UNALIGNED)
    size = F.when(F.col("sub"), F.when(aligned, S.aligned_bases("cigar")).otherwise(F.length("seq"))).otherwise(F.lit(0))
    pick = F.when(F.col("sub"), F.col("qname")).otherwise("")
    t = rows.withColumns({"__m": S.molecule("qname"), "__t": F.col("tier") + F.when(aligned, 0).otherwise(100), "__s": F.coalesce(size.cast("long"), F.lit(0)), "__p": pick})
    return selection.best_by_tier(t, "__m", "__t", "__s", "__p").drop("__m", "__t", "__s", "__p")


@tool
def pacbio_best_molecule_alignments(spark, *paths):
    """Paths in order of priority; those that hold subreads are written ``sub:path``."""
    every = None
    for i, p in enumerate(paths):
        own = text.read(spark, p.removeprefix("sub:"), "sam").withColumns({"tier": F.lit(i), "sub": F.lit(p.startswith("sub:"))})
        every = own if every is None else every.unionByName(own)
    return sinks.sam(best_molecules(every))


def pacbio_names(reads: DataFrame, movie: str = "m150101_010101_11111_c111111111111111111_s1_p0", ccs: bool = True) -> DataFrame:
    """``reads`` with ``new_name``: gapless holes in order of the name, counted per hash range and then from a prefix."""
    from lociframe.session import cut

    fixed = cut(reads.repartitionByRange("name").sortWithinPartitions("name").withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() % (1 << 33)))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = fixed.groupBy("__p").agg(F.count("*").alias("n")).withColumn("__b", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    hole = (F.col("__b") + F.col("__i") + 1).cast("string")
    end = F.lit("/ccs") if ccs else F.concat(F.lit("/0_"), F.length("seq").cast("string"))
    return fixed.join(F.broadcast(before), "__p").withColumn("new_name", F.concat(F.lit(movie + "/"), hole, end)).drop("__p", "__i", "__b")


@tool
def rename_to_pacbio(spark, path):
    return sinks.fastq(pacbio_names(text.read_fastq(spark, path)).withColumn("header", F.col("new_name")))


@tool
def sam_to_gpd(spark, path, min_intron=68):
    return sinks.gpd(aligned_transcripts(_sam(spark, path), int(min_intron)))


def psl_counts(sam: DataFrame, sequences: DataFrame) -> DataFrame:
    """(id, matches, ...): counts of each row of ``sam`` (with a unique ``id``) against the bases of its target, fetched by chunk."""
    rows = sam.select(F.col("id").cast("string").alias("name"), F.col("rname").alias("chr"), F.lit("+").alias("strand"), "blocks", F.col("seq").alias("query"))
    span = F.array(F.struct(F.element_at("blocks", 1)["t_start"].alias("start"), F.element_at("blocks", -1)["t_end"].alias("end")))
    bases = genome.spliced(rows.select("name", "chr", "strand", span.alias("exons")), genome.chunked(sequences)).select("name", F.col("seq").alias("target_seq"))
    whole = rows.join(bases, "name").withColumn("target_start", F.element_at("blocks", 1)["t_start"])
    return alignment.alignment_stats(whole).withColumn("id", F.col("name").cast("bigint")).drop("name")


@tool
def sam_to_psl(spark, path, fasta=None):
    """PSL of aligned reads, with counts against the target's bases; without a FASTA file all aligned bases count as matches."""
    from lociframe.session import cut

    rows = _sam(spark, path).withColumn("blocks", S.once(S.cigar_blocks("pos", "cigar"))).where(F.size("blocks") > 0)
    zero, b = F.lit(0).cast("bigint"), "blocks"
    first, last = F.element_at(b, 1), F.element_at(b, -1)
    values = dict(matches=S.aligned_bases("cigar"), strand=F.when(S.has_flag("flag", S.REVERSE), "-").otherwise("+"), qName=F.col("qname"), qSize=S.query_length("cigar"),
                  qStart=first["q_start"] - 1, qEnd=last["q_end"], tName=F.col("rname"), tSize=zero, tStart=first["t_start"] - 1, tEnd=last["t_end"], blockCount=F.size(b).cast("bigint"),
                  blockSizes=F.transform(b, lambda x: x["t_end"] - x["t_start"] + 1), qStarts=F.transform(b, lambda x: x["q_start"] - 1), tStarts=F.transform(b, lambda x: x["t_start"] - 1))
    if fasta:
        sequences = text.read_fasta(spark, fasta)
        rows = cut(rows.select("qname", "flag", "rname", "cigar", "seq", "blocks")).withColumn("id", F.monotonically_increasing_id())
        counts = psl_counts(rows.where("seq IS NOT NULL"), sequences)
        sizes = sequences.select(F.col("name").alias("rname"), F.length("seq").cast("bigint").alias("t_size"))
        names = [c for c in counts.columns if c != "id"]
        rows = rows.join(counts.withColumnsRenamed({c: f"n_{c}" for c in names}), "id", "left").join(sizes, "rname", "left")
        values |= {c: F.coalesce(f"n_{c}", values.get(c, zero)) for c in names} | {"tSize": F.coalesce("t_size", zero)}
    return sinks.psl(rows.select(*[values.get(c, zero).alias(c) for c in text.PSL]))


def read_junctions(sam: DataFrame, min_intron: int = S.MIN_INTRON) -> DataFrame:
    """(chr, left, right, read, pos, right_size) of each intron of aligned reads."""
    rows = sam.select("rname", "qname", "pos", S.cigar_exons("pos", "cigar", min_intron).alias("e"))
    j = F.transform(T.junctions(F.col("e")), lambda x, i: F.struct(x["left"].alias("left"), x["right"].alias("right"),
                                                                   (F.get("e", i + 1)["end"] - F.get("e", i + 1)["start"] + 1).alias("right_size")))
    return (rows.select(F.col("rname").alias("chr"), F.col("qname").alias("read"), "pos", F.explode(j).alias("j")).select("chr", "j.*", "read", "pos"))


@tool
def sam_to_splicemap_junction_bed(spark, path, fasta):
    sam = _sam(spark, path)
    j = genome.junction_strands(read_junctions(sam), genome.chunked(text.read_fasta(spark, fasta)))
    s = stats.junction_support(j, sam.groupBy(F.col("qname").alias("read")).agg(F.count("*").alias("mappings")))
    exons = F.array(F.struct((F.col("left") - 49).alias("start"), F.col("left").alias("end")), F.struct(F.col("right").alias("start"), (F.col("right") + 49).alias("end")))
    return sinks.bed12(sinks.gpd_bed12(s.withColumns({"name": F.col("label"), "exons": exons})).withColumn("score", F.lit(50)))


def simple_alignments(sam: DataFrame) -> DataFrame:
    """SAM rows without soft-clipped bases, deletions as N, and flag 0 or 16."""
    ops = S.cigar_ops("cigar")
    left = F.when(F.get(ops, F.lit(0))["op"] == "S", F.get(ops, F.lit(0))["n"]).otherwise(0)
    n = F.size(ops)
    right = F.when((n > 1) & (F.get(ops, n - 1)["op"] == "S"), F.get(ops, n - 1)["n"]).otherwise(0)
    kept = F.filter(ops, lambda x: ~x["op"].isin("S", "H"))
    cigar = F.array_join(F.transform(kept, lambda x: F.concat(x["n"].cast("string"), F.when(x["op"] == "D", "N").otherwise(x["op"]))), "")
    cut = lambda c: F.substring(c, (left + 1).cast("int"), (F.length(c) - left - right).cast("int"))
    return sam.withColumns({"cigar": cigar, "seq": cut(F.col("seq")), "qual": cut(F.col("qual")), "flag": F.when(S.has_flag("flag", S.REVERSE), 16).otherwise(0).cast("bigint")})


@tool
def sam_to_splicemap_like_sam(spark, path):
    return sinks.sam(simple_alignments(_sam(spark, path)))


@tool
def simulate_tx(spark, fasta, n=1000, kind="long", rate=0.0, seed=1):
    seqs = text.read_fasta(spark, fasta).withColumn("gene_name", F.col("name"))
    return simulation.simulate(seqs, int(n), kind, float(rate), int(seed))[0]


@tool
def sort(spark, path, kind="gpd", name=False):
    return selection.sort_table(text.read(spark, path, kind), kind, bool(name))


def _trim(df: DataFrame, left: int, right: int, ends: bool) -> DataFrame:
    """Without ``left`` and ``right`` bases; ``ends`` keeps just those instead."""
    n = F.length("seq")
    one = lambda c: (F.concat(F.substring(c, 1, left), F.substring(c, (F.greatest(n - right, F.lit(left)) + 1).cast("int"), F.lit(right))) if ends
                     else F.substring(c, F.lit(left + 1), F.greatest(n - left - right, F.lit(0)).cast("int")))
    return df.withColumns({c: one(F.col(c)) for c in ("seq", "qual") if c in df.columns})


@tool
def trim_fasta(spark, path, left=0, right=0, ends=False):
    return sinks.fasta(_trim(text.read_fasta(spark, path), int(left), int(right), bool(ends)))


@tool
def trim_fastq(spark, path, left=0, right=0, ends=False):
    return sinks.fastq(_trim(text.read_fastq(spark, path), int(left), int(right), bool(ends)))


@tool
def alignment_strings(spark, path):
    """Alignments (Parquet: name, strand, blocks, query, target_seq, target_start) base by base."""
    return alignment.alignment_strings(spark.read.parquet(path))


@tool
def bgzf_blocks(spark, path):
    """(start, size) of each block of a compressed file."""
    return spark.createDataFrame(list(bgzf.block_bounds(path)), "start long, size long")


def main(args: list) -> None:
    name, *rest = args
    options = dict(x.split("=", 1) for x in rest if "=" in x and "/" not in x.split("=", 1)[0])
    *inputs, output = [x for x in rest if not ("=" in x and "/" not in x.split("=", 1)[0])]
    out = TOOLS[name](SparkSession.builder.getOrCreate(), *inputs, **options)
    (out.write.text if out.columns == ["value"] else out.write.parquet)(output)


if __name__ == "__main__":
    main(sys.argv[1:])
