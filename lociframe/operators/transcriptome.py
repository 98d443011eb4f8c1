"""A transcriptome from long reads and a reference, in three passes.

1. Reads are judged against the reference: named by it, partly like it, or not
   like it. 2. Families of partly alike reads are judged against the reference
   again. 3. What was detected, the families that are still their own, and merged
   single exons are the candidates that families of unlike reads are judged
   against. Candidates and what then is left as its own make the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions import transcripts as T
from lociframe.operators.assembly import nonredundant
from lociframe.operators.compare import _MET, consecutive, exon_matches, relation
from lociframe.operators.intervals import islands, within
from lociframe.operators.overlap import overlap_join, with_overlap
from lociframe.operators.selection import best
from lociframe.session import cut

COLUMNS = ["gene_name", "name", "chr", "strand", "start", "end", "exons"]


def beside(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows of ``reads`` in a chain of overlaps that holds a row of ``reference``."""
    rows = reads.select("chr", "start", "end").withColumn("__ref", F.lit(0)).unionByName(reference.select("chr", "start", "end").withColumn("__ref", F.lit(1)))
    chains = islands(rows)
    known = within(reference.select("chr", "start", "end"), chains, ["chr"]).select("chr", "__start", "__end").distinct()
    return (within(reads, chains, ["chr"]).join(known, ["chr", "__start", "__end"], "left_semi").select(*reads.columns))


def judged(reads: DataFrame, reference: DataFrame, single_least: int = 20, single_share: float = 0.2, multi_least: int = 10,
           end_share: float = 0.0, mid_share: float = 0.8, novel_loci: bool = False) -> DataFrame:
    """``reads`` (with a unique BIGINT ``id``) with ``verdict`` and the best reference's ``ref``, ``ref_gene``, ``ref_strand``.

    Verdicts: single (one exon, like a one-exon reference), full, partial (the
    read lies in the reference), more (the reference lies in the read, or only
    some exons match), none. Of several references the best verdict counts, then
    for full ones the share of the longer one that is shared, for the others
    matching (for mere matches: consecutive) exons and the least share of a matching exon, then the name.
    Reads whose locus has no reference go unless ``novel_loci``.
    """
    base = reads if novel_loci else beside(reads, reference)
    own = base.select("id", "chr", "start", "end", "exons")
    both = overlap_join(own, reference.select("name", "gene_name", "strand", "chr", "start", "end", "exons"), "b_", "a_")
    one = (F.size("a_exons") == 1) & (F.size("b_exons") == 1)
    m = exon_matches("a_exons", "b_exons", multi_least, end_share, mid_share, single_least, single_share)
    pairs = (both.where(one | ((F.size("a_exons") > 1) & (F.size("b_exons") > 1))).withColumn("m", F.when(F.expr(_MET), m)).where(F.size("m") > 0))
    length = lambda e: e["end"] - e["start"] + 1
    share = F.transform("m", lambda p: (F.least(F.get("a_exons", p["i"])["end"], F.get("b_exons", p["j"])["end"]) - F.greatest(F.get("a_exons", p["i"])["start"], F.get("b_exons", p["j"])["start"]) + 1)
                        / F.greatest(length(F.get("a_exons", p["i"])), length(F.get("b_exons", p["j"]))))
    subset = relation("m", F.size("a_exons"), F.size("b_exons"))["subset"]
    whole = T.overlap_size("a_exons", "b_exons") / F.greatest(T.length("a_exons"), T.length("b_exons"))
    pairs = pairs.withColumns({"tier": F.when(one, 0).when(subset > 0, subset).otherwise(4), "n": F.size("m"), "run": consecutive("m"), "least": F.array_min(share), "whole": whole})
    first = F.when(F.col("tier") <= 1, F.col("whole")).when(F.col("tier") == 4, F.col("run")).otherwise(F.col("n")).cast("double")
    top = best(pairs.withColumn("first", first), ["b_id"], F.col("tier"), -F.col("first"), -F.col("least"), F.col("a_name"))
    verdict = F.when(F.col("tier") == 0, "single").when(F.col("tier") == 1, "full").when(F.col("tier") == 2, "partial").otherwise("more")
    found = top.select(F.col("b_id").alias("id"), verdict.alias("verdict"), F.col("a_name").alias("ref"), F.col("a_gene_name").alias("ref_gene"), F.col("a_strand").alias("ref_strand"))
    return base.join(found, "id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("none")))


def _numbered(tx: DataFrame) -> DataFrame:
    return cut(tx.select(*COLUMNS)).withColumn("id", F.monotonically_increasing_id())


def _families(tx: DataFrame, **how) -> DataFrame:
    return nonredundant(tx.select(*COLUMNS), **how).select(*COLUMNS)


def _own_name(tx: DataFrame) -> DataFrame:
    return tx.withColumn("name", F.sha2(F.concat_ws("|", "chr", "strand", F.to_json("exons")), 256))


def merged_singles(singles: DataFrame, taken: DataFrame) -> DataFrame:
    """One-exon transcripts of ``singles`` that overlap nothing of ``taken``, merged by overlap, on the plus strand."""
    free = with_overlap(singles.select("chr", "start", "end"), taken.select("chr", "start", "end"), anti=True)
    rows = islands(free).select("chr", F.lit("+").alias("strand"), "start", "end", F.array(F.struct("start", "end")).cast(T.EXONS).alias("exons"))
    return _own_name(rows).withColumn("gene_name", F.col("name")).select(*COLUMNS)


def transcriptome(reads: DataFrame, reference: DataFrame, tolerance: int = 20, least_support: int = 2, end_support: int = 2, downsample: int = 50, **rules) -> DataFrame:
    """(gene_name, name, chr, strand, start, end, exons, how): detected references and families of reads.

    how: reference, partial, single, novel. ``downsample`` as in ``nonredundant``.
    An empty ``reads`` gives an empty result.
    """
    how = dict(tolerance=tolerance, least_support=least_support, end_support=end_support, downsample=downsample, longest=downsample)
    several, named = F.size("exons") > 1, F.col("verdict").isin("single", "full", "partial")
    one = cut(judged(_numbered(reads), reference, **rules))
    alike = one.where(several & (F.col("verdict") == "more")).withColumns({"strand": F.col("ref_strand"), "gene_name": F.col("ref_gene")})
    unlike = one.where(several & (F.col("verdict") == "none"))
    partial = _numbered(_own_name(_families(alike, **how)))
    two = cut(judged(partial, reference, **rules))
    detected = one.where(named).select("ref").unionByName(two.where(named).select("ref")).distinct()
    known = reference.select(*COLUMNS).join(detected, F.col("name") == F.col("ref"), "left_semi")
    kept = two.where(~named).select(*COLUMNS)
    taken = alike.select("chr", "start", "end").unionByName(unlike.select("chr", "start", "end")).unionByName(reference.select("chr", "start", "end"))
    singles = merged_singles(one.where(~several & (F.col("verdict") == "none")), taken)
    tag = lambda df, x: df.withColumn("how", F.lit(x))
    candidates = cut(tag(known, "reference").unionByName(tag(kept, "partial")).unionByName(tag(singles, "single")))
    # families of unlike reads meet the candidates: what one of them names is there already
    novel = cut(judged(_numbered(_own_name(_families(unlike, **how))), candidates, **(rules | {"novel_loci": True})))
    return candidates.unionByName(tag(novel.where(~named).select(*COLUMNS), "novel"))
