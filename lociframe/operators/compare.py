"""Transcript comparison: exon and junction matches, annotation, reannotation.

Transcripts: (name, gene_name, chr, strand, start, end, exons). Candidate
pairs come from the overlap join of their ranges; exon arrays of a pair are
compared in place, so no exon is shuffled on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import transcripts as T
from lociframe.functions.ranges import span, to_text
from lociframe.functions.sequence import col
from lociframe.operators.graph import connected_components
from lociframe.operators.overlap import overlap_join
from lociframe.operators.selection import best

MATCHES = "array<struct<i:int,j:int>>"
#: Overlapping pairs: said again before exons are compared, as Spark may compare them for all pairs of a bin.
_MET = "a_start <= b_end AND b_start <= a_end"


def exon_matches(a: Column | str, b: Column | str, multi_least: int = 10, end_share: float = 0.0, mid_share: float = 0.8,
                 single_least: int = 50, single_share: float = 0.5) -> Column:
    """(i, j) of exons that match, in order.

    With a single-exon transcript on either side: ``single_least`` bases and
    ``single_share`` of both. Else ``multi_least`` bases, and ``end_share`` of both
    where one of the two is an end, ``mid_share`` for inner ones.
    """
    a, b = col(a), col(b)
    single = (F.size(a) == 1) | (F.size(b) == 1)

    def pair(x, i):
        def one(y, j):
            n = F.greatest(F.lit(0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]) + 1)
            share = n / F.greatest(x["end"] - x["start"] + 1, y["end"] - y["start"] + 1)
            edge = (i == 0) | (j == 0) | (i == F.size(a) - 1) | (j == F.size(b) - 1)
            ok = F.when(single, (n >= single_least) & (share >= single_share)).otherwise((n >= multi_least) & F.when(edge, share >= end_share).otherwise(share >= mid_share))
            return F.when(ok, F.struct(i.alias("i"), j.alias("j")))

        return F.filter(F.transform(b, one), lambda m: m.isNotNull())

    return F.flatten(F.transform(a, pair)).cast(MATCHES)


def junction_matches(a: Column | str, b: Column | str, tolerance: int = 0, whole_exons: bool = True) -> Column:
    """(i, j) of junctions that match.

    ``whole_exons``: the exons left and right of both junctions overlap, the
    other widened by ``tolerance``. Else both edges agree within ``tolerance``.
    """
    a, b = col(a), col(b)
    over = lambda x, y: (x["start"] <= y["end"] + tolerance) & (F.greatest(y["start"] - tolerance, F.lit(1)) <= x["end"])
    near = lambda x, y: F.abs(x - y) <= tolerance
    ints = lambda x: F.when(F.size(x) > 1, F.sequence(F.lit(1), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda x, i: F.try_element_at(x, i)

    def pair(i):
        def one(j):
            p, q, r, s = at(a, i), at(a, i + 1), at(b, j), at(b, j + 1)
            ok = (over(p, r) & over(q, s)) if whole_exons else (near(p["end"], r["end"]) & near(q["start"], s["start"]))
            return F.when(ok, F.struct((i - 1).alias("i"), (j - 1).alias("j")))

        return F.filter(F.transform(ints(b), one), lambda m: m.isNotNull())

    return F.flatten(F.transform(ints(a), pair)).cast(MATCHES)


def _steps(m: Column) -> Column:
    n = F.greatest(F.size(m) - 1, F.lit(0))
    return F.zip_with(F.slice(m, 1, n), F.slice(m, 2, n), lambda x, y: F.struct((y["i"] - x["i"]).alias("i"), (y["j"] - x["j"]).alias("j")))


def consecutive(m: Column | str) -> Column:
    """Most matches in a row that are one step apart on both sides."""
    m = col(m)
    run = F.aggregate(_steps(m), F.struct(F.lit(1).alias("now"), F.lit(1).alias("top")),
                      lambda a, d: F.struct(F.when((d["i"] == 1) & (d["j"] == 1), a["now"] + 1).otherwise(1).alias("now"),
                                            F.greatest(a["top"], F.when((d["i"] == 1) & (d["j"] == 1), a["now"] + 1).otherwise(1)).alias("top")), lambda a: a["top"])
    return F.when(F.size(m) > 0, run).otherwise(0)


def relation(m: Column | str, n_a: Column, n_b: Column, strict: bool = False) -> Column:
    """Struct (subset, full, compatible) of matches among ``n_a`` and ``n_b`` exons (or junctions).

    subset: 1 both cover each other, 2 the second lies in the first, 3 the
    first in the second, 0 neither. Matches must be one run: the largest step is
    1 on both sides, with ``strict`` every step.
    """
    m = col(m)
    steps = _steps(m)
    run = (~F.exists(steps, lambda d: (d["i"] != 1) | (d["j"] != 1)) if strict
           else (F.size(steps) == 0) | ((F.array_max(F.transform(steps, lambda d: d["i"])) == 1) & (F.array_max(F.transform(steps, lambda d: d["j"])) == 1)))
    first, last = F.try_element_at(m, F.lit(1)), F.try_element_at(m, F.lit(-1))
    start_a, start_b, end_a, end_b = first["i"] == 0, first["j"] == 0, last["i"] == n_a - 1, last["j"] == n_b - 1
    one, two = start_a & end_a, start_b & end_b
    some = (F.size(m) > 0) & run
    return F.struct(F.when(some & one & two, 1).when(some & two, 2).when(some & one, 3).otherwise(0).alias("subset"),
                    F.coalesce(some & one & two, F.lit(False)).alias("full"),
                    F.coalesce(some & (start_a | start_b) & (end_a | end_b), F.lit(False)).alias("compatible"))


def compared(a: DataFrame, b: DataFrame, need_run: bool = True, **rules) -> DataFrame:
    """Overlapping pairs (a_*, b_*) with exon ``matches``; pairs without any go, and with ``need_run``
    multi-exon pairs without two matches one step apart."""
    both = overlap_join(a, b).withColumn("matches", F.when(F.expr(_MET), exon_matches("a_exons", "b_exons", **rules))).where(F.size("matches") > 0)
    if need_run:
        steps = _steps(F.col("matches"))
        least = lambda k: F.array_min(F.transform(steps, lambda d: d[k])) == 1
        both = both.where((F.size("a_exons") == 1) | ((F.size("matches") >= 2) & least("i") & least("j")))
    return both


def annotate(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """The best reference transcript of each read, with 15 columns of evidence.

    ``reads`` and ``reference`` have a ``line`` (their order). Best: full, subset,
    most consecutive exons, most exons, largest share of the longer one; then
    the reference's order.
    """
    multi = exon_matches("a_exons", "b_exons")
    alone = exon_matches("a_exons", "b_exons", single_least=100)
    single = (F.size("a_exons") == 1) | (F.size("b_exons") == 1)
    both = overlap_join(reads, reference).withColumn("m", F.when(F.expr(_MET), F.when(single, alone).otherwise(multi))).where(F.size("m") > 0)
    rel = relation("m", F.size("a_exons"), F.size("b_exons"))
    both = both.withColumns({
        "full": ~single & rel["full"], "subset": ~single & (rel["subset"] > 0), "run": F.when(single, 1).otherwise(consecutive("m")), "n": F.size("m"),
        "shared": T.overlap_size("a_exons", "b_exons"), "a_len": T.length("a_exons"), "b_len": T.length("b_exons")})
    top = best(both, ["a_line"], ~F.col("full"), ~F.col("subset"), -F.col("run"), -F.col("n"), -(F.col("shared") / F.greatest("a_len", "b_len")), F.col("b_line"))
    return top.select(
        F.col("a_line").alias("read_line"), F.col("a_name").alias("read_name"), F.col("b_gene_name").alias("gene_name"), F.col("b_name").alias("transcript_name"),
        F.when(F.col("full"), "full").otherwise("partial").alias("match_type"), F.col("n").cast("long").alias("matching_exons"), F.col("run").cast("long").alias("consecutive_exons"),
        F.size("a_exons").cast("long").alias("read_exons"), F.size("b_exons").cast("long").alias("reference_exons"), F.col("shared").alias("overlap_size"),
        F.col("a_len").alias("read_length"), F.col("b_len").alias("reference_length"),
        to_text(span("a_")).alias("read_range"), to_text(span("b_")).alias("reference_range"), F.col("b_line").alias("reference_line"))


def reannotate(tx: DataFrame, reference: DataFrame) -> DataFrame:
    """``tx`` with ``gene_name`` and ``name`` from the reference.

    Multi-exon transcripts with a reference's junctions become that one;
    single-exon ones the single-exon reference of best mutual coverage. Others
    get the gene of the best overlapping reference and a name of their own;
    what is left forms genes by overlap. Own names are hashes of the layout.
    Names in ``tx`` must be unique; ``how`` tells the rule.
    """
    own = F.sha2(F.concat_ws("|", "chr", "strand", F.to_json("exons")), 256)
    a = tx.withColumn("juncs", F.when(F.size("exons") > 1, T.junction_string("chr", "exons")))
    r = reference.withColumn("juncs", F.when(F.size("exons") > 1, T.junction_string("chr", "exons")))
    by = best(r.where("juncs IS NOT NULL").select("juncs", "gene_name", "name"), ["juncs"], "name").select("juncs", F.col("gene_name").alias("j_gene"), F.col("name").alias("j_name"))
    both = (overlap_join(a.select("name", "chr", "start", "end", "exons"), reference.select("name", "gene_name", "chr", "start", "end", "exons"))
            .withColumn("cover", T.mutual_coverage("a_exons", "b_exons")).where("cover > 0"))
    single = best(both.where("size(a_exons) = 1 AND size(b_exons) = 1").select("a_name", "b_gene_name", "b_name", "cover"), ["a_name"], -F.col("cover"), "b_name")
    near = best(both.select("a_name", "b_gene_name", "b_name", "cover"), ["a_name"], -F.col("cover"), "b_name")
    named = (a.join(by, "juncs", "left")
             .join(single.select(F.col("a_name").alias("name"), F.col("b_gene_name").alias("s_gene"), F.col("b_name").alias("s_name")), "name", "left")
             .join(near.select(F.col("a_name").alias("name"), F.col("b_gene_name").alias("n_gene")), "name", "left"))
    novel = named.where("j_name IS NULL AND s_name IS NULL AND n_gene IS NULL").select("name", "chr", "start", "end")
    groups = overlap_groups(novel)
    out = named.join(groups, "name", "left")
    gene = F.coalesce("j_gene", "s_gene", "n_gene", F.concat(F.lit("locus:"), F.col("group")))
    return out.select(F.col("name").alias("read_name"), gene.alias("gene_name"), F.coalesce("j_name", "s_name", own).alias("name"), "chr", "strand", "start", "end", "exons",
                      F.when(F.col("j_name").isNotNull(), "junctions").when(F.col("s_name").isNotNull(), "single").when(F.col("n_gene").isNotNull(), "gene").otherwise("novel").alias("how"))


def overlap_groups(tx: DataFrame) -> DataFrame:
    """(name, group): ranges in one chain of overlaps share ``chr:start-end`` of the chain."""
    from lociframe.operators.intervals import with_locus

    return with_locus(tx.select("name", "chr", "start", "end")).select(
        "name", F.concat("chr", F.lit(":"), F.col("locus_start").cast("string"), F.lit("-"), F.col("locus_end").cast("string")).alias("group"))


def rename(tx: DataFrame) -> DataFrame:
    """Transcripts with a gene for each overlap group and names from their layout."""
    own = F.sha2(F.concat_ws("|", "name", "chr", "strand", F.to_json("exons")), 256)
    groups = overlap_groups(tx).withColumnRenamed("name", "__n")
    return tx.join(groups, F.col("name") == F.col("__n")).withColumns({"gene_name": F.sha2("group", 256), "name": own}).select(*tx.columns)


def compatible(a: DataFrame, b: DataFrame, tolerance: int = 0, outer: bool = False) -> DataFrame:
    """Pairs with as many junctions that agree one by one within ``tolerance`` (a.name, b.name); ``outer`` keeps others of ``a``."""
    def keyed(df, tag):
        j = T.junctions("exons")
        return df.where(F.size("exons") > 1).select(F.col("name").alias(tag), "chr", F.size(j).alias("n"), j.alias(f"{tag}_j"), j[0]["left"].alias(f"{tag}_left"))

    width = 2 * tolerance + 1
    x = keyed(a, "a").withColumn("bin", F.floor(F.col("a_left") / width))
    y = keyed(b, "b").withColumn("bin", F.explode(F.array_distinct(F.array(*[F.floor((F.col("b_left") + d) / width) for d in (-tolerance, tolerance)]))))
    same = F.forall(F.zip_with("a_j", "b_j", lambda p, q: (F.abs(p["left"] - q["left"]) <= tolerance) & (F.abs(p["right"] - q["right"]) <= tolerance)), lambda v: v)
    got = x.join(y, ["chr", "n", "bin"]).where(same).select("a", "b")
    return a.select(F.col("name").alias("a")).join(got, "a", "left") if outer else got


def partition_loci(tx: DataFrame, kind: str = "any", tolerance: int = 0, **rules) -> DataFrame:
    """(id, locus): transcripts (with a BIGINT ``id``) joined by exon matches of ``kind`` any, compatible, subset or full."""
    both = compared(tx, tx, need_run=False, **rules).where("a_id < b_id")
    rel = relation("matches", F.size("a_exons"), F.size("b_exons"))
    test = {"any": F.lit(True), "compatible": rel["compatible"], "subset": rel["subset"] > 0, "full": rel["full"]}[kind]
    comp = connected_components(both.where(test).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")))
    return tx.select("id").join(comp, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("locus"))


def unsupported_pairs(tx: DataFrame, junctions: DataFrame) -> DataFrame:
    """Consecutive junctions of transcripts of which at least one is not among ``junctions`` (chr, left, right)."""
    j = T.junctions("exons")
    pairs = F.zip_with(F.slice(j, 1, F.greatest(F.size(j) - 1, F.lit(0))), F.slice(j, 2, F.greatest(F.size(j) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    rows = tx.where(F.size("exons") > 2).select("name", "chr", F.explode(pairs).alias("p"))
    known = junctions.select(F.col("chr"), "left", "right").distinct()
    for side in ("x", "y"):
        own = known.select(F.col("chr").alias("c"), F.col("left").alias("l"), F.col("right").alias("r"), F.lit(True).alias(f"has_{side}"))
        rows = rows.join(own, (F.col("chr") == F.col("c")) & (F.col(f"p.{side}.left") == F.col("l")) & (F.col(f"p.{side}.right") == F.col("r")), "left").drop("c", "l", "r")
    return rows.where("has_x IS NULL OR has_y IS NULL").select("name", "chr", F.col("p.x.left").alias("left1"), F.col("p.x.right").alias("right1"),
                                                               F.col("p.y.left").alias("left2"), F.col("p.y.right").alias("right2"))


def nearest_junction(reads: DataFrame, reference: DataFrame, reach: int = 10) -> DataFrame:
    """Of junctions (id, chr, left, right) the nearest reference junction by the sum of both distances, each at most ``reach``; ties by place."""
    width = 2 * reach + 1
    x = reads.withColumn("bin", F.floor(F.col("left") / width))
    y = reference.select(F.col("chr").alias("c"), F.col("left").alias("ref_left"), F.col("right").alias("ref_right"), F.col("strand").alias("ref_strand"),
                         F.explode(F.array_distinct(F.array(F.floor((F.col("left") - reach) / width), F.floor((F.col("left") + reach) / width)))).alias("b"))
    near = (F.abs(F.col("left") - F.col("ref_left")) <= reach) & (F.abs(F.col("right") - F.col("ref_right")) <= reach)
    both = x.join(y, (F.col("chr") == F.col("c")) & (F.col("bin") == F.col("b")) & near).withColumn("gap", F.abs(F.col("left") - F.col("ref_left")) + F.abs(F.col("right") - F.col("ref_right")))
    return best(both.select("id", "chr", "left", "right", "ref_left", "ref_right", "ref_strand", "gap"), ["id"], "gap", "ref_left", "ref_right", "ref_strand")
