"""Registered queries of the sequence and interval operators over the driver's whole tables, with their SQL.

Rows of ``lineitem`` and ``orders`` serve as ranges, orders with their items
as transcripts, documents as sequences, conversations as molecules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.functions import ranges as R
from lociframe.functions import sequence as S
from lociframe.functions import transcripts as T
from lociframe.operators import assembly, compare, genome, graph, intervals, overlap, selection, stats
from lociframe.operators import simulation as sim
from lociframe.session import spread
from lociframe.sources import sinks, text
from lociframe.streaming import loci

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# inputs ---------------------------------------------------------------------------------------------

def items(spark, sf):
    start = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    n = F.col("l_quantity").cast("bigint")
    return _t(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("chr"), start.alias("start"), (start + n - 1).alias("end"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
        n.alias("qty"), F.col("l_returnflag").alias("flag"))


def spans(spark, sf):
    start = F.col("o_orderkey") * 16
    return _t(spark, sf, "orders").select(F.col("o_orderstatus").alias("chr"), start.alias("start"), (start + F.col("o_custkey") % 40).alias("end"), F.col("o_orderkey").alias("id"))


def transcripts(spark, sf):
    start = F.col("o_custkey") * 1000 + F.col("l_linenumber") * 60
    rows = (spread(_t(spark, sf, "lineitem"), "l_orderkey").join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderpriority") < "3", "+").otherwise("-").alias("strand"), start.alias("start"),
                    (start + F.col("l_quantity").cast("bigint")).alias("end"))
            .groupBy("o_orderkey", "o_custkey", "o_orderstatus", "strand", "start").agg(F.max("end").alias("end")))
    return (rows.groupBy("o_orderkey", "o_custkey", "o_orderstatus", "strand").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"))
            .select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_custkey").cast("string").alias("gene_name"), F.col("o_orderstatus").alias("chr"),
                    "strand", F.element_at("exons", 1)["start"].alias("start"), F.element_at("exons", -1)["end"].alias("end"), "exons"))


IV = """iv AS (SELECT l_linestatus AS chr, l_orderkey * 16 + l_linenumber AS s, l_orderkey * 16 + l_linenumber + CAST(l_quantity AS BIGINT) - 1 AS e,
    CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag FROM lineitem)"""
IW = "iw AS (SELECT o_orderstatus AS chr, o_orderkey * 16 AS s, o_orderkey * 16 + o_custkey % 40 AS e, o_orderkey AS id FROM orders)"
EXONS = """x AS (SELECT o_orderkey AS id, o_custkey AS gene, o_orderstatus AS chr, CASE WHEN o_orderpriority < '3' THEN '+' ELSE '-' END AS strand,
    o_custkey * 1000 + l_linenumber * 60 AS s, max(o_custkey * 1000 + l_linenumber * 60 + CAST(l_quantity AS BIGINT)) AS e
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
  ex AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM x)"""
TX = EXONS + """, tx AS (SELECT id, any_value(gene) AS gene, any_value(chr) AS chr, any_value(strand) AS strand, min(s) AS s, max(e) AS e, count(*) AS n, sum(e - s + 1)::BIGINT AS len FROM x GROUP BY id)"""


def _bases(name: str, source: str) -> str:
    return f"{name} AS (SELECT chr, unnest(range(s, e + 1)) AS p FROM {source})"


def _chains(source: str, gap: int, keys: str = "chr", cols: str = "", tail: str = "") -> str:
    """SQL of chains of ranges with at most ``gap`` between a start and the reach before it."""
    return f"""o AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
  k AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM o)
  SELECT {keys}, min(s) AS "start", max(e) AS "end"{cols} FROM k GROUP BY {keys}, run {tail}"""


#: Runs of neighbouring bases of one value.
_RUNS = """SELECT chr, min(p) AS "start", max(p) AS "end"{v} FROM (SELECT *, p - row_number() OVER (PARTITION BY chr{k} ORDER BY p) AS g FROM {t}) GROUP BY chr, g{k}"""


# intervals ------------------------------------------------------------------------------------------

@query(f"WITH {IV}, {_bases('b', 'iv')}, d AS (SELECT chr, p, count(*) AS depth FROM b GROUP BY chr, p) " + _RUNS.format(v=", depth", k=", depth", t="d"))
def coverage(spark, sf):
    return intervals.coverage(items(spark, sf))


@query(f"WITH {IV}, b AS (SELECT chr, unnest(range(s, e + 1)) AS p, qty FROM iv), d AS (SELECT chr, p, sum(qty)::BIGINT AS depth FROM b GROUP BY chr, p) " + _RUNS.format(v=", depth", k=", depth", t="d"))
def weighted_coverage(spark, sf):
    return intervals.coverage(items(spark, sf), weight="qty")


@query(f"""WITH iv AS (SELECT l_linestatus AS chr, l_orderkey * 16 + l_linenumber AS s, l_orderkey * 16 + l_linenumber + CAST(l_quantity AS BIGINT) - 1 AS e,
    CAST(l_extendedprice / 7000.0 AS DECIMAL(38, 15)) AS w FROM lineitem), b AS (SELECT chr, unnest(range(s, e + 1)) AS p, w FROM iv),
  d AS (SELECT chr, p, sum(w) AS depth FROM b GROUP BY chr, p), r AS (""" + _RUNS.format(v=", any_value(depth) AS depth", k=", depth", t="d") + """)
  SELECT chr, "start", "end", round(depth::DOUBLE, 6) AS depth FROM r""")
def fractional_coverage(spark, sf):
    price = _t(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("chr"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("start"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber") + F.col("l_quantity").cast("bigint") - 1).alias("end"), (F.col("l_extendedprice").cast("double") / 7000.0).alias("w"))
    return intervals.coverage(price, weight="w").withColumn("depth", F.round("depth", 6))


@query(f"WITH {IV}, " + _chains("iv", 1))
def merge_ranges(spark, sf):
    return intervals.merge(items(spark, sf))


@query(f"WITH {IV}, " + _chains("iv", 0, cols=", count(*) AS members"))
def locus_ranges(spark, sf):
    return intervals.loci(items(spark, sf))


@query(f"WITH {IV}, " + _chains("iv", 3, "chr, strand", ", count(*) AS members"))
def stranded_loci(spark, sf):
    return intervals.loci(items(spark, sf), overhang=3, stranded=True)


@query(f"WITH {IV}, " + _chains("iv", 1, "chr, flag"))
def merge_by_feature(spark, sf):
    return intervals.bed_merge(items(spark, sf), "flag")


@query(f"""WITH {IV}, o AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
  k AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM o)
  SELECT chr, s AS "start", e AS "end", strand, min(s) OVER (PARTITION BY chr, run) AS locus_start, max(e) OVER (PARTITION BY chr, run) AS locus_end FROM k""")
def locus_members(spark, sf):
    return intervals.with_locus(items(spark, sf).select("chr", "start", "end", "strand"))


@query(f"""WITH {IV}, {IW}, u AS (SELECT chr, s, e, 'item' AS side FROM iv UNION ALL SELECT chr, s, e, 'order' FROM iw), """
       + _chains("u", 0, cols=", count(*) FILTER (side = 'item') AS items, count(*) FILTER (side = 'order') AS orders"))
def multi_locus(spark, sf):
    rows = intervals.multi_loci({"item": items(spark, sf), "order": spans(spark, sf)})
    return rows.groupBy("chr", F.col("locus_start").alias("start"), F.col("locus_end").alias("end")).agg(
        F.count_if(F.col("side") == "item").alias("items"), F.count_if(F.col("side") == "order").alias("orders"))


@query(f"WITH {IV}, {IW}, {_bases('a', 'iv')}, {_bases('b', 'iw')}, d AS (SELECT chr, p FROM a EXCEPT SELECT chr, p FROM b) " + _RUNS.format(v="", k="", t="d"))
def subtract_ranges(spark, sf):
    return intervals.subtract(items(spark, sf), spans(spark, sf))


@query(f"WITH {IV}, {IW}, {_bases('a', 'iv')}, {_bases('b', 'iw')}, d AS (SELECT chr, p FROM a INTERSECT SELECT chr, p FROM b) " + _RUNS.format(v="", k="", t="d"))
def intersect_ranges(spark, sf):
    return intervals.intersect(items(spark, sf), spans(spark, sf))


@query(f"""WITH {IV}, {IW} SELECT a.chr, a.s AS a_start, a.e AS a_end, b.id, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS size
  FROM iv a JOIN iw b ON a.chr = b.chr AND a.s <= b.e AND b.s <= a.e""")
def overlap_pairs(spark, sf):
    return overlap.pieces(items(spark, sf), spans(spark, sf)).select("chr", "a_start", "a_end", F.col("b_id").alias("id"), "size")


@query(f"""WITH {IV}, {IW} SELECT a.chr, a.s AS a_start, a.e AS a_end, b.id FROM iv a JOIN iw b ON a.chr = b.chr AND a.s <= b.e + 5 AND greatest(b.s - 5, 1) <= a.e""")
def padded_overlap(spark, sf):
    return overlap.overlap_join(items(spark, sf), spans(spark, sf), padding=5).select(F.col("a_chr").alias("chr"), "a_start", "a_end", F.col("b_id").alias("id"))


@query(f"""WITH {IV}, {IW}, {_bases('b', 'iv')}, d AS (SELECT chr, p, count(*) AS depth FROM b GROUP BY chr, p),
  q AS (SELECT id, chr, unnest(range(s, e + 1)) AS p FROM iw)
  SELECT q.id, count(*) AS length, count(d.depth) AS covered, count(d.depth) / count(*) AS fraction, coalesce(sum(d.depth), 0) / count(*) AS mean_depth
  FROM q LEFT JOIN d ON q.chr = d.chr AND q.p = d.p GROUP BY q.id""")
def covered_spans(spark, sf):
    return overlap.covered_by(spans(spark, sf), intervals.coverage(items(spark, sf)), "id")


@query(f"WITH {IV}, {IW} SELECT chr, s AS \"start\", e AS \"end\", id FROM iw b WHERE EXISTS (SELECT 1 FROM iv a WHERE a.chr = b.chr AND a.s <= b.e AND b.s <= a.e)")
def semi_overlap(spark, sf):
    return overlap.with_overlap(spans(spark, sf), items(spark, sf))


@query(f"WITH {IV}, {IW} SELECT chr, s AS \"start\", e AS \"end\", strand FROM iv a WHERE NOT EXISTS (SELECT 1 FROM iw b WHERE a.chr = b.chr AND a.s <= b.e AND b.s <= a.e)")
def anti_overlap(spark, sf):
    return overlap.with_overlap(items(spark, sf).select("chr", "start", "end", "strand"), spans(spark, sf), anti=True)


@query(f"""WITH {IV}, m AS (SELECT chr, min(s) AS low, max(e) AS high FROM iv GROUP BY chr)
  SELECT chr, greatest(s - 100, low) AS "start", least(e + 100, high) AS "end" FROM iv JOIN m USING (chr)""")
def pad_ranges(spark, sf):
    rows = items(spark, sf).select("chr", "start", "end")
    return intervals.pad(rows, 100, rows.groupBy("chr").agg(F.min("start").alias("low"), F.max("end").alias("high")))


@query(f"""WITH {IV}, w AS (SELECT chr, s, e, unnest(range(0, (e - s) // 7)) AS i FROM iv) SELECT chr, s + i * 7 AS "start", s + i * 7 + 6 AS "end" FROM w""")
def window_break(spark, sf):
    return intervals.windows(items(spark, sf).select("chr", "start", "end"), 7)


@query("""WITH p AS (SELECT l_linestatus AS ac, l_orderkey * 16 + l_linenumber AS a1, l_orderkey * 16 + l_linenumber + CAST(l_quantity AS BIGINT) - 1 AS a2,
    o_orderstatus AS bc, o_orderkey * 16 AS b1, o_orderkey * 16 + o_custkey % 40 AS b2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT a1, a2, b1, b2, CASE WHEN ac <> bc THEN -1 WHEN a1 <= b2 AND b1 <= a2 THEN 0 ELSE greatest(b1 - a2, a1 - b2) - 1 END AS distance,
    CASE WHEN ac = bc THEN greatest(0, least(a2, b2) - greatest(a1, b1) + 1) ELSE 0 END AS shared,
    CASE WHEN ac = bc AND a1 <= b2 AND b1 <= a2 THEN 0 WHEN ac < bc OR (ac = bc AND a2 < b1) THEN -1 ELSE 1 END AS cmp,
    ac = bc AND (a2 + 1 = b1 OR b2 + 1 = a1) AS adjacent, ac || ':' || a1 || '-' || a2 AS "text",
    CASE WHEN ac = bc THEN least(a1, b1) END AS hull_start,
    CASE WHEN ac <> bc OR a1 > b2 OR b1 > a2 THEN 1 ELSE (a1 < b1)::INT + (a2 > b2)::INT END AS pieces FROM p""")
def range_functions(spark, sf):
    start = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    a = R.Span(F.col("ac"), F.col("a1"), F.col("a2"))
    b = R.Span(F.col("bc"), F.col("b1"), F.col("b2"))
    rows = _t(spark, sf, "lineitem").join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_linestatus").alias("ac"), start.alias("a1"), (start + F.col("l_quantity").cast("bigint") - 1).alias("a2"),
        F.col("o_orderstatus").alias("bc"), (F.col("o_orderkey") * 16).alias("b1"), (F.col("o_orderkey") * 16 + F.col("o_custkey") % 40).alias("b2"))
    return rows.select("a1", "a2", "b1", "b2", R.distance(a, b).alias("distance"), R.overlap_size(a, b).alias("shared"), R.compare(a, b).alias("cmp"), R.adjacent(a, b).alias("adjacent"),
                       R.to_text(a).alias("text"), R.hull(a, b)["start"].alias("hull_start"), F.size(R.difference(a, b)).alias("pieces"))


# sequences ------------------------------------------------------------------------------------------

@query("SELECT doc_id, md5(reverse(translate(text, 'ACTGUNXactgunx', 'TGACANXtgacanx'))) AS rc FROM documents")
def reverse_complement(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(S.rc("text")).alias("rc"))


@query("""SELECT least(CAST(floor(len(regexp_replace(upper(text), '[^GC]', '', 'g')) / len(text) * 20) AS INT), 19) AS bin, count(*) AS n FROM documents WHERE len(text) > 0 GROUP BY 1""")
def gc_histogram(spark, sf):
    return _t(spark, sf, "documents").where("length(text) > 0").groupBy(S.gc_bin("text", 20).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_name AS s, unnest(range(1, len(p_name) - 2)) AS i FROM part WHERE len(p_name) >= 4) SELECT substr(s, i, 4) AS kmer, count(*) AS n FROM p GROUP BY 1""")
def kmer_counts(spark, sf):
    return _t(spark, sf, "part").select(F.explode(S.kmers("p_name", 4)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def _reads(spark, sf):
    """SAM lines of items: a clipped read with an insertion, an intron and a deletion."""
    q = F.col("l_quantity").cast("bigint")
    cigar = F.format_string("%dS%dM2I%dM%dN9M1D4M", F.col("l_linenumber"), q + 9, q + 1, q * 4)
    flag = F.when(F.col("l_returnflag") == "R", 16).otherwise(0)
    return _t(spark, sf, "lineitem").select(S.once(F.format_string(
        "r%d/%d\t%d\t%s\t%d\t%d\t%s\t*\t0\t0\t*\t*\tNH:i:%d", F.col("l_orderkey"), F.col("l_linenumber"), flag, F.col("l_linestatus"), F.col("l_orderkey") * 10 + 10, F.col("l_suppkey") % 60,
        cigar, F.col("l_linenumber"))).alias("value"))


_READS = """q AS (SELECT 'r' || l_orderkey || '/' || l_linenumber AS qname, CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END::BIGINT AS flag, l_linestatus AS rname, l_orderkey * 10 + 10 AS pos,
  l_suppkey % 60 AS mapq, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS k FROM lineitem)"""


@query(f"""WITH {_READS} SELECT qname, flag, rname, pos, mapq, k::VARCHAR AS nh, pos + 2 * q + 9 + 1 + q * 4 + 13 AS target_end, k + 2 * q + 10 + 2 + 13 AS query_length,
  2 * q + 10 + 13 AS aligned, 4::INT AS blocks, q * 4 >= 68 AS spliced FROM q""")
def sam_alignments(spark, sf):
    sam = text.parse_sam(_reads(spark, sf))
    return sam.select("qname", "flag", "rname", "pos", "mapq", F.col("tags")["NH"]["value"].alias("nh"), (F.col("pos") + S.target_span("cigar") - 1).alias("target_end"),
                      S.query_length("cigar").alias("query_length"), S.aligned_bases("cigar").alias("aligned"), F.size(S.cigar_blocks("pos", "cigar")).alias("blocks"),
                      S.has_junction("cigar").alias("spliced"))


@query(f"""WITH {_READS}, j AS (SELECT rname AS chr, pos + 2 * q + 9 AS "left", pos + 6 * q + 10 AS "right", qname AS read, pos FROM q WHERE q * 4 >= 68)
  SELECT chr, "left", "right", count(DISTINCT read) AS reads, count(DISTINCT pos) AS positions, 0::BIGINT AS width FROM j GROUP BY 1, 2, 3""")
def read_junction_support(spark, sf):
    from lociframe.plans.tools import read_junctions

    sam = text.parse_sam(_reads(spark, sf))
    j = read_junctions(sam).withColumn("strand", F.lit("+"))
    mapped = sam.groupBy(F.col("qname").alias("read")).agg(F.count("*").alias("mappings"))
    return stats.junction_support(j, mapped).select("chr", "left", "right", "reads", "positions", "width")


@query(f"""WITH {_READS}, e AS (SELECT rname AS chr, unnest(CASE WHEN q * 4 >= 68 THEN [{{'s': pos, 'e': pos + 2 * q + 9}}, {{'s': pos + 6 * q + 10, 'e': pos + 6 * q + 23}}]
    ELSE [{{'s': pos, 'e': pos + 6 * q + 23}}] END) AS x FROM q),
  v AS (SELECT chr, x.s AS s, x.e AS e FROM e), {_bases('b', 'v')}, d AS (SELECT chr, p, count(*) AS depth FROM b GROUP BY chr, p) """ + _RUNS.format(v=", depth", k=", depth", t="d"))
def alignment_depth(spark, sf):
    from lociframe.plans.tools import aligned_transcripts, exon_rows

    return intervals.coverage(exon_rows(aligned_transcripts(text.parse_sam(_reads(spark, sf)))))


@query("SELECT l_linestatus AS chr, l_orderkey + 1 AS \"start\", l_orderkey + CAST(l_quantity AS BIGINT) AS \"end\", l_returnflag || chr(9) || l_linenumber AS extra FROM lineitem")
def bed_lines(spark, sf):
    q = F.col("l_quantity").cast("bigint")
    lines = _t(spark, sf, "lineitem").select(F.concat_ws("\t", "l_linestatus", "l_orderkey", F.col("l_orderkey") + q, "l_returnflag", "l_linenumber").alias("value"))
    return text.parse_bed(lines)


@query("""SELECT l_linestatus AS seqname, l_orderkey AS "start", l_orderkey + l_linenumber AS "end", CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
  'g' || l_suppkey AS gene_id, 't' || l_partkey AS transcript_id, NULL::VARCHAR AS score FROM lineitem""")
def gtf_lines(spark, sf):
    lines = _t(spark, sf, "lineitem").select(F.format_string(
        '%s\tsrc\texon\t%d\t%d\t.\t%s\t.\tgene_id "g%d"; transcript_id "t%d";', F.col("l_linestatus"), F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_linenumber"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+"), F.col("l_suppkey"), F.col("l_partkey")).alias("value"))
    a = F.col("attribute")
    return text.parse_gtf(lines).select("seqname", "start", "end", "strand", a["gene_id"].alias("gene_id"), a["transcript_id"].alias("transcript_id"), "score")


@query(f"""WITH {TX} SELECT tx.id::VARCHAR AS name, tx.gene::VARCHAR AS gene_name, tx.chr, tx.strand, tx.s AS "start", tx.e AS "end", tx.n::INT AS exons, tx.len AS length,
  coalesce((SELECT string_agg(a.chr || ':' || a.e || '/' || a.chr || ':' || b.s, ';' ORDER BY a.s) FROM ex a JOIN ex b ON a.id = b.id AND b.i = a.i + 1 WHERE a.id = tx.id), '') AS junctions FROM tx""")
def gpd_roundtrip(spark, sf):
    tx = text.parse_gpd(sinks.gpd(transcripts(spark, sf)))
    return tx.select("name", "gene_name", "chr", "strand", "start", "end", F.size("exons").alias("exons"), T.length("exons").alias("length"), T.junction_string("chr", "exons").alias("junctions"))


@query(f"""WITH {TX} SELECT id::VARCHAR AS "qName", len AS "qSize", s - 1 AS "tStart", e AS "tEnd", n AS "blockCount", len AS matches FROM tx""")
def fake_psl(spark, sf):
    return text.valid_psl(text.parse_psl(sinks.psl(sinks.fake_psl(transcripts(spark, sf))))).select("qName", "qSize", "tStart", "tEnd", "blockCount", "matches")


@query(f"""WITH {TX} SELECT tx.id::VARCHAR AS name, tx.chr, ex.i::INT AS exon, ex.s AS "start", ex.e AS "end" FROM tx JOIN ex ON ex.id = tx.id""")
def bed12_exons(spark, sf):
    bed = text.parse_bed12(sinks.bed12(sinks.gpd_bed12(transcripts(spark, sf))))
    return bed.select("name", F.col("chrom").alias("chr"), F.posexplode("exons").alias("exon", "e")).select("name", "chr", "exon", F.col("e.start").alias("start"), F.col("e.end").alias("end"))


@query("""SELECT o_orderstatus AS chrom, o_orderkey AS pos, o_custkey::VARCHAR AS dp, floor(o_totalprice)::BIGINT AS qual FROM orders""")
def vcf_lines(spark, sf):
    lines = _t(spark, sf, "orders").select(F.concat_ws("\t", "o_orderstatus", "o_orderkey", F.lit("."), F.lit("A"), F.lit("C"), F.floor("o_totalprice"), F.lit("PASS"),
                                                       F.concat(F.lit("DP="), "o_custkey", F.lit(";DB"))).alias("value"))
    return text.parse_vcf(lines).select("chrom", "pos", F.col("info")["DP"].alias("dp"), F.col("qual").cast("bigint").alias("qual"))


@query("""SELECT 'o' || o_orderkey AS name, o_custkey::VARCHAR AS sam, o_custkey::VARCHAR AS vcf, o_custkey::VARCHAR AS gff FROM orders""")
def repeated_keys(spark, sf):
    """Odd lines that give a key twice: the last value stays."""
    o = _t(spark, sf, "orders")
    name = F.concat(F.lit("o"), "o_orderkey")
    sam = text.parse_sam(o.select(F.concat_ws("\t", name, *map(F.lit, "0 c 1 9 1M * 0 0 A I".split()), F.lit("NH:i:0"), F.lit("XX:Z:a"), F.concat(F.lit("NH:i:"), "o_custkey")).alias("value")))
    vcf = text.parse_vcf(o.select(F.concat_ws("\t", F.lit("c"), F.lit("1"), name, *map(F.lit, "A C 9 PASS".split()), F.concat(F.lit("DP=0;DB;DP="), "o_custkey")).alias("value")))
    gff = text.parse_gff3(o.select(F.concat_ws("\t", F.lit("c"), *map(F.lit, "s gene 1 9 . + .".split()), F.concat(F.lit("ID="), name, F.lit(";n=0;n="), "o_custkey")).alias("value")))
    return (sam.select(F.col("qname").alias("name"), F.col("tags")["NH"]["value"].alias("sam"))
            .join(vcf.select(F.col("id").alias("name"), F.col("info")["DP"].alias("vcf")), "name")
            .join(gff.select(F.col("attribute")["ID"].alias("name"), F.col("attribute")["n"].alias("gff")), "name"))


# transcripts ----------------------------------------------------------------------------------------

@query(f"""WITH {EXONS}, g AS (SELECT *, s - lag(e) OVER (PARTITION BY id ORDER BY s) - 1 AS gap FROM x),
  r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s) AS run FROM g)
  SELECT id::VARCHAR AS name, min(s) AS "start", max(e) AS "end" FROM r GROUP BY id, run""")
def smoothed_exons(spark, sf):
    return transcripts(spark, sf).select("name", F.explode(T.smooth("exons", 40)).alias("e")).select("name", F.col("e.start").alias("start"), F.col("e.end").alias("end"))


@query(f"""WITH {EXONS}, b AS (SELECT id, strand, unnest(range(s, e + 1)) AS p FROM x),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN strand = '+' THEN p ELSE -p END) - 1 AS o FROM b),
  k AS (SELECT *, p - row_number() OVER (PARTITION BY id ORDER BY p) AS g FROM r WHERE o >= 10 AND o < 75)
  SELECT id::VARCHAR AS name, min(p) AS "start", max(p) AS "end" FROM k GROUP BY id, g""")
def sliced_exons(spark, sf):
    return transcripts(spark, sf).select("name", F.explode(T.slice_sequence("exons", "strand", 10, 75)).alias("e")).select("name", F.col("e.start").alias("start"), F.col("e.end").alias("end"))


_MATCHES = f"""WITH {EXONS}, m AS (SELECT a.id AS a, b.id AS b, a.i, b.i AS j, a.n AS na, b.n AS nb, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS o, greatest(a.e - a.s, b.e - b.s) + 1 AS len
    FROM ex a JOIN ex b ON a.chr = b.chr AND a.gene = b.gene AND a.s <= b.e AND b.s <= a.e),
  ok AS (SELECT * FROM m WHERE CASE WHEN na = 1 OR nb = 1 THEN o >= {{single}} AND o / len >= 0.5
    WHEN i = 0 OR j = 0 OR i = na - 1 OR j = nb - 1 THEN o >= 10 ELSE o >= 10 AND o / len >= 0.8 END),
  d AS (SELECT *, i - lag(i) OVER w AS di, j - lag(j) OVER w AS dj FROM ok WINDOW w AS (PARTITION BY a, b ORDER BY i, j)),
  p AS (SELECT a, b, any_value(na) AS na, any_value(nb) AS nb, count(*) AS n, coalesce(max(di), 1) = 1 AND coalesce(max(dj), 1) = 1 AS run,
    arg_min(i, i * 1000 + j) = 0 AS sa, arg_min(j, i * 1000 + j) = 0 AS sb, arg_max(i, i * 1000 + j) = any_value(na) - 1 AS ea, arg_max(j, i * 1000 + j) = any_value(nb) - 1 AS eb FROM d GROUP BY a, b)"""


@query(_MATCHES.format(single=20) + """ SELECT a, b, n::INT AS matches,
  CASE WHEN NOT run THEN 0 WHEN sa AND ea AND sb AND eb THEN 1 WHEN sb AND eb THEN 2 WHEN sa AND ea THEN 3 ELSE 0 END AS subset,
  run AND (sa OR sb) AND (ea OR eb) AS compatible FROM p""")
def exon_relations(spark, sf):
    tx = transcripts(spark, sf)
    both = compare.compared(tx, tx, need_run=False, single_least=20)
    rel = compare.relation("matches", F.size("a_exons"), F.size("b_exons"))
    return both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.size("matches").alias("matches"), rel["subset"].alias("subset"), rel["compatible"].alias("compatible"))


@query()
def annotate_reads(spark, sf):
    tx = transcripts(spark, sf).withColumn("line", F.col("id"))
    return compare.annotate(tx, tx.withColumn("exons", T.smooth("exons", 30)))


@query()
def reannotated(spark, sf):
    tx = transcripts(spark, sf)
    return compare.reannotate(tx, tx.withColumn("exons", T.smooth("exons", 30)).where(F.col("strand") == "+")).drop("exons")


@query(f"""WITH {EXONS}, j AS (SELECT a.id, a.chr, a.i, a.n, a.e AS l, b.s AS r FROM ex a JOIN ex b ON a.id = b.id AND b.i = a.i + 1)
  SELECT a.id::VARCHAR AS a, b.id::VARCHAR AS b FROM j a JOIN j b ON a.chr = b.chr AND a.n = b.n AND a.i = b.i AND abs(a.l - b.l) <= 15 AND abs(a.r - b.r) <= 15
  GROUP BY a.id, b.id HAVING count(*) = any_value(a.n) - 1""")
def compatible_layouts(spark, sf):
    tx = transcripts(spark, sf)
    return compare.compatible(tx, tx, 15)


@query(f"""WITH {EXONS}, j AS (SELECT a.id, a.chr, a.i, a.strand, a.e AS l, b.s AS r FROM ex a JOIN ex b ON a.id = b.id AND b.i = a.i + 1),
  known AS (SELECT DISTINCT chr, l, r FROM j WHERE strand = '+')
  SELECT a.id::VARCHAR AS name, a.chr, a.l AS left1, a.r AS right1, b.l AS left2, b.r AS right2 FROM j a JOIN j b ON a.id = b.id AND b.i = a.i + 1
  WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.chr = a.chr AND k.l = a.l AND k.r = a.r) OR NOT EXISTS (SELECT 1 FROM known k WHERE k.chr = b.chr AND k.l = b.l AND k.r = b.r)""")
def unsupported_junction_pairs(spark, sf):
    tx = transcripts(spark, sf)
    known = tx.where("strand = '+'").select("chr", F.explode(T.junctions("exons")).alias("j")).select("chr", "j.left", "j.right")
    return compare.unsupported_pairs(tx, known)


@query(f"""WITH {EXONS}, j AS (SELECT a.id * 100 + a.i AS id, a.chr, a.strand, a.e AS l, b.s AS r FROM ex a JOIN ex b ON a.id = b.id AND b.i = a.i + 1),
  known AS (SELECT DISTINCT chr, l, r FROM j WHERE strand = '+')
  SELECT a.id, k.l AS ref_left, k.r AS ref_right, abs(a.l - k.l) + abs(a.r - k.r) AS gap FROM j a JOIN known k ON a.chr = k.chr AND abs(a.l - k.l) <= 10 AND abs(a.r - k.r) <= 10
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY gap, k.l, k.r) = 1""")
def nearest_junctions(spark, sf):
    j = transcripts(spark, sf).select("id", "chr", "strand", F.posexplode(T.junctions("exons")).alias("i", "j")).select((F.col("id") * 100 + F.col("i")).alias("id"), "chr", "strand", "j.left", "j.right")
    known = j.where("strand = '+'").select("chr", "left", "right", "strand").distinct()
    return compare.nearest_junction(j.drop("strand"), known).select("id", "ref_left", "ref_right", "gap")


@query()
def transcript_loci(spark, sf):
    return compare.partition_loci(transcripts(spark, sf), "compatible", single_least=20)


@query()
def nonredundant_transcripts(spark, sf):
    return assembly.nonredundant(transcripts(spark, sf), least_support=1, end_support=1, downsample=0).drop("exons")


@query()
def consensus_transcripts(spark, sf):
    return assembly.consensus(transcripts(spark, sf)).drop("exons")


@query(f"""WITH {EXONS}, l AS (SELECT id, any_value(chr) AS chr, any_value(strand) AS strand, list([s, e] ORDER BY s) AS lay FROM x GROUP BY id)
  SELECT min(id::VARCHAR) AS name, chr, strand, count(*) AS support FROM l GROUP BY chr, strand, lay""")
def distinct_layouts(spark, sf):
    return assembly.layouts(transcripts(spark, sf)).select("name", "chr", "strand", "support")


@query("""WITH d AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', 'N', 'g')) AS t, len(text) AS n FROM documents WHERE len(text) > 0),
  e AS (SELECT doc_id, CASE WHEN n < 3 THEN t ELSE substr(t, 1, (n // 3)::INT) || substr(t, (n // 2 + 1)::INT, (n - n // 2)::INT) END AS s FROM d)
  SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN s ELSE reverse(translate(s, 'ACTGUNXactgunx', 'TGACANXtgacanx')) END) AS seq FROM e""")
def fetched_sequences(spark, sf):
    """Two exons of each whole text: its first third and its second half; a text under 3 characters is one exon."""
    docs = _t(spark, sf, "documents").where("length(text) > 0")
    seqs = docs.select(F.col("doc_id").cast("string").alias("name"), F.regexp_replace("text", "[^A-Za-z]", "N").alias("seq"))
    n, exon = F.length("text").cast("bigint"), lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
    exons = F.when(n < 3, F.array(exon(F.lit(1), n))).otherwise(F.array(exon(F.lit(1), F.floor(n / 3)), exon(F.floor(n / 2) + 1, n)))
    tx = docs.select(F.col("doc_id").cast("string").alias("name"), F.col("doc_id").cast("string").alias("chr"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), exons.alias("exons"))
    return genome.spliced(tx, genome.chunked(seqs, 1000), 1000).select(F.col("name").cast("bigint").alias("doc_id"), F.md5("seq").alias("seq"))


# selection ------------------------------------------------------------------------------------------

@query("""SELECT conv_id, turn, role, len(text) AS size FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY len(text) DESC, turn) = 1""")
def best_of_group(spark, sf):
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("size"))
    return selection.best(rows, ["conv_id"], -F.col("size"), "turn")


@query("""WITH r AS (SELECT l_orderkey AS molecule, l_linenumber AS line, l_partkey AS part, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS tier, CAST(l_quantity AS BIGINT) AS size,
    l_suppkey::VARCHAR AS name FROM lineitem),
  b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY molecule ORDER BY tier, size DESC, name) = 1)
  SELECT r.molecule, r.line, r.part, r.tier, r.size, r.name FROM r JOIN b ON r.molecule = b.molecule AND r.tier = b.tier AND r.name = b.name""")
def best_molecules(spark, sf):
    tier = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("molecule"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), tier.alias("tier"),
                                            F.col("l_quantity").cast("bigint").alias("size"), F.col("l_suppkey").cast("string").alias("name"))
    return selection.best_by_tier(rows, "molecule", "tier", "size", "name")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) <= 3""")
def capped_duplicates(spark, sf):
    return selection.cap(_t(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], 3, "l_orderkey", "l_linenumber")


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_name) AS n FROM part)
  SELECT p_partkey, CASE WHEN n > 1 THEN p_name || '[' || i || '/' || n || ']' ELSE p_name END AS unique_name FROM w""")
def unique_names(spark, sf):
    return selection.numbered_names(_t(spark, sf, "part"), "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def in_name_list(spark, sf):
    names = _t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return selection.in_list(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", names, "c_custkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def not_in_name_list(spark, sf):
    names = _t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return selection.in_list(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", names, "c_custkey", invert=True)


@query("""WITH d AS (SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text) SELECT doc_id, copies FROM d""")
def distinct_documents(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("layout"))
    return selection.distinct_layouts(docs, ["layout"], "doc_id").select("doc_id", "copies")


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
  t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_orderkey, l_linenumber) AS i FROM r),
  d AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, i <= 5 ORDER BY md5('7|' || l_orderkey || '|' || l_linenumber || '|' || q), l_orderkey, l_linenumber, q) AS k FROM t)
  SELECT l_suppkey, l_orderkey, l_linenumber, q FROM d WHERE i <= 5 OR k <= 5""")
def longest_and_random(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    return selection.sample(rows, ["l_suppkey"], 5, 5, "q", 7, "l_orderkey", "l_linenumber", "q")


@query("""WITH n AS (SELECT DISTINCT o_custkey FROM orders), c AS (SELECT o_custkey FROM n ORDER BY md5('3|' || o_custkey), o_custkey LIMIT 50)
  SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM c)""")
def drawn_names(spark, sf):
    return selection.draw_names(_t(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 50, 3)


# statistics -----------------------------------------------------------------------------------------

@query("""SELECT o_orderstatus, count(*) AS n, round(avg(x), 6) AS mean, median(x) AS median, round(stddev_samp(x), 6) AS stddev, round(stddev_pop(x), 6) AS stddev_pop
  FROM (SELECT o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders) GROUP BY 1""")
def described(spark, sf):
    rows = _t(spark, sf, "orders").select("o_orderstatus", F.floor("o_totalprice").alias("x"))
    return stats.describe(rows, "x", ("o_orderstatus",)).select("o_orderstatus", "n", F.round("mean", 6).alias("mean"), "median", F.round("stddev", 6).alias("stddev"), F.round("stddev_pop", 6).alias("stddev_pop"))


@query("""WITH v AS (SELECT o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders), c AS (SELECT *, sum(x) OVER (PARTITION BY o_orderstatus ORDER BY x) AS upto, sum(x) OVER (PARTITION BY o_orderstatus) AS total FROM v)
  SELECT o_orderstatus, min(x) AS n50 FROM c WHERE upto * 2 > total GROUP BY 1""")
def n50(spark, sf):
    rows = _t(spark, sf, "orders").select("o_orderstatus", F.floor("o_totalprice").alias("x"))
    return stats.n50(rows, "x", ("o_orderstatus",))


@query("""WITH v AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_orderkey * 100 + l_linenumber AS k FROM lineitem), m AS (SELECT l_suppkey, avg(q) AS mean FROM v GROUP BY 1)
  SELECT l_suppkey, q AS nearest FROM v JOIN m USING (l_suppkey) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(q - mean), k) = 1""")
def nearest_to_mean(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"))
    return stats.nearest_to_mean(rows, "q", "k", ("l_suppkey",))


@query("""WITH v AS (SELECT l_returnflag, CAST(floor(l_extendedprice) AS BIGINT) AS x FROM lineitem), s AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM v),
  p AS (SELECT unnest([5, 50, 95]) AS percent) SELECT l_returnflag, percent, x AS value FROM s, p WHERE i = (percent * n) // 100""")
def percentiles(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_returnflag", F.floor("l_extendedprice").alias("x"))
    return stats.index_percentiles(rows, "x", [5, 50, 95], ("l_returnflag",))


@query("""WITH v AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS x FROM lineitem), s AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY x) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM v)
  SELECT l_returnflag, round(avg(x), 6) AS trimmed_mean FROM s WHERE i <= floor(n * 0.95) GROUP BY 1""")
def trimmed_mean(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("x"))
    return stats.trimmed_mean(rows, "x", 0.05, ("l_returnflag",)).select("l_returnflag", F.round("trimmed_mean", 6).alias("trimmed_mean"))


@query("""WITH c AS (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS n FROM lineitem GROUP BY 1), r AS (SELECT p_partkey, p_brand, coalesce(n, 0) AS reads, (p_size + 100) AS len FROM part LEFT JOIN c ON p_partkey = l_partkey),
  t AS (SELECT sum(reads / len) AS rates, sum(reads) AS total FROM r), g AS (SELECT *, reads / len * 1e6 / rates AS tpm, reads / len * 1e9 / total AS fpkm FROM r, t)
  SELECT p_partkey, reads, round(tpm, 4) AS tpm, round(fpkm, 4) AS fpkm, round(sum(tpm) OVER (PARTITION BY p_brand), 3) AS gene_tpm FROM g""")
def expression(spark, sf):
    c = _t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("n"))
    rows = _t(spark, sf, "part").join(c, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_brand", F.coalesce("n", F.lit(0)).alias("reads"), (F.col("p_size") + 100).alias("len"))
    out = stats.expression(rows, "p_partkey", "len", "reads", "p_brand")
    return out.select("p_partkey", "reads", F.round("tpm", 4).alias("tpm"), F.round("fpkm", 4).alias("fpkm"), F.round("gene_tpm", 3).alias("gene_tpm"))


@query(f"""WITH {IV}, {_bases('b', 'iv')}, d AS (SELECT chr, p, count(*) AS depth FROM b GROUP BY chr, p), h AS (SELECT depth, count(*) AS n FROM d GROUP BY 1),
  u AS (SELECT depth, sum(n) OVER (ORDER BY depth DESC) AS upto, sum(n) OVER () AS total FROM h),
  c AS (SELECT unnest([50, 250, 500, 2500, 5000, 25000, 50000, 250000, 500000, 2500000, 5000000, 25000000, 50000000, 250000000, 500000000]) AS lim),
  w AS (SELECT depth, upto, total, (SELECT count(*) FROM c WHERE lim < total) AS z, (SELECT count(*) FROM c WHERE lim < upto) AS below FROM u),
  s AS (SELECT chr, p, z + 1 - below AS strata FROM d JOIN w USING (depth)) """ + _RUNS.format(v=", any_value(strata)::INT AS strata", k=", strata", t="s"))
def coverage_strata(spark, sf):
    return stats.strata(intervals.coverage(items(spark, sf)))


@query(f"""WITH {IV}, {_bases('b', 'iv')}, d AS (SELECT chr, p, count(*) AS depth FROM b GROUP BY chr, p), h AS (SELECT depth, count(*) AS n FROM d GROUP BY 1),
  u AS (SELECT depth, n, sum(n) OVER (ORDER BY depth) - n AS before, sum(n) OVER () AS total FROM h)
  SELECT depth, n AS bases, least(floor(before * 4 / total) + 1, 4)::INT AS strata FROM u""")
def equal_strata(spark, sf):
    rows = stats.equal_strata(intervals.coverage(items(spark, sf)), 4)
    return rows.groupBy("depth", "strata").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))


@query(f"""WITH {IV}, {IW}, {_bases('b', 'iv')}, d AS (SELECT chr, p, count(*) AS depth FROM b GROUP BY chr, p), {_bases('c', 'iw')}, f AS (SELECT chr, p, count(*) AS depth FROM c GROUP BY chr, p),
  t AS (SELECT unnest([1, 2, 4]) AS t), pr AS (SELECT a.t AS a_least, b.t AS b_least FROM t a JOIN t b ON a.t >= b.t)
  SELECT a_least::BIGINT AS a_least, b_least::BIGINT AS b_least, (SELECT count(*) FROM d WHERE depth >= a_least) AS a_size, (SELECT count(*) FROM f WHERE depth >= b_least) AS b_size,
    (SELECT count(*) FROM d JOIN f ON d.chr = f.chr AND d.p = f.p WHERE d.depth >= a_least AND f.depth >= b_least) AS overlap FROM pr""")
def depth_threshold_overlap(spark, sf):
    return stats.depth_overlap(intervals.coverage(items(spark, sf)), intervals.coverage(spans(spark, sf)), [1, 2, 4]).drop("bias")


@query(f"""WITH {EXONS}, {IW}, {_bases('c', 'iw')}, f AS (SELECT chr, p, count(*) AS depth FROM c GROUP BY chr, p),
  b AS (SELECT id, chr, strand, unnest(range(s, e + 1)) AS p FROM x),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN strand = '-' THEN -p ELSE p END) - 1 AS o, count(*) OVER (PARTITION BY id) AS n FROM b),
  g AS (SELECT id, n, o * 10 // n AS bin, sum(depth) AS s FROM r JOIN f ON r.chr = f.chr AND r.p = f.p GROUP BY ALL)
  SELECT id::VARCHAR AS name, bin::INT AS bin, round(s / greatest(ceil((bin + 1) * n / 10) - ceil(bin * n / 10), 1), 6) AS mean_depth FROM g""")
def positional_bias(spark, sf):
    return stats.position_bias(intervals.coverage(spans(spark, sf)), transcripts(spark, sf), 10).withColumn("mean_depth", F.round("mean_depth", 6))


@query("""WITH r AS (SELECT l_partkey AS label, (l_orderkey * 100 + l_linenumber)::VARCHAR AS read, unnest(range(1, 6)) AS trial FROM lineitem),
  u AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY substr(md5('1|' || trial || '|' || read), 1, 13), read) AS n FROM r),
  k AS (SELECT z.size, trial, count(DISTINCT label) AS k FROM u JOIN (SELECT unnest([100, 1000, 10000]) AS size) z ON n <= z.size GROUP BY 1, 2)
  SELECT size::BIGINT AS size, floor(sum(k) / 5)::BIGINT AS found FROM k GROUP BY 1""")
def rarefaction(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("label"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("read"))
    return stats.rarefaction(rows, "label", "read", [100, 1000, 10000], trials=5)


@query("""SELECT l_linestatus AS chr, l_suppkey AS "left", l_suppkey + 100 AS "right", CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, sum(CAST(l_quantity AS BIGINT))::BIGINT AS reads,
  max(l_linenumber)::INT AS width, max(l_linenumber)::INT AS positions, count(*) AS unique_reads, 0::BIGINT AS multi_reads FROM lineitem GROUP BY 1, 2, 3, 4""")
def combined_junctions(spark, sf):
    rows = _t(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("chr"), F.col("l_suppkey").alias("left"), (F.col("l_suppkey") + 100).alias("right"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
        F.col("l_quantity").cast("bigint").alias("reads"), F.col("l_linenumber").alias("width"), F.col("l_linenumber").alias("positions"), F.lit(1).alias("unique_reads"), F.lit(0).alias("multi_reads"))
    return stats.combine_junctions(rows)


@query("""WITH c AS (SELECT p_name AS q, unnest(range(1, len(p_name) + 1)) AS i FROM part) SELECT (i - 1)::INT AS pos, substr(q, i, 1) AS qual, count(*) AS reads FROM c GROUP BY 1, 2""")
def quality_profile(spark, sf):
    return stats.quality_profile(_t(spark, sf, "part").select(F.col("p_name").alias("qual")))


# graphs, simulation, streams ------------------------------------------------------------------------

@query("""SELECT l_orderkey * 16 + l_linenumber AS node, min(l_orderkey * 16 + l_linenumber) OVER (PARTITION BY l_orderkey) AS component
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) QUALIFY count(*) OVER (PARTITION BY l_orderkey) > 1""")
def graph_chains(spark, sf):
    """Components of all lines: each line is linked to the next one of its order."""
    e = _t(spark, sf, "lineitem").select(F.col("l_orderkey"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("src"))
    return graph.connected_components(e.withColumn("dst", F.lead("src").over(Window.partitionBy("l_orderkey").orderBy("src"))))


@query()
def graph_components(spark, sf):
    """Components of parts and orders over all lines; tested against union-find."""
    e = _t(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_orderkey") * 2 + 1).alias("dst"))
    return graph.connected_components(e)


def _tree(spark, sf):
    nation = _t(spark, sf, "nation").select(F.col("n_regionkey").cast("bigint").alias("src"), (F.col("n_nationkey") + 100).cast("bigint").alias("dst"))
    return nation.unionByName(_t(spark, sf, "customer").select((F.col("c_nationkey") + 100).cast("bigint").alias("src"), (F.col("c_custkey") + 1000).alias("dst")))


@query("""SELECT n_regionkey::BIGINT AS "start", n_nationkey::BIGINT + 100 AS node FROM nation UNION ALL SELECT n_regionkey::BIGINT, c_custkey + 1000 FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def graph_descendants(spark, sf):
    return graph.descendants(_tree(spark, sf), _t(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("node")))


@query("""SELECT DISTINCT n_regionkey::BIGINT AS node FROM nation""")
def graph_roots(spark, sf):
    e = _tree(spark, sf)
    return graph.roots(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), e)


@query("""WITH e AS (SELECT n_regionkey::BIGINT AS src, n_nationkey::BIGINT + 100 AS dst, n_regionkey::BIGINT AS "start" FROM nation
  UNION ALL SELECT c_nationkey::BIGINT + 100, c_custkey + 1000, n_regionkey::BIGINT FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT DISTINCT * FROM e""")
def graph_of_roots(spark, sf):
    e = _tree(spark, sf)
    return graph.root_graphs(e, _t(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("node")))[1].distinct()


@query("""WITH r AS (SELECT o_orderkey * 2 AS a, o_orderkey * 2 + 1 AS b, o_custkey * -1 - 1 AS c, o_orderkey % 3 = 0 AS ring FROM orders)
  SELECT DISTINCT CASE WHEN ring THEN a ELSE b END AS src, c AS dst FROM r UNION SELECT a, b FROM r WHERE NOT ring""")
def graph_without_cycles(spark, sf):
    """Each order's two nodes, a cycle for every third, lead to its customer."""
    o = _t(spark, sf, "orders").select((F.col("o_orderkey") * 2).alias("a"), (F.col("o_orderkey") * 2 + 1).alias("b"), (-F.col("o_custkey") - 1).alias("c"), (F.col("o_orderkey") % 3 == 0).alias("ring"))
    e = (o.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(o.where("ring").select(F.col("b").alias("src"), F.col("a").alias("dst")))
         .unionByName(o.select(F.col("b").alias("src"), F.col("c").alias("dst"))))
    return graph.merged_cycles(e.select(F.explode(F.array("src", "dst")).alias("node")), e)[1]


@query("""WITH p AS (SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, sum(CAST(l_quantity AS BIGINT))::BIGINT AS weight FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2)
  SELECT a AS src, b AS dst, weight FROM p UNION ALL SELECT b, a, weight FROM p""")
def graph_weights(spark, sf):
    return graph.linked(_t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("bigint").alias("weight")))


@query()
def simulated_reads(spark, sf):
    tx = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("source").alias("gene_name"), F.col("text").alias("seq"))
    reads, _ = sim.simulate(tx, 2000, "short", 0.01, 5)
    return reads.select("read", "name", "start", "flip", "mate1", "mate2")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS n FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  k AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT user_id, min(ts) AS "start", max(ts) AS "end", count(*) AS events FROM k GROUP BY user_id, run""")
def session_loci(spark, sf):
    return loci.session_loci(_t(spark, sf, "events").where("user_id IS NOT NULL"), "user_id", "ts", "30 minutes")


@query("""SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS "start", count(*) AS events FROM events GROUP BY 1, 2""")
def hourly_counts(spark, sf):
    return loci.tumbling(_t(spark, sf, "events"), "user_id", "ts", "1 hour")
