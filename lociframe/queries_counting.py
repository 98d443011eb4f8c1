"""Registered queries of counts, filters and sample tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.operators import alignment, counting, genome
from lociframe.queries import EXONS, TX, _t, query, transcripts
from lociframe.sources import sinks, text


def sam(spark, sf):
    """Lines of an order as alignments of one read: mates by turns, some unaligned, some spliced."""
    q, lost = F.col("l_quantity").cast("bigint"), (F.col("l_returnflag") == "N") & (F.col("l_quantity") < 5)
    flag = F.when(F.col("l_linenumber") % 2 == 1, 66).otherwise(130) + F.when(lost, 4).otherwise(0)
    cigar = F.when(~lost, F.format_string("10M%dN%dM", q * 4, q))
    return _t(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey").alias("qname"), flag.cast("bigint").alias("flag"), F.col("l_linestatus").alias("rname"), F.col("l_suppkey").cast("bigint").alias("pos"), cigar.alias("cigar"),
        F.create_map(F.lit("NH"), F.struct(F.lit("i").alias("type"), F.col("l_linenumber").cast("string").alias("value"))).alias("tags"))


SAM = """m AS (SELECT 'o' || l_orderkey AS qname, l_linestatus AS rname, l_suppkey::BIGINT AS pos, CAST(l_quantity AS BIGINT) AS q, l_linenumber::BIGINT AS nh, l_linenumber % 2 AS odd,
  l_returnflag = 'N' AND l_quantity < 5 AS lost FROM lineitem)"""


@query(f"WITH {SAM} SELECT rname, count(DISTINCT qname) AS reads FROM m GROUP BY 1")
def read_counts(spark, sf):
    return counting.distinct_reads(sam(spark, sf), ("rname",))


@query(f"WITH {SAM} SELECT rname, count(DISTINCT qname || '.' || odd) AS mates FROM m WHERE NOT lost GROUP BY 1")
def mapped_mates(spark, sf):
    return counting.mapped_mates(sam(spark, sf), ("rname",))


@query(f"WITH {SAM} SELECT qname, CASE WHEN count(*) FILTER (NOT lost) = 0 THEN 0 ELSE greatest(count(*) FILTER (NOT lost), max(nh) FILTER (NOT lost)) END AS mappings FROM m GROUP BY 1")
def mapping_counts(spark, sf):
    return counting.mapping_counts(sam(spark, sf))


@query(f"WITH {SAM} SELECT qname, pos FROM m WHERE NOT lost AND nh = 1")
def uniquely_mapped(spark, sf):
    return counting.uniquely_mapped(sam(spark, sf)).select("qname", "pos")


@query(f"WITH {SAM} SELECT qname, coalesce(max(10 + q) FILTER (NOT lost), 0) AS bases FROM m GROUP BY 1")
def best_coverage(spark, sf):
    return counting.best_coverage(sam(spark, sf))


@query(f"""WITH {SAM}, p AS (SELECT qname, rname, min(pos) FILTER (odd = 1) AS s1, max(pos + 9 + 5 * q) FILTER (odd = 1) AS e1, min(pos) FILTER (odd = 0) AS s2, max(pos + 9 + 5 * q) FILTER (odd = 0) AS e2
  FROM m WHERE NOT lost GROUP BY ALL) SELECT qname, greatest(e2 - s1, e1 - s2) + 1 AS size FROM p WHERE s1 IS NOT NULL AND s2 IS NOT NULL""")
def insert_sizes(spark, sf):
    return counting.insert_sizes(sam(spark, sf))


@query(f"""WITH {SAM}, j AS (SELECT *, count(*) OVER (PARTITION BY rname, pos, q * 4) AS n FROM m WHERE NOT lost AND q * 4 >= 68) SELECT qname, pos, q AS "right" FROM j WHERE n >= 2""")
def junction_reads(spark, sf):
    return counting.junction_reads(sam(spark, sf), 2).select("qname", "pos", F.regexp_extract("cigar", r"(\d+)M$", 1).cast("bigint").alias("right"))


@query("""WITH r AS (SELECT p_partkey, p_name AS s FROM part), g AS (SELECT l.a, x.b, f.c FROM (SELECT unnest([0, 3]) AS a) l, (SELECT unnest([0, 4]) AS b) x, (SELECT unnest([70, 75, 80]) AS c) f),
  w AS (SELECT p_partkey, a, b, c, substr(s, (a + 1)::INT, (len(s) - a - b)::INT) AS t FROM r, g WHERE len(s) - a - b >= 3),
  k AS (SELECT p_partkey, a, b, c, len(t) AS n, len(list_filter(string_split(t, ''), lambda z: upper(z) = 'N' OR ascii(z) - 33 < c)) AS bad FROM w)
  SELECT a::INT AS l_cut, b::INT AS r_cut, c::INT AS q_floor, m::INT AS failure_limit, count(*) AS reads, sum(n)::BIGINT AS bases FROM k, (SELECT unnest([4, 8, 30]) AS m) z WHERE bad <= m GROUP BY ALL""")
def quality_grid(spark, sf):
    reads = _t(spark, sf, "part").select(F.col("p_name").alias("seq"), F.col("p_name").alias("qual"))
    return counting.quality_grid(reads, [0, 3], [0, 4], [70, 75, 80], [4, 8, 30], 3)


@query("""WITH s AS (SELECT DISTINCT 'm/' || l_orderkey AS mol, 'm/' || l_orderkey || '/' || l_linenumber || '_9' AS name, CAST(l_quantity AS BIGINT) AS n FROM lineitem WHERE l_orderkey % 3 <> 0),
  t AS (SELECT *, row_number() OVER (PARTITION BY mol ORDER BY n DESC, name) AS k FROM s)
  SELECT 'm/' || o_orderkey || '/ccs' AS name, 1::BIGINT AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT name, n FROM t WHERE k = 1""")
def ccs_and_longest(spark, sf):
    ccs = _t(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.format_string("m/%d/ccs", "o_orderkey").alias("name"), F.lit("C").alias("seq"))
    sub = _t(spark, sf, "lineitem").select(F.format_string("m/%d/%d_9", "l_orderkey", "l_linenumber").alias("name"), F.repeat(F.lit("A"), F.col("l_quantity").cast("int")).alias("seq"))
    return counting.ccs_and_longest(ccs, sub).select("name", F.length("seq").cast("bigint").alias("n"))


@query("""WITH o AS (SELECT 'r' || o_orderkey AS name, o_custkey % 50 + 1 AS c, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 60 + 1 END AS f FROM orders)
  SELECT CASE WHEN f >= c AND f * 0.8 <= c THEN name ELSE name || '|x' END AS name, CASE WHEN f >= c AND f * 0.8 <= c THEN f ELSE c END::BIGINT AS n, coalesce(f >= c AND f * 0.8 <= c, false) AS swapped FROM o""")
def swapped_reads(spark, sf):
    o = _t(spark, sf, "orders")
    corrected = o.select(F.format_string("r%d|x", "o_orderkey").alias("name"), F.repeat(F.lit("A"), (F.col("o_custkey") % 50 + 1).cast("int")).alias("seq"))
    full = o.where("o_orderkey % 4 <> 0").select(F.format_string("r%d|y", "o_orderkey").alias("name"), F.repeat(F.lit("C"), (F.col("o_orderkey") % 60 + 1).cast("int")).alias("seq"))
    return counting.swap_corrected(corrected, full, 0.8).select("name", F.length("seq").cast("bigint").alias("n"), "swapped")


@query("""SELECT o_orderkey AS pos FROM orders WHERE floor(o_totalprice) >= 1000 AND o_custkey >= 5 AND least(o_custkey % 9 + o_orderkey % 7, o_custkey % 5 + o_orderkey % 3) >= 2
  AND least(o_custkey % 9, o_orderkey % 7, o_custkey % 5, o_orderkey % 3) >= 1 AND o_orderkey % 4 <> 0 AND o_orderkey % 2 <> o_custkey % 2""")
def filtered_variants(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    info = F.format_string("DP=%d;DP4=%d,%d,%d,%d", c, c % 9, k % 7, c % 5, k % 3)
    lines = _t(spark, sf, "orders").select(F.concat_ws("\t", F.lit("c"), k, F.lit("."), F.lit("A"), F.when(k % 4 == 0, "CT").otherwise("G"), F.floor("o_totalprice"), F.lit("PASS"), info, F.lit("GT:PL"),
                                                       F.format_string("%d/%d:9", k % 2, c % 2)).alias("value"))
    return counting.filter_variants(text.parse_vcf(lines), 1000, 5, 2, 1, True).select("pos")


@query(f"WITH {TX} SELECT gene::VARCHAR AS gene_name, id::VARCHAR AS name, len AS length FROM tx")
def transcript_lengths(spark, sf):
    return counting.transcript_lengths(transcripts(spark, sf))


@query(f"WITH {TX} SELECT gene::VARCHAR AS gene_name, list_aggregate(list_sort(list_distinct(list(len))), 'string_agg', ',') AS lengths FROM tx GROUP BY 1")
def gene_lengths(spark, sf):
    return counting.gene_lengths(transcripts(spark, sf)).withColumn("lengths", F.array_join(F.col("lengths").cast("array<string>"), ","))


@query(f"""WITH {TX}, b AS (SELECT id, chr, unnest(range(s, e + 1)) AS p FROM x), d AS (SELECT chr, p, count(*) AS depth FROM b GROUP BY ALL)
  SELECT b.id::VARCHAR AS name, any_value(tx.n)::INT AS exon_count, any_value(tx.len) AS length, round(sum(d.depth) / any_value(tx.len), 6) AS coverage FROM b JOIN d ON b.chr = d.chr AND b.p = d.p JOIN tx ON tx.id = b.id GROUP BY 1""")
def mutual_coverage(spark, sf):
    return counting.mutual_coverage(transcripts(spark, sf)).withColumn("coverage", F.round("coverage", 6))


def _psl(spark, sf):
    return text.psl_blocks(text.parse_psl(sinks.psl(sinks.fake_psl(transcripts(spark, sf)))))


_SMOOTH = f"""{EXONS}, g AS (SELECT *, s - lag(e) OVER (PARTITION BY id ORDER BY s) - 1 AS gap FROM x),
  r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s) AS run FROM g), sm AS (SELECT id, chr, min(s) AS s, max(e) AS e FROM r GROUP BY id, chr, run)"""


@query(f"""WITH {_SMOOTH} SELECT chr, s AS "start", e AS "end", id::VARCHAR AS name FROM sm""")
def target_exons(spark, sf):
    return counting.target_exons(_psl(spark, sf), 20)


@query(f"""WITH {_SMOOTH}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY e - s DESC, s) AS k FROM sm)
  SELECT chr AS "tName", s - 1 AS "start", e AS "end", id::VARCHAR AS "qName", e - s + 1 AS length FROM k WHERE k = 1""")
def longest_exons(spark, sf):
    return counting.longest_exon(_psl(spark, sf), 20).drop("qSize", "tSize")


@query("""WITH d AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', 'N', 'g')) AS t FROM documents WHERE len(text) >= 20),
  s AS (SELECT doc_id, substr(t, 1, 20) AS q FROM d), g AS (SELECT doc_id, least(floor(len(regexp_replace(q, '[^GC]', '', 'g')) / 20.0 * 10), 9)::INT AS bin FROM s WHERE len(replace(q, 'N', '')) >= 10)
  SELECT bin, (doc_id % 3 + 1)::BIGINT AS depth, (count(*) * 15)::BIGINT AS bases FROM g GROUP BY ALL""")
def gc_depth(spark, sf):
    docs = _t(spark, sf, "documents").where("length(text) >= 20")
    name = F.col("doc_id").cast("string")
    seqs = docs.select(name.alias("name"), F.regexp_replace("text", "[^A-Za-z]", "N").alias("seq"))
    exons = F.array(F.struct(F.lit(1).cast("bigint").alias("start"), F.lit(20).cast("bigint").alias("end")))
    tx = docs.select(name.alias("name"), name.alias("chr"), F.lit("+").alias("strand"), exons.alias("exons"))
    depths = docs.select(name.alias("chr"), F.lit(6).cast("bigint").alias("start"), F.length("text").cast("bigint").alias("end"), (F.col("doc_id") % 3 + 1).alias("depth"))
    return counting.gc_depth(tx, depths, genome.chunked(seqs), 10, 10)


def _samples(spark, sf):
    return transcripts(spark, sf).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("sample"), F.when(F.col("id") % 4 == 0, F.concat("chr", F.lit(":1-2.1"))).otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("name"),
        F.when(F.col("id") % 4 == 0, F.concat("chr", F.lit(":1-2"))).otherwise(F.concat(F.lit("g"), F.col("id") % 20)).alias("gene_name"), "chr", "start", "end", "exons",
        (F.col("id") % 7).cast("double").alias("expression"))


_MERGED = f"""{TX}, jn AS (SELECT a.id, string_agg(a.e || '-' || b.s, ';' ORDER BY a.i) AS j FROM ex a JOIN ex b ON a.id = b.id AND b.i = a.i + 1 GROUP BY a.id),
  r AS (SELECT tx.id, chr, coalesce(j, '') AS j, s, e, CASE WHEN tx.id % 4 <> 0 THEN 't' || tx.id % 50 END AS name, CASE WHEN tx.id % 4 <> 0 THEN 'g' || tx.id % 20 END AS gene, tx.id % 7 AS x, tx.id % 3 AS sample
    FROM tx LEFT JOIN jn ON tx.id = jn.id),
  o AS (SELECT chr, j, min(name) AS n, min(gene) AS g, min(s) AS s, max(e) AS e, sum(x) FILTER (sample = 0) AS s0, sum(x) FILTER (sample = 1) AS s1, sum(x) FILTER (sample = 2) AS s2 FROM r GROUP BY chr, j),
  p AS (SELECT *, coalesce(n, chr || ':' || s || '-' || e) AS base FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY chr, j) - 1 AS k FROM p)"""


@query(f"""WITH {_MERGED} SELECT chr, j AS junctions, CASE WHEN k = 0 THEN base ELSE base || '.' || k END AS name, coalesce(g, base) AS gene_name, s AS "start", e AS "end" FROM k""")
def merged_layouts(spark, sf):
    return counting.merged_layouts(_samples(spark, sf)).drop("samples")


@query(f"""WITH {_MERGED} SELECT coalesce(g, base) AS gene_name, coalesce(sum(s0), 0)::DOUBLE AS s0, coalesce(sum(s1), 0)::DOUBLE AS s1, coalesce(sum(s2), 0)::DOUBLE AS s2 FROM k GROUP BY 1""")
def sample_table(spark, sf):
    return counting.sample_table(counting.merged_layouts(_samples(spark, sf)), "gene_name", ["s0", "s1", "s2"])


@query("""WITH g AS (SELECT o_custkey::VARCHAR AS gene, max(o_totalprice) AS f FROM orders GROUP BY 1 HAVING max(o_totalprice) >= 100000),
  i AS (SELECT o_custkey::VARCHAR AS gene, o_orderkey % 997 AS len, o_totalprice AS f FROM orders), t AS (SELECT gene, len, f, row_number() OVER (PARTITION BY gene ORDER BY f DESC, len) AS k FROM i),
  l AS (SELECT DISTINCT gene, len FROM t JOIN g USING (gene) WHERE t.k = 1 OR t.f >= 100000)
  SELECT gene AS gene_name, string_agg(len::VARCHAR, ',' ORDER BY len) AS lengths FROM l GROUP BY gene HAVING count(*) FILTER (len BETWEEN 100 AND 400) > 0""")
def expressed_genes(spark, sf):
    o = _t(spark, sf, "orders")
    gene, price = F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("double")
    out = counting.expressed_genes(o.select(gene.alias("name"), price.alias("fpkm")), o.select(gene.alias("gene_name"), (F.col("o_orderkey") % 997).alias("length"), price.alias("fpkm")), 100000.0, 100, 400)
    return out.withColumn("lengths", F.array_join(F.col("lengths").cast("array<string>"), ","))


@query("""SELECT 'g' || o_custkey AS gene, 't' || o_orderkey AS transcript, (o_orderkey % 100)::DOUBLE AS tpm, (sum(o_orderkey % 100) OVER (PARTITION BY o_custkey))::DOUBLE AS gene_tpm,
  (o_orderkey % 13)::DOUBLE AS coverage, CASE WHEN o_orderkey % 2 = 0 THEN 'R' || o_orderkey END AS reference FROM orders""")
def assembled_expression(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    own = F.concat(F.format_string('gene_id "g%d"; transcript_id "t%d"; TPM "%d"; cov "%d";', c, k, k % 100, k % 13), F.when(k % 2 == 0, F.format_string(' reference_id "R%d";', k)).otherwise(""))
    head = "c\ta\ttranscript\t1\t9\t.\t+\t.\t"
    return counting.assembled_expression(text.parse_gtf(_t(spark, sf, "orders").select(F.concat(F.lit(head), own).alias("value"))))


@query(f"""WITH {TX}, b AS (SELECT DISTINCT gene, least(len // 50 * 50, 200)::BIGINT AS low FROM tx), r AS (SELECT b.* FROM b WHERE gene % 2 = 0)
  SELECT low, count(*) AS genes, count(*) FILTER (gene % 3 = 0) AS detected, count(*) FILTER (gene % 5 = 0) AS predicted FROM r GROUP BY low""")
def identification_rate(spark, sf):
    tx = transcripts(spark, sf)
    genes = lambda n: tx.where(F.col("gene_name").cast("bigint") % n == 0).select("gene_name")
    return counting.identification_rate(counting.transcript_lengths(tx), genes(2), genes(3), genes(5), 50, 200)


@query(f"""WITH {TX} SELECT id::VARCHAR AS name, 'http://genome.ucsc.edu/cgi-bin/hgTracks?db=hg19&position=' || chr || '%3A' || s || '-' || e AS url, '240,59,32' AS colour FROM tx""")
def track_rows(spark, sf):
    bed = counting.recoloured(text.parse_bed12(sinks.bed12(sinks.gpd_bed12(transcripts(spark, sf)))), "red")
    return bed.select("name", counting.browser_url("chrom", "chromStart", "chromEnd", "hg19").alias("url"), F.array_join(F.col("itemRgb").cast("array<string>"), ",").alias("colour"))




_GROUPS = """g AS (SELECT l_orderkey AS name, l_linenumber AS k, max(l_partkey) % 3 AS t, max(l_suppkey) % 4 AS q, max(l_partkey) % 5 = 0 AS bad FROM lineitem GROUP BY ALL),
  h AS (SELECT name, k, CASE WHEN t + q = 0 THEN 1 ELSE t END AS t, q, bad AND t > 0 AND q > 0 AS bad FROM g)"""


def _groups(spark, sf):
    """Homopolymer groups: the lines of an order, of A in the target and A or C in the query."""
    g = (_t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("position"))
         .agg((F.max("l_partkey") % 3).cast("int").alias("t"), (F.max("l_suppkey") % 4).cast("int").alias("q"), (F.max("l_partkey") % 5 == 0).alias("bad")))
    g = g.withColumn("t", F.when(F.col("t") + F.col("q") == 0, 1).otherwise(F.col("t")))
    return g.select("name", "position", F.repeat(F.lit("A"), F.col("t")).alias("target"), F.repeat(F.when(F.col("bad") & (F.col("t") > 0), "C").otherwise("A"), F.col("q")).alias("query"))


def _base_sql(own: str, far: str) -> str:
    return f"""WITH {_GROUPS}, w AS (SELECT *, lag({own}) OVER o AS po, lag({far}) OVER o AS pf, lead({own}) OVER o AS no, lead({far}) OVER o AS nf,
    coalesce(sum({own}) OVER (PARTITION BY name ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, (sum({own}) OVER (PARTITION BY name))::BIGINT AS whole FROM h WINDOW o AS (PARTITION BY name ORDER BY k)),
  b AS (SELECT *, unnest(range(0, {own}) ) AS z FROM w WHERE {own} > 0), c AS (SELECT *, first + z AS i, abs({own} - {far}) AS d FROM b),
  e AS (SELECT *, CASE WHEN bad OR {far} = 0 THEN 1.0::DOUBLE ELSE least(d / {own}, 1.0)::DOUBLE END AS ob, CASE WHEN d > {own} THEN (d - {own}) / {own} ELSE 0 END AS x,
    CASE WHEN z = 0 AND i > 0 AND po = 0 THEN pf END AS b, CASE WHEN z = {own} - 1 AND i < whole - 1 AND no = 0 THEN nf END AS a FROM c),
  f AS (SELECT *, CASE WHEN b IS NOT NULL THEN 0.5 ELSE 0 END::DOUBLE AS hb, CASE WHEN a IS NOT NULL THEN 0.5 ELSE 0 END::DOUBLE AS ha FROM e)
  SELECT name, i::INT AS i, round(ob, 6) AS observable, hb + (1 - hb) * ha AS unobservable, round(ob + (1 - ob) * (hb + (1 - hb) * ha), 6) AS probability,
    round(ob + x + 0.5 * coalesce(b, 0) + 0.5 * coalesce(a, 0), 6)::DOUBLE AS errors FROM f"""


def _base_errors(spark, sf, side):
    rows = alignment.base_errors(_groups(spark, sf), side).drop("base")
    return rows.withColumns({c: F.round(c, 6) for c in ("observable", "probability", "errors")})


@query(_base_sql("q", "t"))
def query_base_errors(spark, sf):
    return _base_errors(spark, sf, "query")


@query(_base_sql("t", "q"))
def target_base_errors(spark, sf):
    return _base_errors(spark, sf, "target")
