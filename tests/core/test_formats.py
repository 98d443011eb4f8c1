"""Readers, sinks, CIGAR, transcripts, alignments, BAM and graph operators on hand-made cases."""

from pyspark.sql import functions as F

from lociframe.functions import sequence as S
from lociframe.functions import transcripts as T
from lociframe.operators import alignment, compare, genome, graph, stats
from lociframe.sources import bgzf, sinks, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_sequence_functions(spark):
    got = one(spark, S.rc(F.lit("ACGTUNXacgtunx")).alias("a"), S.phred_of_rate(F.lit(0.1)).alias("b"), S.phred_of_rate(F.lit(0.00001)).alias("c"), S.motif_strand(F.lit("GT-AG")).alias("d"),
              S.motif_strand(F.lit("CT-AC")).alias("e"), S.motif_strand(F.lit("AA-AA")).alias("f"), S.kmers(F.lit("ABCD"), 3).alias("g"), S.is_uuid4(F.lit("x")).alias("h"))
    assert tuple(got) == ("xnaacgtXNAACGT", "+", "I", "+", "-", None, ["ABC", "BCD"], False)


def test_cigar(spark):
    cigar = F.lit("3H5S10M2I5M100N7M3D4M")
    b = S.cigar_blocks(F.lit(100), cigar)
    got = one(spark, b.alias("b"), S.target_span(cigar).alias("t"), S.query_length(cigar).alias("q"), S.query_length(cigar, True).alias("o"), S.blocks_cigar(b, F.lit(33)).alias("c"),
              S.blocks_exons(b).alias("e"), S.original_query_range(cigar, F.lit("-")).alias("r"), S.has_junction(cigar, 10).alias("j"), S.has_junction(cigar, 12).alias("k"))
    assert [tuple(x) for x in got.b] == [(100, 109, 6, 15), (110, 114, 18, 22), (215, 221, 23, 29), (225, 228, 30, 33)]
    assert (got.t, got.q, got.o) == (129, 33, 36) and got.c == "5S10M2I5M100N7M3D4M"
    assert [tuple(x) for x in got.e] == [(100, 114), (215, 228)] and tuple(got.r) == (1, 28) and got.j and not got.k


def test_transcript_functions(spark):
    e = F.array(*[F.struct(F.lit(s).cast("bigint").alias("start"), F.lit(t).cast("bigint").alias("end")) for s, t in [(1, 10), (20, 30), (131, 140)]])
    got = one(spark, T.smooth(e, 68).alias("s"), T.length(e).alias("n"), T.junction_string(F.lit("c"), e).alias("j"), T.slice_sequence(e, F.lit("-"), 0, 12).alias("m"),
              T.slice_sequence(e, F.lit("+"), 9, 500).alias("p"), T.clip(e, 10, 131).alias("c"))
    pairs = lambda x: [tuple(y) for y in x]
    assert pairs(got.s) == [(1, 30), (131, 140)] and got.n == 31 and got.j == "c:10/c:20;c:30/c:131"
    assert pairs(got.m) == [(29, 30), (131, 140)] and pairs(got.p) == [(10, 10), (20, 30), (131, 140)] and pairs(got.c) == [(10, 10), (20, 30), (131, 131)]


def test_fasta_fastq_fai(spark, tmp_path):
    fa, fq = tmp_path / "a.fa", tmp_path / "a.fq"
    fa.write_text(">myval\tcheck 1>2\nAAttCC\nggATCG\nAA\n>b\nACG\n")
    got = text.read_fasta(spark, str(fa)).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("b", "b", "ACG"), ("myval", "myval\tcheck 1>2", "AAttCCggATCGAA")]
    assert [tuple(r) for r in text.fai(spark, str(fa)).orderBy("name").collect()] == [("b", 3, 37, 3, 4), ("myval", 14, 17, 6, 7)]
    fq.write_text("".join(f"@r{i} x\nACGT\n+\n@III\n" for i in range(500)) + "@last\nAC\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        reads = text.read_fastq(spark, str(fq))
        assert {r.name for r in reads.collect()} == {f"r{i}" for i in range(500)} and reads.where("seq = 'ACGT' AND qual = '@III' AND line3 = '+'").count() == 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sinks.fastq(reads.where("name = 'r7'")).first()[0] == "@r7 x\nACGT\n+\n@III"


def test_annotation(spark):
    exons = "array<struct<start:bigint,end:bigint>>"
    schema = f"line long, id long, name string, gene_name string, chr string, strand string, start long, end long, exons {exons}"
    tx = lambda i, *e: (i, i, f"t{i}", f"g{i}", "c", "+", e[0][0], e[-1][1], list(e))
    ref = spark.createDataFrame([tx(1, (1, 100), (201, 300), (401, 500)), tx(2, (201, 300), (401, 500)), tx(3, (1000, 1200))], schema)
    reads = spark.createDataFrame([tx(10, (50, 100), (201, 300), (401, 450)), tx(11, (1050, 1180)), tx(12, (1190, 1230)), tx(13, (5000, 5001))], schema)
    got = {r.read_line: (r.transcript_name, r.match_type, r.matching_exons, r.consecutive_exons) for r in compare.annotate(reads, ref).collect()}
    assert got == {10: ("t1", "full", 3, 3), 11: ("t3", "partial", 1, 1)}
    again = {r.read_name: (r.gene_name, r.how) for r in compare.reannotate(reads, ref).collect()}
    assert again["t10"] == ("g1", "junctions") and again["t11"] == ("g3", "single") and again["t13"][1] == "novel"
    assert [tuple(r) for r in compare.partition_loci(ref, "subset").orderBy("id").collect()] == [(1, 1), (2, 1), (3, 3)]


def test_alignment_rows(spark):
    blocks = [(1, 4, 1, 4), (6, 8, 5, 7), (100, 102, 9, 11)]
    df = spark.createDataFrame([("r", "+", blocks, "ACGTTTAGCCC", "ACGAGTTA" + "N" * 91 + "CCG", 1)],
                               "name string, strand string, blocks array<struct<t_start:bigint,t_end:bigint,q_start:bigint,q_end:bigint>>, query string, target_seq string, target_start long")
    s = [(r.query, r.target) for r in alignment.alignment_strings(df).orderBy("exon").collect()]
    assert s == [("ACGT-TTA", "ACGAGTTA"), ("CCC", "CCG")]
    r = alignment.alignment_stats(df).first()
    assert (r.matches, r.misMatches, r.qNumInsert, r.tNumInsert, r.tBaseInsert) == (8, 2, 0, 1, 1)
    groups = alignment.homopolymer_groups(df)
    assert {x.type: x.groups for x in alignment.error_totals(groups).collect()} == {"match": 6, "mismatch": 2, "total_deletion": 1}
    assert alignment.filled_contexts(alignment.context_errors(groups)).count() == 320
    assert alignment.global_score("ACGT", "ACT") == 15 and alignment.local_alignment("TTACGT", "GGACGTA")[:3] == (40, "ACGT", "ACGT")
    assert alignment.splice_shifts("AAG", "GTC", "GTA", "CAG") == (2, 2)


def test_bam(spark, tmp_path):
    refs = [("chr1", 10_000), ("chr2", 500)]
    rows = [{"qname": f"r{i}", "flag": 256 if i % 7 == 3 else 0, "rname": "chr1" if i % 2 else "chr2", "pos": i + 1, "mapq": i % 60, "cigar": "5M", "rnext": None, "pnext": None, "tlen": None,
             "seq": "ACGTN", "qual": "IIII!", "tags": {"NH": {"type": "i", "value": str(i)}, "XS": {"type": "Z", "value": "a b"}}} for i in range(6000)]
    raw = bgzf.encode_header("@HD\tVN:1.0\n", refs) + b"".join(bgzf.encode_record(r, {"chr1": 0, "chr2": 1}) for r in rows)
    path = tmp_path / "a.bam"
    path.write_bytes(bgzf.compress(raw, 3000))
    assert bgzf.is_bgzf(str(path)) and b"".join(bgzf.inflate(path.read_bytes()[a:a + n], True) for a, n in bgzf.block_bounds(str(path))) == raw
    for size in (1 << 30, 4000):
        got = bgzf.read_bam(spark, str(path), size)
        assert got.count() == 6000 and got.select("qname").distinct().count() == 6000
    r = got.where("qname = 'r41'").first()
    assert (r.flag, r.rname, r.pos, r.mapq, r.cigar, r.seq, r.qual, r.tags["NH"].value, r.tags["XS"].value) == (0, "chr1", 42, 41, "5M", "ACGTN", "IIII!", "41", "a b")
    assert bgzf.index(got).where("flag & 2304 = 0").count() == 6000
    bgzf.write_index(got, str(tmp_path / "a.bgi"))
    again = bgzf.read_index(spark, str(tmp_path / "a.bgi"))
    assert sorted(again.collect()) == sorted(bgzf.index(got).select(*bgzf.INDEX).collect())
    some = bgzf.primaries(again, 300, 7)
    assert some.count() == 300 and sorted(some.collect()) == sorted(bgzf.primaries(again, 300, 7).collect())
    assert sorted(r.qname for r in bgzf.records_at(some, str(path)).collect()) == sorted(r.qname for r in some.collect())
    assert bgzf.records_at(again, str(path)).drop("tags").exceptAll(got.drop("tags")).count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13, 14]], "x long")
    r = stats.describe(df, "x").first()
    assert (r["median"], r["mean"], round(r.stddev, 11)) == (7.5, 7.5, 4.54272645405) and stats.n50(df, "x").first()[0] == 11
    q = stats.expression(spark.createDataFrame([("a", 1000, 10), ("b", 2000, 20)], "n string, l long, c long"), "n", "l", "c").collect()
    assert [(x.tpm, round(x.fpkm, 2)) for x in q] == [(500000.0, 333333.33)] * 2


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.strong_components(e).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    start = spark.createDataFrame([(6,), (4,)], "node long")
    assert sorted(tuple(r) for r in graph.descendants(e, start).collect()) == [(4, 4), (4, 5), (6, 7)]
    assert sorted(r.path for r in graph.paths(e, spark.createDataFrame([(6,), (2,)], "node long")).collect()) == [[2, 3, 1], [2, 3, 4, 5], [6, 7]]


def test_sequences(spark):
    chunks = genome.chunked(spark.createDataFrame([("c", "ACGTACGTAA")], "name string, seq string"), 4)
    tx = spark.createDataFrame([("a", "c", "-", [(2, 5), (8, 9)]), ("b", "c", "+", [(1, 10)])], f"name string, chr string, strand string, exons {T.EXONS}")
    assert {r.name: r.seq for r in genome.spliced(tx, chunks, 4).collect()} == {"a": "TATACG", "b": "ACGTACGTAA"}


def test_gc_bin_takes_the_length_of_the_text_itself(spark):
    df = spark.createDataFrame([("gßßß",), ("GCat",), ("",)], "s string")
    assert [r[0] for r in df.select(S.gc_bin("s", 20)).collect()] == [5, 10, None]


def test_attributes_are_parsed_once_for_all_that_reads_them(spark):
    from lociframe.operators import counting

    lines = spark.createDataFrame([('c\ta\ttranscript\t1\t9\t.\t+\t.\tgene_id "g"; gene_id "h"; transcript_id "t"; TPM "2"; cov "3";',)], "value string")
    df = counting.assembled_expression(text.parse_gtf(lines))
    # the rows and the sums by gene, two groups of one expression each
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 4
    assert [tuple(r) for r in df.collect()] == [("h", "t", 2.0, 2.0, 3.0, None)]


def test_exons_of_batches_of_cigars_are_those_of_the_expressions(spark):
    import random

    from lociframe.plans.tools import read_junctions

    r = random.Random(3)
    odd = [(5, None), (None, "5M100N5M"), (7, ""), (9, "M5Q3M12M"), (1, "10M67N2M68N1M"), (3, "5"), (2, "0M70N4M"), (4, "é3M80N2M"), (6, "*"), (8, "12M34"), (9, "5M")]
    data = odd + [(r.randrange(1, 999), "".join(f"{r.choice([1, 9, 67, 68, 120])}{r.choice('MIDNSHP=X')}" for _ in range(r.randrange(12)))) for _ in range(300)]
    df = spark.createDataFrame([(f"r{i}", "c", *d) for i, d in enumerate(data)], "qname string, rname string, pos long, cigar string").repartition(3)
    got = df.select("qname", S.cigar_exons("pos", "cigar").alias("a"), S.blocks_exons(S.cigar_blocks("pos", "cigar")).alias("b")).collect()
    assert len(got) == len(data) and all(x.a == x.b for x in got)

    # CIGARs are read in one pass for reads and for positions
    plan = stats.junction_support(read_junctions(df).withColumn("strand", F.lit("+")), df.select(F.col("qname").alias("read"), F.lit(1).alias("mappings")))
    text_of = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text_of.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in text_of


def test_junction_support_of_reads_and_places(spark):
    rows = [("c", 1, 9, "+", "a", 5, 10), ("c", 1, 9, "+", "a", 6, 12), ("c", 1, 9, "+", "b", 5, 30), ("c", 1, 9, "+", "lost", 7, 90), ("c", 2, 9, "+", "lost", 7, 9), ("c", 3, 9, None, "a", 7, 9), (None, 3, 9, "+", "a", 7, 9)]
    j = spark.createDataFrame(rows, "chr string, left long, right long, strand string, read string, pos long, right_size long")
    got = stats.junction_support(j, spark.createDataFrame([("a", 1), ("b", 3)], "read string, mappings long")).collect()
    assert [(r.left, r.reads, r.width, r.unique_reads, r.multi_reads, r.positions, r.label) for r in got] == [(1, 2, 20, 1, 1, 3, "(2)[20_3](1/1)")]


def test_spliced_is_has_junction(spark):
    import random

    from lociframe.operators import counting

    r = random.Random(5)
    data = [(None,), ("",), ("5M68N5M",), ("68N5M",), ("5S68N5M",)] + [("".join(f"{r.choice([1, 9, 68])}{r.choice('MIDNS=')}" for _ in range(r.randrange(9))),) for _ in range(200)]
    df = spark.createDataFrame(data, "c string").repartition(2)
    assert all(x.a == x.b and x.d == x.e for x in df.select(S.spliced("c").alias("a"), S.has_junction("c").alias("b"), S.spliced("c", 9).alias("d"), S.has_junction("c", 9).alias("e")).collect())
    sam = spark.createDataFrame([("a", 0, "c", 10, "5M70N5M70N5M", 1), ("b", 0, "c", 10, "5M70N5M70N5M", 2), ("d", 0, "c", 10, "5M80N5M", 3), ("a", 0, "c", 10, "5M70N5M", 1)],
                                "qname string, flag long, rname string, pos long, cigar string, k int")
    found = counting.junction_reads(sam, 2)
    assert found.columns == sam.columns and sorted((x.qname, x.cigar) for x in found.collect()) == [("a", "5M70N5M"), ("a", "5M70N5M70N5M"), ("b", "5M70N5M70N5M")]
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
