"""The three passes on hand-made loci, and PSL counts against a sequence."""

GPD = "gene_name string, name string, chr string, strand string, start long, end long, exons array<struct<start:long,end:long>>"


def tx(gene, name, *exons, chrom="c", strand="+"):
    return (gene, name, chrom, strand, exons[0][0], exons[-1][1], [tuple(e) for e in exons])


def test_judged(spark):
    from lociframe.operators.transcriptome import judged

    ref = spark.createDataFrame([tx("g", "r1", (100, 200), (300, 400), (500, 600)), tx("h", "s1", (5000, 5100)), tx("g", "r2", (100, 200), (300, 400))], GPD)
    reads = [tx("", "full", (110, 200), (300, 400), (500, 590)), tx("", "in", (320, 400), (500, 580)), tx("", "out", (100, 200), (300, 400), (500, 600), (700, 800)),
             tx("", "odd", (100, 200), (250, 280), (300, 400)), tx("", "one", (5010, 5100)), tx("", "small", (5095, 5300)), tx("", "far", (90_000, 90_100), (90_200, 90_300))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(reads)], GPD + ", id long")
    got = {r.name: (r.verdict, r.ref) for r in judged(df, ref).collect()}
    assert got == {"full": ("full", "r1"), "in": ("partial", "r1"), "out": ("more", "r1"), "odd": ("more", "r1"), "one": ("single", "s1"), "small": ("none", None)}
    assert {r.name: r.verdict for r in judged(df, ref, novel_loci=True).collect()}["far"] == "none"


def test_three_passes(spark):
    from lociframe.operators.transcriptome import transcriptome

    ref = spark.createDataFrame([tx("g", "r1", (100, 200), (300, 400), (500, 600)), tx("g", "r9", (4000, 4100), (4200, 4300)), tx("w", "wide", (10_000, 10_100), (30_000, 30_100))], GPD)
    longer = [tx("", f"l{i}", (100 + i, 200), (300, 400), (500, 600), (700, 800 + i)) for i in range(3)]
    novel = [tx("", f"n{i}", (12_000 + i, 12_100), (12_300, 12_400)) for i in range(3)]
    single = [tx("", "s1", (20_000, 20_100)), tx("", "s2", (20_050, 20_200))]
    reads = spark.createDataFrame([tx("", "f", (100, 200), (300, 400), (500, 600)), *longer, *novel, *single], GPD)
    got = {(r.how, r.start, r.end, len(r.exons)): r for r in transcriptome(reads, ref).collect()}
    # reads within the wide intron are of its locus; what overlaps its span is no free single exon
    assert set(got) == {("reference", 100, 600, 3), ("partial", 100, 800, 4), ("novel", 12_000, 12_400, 2)}, set(got)
    assert got["reference", 100, 600, 3].name == "r1" and got["partial", 100, 800, 4].gene_name == "g"
    assert transcriptome(reads.limit(0), ref).count() == 0


def test_psl_counts(spark, tmp_path):
    from lociframe.plans.tools import TOOLS

    genome = "ACGTACGTAC" * 30
    read = genome[10:20] + "TT" + genome[20:25] + genome[128:140]
    read = read[:3] + ("A" if read[3] != "A" else "C") + read[4:]
    (tmp_path / "g.fa").write_text(f">c x\n{genome}\n")
    (tmp_path / "r.sam").write_text("\t".join(["r", "0", "c", "11", "9", "10M2I5M103N12M", "*", "0", "0", read, "*"]) + "\n")
    (line,) = [r[0] for r in TOOLS["sam_to_psl"](spark, str(tmp_path / "r.sam"), str(tmp_path / "g.fa")).collect()]
    f = line.split("\t")
    assert [int(x) for x in f[:8]] == [26, 1, 0, 0, 1, 2, 0, 0] and f[9:13] == ["r", "29", "0", "29"] and f[13:17] == ["c", "300", "10", "140"]


def test_consensus_against_brute_force(spark):
    """Junction places clustered by single linkage, by loops."""
    import random
    from collections import Counter

    from lociframe.operators.assembly import consensus

    r = random.Random(6)
    rows = []
    for i in range(150):
        base = r.choice([[(100, 200), (300, 400), (500, 600)], [(100, 200), (340, 400)], [(4000, 4100), (4200, 4300), (4500, 4600), (4700, 4800)], [(50, 90)]])
        exons = [[s, e] for s, e in base]
        for k in range(len(exons)):
            exons[k] = [exons[k][0] + r.choice([0, 0, 0, 3, -4, 12]), exons[k][1] + r.choice([0, 0, 0, 2, -5, 30])]
        rows.append(tx("g", f"r{i:03}", *map(tuple, exons), chrom=r.choice("cd"), strand=r.choice("+-")))
    df = spark.createDataFrame(rows, GPD).repartition(3)

    def linked(values, tolerance):
        out, last = {}, None
        for v in sorted(set(values)):
            if last is None or v - last > tolerance:
                start = v
            out[v], last = start, v
        return out

    want = {}
    reads = [x for x in rows if len(x[6]) > 1]
    for key in {(x[2], x[3]) for x in reads}:
        own = [x for x in reads if (x[2], x[3]) == key]
        juncs = {x[1]: [(a[1], b[0]) for a, b in zip(x[6], x[6][1:])] for x in own}
        left = linked([j[0] for js in juncs.values() for j in js], 10)
        right = {c: linked([j[1] for js in juncs.values() for j in js if left[j[0]] == c], 10) for c in set(left.values())}
        cluster = lambda j: (left[j[0]], right[left[j[0]]][j[1]])
        n = Counter(j for js in juncs.values() for j in js)
        place = {}
        for j, k in n.items():
            c = cluster(j)
            place[c] = max(place.get(c, ((0,),)), ((k, -j[0], -j[1]), j))
        for x in own:
            chain = tuple(place[cluster(j)][1] for j in juncs[x[1]])
            w = want.setdefault((*key, chain), [0, 1 << 60, 0])
            want[(*key, chain)] = [w[0] + 1, min(w[1], x[4]), max(w[2], x[5])]
    got = {}
    for x in consensus(df, 10).collect():
        e = x.exons
        got[x.chr, x.strand, tuple((a.end, b.start) for a, b in zip(e, e[1:]))] = [x.support, x.start, x.end]
    assert got == want


def test_loci_are_reduced_one_after_the_other_in_a_task(spark):
    """Many loci in one task, families as by comparing each row with every family before it."""
    import random

    from lociframe.functions import transcripts as T
    from lociframe.operators import assembly

    r, data = random.Random(2), []
    for k in range(150):
        at, exons = 10_000 * (k // 5 + 1) + r.randrange(40), []
        for _ in range(r.choice([1, 1, 2, 3])):
            exons.append((at, at + r.choice([30, 60])))
            at = exons[-1][1] + r.choice([20, 90])
        data.append((f"n{k:03}", "g", "c", r.choice("+-"), exons[0][0], exons[-1][1], exons))
    tx = spark.createDataFrame(data, f"name string, gene_name string, chr string, strand string, start long, end long, exons {T.EXONS}")
    made = assembly.nonredundant(tx, 20, 1, 1, downsample=0)
    # a locus is no call of its own
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().analyzed().toString()

    def joins(a, b):
        j = lambda e: [(e[k][1], e[k + 1][0]) for k in range(len(e) - 1)]
        near = lambda x, y: abs(x[0] - y[0]) <= 20 and abs(x[1] - y[1]) <= 20
        if len(a) == 1:
            return any(s - 20 <= a[0][0] and a[0][1] <= e + 20 for s, e in b)
        return any(len(a) - 1 <= len(b) - 1 - k and all(near(x, y) for x, y in zip(j(a), j(b)[k:])) for k in range(len(b)))

    want, layouts = [], {}
    for name, _, _, strand, _, _, exons in data:
        layouts.setdefault((strand, tuple(exons)), []).append(name)
    loci: dict = {}
    for (strand, exons), names in sorted(layouts.items(), key=lambda x: x[0][1]):
        own = loci.setdefault(strand, [])
        if own and exons[0][0] <= own[-1][0]:
            own[-1][1].append((exons, names))
            own[-1][0] = max(own[-1][0], exons[-1][1])
        else:
            own.append([exons[-1][1], [(exons, names)]])
    for _, rows in (x for own in loci.values() for x in own):
        families: list = []
        for exons, names in sorted(rows, key=lambda x: (-len(x[0]), -sum(e - s + 1 for s, e in x[0]), x[0][0][0], min(x[1]))):
            for f in families:
                if joins(exons, f[0]):
                    f[2], f[3] = f[2] + 1, f[3] + len(names)
                    break
            else:
                families.append([exons, min(names), 1, len(names)])
        want += [(n, m, s) for _, n, m, s in families]
    assert sorted((x.name, x.members, x.support) for x in made.collect()) == sorted(want) and len(want) < len(layouts)
