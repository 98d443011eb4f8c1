"""Interval algebra against per-base brute force and hand-made cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociframe.functions import ranges as R
from lociframe.operators import intervals as I
from lociframe.operators import overlap as O

SCHEMA = "chr string, start long, end long"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(4)
    data = [(r.choice("ab"), s, s + r.choice([0, 1, 5, 30, 200])) for s in (r.randrange(1, 900) for _ in range(160))]
    return data, spark.createDataFrame([*data, ("a", None, 4), (None, 1, 2), ("a", 9, 3)], SCHEMA).repartition(4)


def depth_of(data):
    d = Counter()
    for c, s, e in data:
        for p in range(s, e + 1):
            d[c, p] += 1
    return d


def expand(got):
    return {(c, p): d for c, s, e, d in got for p in range(s, e + 1)}


@pytest.mark.parametrize("bin_size", [7, 64, 65536])
def test_coverage(many, bin_size):
    data, df = many
    got = rows(I.coverage(df, bin_size=bin_size))
    assert expand(got) == dict(depth_of(data))
    for a, b in zip(got, got[1:]):
        assert not (a[0] == b[0] and a[2] + 1 == b[1] and a[3] == b[3])


def brute_islands(data, gap):
    out = []
    for c, s, e in sorted(data):
        if out and out[-1][0] == c and s <= out[-1][2] + gap:
            out[-1][2] = max(out[-1][2], e)
            out[-1][3] += 1
        else:
            out.append([c, s, e, 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("bin_size", [5, 40, 65536])
@pytest.mark.parametrize("gap", [0, 1, 9])
def test_islands(many, gap, bin_size):
    data, df = many
    few = data[:60]
    small = df.sparkSession.createDataFrame(few, SCHEMA)
    assert rows(I.islands(small, gap, bin_size=bin_size)) == brute_islands(few, gap)
    if gap == 0:
        got = rows(I.with_locus(small, bin_size=bin_size))
        want = {(c, p): (s, e) for c, s, e, _ in brute_islands(few, 0) for p in range(s, e + 1)}
        assert len(got) == len(few) and all(want[c, s] == (ls, le) for c, s, _, ls, le in got)


def test_merge_cases(spark):
    df = spark.createDataFrame([("c", 1, 10), ("c", 11, 20), ("c", 22, 30)], SCHEMA)
    assert rows(I.merge(df)) == [("c", 1, 20), ("c", 22, 30)]
    assert rows(I.loci(df), "start", "end") == [(1, 10), (11, 20), (22, 30)]
    assert rows(I.coverage(df.limit(2)), "start", "end", "depth") == [(1, 20, 1)]
    assert rows(I.merge(I.merge(df))) == rows(I.merge(df))
    assert I.subtract(df, df).count() == 0 and I.coverage(df.limit(0)).count() == 0


def test_subtract_and_intersect(many, spark):
    data, _ = many
    a, b = data[:80], data[80:110]
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    da, db = set(depth_of(a)), set(depth_of(b))
    assert set(expand([(*r, 1) for r in rows(I.subtract(x, y))])) == da - db
    assert set(expand([(*r, 1) for r in rows(I.intersect(x, y))])) == da & db


@pytest.mark.parametrize("padding", [0, 6])
@pytest.mark.parametrize("bin_size", [3, 50, 16384])
def test_overlap_join(many, spark, padding, bin_size):
    data, _ = many
    a, b = data[:70], [*data[70:], ("a", 1, 5000)]
    want = Counter((*p, *q) for p in a for q in b if p[0] == q[0] and p[1] <= q[2] + padding and max(q[1] - padding, 1) <= p[2])
    got = O.overlap_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), padding=padding, bin_size=bin_size)
    assert got.columns == ["a_chr", "a_start", "a_end", "b_chr", "b_start", "b_end"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_with_overlap(many, spark):
    data, _ = many
    a, b = data[:70], data[150:]
    hit = [p for p in a if any(p[0] == q[0] and p[1] <= q[2] and q[1] <= p[2] for q in b)]
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    assert rows(O.with_overlap(x, y)) == sorted(hit)
    assert rows(O.with_overlap(x, y, anti=True)) == sorted(set(a) - set(hit))


def test_covered_by(spark):
    a = spark.createDataFrame([("x", "c", 1, 10), ("x", "c", 21, 30), ("y", "d", 1, 4)], "name string, chr string, start long, end long")
    d = spark.createDataFrame([("c", 6, 25, 3), ("c", 26, 26, 0)], SCHEMA + ", depth long")
    assert rows(O.covered_by(a, d, "name")) == [("x", 20, 10, 0.5, 1.5), ("y", 4, 0, 0.0, 0.0)]


def test_windows_pad_runs(spark):
    df = spark.createDataFrame([("c", 1, 10), ("c", 3, 4)], SCHEMA)
    assert rows(I.windows(df, 3)) == [("c", 1, 3), ("c", 4, 6), ("c", 7, 9)]
    assert rows(I.windows(df, 5)) == [("c", 1, 5)] and rows(I.windows(df, 5, True)) == [("c", 1, 5), ("c", 6, 10)]
    bounds = spark.createDataFrame([("c", 2, 12)], "chr string, low long, high long")
    assert rows(I.pad(df, 5)) == [("c", 1, 9), ("c", 1, 15)] and rows(I.pad(df, 5, bounds)) == [("c", 2, 9), ("c", 2, 12)]
    runs = spark.createDataFrame([("c", 1, 2, 5), ("c", 3, 9, 5), ("c", 10, 11, 6)], SCHEMA + ", v long")
    assert rows(I.merge_runs(runs, "v")) == [("c", 1, 9, 5), ("c", 10, 11, 6)]
    a = spark.createDataFrame([("c", 1, 4)], SCHEMA)
    assert {(r.side, r.locus_start, r.locus_end) for r in I.multi_loci({"x": df, "y": a}).collect()} == {("x", 1, 10), ("y", 1, 10)}


def test_range_functions(spark):
    df = spark.createDataFrame([("c", 1, 10, "c", 12, 20), ("c", 1, 10, "c", 11, 20), ("c", 1, 10, "d", 1, 10), ("c", 1, 10, "c", 4, 6)],
                               "a_chr string, a_start long, a_end long, b_chr string, b_start long, b_end long")
    a, b = R.span("a_"), R.span("b_")
    got = df.select(R.distance(a, b), R.adjacent(a, b), R.overlap_size(a, b), R.compare(a, b), R.to_text(b)).collect()
    assert [tuple(r) for r in got] == [(1, False, 0, -1, "c:12-20"), (0, True, 0, -1, "c:11-20"), (-1, False, 0, -1, "d:1-10"), (0, False, 3, 0, "c:4-6")]
    assert [(x.start, x.end) for x in df.select(R.difference(a, b).alias("d")).collect()[3].d] == [(1, 3), (7, 10)]
    one = spark.createDataFrame([("c", 1, 5, "c", 8, 9)], df.schema)
    assert one.select(R.overlaps(a, b, 3), R.overlaps(a, b, 2)).first()[:] == (True, False)
    got = one.select(R.from_text(F.lit("c:x:3-9")).alias("r"), R.from_text(F.lit("bad")).alias("n"), R.clip(a, 2, 3).alias("k"), R.hull(a, b).alias("h"), R.intersection(a, b).alias("i")).first()
    assert tuple(got.r) == ("c:x", 3, 9) and got.n is None and tuple(got.k) == ("c", 2, 3) and tuple(got.h) == ("c", 1, 9) and got.i is None
