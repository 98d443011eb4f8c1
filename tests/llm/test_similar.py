"""The near-dedup stage against brute force on exact five-word shingle similarity."""

import random

import pytest


def sets(t):
    w = t.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))}


def edited(words, share, r):
    return [f"e{r.random()}" if r.random() < share else w for w in words]


@pytest.fixture(scope="module")
def near():
    """Texts in pairs of similarities on both sides of 0.8, with a common passage."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    out = []
    for k in range(120):
        words = [f"w{r.random()}" for _ in range(r.choice([90, 200]))] + passage
        out += [" ".join(words), " ".join(edited(words, r.choice([0.01, 0.02, 0.025, 0.03, 0.05]), r))]
    out += ["", "  ", "one two", "One  two", "one two three"]
    return out


def brute(rows):
    own, root = [sets(t) if t.split() else set() for t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(rows)) if find(i) == i}


def test_stage_keeps_one_of_each_pair_of_exact_similarity(spark, near):
    from lociframe.llm.simhash import STAGE, one_of_each

    df = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in one_of_each(df, **STAGE).collect()} == brute(near)


def test_large_group_of_near_copies(spark):
    from lociframe.llm.simhash import STAGE, one_of_each

    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = [" ".join(edited(base, 0.02, r)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert {x.doc_id for x in one_of_each(df, **STAGE).collect()} == brute(rows)


def test_group_under_the_threshold_in_blocks(spark, monkeypatch):
    """Many texts of similarity around 0.8 in one home, in blocks of a few."""
    from lociframe.llm import buckets, similar
    from lociframe.llm.simhash import STAGE, one_of_each

    monkeypatch.setattr(similar, "HOME", 8)
    monkeypatch.setattr(buckets, "BLOCK", 8)
    r = random.Random(10)
    base = [f"w{i}" for i in range(120)]
    rows = [" ".join(edited(base, r.choice([0.02, 0.03, 0.04]), r)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert 10 < len(want) < 110
    assert {x.doc_id for x in one_of_each(df, **STAGE).collect()} == want


def test_common_counts():
    import numpy as np

    from lociframe.llm.similar import common

    r = np.random.default_rng(3)
    own = [np.unique(r.integers(0, 9000, n)).astype(np.uint64) for n in (0, 1, 500, 5000, 5000, 800)]
    assert common(own).tolist() == [[len(np.intersect1d(a, b)) if i != j else common(own)[i, i] for j, b in enumerate(own)] for i, a in enumerate(own)]


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(None, "", "x"), (None, "", "x"), (1, "a b", "y"), (1, "a b", "z"), (2, "A  b", "z")]])
def test_odd_tables(spark, rows):
    from lociframe.llm.simhash import STAGE, one_of_each

    df = spark.createDataFrame(rows, "doc_id long, text string, __k string")
    got = one_of_each(df, **STAGE)
    assert got.columns == df.columns
    assert sorted((x[0] is not None, x[0] or 0) for x in got.collect()) == {0: [], 1: [(False, 0)], 5: [(False, 0), (True, 1)]}[len(rows)]


def test_small_homes_of_a_field_share_blocks(spark):
    """Blocks follow the weight of what is tied, not the number of homes; a heavy set weighs more, untied homes stay apart."""
    from lociframe.llm.similar import HEAVY, HOME, placed

    homes = [(i, 100, 10_000 + i // 3) for i in range(3 * HOME)] + [(50_000 + i, HEAVY * HOME, 60_000) for i in range(4)] + [(70_000, 5, 70_000), (70_001, 5, 70_001)]
    ties = [(i, 10_000 + i // 3) for i in range(3 * HOME)] + [(10_000 + i, 10_001 + i) for i in range(HOME - 1)] + [(50_000 + i, 60_000) for i in range(4)]
    got = {r.id: r.block for r in placed(spark.createDataFrame(homes, "id long, n long, home long"), spark.createDataFrame(ties, "src long, dst long")).collect()}
    assert set(got) == {h[0] for h in homes}
    assert len({got[i] for i in range(3 * HOME)}) == 3
    assert len({got[50_000 + i] for i in range(4)}) > 1
    assert got[70_000] != got[70_001]


def test_units_tell_each_joined_component_once(spark, monkeypatch):
    """In blocks of a few: links do not repeat what is joined already, unit by unit."""
    from lociframe.llm import similar

    monkeypatch.setattr(similar, "HOME", 8)
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = [" ".join(edited(base, r.choice([0.02, 0.03, 0.04]), r)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    found = similar.links(df, similar.table(similar.prints(df, 5, 80)), 5, 80)
    assert found.count() < 2 * len(rows)


def test_stage_probes_fingerprints_by_pigeonhole(spark, near, monkeypatch):
    """The stage asks the pigeonhole probe, which proposes the pairs close in some SimHash word; whole sets decide."""
    from lociframe.llm import simhash

    asked, probe = [], simhash.probed

    def probed(sets):
        found = probe(sets)
        asked.append(([tuple(r) for r in sets.collect()], {tuple(sorted(r)) for r in found.collect()}))
        # a proposal of two unlike sets must not link them
        one, two = sorted(r[0] for r in asked[0][0])[:2]
        return found.unionByName(spark.createDataFrame([(one, two)], "src long, dst long"))

    monkeypatch.setattr(simhash, "probed", probed)
    df = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.one_of_each(df, **simhash.STAGE).collect()} == brute(near)
    (rows, found), = asked
    rows.sort()
    want = {(a[0], b[0]) for j, b in enumerate(rows) for a in rows[:j] if any(((x ^ y) & (2 ** 64 - 1)).bit_count() <= simhash.PROBE for x, y in zip(a[1:], b[1:]))}
    assert len(want) > 10 and found == want
