"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, kept string, fingerprint int, label string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def rows():
    t = "one two three four five six seven eight nine ten eleven twelve. " * 5
    return [(1, None), (2, ""), (3, "   \n\t "), (4, t), (5, t), (5, t), (None, t), (None, None), (6, LONG), (7, LONG),
            (8, "a"), (9, "MIT License. ünï  cöde \x00 nul"), (10, "no\n\nno\nno\n"), (11, "idiot " * 40), (12, "é" * 300)]


@pytest.fixture(scope="module")
def awkward(spark):
    from lociframe.llm.common import tune

    tune(spark)
    return spark.createDataFrame([(d, t, "en", "s", 0, "x", 1, "y") for d, t in rows()], AWKWARD).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    from lociframe.llm.common import read

    return read(spark, SF, "documents")


@pytest.fixture(scope="module")
def local(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def bag(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# 1 ------------------------------------------------------------------------------------------------

def brute_statistics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_statistics(spark, awkward, local):
    from lociframe.llm.quality import quality_rules, statistics

    for _, t in local:
        assert statistics(t.encode())[:5] == brute_statistics(t)
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (8, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = quality_rules(awkward, labels)
    assert bag(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == Counter((d, *brute_statistics(t)) for d, t in rows())
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules(awkward.limit(0), labels).count() == 0


def test_quality_finds_anomalies(spark):
    from lociframe.llm.common import read
    from lociframe.llm.quality import quality_rules

    sf = "/root/testdata/sf0.01"
    got = quality_rules(read(spark, sf, "documents"), read(spark, sf, "labels")).join(read(spark, sf, "labels"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) < 0.2 * n[0, False]
    assert n.get((1, False), 0) < 0.06 * n[1, True]


# 2 ------------------------------------------------------------------------------------------------

def brute_phrases(text):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at, labels = [], set()
    for label, p in {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}.items():
        p = p.split()
        for i in range(len(words)):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))


def test_license_scan(spark, awkward, docs, local):
    from lociframe.llm.license import license_scan
    from lociframe.llm.license_texts import APACHE_NOTICE, BSD_CONDITIONS, BSD_DISCLAIMER, BSD_NAMES, ISC, MIT

    for df, want in ((docs, local), (awkward, rows())):
        got = license_scan(df)
        assert bag(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter((d, *brute_phrases(t)) for d, t in want)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.collect())
    notice = "xx " * 50 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files, to deal in the software without any restriction"
    cases = [(1, notice + MIT[MIT.index("including without"):], "mit"), (2, "permission is not granted " * 9, ""), (3, "under the Mozilla Public License version 2.0", "mpl"),
             (4, "This work is licensed under a commercial agreement.", ""), (5, "Licensed under the GNU General Public License version 2.0", "gpl"),
             (6, "this work is licensed " * 80 + "under the gnu general public license version 3", "gpl"), (7, "We licensed under CC BY-NC 4.0 and", "cc-by-nc"),
             (8, "a\n".join([BSD_CONDITIONS, BSD_DISCLAIMER]), "bsd-2-clause"), (9, BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER, "bsd-3-clause"),
             (10, ISC + " foo bar " * 20 + APACHE_NOTICE, "apache,isc"), (11, "licensed under a house by nc rules", ""), (None, None, "")]
    df = spark.createDataFrame([(d, t, "x") for d, t, _ in cases + cases], "doc_id long, text string, labels string").repartition(3)
    got = license_scan(df).collect()
    assert {r.doc_id: r.labels for r in got} == {d: x for d, _, x in cases} and len(got) == 2 * len(cases)
    assert {r.doc_id for r in got if r.score > 0.85} >= {3, 5, 6, 7, 8, 9, 10}
    assert license_scan(awkward.limit(0)).count() == 0


def test_license_spans_against_brute_force(spark):
    """Votes, windows and longest common subsequences by plain loops."""
    import random

    from lociframe.llm import license as L

    r = random.Random(5)
    templates = [("a", "", "one two three four five six seven eight nine ten"), ("b", "red", "red two three four five six"), ("c", "", "k l m n o p q r s t u v w x y z")]
    cut_up = [(label, set(must.split()), text.split()) for label, must, text in templates]
    rows = []
    for i in range(150):
        out = []
        for _ in range(r.randint(0, 4)):
            words = list(r.choice(cut_up)[2])
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(["red", "zz", "two", words[0]])
            del words[r.randrange(len(words)):][: r.randint(0, 2)]
            out += words + ["pad"] * r.randint(0, 9)
        rows.append((i, " ".join(out)))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for d, t in rows:
        words, want, found = t.split(), set(), []
        for k, (label, must, own) in enumerate(cut_up):
            votes = Counter(i - j for i in range(len(words) - 3) for j in range(len(own) - 3) if words[i:i + 4] == own[j:j + 4])
            for x in votes:
                if 5 * sum(votes[x + e] for e in range(-4, 5)) >= len(own) - 3:
                    found.append((k, x))
                    near = words[max(x - 4, 0): x + len(own) + 4]
                    if must <= set(near) and lcs(own, near) >= 0.6 * len(own):
                        want.add((label, lcs(own, near) / len(own)))
        got = L.verified(words, found, [(x, frozenset(m), o) for x, m, o in cut_up])
        # the best of all stays, and nothing is there that loops do not find
        assert {(x[0], x[3]) for x in got} <= want
        assert max((x[1] for x in want), default=0) == max((x[3] for x in got), default=0)
        rows[d] = (d, t, {(x[0], x[1], x[2], round(x[3], 9)) for x in got})
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    spans = L.license_spans(df, templates).join(df.select("doc_id", F.xxhash64("text").alias("text_key")), "text_key").collect()
    assert {(x.doc_id, x.label, x["first"], x["last"], round(x.score, 9)) for x in spans} == {(d, *x) for d, _, s in rows for x in s}


# 3 ------------------------------------------------------------------------------------------------

def brute_ppm(train, text, order):
    """Escape by distinct symbols and exclusion, one symbol at a time, over a dictionary trie; 256 is the end and what stands before a text."""
    nodes = [{} for _ in range(order + 1)]
    for t in train:
        b = (256,) * order + tuple(t.lower()) + (256,)
        for i in range(order, len(b)):
            for k in range(order + 1):
                own = nodes[k].setdefault(b[i - k:i], Counter())
                own[b[i]] += 1
    total = 0.0
    b = (256,) * order + tuple(text.lower()) + (256,)
    for i in range(order, len(b)):
        out, p = set(), 1.0
        for k in range(order, -2, -1):
            if k < 0:
                p /= 257 - len(out)
                break
            seen = nodes[k].get(b[i - k:i])
            if seen is None:
                continue
            live = {s: n for s, n in seen.items() if s not in out}
            if not live:
                continue
            whole = sum(live.values()) + len(live)
            if b[i] in live:
                p *= live[b[i]] / whole
                break
            p *= len(live) / whole
            out |= set(live)
        total += math.log10(p)
    return total


@pytest.mark.parametrize("least", [10 ** 6, 400])
def test_ppm_scores(spark, awkward, monkeypatch, least):
    from lociframe.llm import ppm
    from lociframe.llm.ppm import lm_scores, tokens

    # chunks of a few texts
    monkeypatch.setattr(ppm, "CHUNK_BYTES", least)
    small = [(d, t[:700] if t else t) for d, t in rows()] + [(100 + i, f"the cat number {i % 7} sat on mat {i}") for i in range(40)] + [(900, "nul \0\0 Nul \0"), (901, "\0")]
    df = spark.createDataFrame([(d, t, "q") for d, t in small], "doc_id long, text string, score string").repartition(3)
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10
    train = [(t or "").encode() for d, t in small if fold(d)]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = {}
    for r in lm_scores(df, order=3).collect():
        got.setdefault((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4), r.held_out, r.train_tokens), 0)
    want = set()
    for d, t in small:
        ts = tokens((t or "").encode())
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
        want.add((d, len(ts), sum(c[w] > 0 for w in ts), round(base, 6), round(brute_ppm(train, (t or "").encode(), 3), 4), fold(d) == 0, n))
    assert {x[:3] for x in got} == {x[:3] for x in want}
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert a[:3] == b[:3] and a[5:] == b[5:] and abs(a[3] - b[3]) < 1e-5 and abs(a[4] - b[4]) < 1e-3
    assert lm_scores(df.limit(0), order=3).count() == 0


# 4 ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("chunk,overlap", [(32_768, 512), (90, 40), (13, 6)])
def test_bpe_roundtrip(spark, awkward, chunk, overlap):
    import public_tokenizers as P
    from lociframe.llm.bpe import bpe_roundtrip, load

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = load(path, P.PATTERN)
    extra = [(50, "a" * 200 + "  \n\n b 's't it's  " * 20), (51, " " * 300), (52, "x\n\ny   z " * 40)]
    want = Counter()
    few = [(d, t[:3000] if t and chunk < 100 else t) for d, t in rows() + extra]
    for d, t in few:
        ids = enc.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    df = spark.createDataFrame([(d, t, "z") for d, t in few], "doc_id long, text string, ids string")
    got = bpe_roundtrip(df, path, P.PATTERN, chunk, overlap)
    assert bag(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe_roundtrip(df.limit(0), path, P.PATTERN).count() == 0


# 5 ------------------------------------------------------------------------------------------------

def brute_fingerprint(text, k=4):
    import re
    import xxhash

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(len(words) - k + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, near):
    root = union_find(len(ids), zip(*np.nonzero(near)))
    least = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(r) for r in root]


@pytest.mark.parametrize("radius", [4, 9])
def test_simhash(spark, awkward, docs, local, radius):
    from lociframe.llm import simhash

    for df, pairs in ((docs, local), (awkward, rows())):
        f = np.array([brute_fingerprint(t) for _, t in pairs], np.uint64)
        comp = brute_components([d for d, _ in pairs], np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
        got = simhash.near_duplicates(df, radius=radius)
        assert bag(got, "doc_id", "fingerprint", "component_id") == Counter((d, f"{int(x):016x}", c) for (d, _), x, c in zip(pairs, f, comp))
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_pigeonhole_plan():
    from lociframe.llm.simhash import plan

    sample = np.random.default_rng(0).integers(0, 2 ** 63, 500, dtype=np.uint64)
    for count in (10, 10 ** 5, 10 ** 8):
        for radius in (0, 4, 10):
            chosen = plan(sample, count, radius)
            assert sum(r + 1 for _, r in chosen) == radius + 1
            used = [b for bits, _ in chosen for b in bits]
            assert len(used) == len(set(used))


def test_bucket_blocks(spark, monkeypatch):
    from lociframe.llm import simhash

    monkeypatch.setattr(simhash.units, "__defaults__", (4,))
    f = [int(x) for x in np.random.default_rng(1).integers(0, 2 ** 12, 80)]
    df = spark.createDataFrame([(x, x) for x in set(f)], "id long, f0 long")
    edges = [(r.src, r.dst) for r in simhash.links(df, 1, 2).collect()]
    ids = sorted(set(f))
    at = {x: i for i, x in enumerate(ids)}
    a = np.array(ids, np.uint64)
    want = union_find(len(ids), zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 2)))
    assert union_find(len(ids), [(at[s], at[d]) for s, d in edges]) == want


def test_one_of_each(spark, awkward):
    from lociframe.llm.simhash import one_of_each

    base = [f"word{i}" for i in range(300)]
    near = base.copy()
    near[40] = "other"
    other = [f"else{i}" for i in range(300)]
    df = spark.createDataFrame([(3, " ".join(base), 1), (1, " ".join(near), 2), (7, " ".join(other), 3), (7, " ".join(other), 3), (None, " ".join(base), 4)],
                               "doc_id long, text string, __own int")
    got = one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r[0], r[2]) for r in got.collect()) == [(1, 2), (7, 3)]
    assert one_of_each(awkward.limit(0)).count() == 0


# 6 ------------------------------------------------------------------------------------------------

def test_cap_filters(spark):
    from lociframe.llm.capfilters import near_vectors

    rng = np.random.default_rng(5)
    centre = rng.standard_normal((6, 48))
    x = [(i, (centre[i % 6] + 0.08 * rng.standard_normal(48)).astype(np.float32).tolist(), i % 2) for i in range(400)]
    x += [(1000 + i, x[3][1], x[3][2]) for i in range(30)]
    odd = [(2000, None, 1), (2001, [0.0] * 48, 1), (2002, [float("nan")] * 48, 1), (2003, x[0][1], None), (2004, [None] + [1.0] * 47, 0),
           (2005, [float("inf")] * 48, 0), (2006, [], 0), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0), (2009, [3.0], 1)]
    df = spark.createDataFrame([(*r, "e") for r in x + odd], "vec_id long, embedding array<float>, label int, kept string").repartition(4)
    v = np.array([e for _, e, _ in x], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in x])
    near = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp = brute_components([r[0] for r in x], near)
    want = {r[0]: (int(n), c) for r, n, c in zip(x, near.sum(1), comp)} | {r[0]: (0, r[0]) for r in odd} | {2007: (1, 2007), 2008: (1, 2007)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert got.keys() == want.keys()
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert 0.9 * there <= found <= there and there > 1000
    assert all(got[k][0] <= want[k][0] for k in want)
    assert near_vectors(df.limit(0)).count() == 0


def test_cap_filters_recall(spark):
    """Against all pairs: 2,000 directions, and a third of them with copies at cosines on both sides of 0.98."""
    from lociframe.llm.capfilters import near_vectors

    rng = np.random.default_rng(12)
    base = rng.standard_normal((2000, 64))
    near = [base[i] + rng.uniform(0.05, 0.25) * np.linalg.norm(base[i]) / 8 * rng.standard_normal(64) for i in range(0, 2000, 3) for _ in range(2)]
    x = np.vstack([base, near]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    v = x.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = int((v @ v.T >= 0.98).sum()) - len(v)
    assert links > 500 and 0.9 * links <= near_vectors(df).agg(F.sum("n_links")).first()[0] <= links


# 7 ------------------------------------------------------------------------------------------------

def test_toxicity(spark, awkward):
    from lociframe.llm.common import read
    from lociframe.llm.toxicity import toxicity, without_toxic

    sf = "/root/testdata/sf0.1"
    labels = read(spark, sf, "labels")
    got = toxicity(read(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] > 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) < 0.03 * n[0, 0]
    own = spark.createDataFrame([(11, 1, None), (4, 0, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    out = toxicity(awkward, own).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert without_toxic(awkward, own.limit(0)).columns == awkward.columns
    assert without_toxic(awkward, own.limit(0)).count() == len(rows())
    assert toxicity(awkward.limit(0), own).count() == 0


def test_nnpu_separates():
    from lociframe.llm.toxicity import SURE, _sigmoid, lift, nnpu

    rng = np.random.default_rng(2)
    words = [b"w%d" % i for i in range(200)]
    plain = [set(rng.choice(words, 30)) for _ in range(900)]
    bad = [set(rng.choice(words, 30)) | {b"vile"} for _ in range(100)]
    positive, unlabelled = bad[:50], plain[:450] + bad[50:]
    chosen = [w for w in [*words, b"vile"] if lift(sum(w in x for x in positive), sum(w in x for x in unlabelled), 50, 500) >= SURE]
    index = {w: i for i, w in enumerate(chosen)}

    def matrix(sets):
        own = [[index[w] for w in sorted(x) if w in index] for x in sets]
        return len(own), np.repeat(np.arange(len(own)), [len(x) for x in own]), np.array([i for x in own for i in x], np.int64)

    theta, bias = nnpu(matrix(positive), matrix(unlabelled), len(index), 0.1)
    score = lambda x: _sigmoid(sum(theta[index[w]] for w in x if w in index) + bias)
    assert all(score(x) > 0.5 for x in bad) and sum(score(x) > 0.5 for x in plain) < 10


# 8 ------------------------------------------------------------------------------------------------

def test_sharding(spark, awkward, docs, local):
    from lociframe.llm.sharding import shard

    for df, pairs in ((docs, local), (awkward, rows())):
        got = shard(df).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs)
        for s in range(16):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
    total = Counter()
    for r in shard(docs).collect():
        total[r.shard] += r["size"]
    assert max(total.values()) - min(total.values()) <= max(len(t.encode()) for _, t in local)
    hot = spark.createDataFrame([(i, "same text " * 20) for i in range(800)] + [(1000 + i, f"own {i} " * 25) for i in range(1600)], "doc_id long, text string")
    total = Counter()
    for r in shard(hot).collect():
        total[r.shard] += r["size"]
    assert max(total.values()) < 1.03 * min(total.values())
    # a third of the rows are empty: bytes, tokens and rows are all balanced
    many = spark.createDataFrame([(i, "" if i % 3 else f"{i} " + "word " * (i % 50)) for i in range(6000)], "doc_id long, text string")
    sums = [many.join(shard(many), "doc_id").groupBy("shard").agg(F.sum("size").alias("b"), F.sum(F.size(F.split("text", " "))).alias("t"), F.count("*").alias("r")).toPandas()[c] for c in "btr"]
    assert all(len(x) == 16 and x.max() < 1.06 * x.min() for x in sums), sums
    assert shard(awkward.limit(0)).count() == 0


# 9 ------------------------------------------------------------------------------------------------

def brute_removal(pairs, w, first):
    data = [(d, (t or "").encode()) for d, t in pairs]
    seen = Counter(b[i:i + w] for _, b in data for i in range(len(b) - w + 1))
    out, met = Counter(), set()
    for d, b in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0)):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if (b[i:i + w] in met) if first else seen[b[i:i + w]] > 1:
                gone[i:i + w] = True
            met.add(b[i:i + w])
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d, len(b), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window,gram,unit", [(200, 64, 400), (12, 4, 400), (12, 4, 1)])
def test_suffix_removal(spark, docs, local, monkeypatch, window, gram, unit):
    from lociframe.llm import suffix

    monkeypatch.setattr(suffix, "UNIT", unit)
    monkeypatch.setattr(suffix, "SEGMENT", 5000)
    some = [(d, t[:1500]) for d, t in local[:40]] + [(900 + i, "ab" * 30 + f"{i % 3}" + "x" * 40) for i in range(9)]
    some += [(d, t if not t or len(t) < 9000 else t[:9000]) for d, t in rows() if d is None or d not in (4, 5)]
    df = spark.createDataFrame([(d, t, 1) for d, t in some], "doc_id long, text string, spans int").repartition(3)
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert bag(suffix.removal_digest(df, window, gram), *cols) == brute_removal(some, window, False)
    own = [(d, t) for d, t in some if d is not None]
    assert bag(suffix.removal_digest(df.where("doc_id IS NOT NULL"), window, gram, True), *cols) == brute_removal(own, window, True)


def test_longest_previous_factors():
    """Against all pairs of positions."""
    import random

    from lociframe.llm.suffix import factors, repeated_windows

    r = random.Random(4)
    for _ in range(30):
        contents = [bytes(r.choice(b"ab\0\xff") for _ in range(r.randint(1, 40))) * r.randint(1, 2) for _ in range(r.randint(1, 6))]
        ends = np.cumsum([len(c) + 1 for c in contents])
        suffix = [c[i:] for c in contents for i in range(len(c) + 1)]

        def shared(i, j):
            return next((k for k, (x, y) in enumerate(zip(suffix[i], suffix[j])) if x != y), min(len(suffix[i]), len(suffix[j])))

        previous, elsewhere = factors(contents)
        assert len(previous) == ends[-1]
        for i in range(len(suffix)):
            assert previous[i] == max((shared(i, j) for j in range(i)), default=0)
            assert elsewhere[i] == max((shared(i, j) for j in range(len(suffix)) if j != i), default=0)
    owner, offset, repeated, later = repeated_windows([b"xabcd", b"abcdy"], np.array([[7, 0, 0], [5, 0, 3]]), 4)
    assert sorted(zip(owner.tolist(), offset.tolist(), repeated.tolist(), later.tolist())) == [(0, 0, False, False), (0, 1, True, True), (1, 0, True, False), (1, 1, False, False)]


def test_suffix_texts(spark, awkward):
    from lociframe.llm.suffix import removal_digest, remove_repeats

    p = "a passage that stands in both documents and is well over the length of the window of bytes " * 3
    df = spark.createDataFrame([(1, "one " + p + " end", 5), (2, "two " + p + " fin", 6), (3, None, 7)], "doc_id long, text string, __spans int")
    got = {r.doc_id: r.text for r in remove_repeats(df).collect()}
    assert got[1] == "one " + p + " end" and len(got[2]) < 20 and got[3] is None
    assert removal_digest(awkward.limit(0)).count() == 0
    assert removal_digest(awkward).count() == len(rows())


# 10 -----------------------------------------------------------------------------------------------

def test_packing(spark, awkward, docs, local):
    import public_tokenizers as P
    from lociframe.llm.packing import pack
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    special = spark.createDataFrame([(1, "hello <|endoftext|> world"), (2, "a<|startoftext|>b " * 700)], "doc_id long, text string")
    for df, pairs in ((docs, local), (awkward, rows()), (special, [tuple(r) for r in special.collect()])):
        got = pack(df, path).collect()
        want, by_doc = Counter(), {}
        for d, t in pairs:
            raw = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            by_doc.setdefault(d, set()).add(raw.tobytes())
            want[d, len(raw)] += len(raw)
        for r in got:
            want[r.doc_id, r.doc_tokens] -= r.length
            # every piece holds its document's ids from its start on
            assert any(len(raw) == 4 * r.doc_tokens and zlib.crc32(raw[4 * r.start: 4 * (r.start + r.length)]) == r.ids_crc32 for raw in by_doc[r.doc_id])
        assert not any(want.values())
        seqs = {}
        for r in got:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted(seqs) == list(range(len(seqs)))
        for s in seqs.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= 4096
    total = sum(r.length for r in pack(docs, path).collect())
    assert len({r.sequence_id for r in pack(docs, path).collect()}) * 4096 < 1.15 * total
    assert pack(awkward.limit(0), path).count() == 0


def test_word_ids_equal_the_tokenizer():
    import public_tokenizers as P
    from lociframe.llm.packing import WordIds
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    alphabet = list("aAbZ 'ééßİΣ.,;12 \n\t\x0b\x0c\r\x1c\u0085  　中\U0001f600-_<|>") + ["'s", "n't", "the", "<|endoftext|>", " <|startoftext|>", "'RE", "\u0301", "\u00d7", "\u00b5"]
    enc, plain = WordIds(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(3000)] + ["x" * 500 + " " + "y" * 500, "Ünïcödé'S" * 40]
    for t, ids in zip(texts, enc.ids([t.encode() for t in texts])):
        assert plain.encode(t, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist(), repr(t)


def test_piece_lengths():
    from lociframe.llm.packing import piece_lengths

    for n in [*range(1, 9000, 7), 4095, 4096, 4097, 2048, 1365]:
        got = piece_lengths(n)
        assert sum(got) == n and all(0 < x <= 4096 for x in got)
        # a class's sequences are nearly full
        assert all(4096 % x <= 4096 / 16 for x in got)
    assert piece_lengths(1360) == [1360] and piece_lengths(5000) == [4096, 819, 85]
