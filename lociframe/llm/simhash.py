"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of word shingles are probed in partitions of their bits with
unequal radii: correlated bits are grouped, and radii r_i with
sum(r_i + 1) = radius + 1 are allocated by dynamic programming on estimated
candidate counts. Two fingerprints within ``radius`` bits agree within r_i
bits in some partition i, so they share a key (the partition's value with
r_i bits masked); each shared bucket is verified exactly and contributes a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.bits import counted, majority
from lociframe.llm.buckets import BLOCK, components, grouped, units
from lociframe.llm.common import fresh, read, sieve, texts, tune
from lociframe.llm.similar import FACES, labelled
from lociframe.operators.graph import connected_components
from lociframe.session import cut

#: Fingerprints (smallest hashes) from which bit correlations and candidate counts are estimated; the plan only.
SAMPLE = 2048
MAX_PARTITIONS = 14
#: Estimated microseconds of one key row and of one candidate comparison, with its share of the rows that a cut bucket repeats.
KEY_US = 4.0
PAIR_US = 0.01 + 2 * KEY_US / BLOCK
SHINGLES_AT_ONCE = 50_000


def fingerprint(text: bytes | None, shingle: int = 4, words: int = 1) -> list:
    """``words`` 64-bit SimHash words of a text (lower-cased A-Z, ASCII white space between words); none: zeros."""
    ws = text.lower().split() if text else []
    if not ws:
        return [0] * words
    flat = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = ends - np.array([len(w) for w in ws])
    n = max(len(ws) - shingle + 1, 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(ws)) - 1:].tolist()
    total, digest = np.zeros((words, 64), np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, SHINGLES_AT_ONCE):
        total += counted(np.array([digest(flat[s:e], 42) for s, e in zip(starts[lo: lo + SHINGLES_AT_ONCE], ends[lo: lo + SHINGLES_AT_ONCE])], np.uint64), words)
    return majority(total, n)


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, th, f0, f1, ...) for each row, th a hash of the text; null and wordless texts get zeros."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"f{j}" for j in range(words)]

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(t, shingle, words) for t in texts(b.column(1))], np.int64).reshape(b.num_rows, words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(f[:, j]) for j in range(words))], names=["doc_id", "th", *names])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, " + ", ".join(f"{x} long" for x in names))


def group_bits(sample: np.ndarray, parts: int) -> list:
    """64 bits dealt into ``parts`` groups of near equal size, each grown from its most correlated bits."""
    if len(sample) > 1:
        bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
        bits -= bits.mean(0)
        scale = np.sqrt((bits ** 2).sum(0)) + 1e-9
        near = np.abs(bits.T @ bits / scale[:, None] / scale[None, :])
    else:
        near = np.zeros((64, 64))
    left, out = list(range(64)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        own = [left.pop(0)]
        while len(own) < size:
            best = max(left, key=lambda b: (near[b, own].sum(), -b))
            left.remove(best)
            own.append(best)
        out.append(sorted(own))
    return out


def plan(sample: np.ndarray, count: int, radius: int) -> list:
    """[(bits, radius)] of least estimated cost; radius -1 partitions are not probed."""
    best: tuple = (np.inf, [])
    for parts in range(1, MAX_PARTITIONS + 1):
        groups = group_bits(sample, parts)
        budget = radius + 1
        cost = np.full((parts, budget + 1), np.inf)
        for i, own in enumerate(groups):
            value = extract(sample, own)
            d = np.bitwise_count(value[:, None] ^ value[None, :])[np.triu_indices(len(value), 1)] if len(value) > 1 else np.zeros(0, int)
            w = len(own)
            seen = np.bincount(d, minlength=w + 1) / max(len(d), 1)
            even = np.array([comb(w, k) / 2.0 ** w for k in range(w + 1)])
            p = np.maximum(seen, even)
            cost[i, 0] = 0
            for spent in range(1, budget + 1):
                r = spent - 1
                if r > min(3, w - 1):
                    break
                pairs = sum(p[k] * comb(w - k, r - k) for k in range(r + 1)) * count * count / 2
                cost[i, spent] = count * comb(w, r) * KEY_US + pairs * PAIR_US
        total = np.full(budget + 1, np.inf)
        total[0] = 0
        back = []
        for i in range(parts):
            new, took = np.full(budget + 1, np.inf), np.zeros(budget + 1, int)
            for b in range(budget + 1):
                options = [total[b - s] + cost[i, s] for s in range(b + 1)]
                took[b] = int(np.argmin(options))
                new[b] = options[took[b]]
            total = new
            back.append(took)
        if total[budget] < best[0]:
            b, radii = budget, []
            for i in reversed(range(parts)):
                radii.append(int(back[i][b]) - 1)
                b -= int(back[i][b])
            best = (total[budget], [(g, r) for g, r in zip(groups, radii[::-1]) if r >= 0])
    return best[1]


def extract(f: np.ndarray, bits: list) -> np.ndarray:
    """The chosen bits of each fingerprint, packed into a uint64."""
    out = np.zeros(len(f), np.uint64)
    for j, b in enumerate(bits):
        out |= ((f >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def links(classes: DataFrame, words: int, radius: int, verify: int | None = None) -> DataFrame:
    """Spanning links (src, dst) among distinct fingerprint classes (id, f0, f1, ...).

    Classes link when f0 differs in ``radius`` bits or fewer and, with
    ``verify``, all words together in ``verify`` bits or fewer. Every such link
    is implied by a path of returned links.
    """
    names = [f"f{j}" for j in range(words)]
    classes = classes.select("id", *names)
    few = [r[0] for r in classes.select("f0").orderBy(F.xxhash64("f0"), "f0").limit(SAMPLE).collect()]
    chosen = plan(np.array(few, np.int64).view(np.uint64), classes.count(), radius)

    def keys(batches):
        for b in batches:
            f = b.column(1).to_numpy().view(np.uint64)
            out, n = [], 0
            for i, (bits, r) in enumerate(chosen):
                value = extract(f, bits)
                for mask in combinations(range(len(bits)), r):
                    v = value & np.uint64(~sum(1 << m for m in mask) & (2 ** 64 - 1))
                    # a mixed key: partition and mask number on top of the masked value
                    x = (v + np.uint64(((i << 16) + n + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    out.append((x ^ (x >> np.uint64(29))).view(np.int64))
                    n += 1
            for k in out:
                yield pa.RecordBatch.from_arrays([pa.array(k), *b.columns], names=["key", "id", *names])

    rows = classes.select("id", *names).mapInArrow(keys, "key long, id long, " + ", ".join(f"{x} long" for x in names))
    ready = units(rows, "key", "id").select("key", "__a", "__b", "id", *names)

    def verify_units(batches):
        for t, edge in grouped(batches):
            ids = t.column(3).to_numpy()
            f = np.column_stack([t.column(4 + j).to_numpy() for j in range(words)]).view(np.uint64)
            src, dst = [], []
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi - lo < 2:
                    continue
                g = f[lo:hi]
                d = np.bitwise_count(g[:, None, 0] ^ g[None, :, 0])
                near = d <= radius
                if verify is not None:
                    more = d.astype(np.int32)
                    for j in range(1, words):
                        more += np.bitwise_count(g[:, None, j] ^ g[None, :, j])
                    near &= more <= verify
                if near.sum() == hi - lo:
                    continue
                root = components(near)
                own = np.flatnonzero(root != np.arange(len(root)))
                src.append(ids[lo:hi][own])
                dst.append(ids[lo:hi][root[own]])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    return ready.mapInArrow(verify_units, "src long, dst long")


def _labelled(prints: DataFrame, shown: F.Column, words: int, radius: int, verify: int | None) -> DataFrame:
    """``prints`` with the smallest ``shown`` value of each row's component as ``least``."""
    names = [f"f{j}" for j in range(words)]
    mark = F.col("f0") if words == 1 else F.xxhash64(*names)
    classes = cut(prints.groupBy(mark.alias("id"), *names).agg(F.min(shown).alias("low")))
    comp = connected_components(links(classes, words, radius, verify))
    whole = classes.join(comp, classes["id"] == comp["node"], "left").select("id", "low", F.coalesce("component", "id").alias("c"))
    # on its own first, so that the join may split a component of very many classes
    lows = cut(whole.groupBy("c").agg(F.min("low").alias("least")))
    label = whole.join(lows, "c").select("id", "least")
    return prints.withColumn("id", mark).join(label, "id")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, words: int = 1, verify: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest doc_id that links reach. Null and wordless
    texts share the zero fingerprint and link like any other; null ids are
    members but never a component's smallest id unless it has no other.
    Repeated rows get a row each; other columns are not read. An empty table
    gives an empty result.
    """
    prints = cut(fingerprints(docs, shingle, words))
    return _labelled(prints, F.col("doc_id"), words, radius, verify).select(
        "doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


#: The corpus pipeline's near-dedup: exact similarity of five-word shingle sets, 0.8 or more.
STAGE = {"shingle": 5, "percent": 80}
#: Differing bits of any one SimHash word up to which the pigeonhole probe proposes a pair of sets.
PROBE = 4


def probed(sets: DataFrame) -> DataFrame:
    """Spanning links (src, dst) of sets (id, f0, ...) that are within ``PROBE`` bits in some word, each word probed in its own partitions."""
    found = [links(sets.select("id", F.col(f).alias("f0")), 1, PROBE) for f in FACES]
    return reduce(DataFrame.unionByName, found)


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest doc_id, null ids last.

    Two texts link when their sets of word shingles have a Jaccard similarity
    of ``percent`` / 100 or more. The pigeonhole probe of their SimHash words
    proposes the closest pairs; what lies beyond its radius is found by common
    shingles, and whole sets decide on either. All columns are kept. Of rows
    that agree in id and text one stays.
    """
    none = F.lit(-(2 ** 63))
    me = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))
    k, h = fresh(docs, "__k"), fresh(docs, "__h")
    rows = labelled(docs, me, shingle, percent, probed).select(F.coalesce("doc_id", none).alias(k), F.col("th").alias(h), (me == F.col("least")).alias("stay"))
    # (id, text) pairs that go or are repeated; the rows of all others stay without a shuffle
    some = cut(rows.groupBy(k, h).agg(F.min("stay").alias("stay"), F.count("*").alias("n")).where("n > 1 OR NOT stay"))
    doubt = sieve(some, k, h)
    keyed = docs.withColumn(k, F.coalesce(F.col("doc_id").cast("long"), none)).withColumn(h, F.xxhash64("text"))
    kept = keyed.where(~doubt(k, h))
    asked = keyed.where(doubt(k, h)).join(some.where("NOT stay"), [k, h], "left_anti")
    again = some.where("stay").select(k, h)
    once = asked.join(again, [k, h], "left_semi").dropDuplicates([k, h])
    return kept.unionByName(asked.join(again, [k, h], "left_anti")).unionByName(once).select(*docs.columns)


def op5_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))
