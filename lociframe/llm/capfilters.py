"""Embedding near-duplicates by spherical-cap filters.

A filter is a pair of codewords of a random product code: after a random
rotation, the halves of a unit vector are scored against two random codebooks
and the vector is list-decoded to every filter whose summed score exceeds a
threshold (and to its BEST ones). Vectors of one label that share a filter are
compared exactly; a pair counts in its smallest common filter only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.buckets import components, grouped, units
from lociframe.llm.common import read, tune
from lociframe.operators.graph import connected_components
from lociframe.session import cut

#: Filters that a vector exceeds on average, and members of a filter aimed at.
LISTS, AIM = 12, 64
#: Best filters that a vector joins in any case: directions far from all codewords exceed few.
BEST = 8


def classes_of(rows: DataFrame) -> DataFrame:
    """Distinct usable vectors of a label: (label, vec, copies, least)."""
    sound = ("label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 "
             "AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x != 0)")
    return rows.where(sound).groupBy("label", F.col("embedding").alias("vec")).agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))


def code_size(count: int) -> int:
    """Codewords of each half, so that a filter holds about AIM of ``count`` vectors."""
    want = max(4096.0, LISTS * count / AIM)
    return int(min(4096, 2 ** np.ceil(np.log2(want) / 2)))


@lru_cache(maxsize=4)
def codebooks(dim: int, size: int, seed: int = 11) -> tuple:
    """(rotation, first half, two codebooks); a process builds them once."""
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = dim // 2

    def book(d: int) -> np.ndarray:
        c = rng.standard_normal((size, max(d, 1)))
        return c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(2)

    return turn, half, book(half), book(dim - half)


def decode(unit: np.ndarray, books: tuple, share: float) -> list:
    """Filters of each unit vector: those whose score exceeds the cap holding ``share`` of the sphere, its BEST ones included."""
    turn, half, left, right = books
    x = unit @ turn
    a = x[:, :half] @ left[:, :half].T if half else np.zeros((len(x), 1))
    b = x[:, half:] @ right.T
    from statistics import NormalDist

    cap = NormalDist().inv_cdf(1 - share) / np.sqrt(unit.shape[1])
    out = []
    for s, t in zip(a, b):
        # the best sums come from the best codewords of each half
        i, j = np.argsort(-s)[:BEST], np.argsort(-t)[:BEST]
        sums = s[i][:, None] + t[j][None, :]
        top = np.argsort(-sums, axis=None)[:BEST]
        best = i[top // len(j)] * len(t) + j[top % len(j)]
        # only codewords that some partner could lift over the cap
        i, j = np.flatnonzero(s >= cap - t.max()), np.flatnonzero(t >= cap - s.max())
        p, q = np.nonzero(s[i][:, None] + t[j][None, :] >= cap) if len(i) and len(j) else (i[:0], j[:0])
        out.append(np.unique(np.concatenate([i[p] * len(t) + j[q], best])))
    return out


def near_vectors(rows: DataFrame, least_cosine: float = 0.98, lists: int = LISTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Rows without a label or with an unusable vector (null, empty, zero, or a
    null or non-finite component) have no links and are their own component.
    Equal vectors of a label are one class whose copies link with each other;
    vectors of unequal lengths never link. Repeated and null ids keep a row
    each. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    tune(spark)
    base = rows.select("vec_id", "embedding", "label")
    found = classes_of(base)
    classes = cut(found.withColumn("cls", F.monotonically_increasing_id()))
    largest = classes.groupBy("label", F.size("vec").alias("dim")).count().agg(F.max("count"), F.max("dim")).first()
    size = code_size(largest[0] or 1)

    def filters(batches):
        for b in batches:
            cls, label, vec, copies = (b.column(i) for i in range(4))
            flat = vec.to_pylist()
            lists_of: list = [None] * len(flat)
            for dim in {len(v) for v in flat}:
                at = [i for i, v in enumerate(flat) if len(v) == dim]
                x = np.array([flat[i] for i in at], np.float64)
                # scaled first, so that tiny and huge vectors keep their direction
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                books = codebooks(dim, size)
                share = min(0.4, lists / (size * size))
                for k in range(0, len(at), 256):
                    for i, f in zip(at[k: k + 256], decode(x[k: k + 256], books, share)):
                        lists_of[i] = f
            yield pa.RecordBatch.from_arrays([cls, label, vec, copies, pa.array([f.tolist() for f in lists_of], pa.list_(pa.int64()))],
                                             names=["cls", "label", "vec", "copies", "filters"])

    kind, vec_kind = base.schema["label"].dataType.simpleString(), base.schema["embedding"].dataType.simpleString()
    coded = classes.select("cls", "label", "vec", "copies").mapInArrow(
        filters, f"cls long, label {kind}, vec {vec_kind}, copies long, filters array<long>")
    dealt = (coded.withColumn("filter", F.explode("filters"))
             .withColumn("key", F.xxhash64("label", F.size("vec"), "filter")))
    ready = units(dealt, "key", "cls").select("key", "__a", "__b", "__own", "cls", "label", "vec", "copies", "filter", "filters")

    def compare(batches):
        for t, edge in grouped(batches):
            a, b, own, cls = (t.column(i).to_numpy() for i in range(1, 5))
            label, vec, fil, filt = t.column(5).to_pylist(), t.column(6).to_pylist(), t.column(8).to_pylist(), t.column(9).to_pylist()
            copies = t.column(7).to_numpy()
            ids, n, src, dst = [], [], [], []
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi - lo < 2:
                    continue
                same = label[lo]
                if any(label[i] != same or len(vec[i]) != len(vec[lo]) or fil[i] != fil[lo] for i in range(lo, hi)):
                    raise ValueError("two filters share a key")
                x = np.array(vec[lo:hi], np.float64)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                near = x @ x.T >= least_cosine
                np.fill_diagonal(near, False)
                if not near.any():
                    continue
                root = components(near)
                moved = np.flatnonzero(root != np.arange(len(root)))
                src.append(cls[lo:hi][moved])
                dst.append(cls[lo:hi][root[moved]])
                # each pair counts in one unit of its smallest common filter: blocks (a, b) of a cut bucket
                side = own[lo:hi]
                if a[lo] != b[lo]:
                    near &= side[:, None] != side[None, :]
                lower = [[f for f in filt[i] if f < fil[lo]] for i in range(lo, hi)]
                name = {f: k for k, f in enumerate({f for x in lower for f in x})}
                holds = np.zeros((hi - lo, max(len(name), 1)), np.float32)
                for i, fs in enumerate(lower):
                    holds[i, [name[f] for f in fs]] = 1
                near &= holds @ holds.T == 0
                count = near @ copies[lo:hi]
                hit = np.flatnonzero(count)
                ids.append(cls[lo:hi][hit])
                n.append(count[hit])
            if ids:
                i, c, s, d = (np.concatenate(v) for v in (ids, n, src, dst))
                z = np.zeros(len(i), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i, s])), pa.array(np.concatenate([c, 0 * s])),
                                                  pa.array(np.concatenate([i, d]))], names=["cls", "n", "dst"])

    seen = cut(ready.mapInArrow(compare, "cls long, n long, dst long"))
    comp = connected_components(seen.where("cls != dst").select(F.col("cls").alias("src"), "dst"))
    counts = seen.groupBy("cls").agg(F.sum("n").alias("n"))
    whole = (classes.join(counts, "cls", "left").join(comp, classes["cls"] == comp["node"], "left")
             .select("cls", "label", "vec", "copies", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "cls").alias("c")))
    lows = whole.groupBy("c").agg(F.min("least").alias("component_id"))
    label = whole.join(lows, "c").select(F.col("label").alias("l"), F.col("vec").alias("v"), "copies", "n", "component_id")
    return (base.join(label, (F.col("embedding") == F.col("v")) & (F.col("label") == F.col("l")), "left")
            .select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))


def op6_cap_filter_near_dedup(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings"))
