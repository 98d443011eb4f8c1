"""Exact similarity of word-shingle sets: all links of a least Jaccard share, as spanning links of sets.

Shingles have one global order. Two sets of similarity ``percent`` / 100 or
more share one of their first ``prefix`` shingles, so the buckets of these
shingles hold every such pair. Shingles that a sample of the texts often shows
come last in the order. This shortens buckets and decides no link. Pairs that
meet are compared by 256-bit SimHash first (``FAR``) and those that are left by
their whole sets. First come the pairs that a ``probe`` of the SimHash words
proposes and each bucket's links to one of its members; what those have not
joined is compared in units of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.llm.bits import counted, majority
from lociframe.llm.buckets import components, grouped, units
from lociframe.llm.common import share, sieve, texts, tune
from lociframe.operators.graph import connected_components
from lociframe.session import cut, forget, table

#: Texts of the sample, its shingles that come last (shown ``OFTEN`` times or more) at most; the order only.
SAMPLE, OFTEN, LAST = 4_000, 3, 200_000
SHINGLES_AT_ONCE = 50_000
#: Weight of a block of sets, which a last part may exceed by half; shingles that weigh as much as a set; rows of what buckets ask
#: to be compared that a task holds to drop repeats.
HOME, HEAVY, TOLD = 1024, 1024, 400_000
#: SimHash words of a set, and the differing bits of them from which a pair is not compared in full. Sets of similarity 0.8
#: differ in 39 (many shingles) to 48 (four and five) bits on average, with a deviation of about 6: ``FAR`` is more than 6 of them beyond.
WORDS, FAR = 4, 88
FACES = [f"f{j}" for j in range(WORDS)]


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of fewer words: one; of none: empty."""
    ws = text.lower().split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    flat = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = ends - np.array([len(w) for w in ws])
    n = max(len(ws) - shingle + 1, 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(ws)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.concatenate([
        np.array([digest(flat[s:e], 42) for s, e in zip(starts[lo: lo + SHINGLES_AT_ONCE], ends[lo: lo + SHINGLES_AT_ONCE])], np.uint64)
        for lo in range(0, n, SHINGLES_AT_ONCE)]))


def mark(own: np.ndarray) -> int:
    """The id of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64))


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Of sets of ``n`` shingles, how many first ones hold one of every set that is similar enough."""
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


def far(percent: int) -> int:
    """Differing SimHash bits from which sets cannot be of this similarity, but for a chance below 1e-9."""
    return FAR if percent >= 80 else 64 * WORDS + 1


def _last(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that a sample of the texts often shows, the less frequent ones first."""

    def run(batches):
        for b in batches:
            for t in texts(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, shingle).view(np.int64))], names=["h"])

    every = max(docs.count() // SAMPLE, 1)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()
    often = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    got = often.orderBy(F.desc("n"), "h").limit(LAST).toPandas()
    return got["h"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def prints(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, th, id, n, first, f0, ...) for each row: a hash of the text, its set's id, size, first shingles in order and SimHash words."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    load = share(docs.sparkSession, _last(docs, shingle))

    def run(batches):
        last = load()
        sort = np.argsort(last)
        named = last[sort]
        for b in batches:
            ids, n, first, faces = [], [], [], []
            for t in texts(b.column(1)):
                own = shingles(t, shingle)
                ids.append(mark(own))
                n.append(len(own))
                rank = np.zeros(len(own), np.int64)
                if len(named) and len(own):
                    at = np.minimum(np.searchsorted(named, own), len(named) - 1)
                    rank = np.where(named[at] == own, sort[at] + 1, 0)
                first.append(own[np.argsort(rank, kind="stable")][: int(prefix(np.int64(len(own)), percent))].view(np.int64))
                faces.append(majority(counted(own, WORDS), len(own)))
            f = np.array(faces, np.int64).reshape(b.num_rows, WORDS)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in first], dtype=np.int64)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*first, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), keys, *(pa.array(f[:, j]) for j in range(WORDS))],
                                             names=["doc_id", "th", "id", "n", "first", *FACES])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        run, f"doc_id {kind}, th long, id long, n long, first array<long>, " + ", ".join(f"{x} long" for x in FACES))


def apart(one: str, two: str):
    """Differing SimHash bits of two column prefixes."""
    return sum((F.bit_count(F.col(one + x).bitwiseXOR(F.col(two + x))) for x in FACES), F.lit(0))


def _sets(ids: DataFrame, docs: DataFrame, marks: DataFrame, shingle: int) -> DataFrame:
    """A written table (id, own) of the whole sets of ``ids``."""
    th = cut(marks.select("id", "th").join(ids, "id", "left_semi").groupBy("id").agg(F.min("th").alias("th")).select("th"))
    asked = sieve(th, "th")

    def sets(batches):
        for b in batches:
            own = [shingles(t, shingle) for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([mark(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["id", "own"])

    return table(docs.select("text", F.xxhash64("text").alias("th")).where(asked("th")).join(th, "th", "left_semi").dropDuplicates(["th"]).select("text")
                 .mapInArrow(sets, "id long, own binary").dropDuplicates(["id"]))


def _verified(pairs: DataFrame, docs: DataFrame, marks: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose sets are similar enough."""
    kept = cut(pairs)
    found = _sets(kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), docs, marks, shingle)

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(both * (100 + percent) >= percent * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    one = found.select(F.col("id").alias("src"), F.col("own").alias("__x"))
    two = found.select(F.col("id").alias("dst"), F.col("own").alias("__y"))
    out = cut(kept.join(one, "src").join(two, "dst").select("src", "dst", "__x", "__y").mapInArrow(compare, "src long, dst long"))
    forget(found)
    return out


def common(sets: list) -> np.ndarray:
    """How many elements each two of ``sets`` (sorted, distinct) share."""
    size = np.array([len(x) for x in sets])
    owner, flat = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    # elements of one set alone are shared with none
    new = np.cumsum(n > 1) - 1
    live = n[column] > 1
    owner, column = owner[live], new[column[live]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    sort = np.argsort(column, kind="stable")
    owner, column = owner[sort], column[sort]
    for lo in range(0, int(n[n > 1].size), 2048):
        i, j = np.searchsorted(column, [lo, lo + 2048])
        held = np.zeros((len(sets), 2048), np.float32)
        held[owner[i:j], column[i:j] - lo] = 1
        out += held @ held.T
    return out.astype(np.int64)


def placed(homes: DataFrame, ties: DataFrame) -> DataFrame:
    """(id, block) of sets (id, n, home): blocks of full weight ``HOME``, whatever the homes' sizes.

    Homes that ``ties`` (src, dst) join are one field. A field's homes, large
    ones in parts, are dealt into blocks one after another, so a group whose
    sets name many small homes still has as few blocks as its weight asks for.
    """
    weight = F.lit(1) + F.floor(F.col("n") / F.lit(HEAVY)).cast("long")
    homes = cut(homes.select("id", "home", weight.alias("w")))
    field = connected_components(ties)
    parts = homes.groupBy("home").agg(F.ceil(F.sum("w") * 2 / F.lit(HOME)).alias("__parts"))
    dealt = homes.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("id", F.lit(HOME)), F.col("__parts"))).drop("__parts")
    whole = dealt.groupBy("home", "part").agg(F.sum("w").alias("w")).join(field, F.col("home") == F.col("node"), "left").withColumn("field", F.coalesce("component", "home"))
    before = F.sum("w").over(Window.partitionBy("field").orderBy("home", "part")) - F.col("w")
    blocks = cut(whole.select("home", "part", F.xxhash64("field", F.floor(before / F.lit(HOME))).alias("block")))
    return cut(dealt.join(blocks, ["home", "part"]).select("id", "block"))


def links(docs: DataFrame, marks: DataFrame, shingle: int, percent: int, probe=None) -> DataFrame:
    """Links (src, dst) of set ids whose components are those of all pairs of similarity ``percent`` / 100 or more.

    ``probe`` proposes pairs (src, dst) of the sets (id, f0, ...); like those of each
    bucket's star they link once their whole sets say so.
    What these do not join meets pairwise in blocks, which say
    only where sets have to be compared: each set has a home (of the heads that it
    is likely to be like, that of its largest bucket; or itself), homes are packed
    into blocks, and two blocks with likely partners are a unit, in which all
    sets are compared in whole. So a group of near copies that are not similar
    enough is compared in units of bounded size, without a row for each pair, and
    a unit tells one link for each component that it joins to another.
    """
    limit = far(percent)
    classes = table(marks.drop("doc_id", "th").dropDuplicates(["id"]))
    rows = classes.select(F.explode("first").alias("key"), "id")
    keys = rows.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1").select("key")
    shared = table(rows.join(keys, "key", "left_semi").join(classes.drop("first"), "id"))
    # each bucket's member of fewest shingles: the others may be like it
    heads = cut(shared.groupBy("key").agg(F.min(F.struct("n", "id", *FACES)).alias("h"), F.count("*").alias("h_size"))
                .select("key", "h_size", *(F.col("h." + c).alias("h_" + c) for c in ("n", "id", *FACES))))
    met = shared.join(heads, "key")
    star = (met.where((F.col("id") != F.col("h_id")) & (F.col("h_n") * 100 >= F.col("n") * percent) & (apart("", "h_") < limit))
            .select(F.col("h_id").alias("src"), F.col("id").alias("dst")))
    if probe:
        star = star.unionByName(probe(classes.where("n > 0").select("id", *FACES)))
    near = _verified(star.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), docs, marks, shingle, percent)
    comp = connected_components(near)
    joined = table(shared.join(comp, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id")).drop("node", "component"))
    many = cut(joined.groupBy("key").agg(F.min("c").alias("__lo"), F.max("c").alias("__hi")).where("__lo < __hi").select("key"))
    live = cut(joined.join(many, "key", "left_semi").select("id", "n", "c").distinct())
    likely = cut(met.where(apart("", "h_") < limit).join(live.select("id"), "id").groupBy("id", "h_id").agg(F.max("h_size").alias("h_size")))
    home = likely.groupBy("id").agg(F.max(F.struct("h_size", "h_id"))["h_id"].alias("home"))
    blocks = placed(live.join(home, "id", "left").select("id", "n", F.coalesce("home", "id").alias("home")), likely.select(F.col("id").alias("src"), F.col("h_id").alias("dst")))
    known = table(joined.join(many, "key", "left_semi").join(blocks, "id"))
    ready = units(known, "key", "id").select("key", "__a", "__b", "__own", "id", "n", "c", "block", *FACES)

    def meet(batches):
        out, size = [], 0

        def told():
            x = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(2)], names=["p", "q"])

        for t, edge in grouped(batches):
            a, b, own, ids, n, c, block = (t.column(i).to_numpy() for i in range(1, 8))
            f = np.column_stack([t.column(8 + j).to_numpy() for j in range(WORDS)]).view(np.uint64)
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi - lo < 2:
                    continue
                g = slice(lo, hi)
                ok = (ids[g][:, None] < ids[g][None, :]) & (c[g][:, None] != c[g][None, :])
                # a pair within a block meets in the block's own unit only
                if a[lo] != b[lo]:
                    ok &= own[g][:, None] != own[g][None, :]
                small, big = np.minimum(n[g][:, None], n[g][None, :]), np.maximum(n[g][:, None], n[g][None, :])
                i, j = np.nonzero(ok & (small * 100 >= big * percent))
                near = np.bitwise_count(f[g][i] ^ f[g][j]).sum(1, dtype=np.int32) < limit
                i, j = lo + i[near], lo + j[near]
                if len(i):
                    p, q = np.minimum(block[i], block[j]), np.maximum(block[i], block[j])
                    out.append(np.unique(np.column_stack([p, q]), axis=0))
                    size += len(out[-1])
            if size >= TOLD:
                yield from told()
                out, size = [], 0
        if out:
            yield from told()

    asked = ready.mapInArrow(meet, "p long, q long").distinct()
    asked = cut(asked.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block")).join(live.join(blocks, "id"), "block").select("p", "q", "id", "c"))
    found = _sets(asked.select("id").distinct(), docs, marks, shingle)
    loaded = asked.join(found, "id").select("p", "q", "id", "c", "own").repartition("p", "q").sortWithinPartitions("p", "q", "id")

    def verify(batches):
        for t, edge in grouped(batches, 2):
            c = t.column(3).to_numpy()
            for lo, hi in zip(edge[:-1], edge[1:]):
                own = [np.frombuffer(x.as_py(), np.uint64) for x in t.column(4)[lo:hi]]
                size, one = np.array([len(x) for x in own]), c[lo:hi]
                near = common(own) * (100 + percent) >= percent * (size[:, None] + size[None, :])
                root = one[components(near | (one[:, None] == one[None, :]))]
                told = np.unique(np.column_stack([root, one])[root != one], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(told[:, k])) for k in range(2)], names=["src", "dst"])

    out = cut(near.unionByName(loaded.mapInArrow(verify, "src long, dst long")))
    forget(classes, shared, joined, known, found)
    return out


def labelled(docs: DataFrame, shown, shingle: int, percent: int, probe=None) -> DataFrame:
    """(doc_id, th, least) for each row of ``docs``: ``least`` is the smallest ``shown`` value of its component."""
    marks = table(prints(docs, shingle, percent))
    comp = connected_components(links(docs, marks, shingle, percent, probe))
    whole = marks.groupBy("id").agg(F.min(shown).alias("low")).join(comp, F.col("id") == F.col("node"), "left").select("id", "low", F.coalesce("component", "id").alias("c"))
    # on its own first, so that the join may split a component of very many classes
    lows = cut(whole.groupBy("c").agg(F.min("low").alias("least")))
    out = cut(marks.select("doc_id", "th", "id").join(whole.join(lows, "c").select("id", "least"), "id"))
    forget(marks)
    return out
