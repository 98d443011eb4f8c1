"""Exact removal of long repeated byte strings by longest-previous-factor arrays.

Every ``window``-byte string has an anchor: its gram of least hash. Windows
that share an anchor occurrence form a run, and equal windows have equal
anchors at equal offsets, so only runs whose anchor gram occurs twice can hold
a repeat. Runs with equal content are equal throughout. What is left, runs of
one anchor with different contents, is brought into suffix order within bounded
units; longest common prefixes with the previous and next smaller positions
give the longest-previous-factor array, and a window whose value reaches its
length repeats an earlier one. Anchors with very many different contents are refined instead by grouped
aggregations: their windows are cut into parts by place around the anchor, and
only where parts agree in the bytes that all their windows hold, but not
wholly, are the parts cut further. So no unit grows with the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import fresh, read, texts, tune
from lociframe.session import cut, forget, scratch, table

WINDOW, GRAM = 200, 64
#: Contents of one anchor that a unit takes; anchors with more are refined in parts.
UNIT = 400
#: Parts into which a part's windows are cut.
FAN = 6
#: Bytes hashed at once; bytes of a text's segment (its windows start there).
CHUNK, SEGMENT = 1_000_000, 4_000_000

_rng = np.random.default_rng(20)
_TABLE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2 ** 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    grid = full.reshape(blocks, width)
    prefix = np.minimum.accumulate(grid, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[:n], prefix[width - 1: width - 1 + n])


def runs(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple:
    """Runs of windows with one anchor in texts laid end to end: (text number, start, windows, gram hash, content hash)."""
    n = len(buf)
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if n < window:
        return empty
    power, back = _powers(_BASE, n + 1), _powers(_BACK, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[buf] * power[:n], out=total[1:])
    grams = _mix((total[gram:] - total[: n + 1 - gram]) * back[: n + 1 - gram])
    low = np.uint64((1 << 24) - 1)
    best = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & low
    edge = np.zeros(n + 1, np.int32)
    ok = lengths >= window
    np.add.at(edge, starts[ok], 1)
    np.add.at(edge, starts[ok] + lengths[ok] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    if not len(at):
        return empty
    anchor = best[at]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    s = at[first]
    e = s + count - 1 + window
    content = _mix((total[e] - total[s]) * back[s]) ^ (count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    # texts of no length share a start with the next: the last one starting there holds the window
    text = np.searchsorted(starts, s, side="right") - 1
    return text, s - starts[text], count, grams[anchor[first].astype(np.int64)], content


def text_runs(rows: list, window: int = WINDOW, gram: int = GRAM):
    """``runs`` over many texts in chunks of bounded size: yields (row number, start, windows, gram hash, content hash)."""
    parts, size = [], 0

    def flush():
        buf = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        lengths = np.array([len(p[2]) for p in parts], np.int64)
        t, s, n, h, c = runs(buf, np.cumsum(lengths) - lengths, lengths, window, gram)
        row, base = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
        return row[t], s + base[t], n, h, c

    for i, t in enumerate(rows):
        if not t or len(t) < window:
            continue
        for lo in range(0, len(t) - window + 1, SEGMENT):
            part = t[lo: lo + SEGMENT + window - 1]
            parts.append((i, lo, part))
            size += len(part)
            if size >= CHUNK:
                yield flush()
                parts, size = [], 0
    if parts:
        yield flush()


def suffix_ranks(contents: list) -> list:
    """Ranks of all positions of ``contents`` laid end to end, by their first 1, 2, 4, ... symbols until they all differ.

    Each content ends in a symbol of its own, below all bytes, so no match leaves its content.
    """
    ends = np.cumsum([len(c) + 1 for c in contents]) - 1
    symbols = np.frombuffer(b"\0".join([*contents, b""]), np.uint8).astype(np.int64) + len(contents)
    symbols[ends] = np.arange(len(contents))
    ranks, n, k = [np.unique(symbols, return_inverse=True)[1].reshape(-1)], len(symbols), 1
    while ranks[-1].max() < n - 1:
        behind = np.full(n, -1, np.int64)
        behind[: max(n - k, 0)] = ranks[-1][k:]
        ranks.append(np.unique(ranks[-1] * (n + 1) + behind + 1, return_inverse=True)[1].reshape(-1))
        k *= 2
    return ranks


def common_prefix(ranks: list, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at each two positions; 0 where either is -1."""
    n, real = len(ranks[0]), (one >= 0) & (two >= 0)
    i, j, out = np.where(real, one, 0), np.where(real, two, 0), np.zeros(len(one), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = real & (i < n) & (j < n)
        same = inside & (ranks[level][np.minimum(i, n - 1)] == ranks[level][np.minimum(j, n - 1)]) & (one != two)
        step = np.where(same, 1 << level, 0)
        i, j, out = i + step, j + step, out + step
    return out


def smaller_neighbours(order: np.ndarray) -> tuple:
    """For each place of a suffix array: the previous and the next entry that is a smaller position, -1 for none."""
    before, after, stack = [-1] * len(order), [-1] * len(order), []
    for r, x in enumerate(order.tolist()):
        while stack and stack[-1][1] > x:
            after[stack.pop()[0]] = x
        if stack:
            before[r] = stack[-1][1]
        stack.append((r, x))
    return np.array(before, np.int64), np.array(after, np.int64)


def factors(contents: list) -> tuple:
    """(longest previous factor, longest factor elsewhere) of each position of ``contents`` laid end to end, each with one end symbol.

    In suffix order, the longest match with an earlier position is met at the
    previous or the next smaller position; the longest match with any position
    is met at a neighbour.
    """
    ranks = suffix_ranks(contents)
    order = np.argsort(ranks[-1], kind="stable")
    before, after = smaller_neighbours(order)
    previous, elsewhere = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    previous[order] = np.maximum(common_prefix(ranks, order, before), common_prefix(ranks, order, after))
    lcp = common_prefix(ranks, order[1:], order[:-1])
    elsewhere[order] = np.maximum(np.append(lcp, 0), np.insert(lcp, 0, 0))
    return previous, elsewhere


def repeated_windows(contents: list, place: np.ndarray, window: int = WINDOW) -> tuple:
    """(owner, offset, repeated, later) of each window of ``contents``, whose windows follow each other from ``place`` on (a sort key, a row each).

    A window repeats when its longest factor elsewhere has ``window`` bytes or
    more, and repeats an earlier one when its longest previous factor has.
    """
    by_place = np.lexsort((place[:, 2], place[:, 1], place[:, 0]))
    own = [contents[i] for i in by_place]
    previous, elsewhere = factors(own)
    size = np.array([len(c) - window + 1 for c in own], np.int64)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(np.cumsum([0] + [len(c) + 1 for c in own[:-1]]), size) + offset
    return np.repeat(by_place, size), offset, elsewhere[at] >= window, previous[at] >= window


def _spans(owner: np.ndarray, offset: np.ndarray, flag: np.ndarray) -> tuple:
    """Maximal runs of flagged windows: (owner, first, last)."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (owner[at[1:]] != owner[at[:-1]]) | (offset[at[1:]] != offset[at[:-1]] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return owner[at[first]], offset[at[first]], offset[at[last]]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, tk, text): an id that is never null and a hash of the text tell rows apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2 ** 63))).alias("doc"),
                       F.xxhash64("text").alias("tk"), "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """(doc, tk, spans array<struct<s:int,e:int>>): byte spans covered by windows that repeat.

    With ``keep_first`` only windows that repeat an earlier one (smaller
    doc_id, then smaller start) are covered; rows that agree in doc_id and
    text are then one text. Spans may overlap; see ``merged``.
    """
    tune(docs.sparkSession)
    with scratch():
        return _spans_of(docs, window, gram, keep_first)


def _spans_of(docs: DataFrame, window: int, gram: int, keep_first: bool) -> DataFrame:
    keyed = _keyed(docs)

    def scan(batches):
        for b in batches:
            for row, s, n, h, c in text_runs(texts(b.column(2)), window, gram):
                for lo in range(0, len(row), 100_000):
                    k = slice(lo, lo + 100_000)
                    take = pa.array(row[k])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[k].view(np.int64)), pa.array(c[k].view(np.int64)), b.column(0).take(take), b.column(1).take(take),
                         pa.array(s[k].astype(np.int32)), pa.array(n[k].astype(np.int32))], names=["h", "c", "doc", "tk", "s", "n"])

    every = table(keyed.mapInArrow(scan, "h long, c long, doc long, tk long, s int, n int"))
    # on its own first, so that the join below may split an anchor that very many runs share
    twice = cut(every.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"))
    live = table(every.join(twice, "h", "left_semi"))
    forget(every)
    classes = cut(live.groupBy("h", "c").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "tk", "s")).alias("first"), F.min("n").alias("n")))
    mixed = classes.groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1")

    copied = classes.where("copies > 1").select("h", "c", "first")
    whole = live.join(copied, ["h", "c"])
    if keep_first:
        whole = whole.where(F.struct("doc", "tk", "s") != F.col("first"))
    whole = whole.select("doc", "tk", "s", (F.col("s") + F.col("n") - 1 + window).alias("e"))

    wanted = (classes.join(mixed, "h")
              .select(F.col("first.doc").alias("doc"), F.col("first.tk").alias("tk"),
                      F.struct("h", F.col("first.s").alias("s"), "n", "copies", "contents").alias("r"))
              .groupBy("doc", "tk").agg(F.collect_list("r").alias("rs")))

    def fetch(batches):
        names = ["h", "doc", "tk", "s", "copies", "contents", "content"]
        for b in batches:
            out: list = [[] for _ in names]
            size = 0
            for doc, tk, t, rs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3).to_pylist()):
                for r in rs:
                    part = t[r["s"]: r["s"] + r["n"] - 1 + window]
                    for col, v in zip(out, (r["h"], doc, tk, r["s"], r["copies"], r["contents"], part)):
                        col.append(v)
                    size += len(part)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    fetched = table(keyed.join(wanted, ["doc", "tk"]).dropDuplicates(["doc", "tk"])
                    .select("doc", "tk", "text", "rs")
                    .mapInArrow(fetch, "h long, doc long, tk long, s int, copies long, contents long, content binary"))

    def order(batches):
        # whole anchors at a time, in units of some thousands of windows
        held: list = []

        def done():
            t = pa.Table.from_batches(held)
            content = t.column(6).to_pylist()
            place = np.column_stack([t.column(i).to_numpy() for i in (1, 2, 3)]).astype(np.int64)
            owner, offset, repeated, later = repeated_windows(content, place, window)
            o, a, z = _spans(owner, offset, later if keep_first else repeated & (t.column(4).to_numpy()[owner] == 1))
            return pa.RecordBatch.from_arrays([pa.array(place[o, 0]), pa.array(place[o, 1]),
                                               pa.array((place[o, 2] + a).astype(np.int32)),
                                               pa.array((place[o, 2] + z + window).astype(np.int32))], names=["doc", "tk", "s", "e"])

        count = 0
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            for lo, hi in zip(edges[:-1], edges[1:]):
                if held and count >= UNIT and held[-1].column(0)[0].as_py() != h[lo]:
                    yield done()
                    held, count = [], 0
                held.append(b.slice(lo, hi - lo))
                count += hi - lo
        if held:
            yield done()

    small = (fetched.where(F.col("contents") <= UNIT).repartition("h").sortWithinPartitions("h")
             .mapInArrow(order, "doc long, tk long, s int, e int"))
    large = _refined(fetched.where(F.col("contents") > UNIT), window, gram, keep_first)
    return cut(whole.unionByName(small).unionByName(large)
               .groupBy("doc", "tk").agg(F.collect_list(F.struct("s", "e")).alias("spans")))


def _part_widths(places: int) -> list:
    """Windows of a part, level by level, down to 1."""
    out = []
    while not out or out[-1] > 1:
        out.append(-(-(out[-1] if out else places) // FAN))
    return out


def _refined(contents: DataFrame, window: int, gram: int, keep_first: bool) -> DataFrame:
    """(doc, tk, s, e) of repeated windows among (h, doc, tk, s, copies, content), of any number of contents an anchor.

    Windows are numbered by where they start before the anchor. On each level a
    part is so many neighbouring numbers; contents whose windows of a part are
    all equal give a span each (but the first, with ``keep_first``) and go on
    as one; parts that share what all windows of the part hold are cut into
    smaller ones. On the last level a part is one window.
    """
    spark = contents.sparkSession
    places = window - gram + 1
    live = contents.select("h", "doc", "tk", "s", "copies", "content", F.lit(-1).alias("q"))
    out = spark.createDataFrame([], "doc long, tk long, s int, e int")
    names = ["key", "full", "h", "doc", "tk", "s", "copies", "content", "q"]
    for width in _part_widths(places):
        if live.isEmpty():
            break

        def parts(batches, width=width):
            for b in batches:
                rows: list = []
                for h, doc, tk, s, copies, content, q in zip(*(b.column(i).to_pylist() for i in range(7))):
                    q = places - 1 - anchor_of(content, h, gram) if q < 0 else q
                    n = len(content) - window + 1
                    for p in range(q // width, (q + n - 1) // width + 1):
                        lo, hi = max(q, p * width), min(q + n, (p + 1) * width)
                        core, piece = content[p * width + width - 1 - q: p * width + window - q], content[lo - q: hi - 1 - q + window]
                        key = xxhash.xxh3_128_digest(b"%d %d " % (h, p) + core)
                        rows.append((key, xxhash.xxh3_128_digest(b"%d " % lo + key + piece), h, doc, tk, s + lo - q, copies, piece, lo))
                cols = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]
        cut_up = table(live.select("h", "doc", "tk", "s", "copies", "content", "q")
                       .mapInArrow(parts, "key binary, full binary, h long, doc long, tk long, s int, copies long, content binary, q int"))
        classes = cut_up.groupBy("key", "full").agg(F.count("*").alias("n"), F.min(F.struct("doc", "tk", "s", "h", "copies", "content", "q")).alias("first"))
        same = classes.where("n > 1").select("key", "full", F.struct("first.doc", "first.tk", "first.s").alias("f"))
        met = cut_up.join(same, ["key", "full"])
        met = met.where(F.struct("doc", "tk", "s") != F.col("f")) if keep_first else met.where("copies = 1")
        out = out.unionByName(met.select("doc", "tk", "s", (F.col("s") + F.octet_length("content")).alias("e")))
        several = classes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
        live = table(classes.join(several, "key", "left_semi").select("first.*"))
    return out


def anchor_of(content: bytes, h: int, gram: int) -> int:
    """Where the gram of hash ``h`` first stands in ``content``."""
    buf = np.frombuffer(content, np.uint8)
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[buf] * _powers(_BASE, n), out=total[1:])
    grams = _mix((total[gram:] - total[: n + 1 - gram]) * _powers(_BACK, n + 1 - gram))
    return int(np.flatnonzero(grams == np.uint64(h & (2 ** 64 - 1)))[0])


def merged(spans: list) -> list:
    """Disjoint, maximal spans in order."""
    out: list = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def without(text: bytes | None, spans: list) -> bytes:
    """The bytes outside disjoint spans."""
    at, out = 0, []
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, (text or b"")[at:]])


def removal_digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``.

    Null texts are empty; texts shorter than a window keep all bytes. Rows
    that repeat an id with the same or another text are separate texts. Other
    columns are not read. An empty table gives an empty result.
    """
    keyed = _keyed(docs)
    spans = repeated_spans(docs, window, gram, keep_first)
    joined = keyed.join(spans, ["doc", "tk"], "left").select("doc", "tk", "text", "spans")

    def run(batches):
        for b in batches:
            size, gone, n, sha = [], [], [], []
            for t, ss in zip(texts(b.column(2)), b.column(3).to_pylist()):
                m = merged(ss)
                size.append(len(t or b""))
                gone.append(sum(e - s for s, e in m))
                n.append(len(m))
                sha.append(hashlib.sha256(without(t, m)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, n)), pa.array(sha, pa.string())],
                                             names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = joined.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    kind = docs.schema["doc_id"].dataType
    return out.select(F.when(F.col("doc") != F.lit(-(2 ** 63)), F.col("doc")).cast(kind).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_first: bool = True) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``; all other columns as they are.

    A character that a span splits is dropped whole. Null texts stay null, texts
    under a window stay as they are. Rows that agree in id and text lose the
    same; rows of one id with other texts, and of null ids, are texts of their
    own. An empty table stays empty; extra columns of any name are kept.
    """
    d, t, doc, tk, ss = (fresh(docs, x) for x in ("__d", "__t", "__doc", "__tk", "__spans"))
    spans = repeated_spans(docs, window, gram, keep_first).toDF(doc, tk, ss)
    keyed = (docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2 ** 63))))
             .withColumn(t, F.xxhash64("text")))
    joined = keyed.join(spans, (F.col(d) == F.col(doc)) & (F.col(t) == F.col(tk)), "left")

    @F.pandas_udf("string")
    def cut_out(text, spans):
        import pandas as pd

        return pd.Series([without(t.encode(), merged(list(s))).decode("utf-8", "ignore") if s is not None and t is not None else t
                          for t, s in zip(text, spans)], dtype=object)

    new = F.when(F.col(ss).isNull(), F.col("text")).otherwise(cut_out("text", ss))
    return joined.select(*[new.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op9_suffix_dedup(spark, sf_dir):
    return removal_digest(read(spark, sf_dir, "documents"))
