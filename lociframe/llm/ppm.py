"""Language-model scores: prediction by partial matching over bytes, and a smoothed unigram base.

The trie of byte contexts up to ``ORDER`` is counted over all training rows
and keeps every node. It is never in one place: a context lies in the shard of
its last two symbols with all longer contexts that end in them, and only orders
0 and 1 (66,049 pairs at most) go to every shard. Texts are cut into chunks; the
distinct (ORDER + 1)-grams of a chunk visit their shards, packed into one blob a
shard, and their probabilities come back in the same order. Escapes are
estimated by the number of distinct symbols (method C) and symbols seen in a
longer context are excluded from the shorter one. The end of a text is a symbol
of its own. Words are counted in the same way, by 64-bit hashes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import fold, read, share, texts, tune
from lociframe.session import cut, forget, table

ORDER = 5
FOLDS = 10
#: Bits of a symbol: 256 bytes, and ``EDGE`` for the end of a text and for what stands before it.
BITS, EDGE = 9, 256
#: Bytes of a chunk.
CHUNK_BYTES = 8_000_000
#: Bytes of texts that are coded at once, and grams that a shard decodes before it counts them.
SLICE_BYTES, MERGE = 4_000_000, 2_000_000
MAX_SHARDS = 1 << 16


def tokens(text: bytes | None) -> list:
    """Words after lower-casing A-Z, and one end token (the empty word)."""
    return [*text.lower().split(), b""] if text else [b""]


def coded(rows: list, order: int = ORDER, most: int = 0):
    """Yields (codes, rows): for each byte of each lower-cased text and for its end, it and its ``order`` predecessors, and its text's index.

    Slices are of ``SLICE_BYTES`` or so; a longer text spans several.
    """
    most = most or SLICE_BYTES

    def slices():
        held, size = [], 0
        for i, t in enumerate(rows):
            t = (t or b"").lower()
            for lo in range(0, len(t) + 1, most):
                last = lo + most > len(t)
                before = np.frombuffer(t[max(lo - order, 0): lo], np.uint8).astype(np.uint16)
                own = np.frombuffer(t[lo: lo + most], np.uint8).astype(np.uint16)
                edge = np.full(order - len(before), EDGE, np.uint16)
                held.append((i, len(own) + last, np.concatenate([edge, before, own, np.full(int(last), EDGE, np.uint16)])))
                size += len(own) + 1
                if size >= most:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    for held in slices():
        buf = np.concatenate([x for _, _, x in held])
        lengths = np.array([n for _, n, _ in held], np.int64)
        code = np.zeros(len(buf), np.uint64)
        for j in range(order + 1):
            code[order:] |= buf[order - j: len(buf) - j].astype(np.uint64) << np.uint64(BITS * j)
        first = np.cumsum(lengths + order) - lengths
        keep = np.arange(lengths.sum()) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
        yield code[keep], np.repeat(np.array([i for i, _, _ in held], np.int64), lengths)


def packed(values: np.ndarray) -> bytes:
    """Values as compressed planes of bytes; sorted uint64 as the steps between them."""
    x = np.diff(values, prepend=np.uint64(0)) if values.dtype == np.uint64 else values
    return pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(blob, size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T.copy().view(dtype).reshape(-1)
    return np.cumsum(raw, dtype=np.uint64) if dtype == np.uint64 else raw


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple:
    """Distinct codes, sorted, and the sums of their counts."""
    c, inverse = np.unique(codes, return_inverse=True)
    return c, np.bincount(inverse.reshape(-1), counts, len(c)).astype(np.int64)


def counted(codes: np.ndarray, flags: np.ndarray) -> tuple:
    """Distinct codes (of 63 bits), sorted, and how often each has its flag."""
    x = np.sort(codes << np.uint64(1) | flags.astype(np.uint64))
    c = x >> np.uint64(1)
    first = np.concatenate([np.zeros(min(len(c), 1), np.int64), np.flatnonzero(c[1:] != c[:-1]) + 1])
    return c[first], np.add.reduceat((x & np.uint64(1)).astype(np.int64), first) if len(c) else np.zeros(0, np.int64)


class Index:
    """Open-addressing map from uint64 codes to positions, probed by whole arrays."""

    def __init__(self, codes: np.ndarray):
        size = 1 << max(int(np.ceil(np.log2(max(len(codes), 1) * 2 + 2))), 4)
        self.mask, self.shift = np.uint64(size - 1), np.uint64(64 - int(np.log2(size)))
        self.codes, self.slot = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        at, left, self.probes = self._home(codes), np.arange(len(codes)), 0
        while len(left):
            self.probes += 1
            free = self.slot[at] < 0
            cells, who = np.unique(at[free], return_index=True)
            own = np.flatnonzero(free)[who]
            self.slot[cells], self.codes[cells] = left[own], codes[left[own]]
            stay = np.ones(len(left), bool)
            stay[own] = False
            left, at = left[stay], ((at[stay].astype(np.uint64) + np.uint64(1)) & self.mask).astype(np.int64)

    def _home(self, codes):
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Positions, -1 where absent."""
        at = self._home(codes)
        slot = self.slot[at]
        out = np.where((slot >= 0) & (self.codes[at] == codes), slot, -1)
        ask = np.flatnonzero((slot >= 0) & (out < 0))
        for _ in range(self.probes):
            if not len(ask):
                break
            cell = ((at[ask].astype(np.uint64) + np.uint64(1)) & self.mask).astype(np.int64)
            at[ask] = cell
            slot = self.slot[cell]
            hit = (slot >= 0) & (self.codes[cell] == codes[ask])
            out[ask[hit]] = slot[hit]
            ask = ask[(slot >= 0) & ~hit]
        return out


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (BITS * n)) - 1)


class Trie:
    """Pretrained PPM: orders[k] = (codes of context and symbol, counts)."""

    def __init__(self, orders: list):
        self.order = len(orders) - 1
        self.pairs, self.contexts = [], []
        below = None
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, (codes, counts) in enumerate(orders):
                sort = np.argsort(codes)
                codes, counts = codes[sort], counts[sort].astype(np.float64)
                ctx, inverse, q = np.unique(codes >> np.uint64(BITS), return_inverse=True, return_counts=True)
                inverse = inverse.reshape(-1)
                total = np.bincount(inverse, counts, len(ctx))
                index = Index(codes)
                log_c = np.log10(counts)
                top = log_c - np.log10(total + q)[inverse] if len(codes) else log_c
                escape = np.log10(q) - np.log10(total + q)
                den = rest_escape = np.zeros(len(ctx))
                if k and len(codes):
                    b_index, b_counts, b_ctx, b_total, b_q = below
                    lower = b_counts[b_index.find(codes & _mask(k))]
                    seen = np.bincount(inverse, lower, len(ctx))
                    own = b_ctx.find(ctx & _mask(k - 1))
                    left_q = b_q[own] - q
                    left = np.maximum(b_total[own] - seen, 0) + left_q
                    den = np.log10(left)
                    rest_escape = np.where(left_q > 0, np.log10(np.maximum(left_q, 1)) - np.log10(np.maximum(left, 1e-9)), 0.0)
                c_index = Index(ctx)
                below = (index, counts, c_index, total, q)
                self.pairs.append((index, log_c, top))
                self.contexts.append((c_index, escape, den, rest_escape))
                if k == 0:
                    self.floor = -np.log10(max(EDGE + 1 - len(codes), 1))

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each code after the bytes before it."""
        out = np.zeros(len(code))
        live = np.arange(len(code))
        above = np.full(len(code), -1, np.int64)  # context of the order above, where the coder has escaped from
        for k in range(self.order, -1, -1):
            if not len(live):
                return out
            index, log_c, top = self.pairs[k]
            c_index, escape, _, _ = self.contexts[k]
            c = code[live]
            at = index.find(c & _mask(k + 1))
            hit = at >= 0
            came = above >= 0
            if k < self.order:
                den, rest = self.contexts[k + 1][2], self.contexts[k + 1][3]
            fresh, later = hit & ~came, hit & came
            out[live[fresh]] += top[at[fresh]]
            if later.any():
                out[live[later]] += log_c[at[later]] - den[above[later]]
            miss = ~hit
            ctx = c_index.find((c[miss] >> np.uint64(BITS)) & _mask(k))
            start = (ctx >= 0) & ~came[miss]
            lost = live[miss]
            out[lost[start]] += escape[ctx[start]]
            go = came[miss]
            if go.any():
                out[lost[go]] += rest[above[miss][go]]
            live, above = lost, ctx.astype(np.int64)
        out[live] += self.floor
        return out


def chunked(base: DataFrame, folds: int) -> DataFrame:
    """(chunk, ids, train, sizes, texts): ``base`` (doc_id, text) in a row for each chunk of ``CHUNK_BYTES`` or a little more, written once.

    ``texts`` has the lower-cased texts one after the other, compressed; ``sizes`` their bytes.
    """
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        chunk, size, held = TaskContext.get().partitionId() << 32, 0, []

        def done():
            ids, train, own = (pa.concat_arrays([h[i] for h in held]) if i < 2 else [t for h in held for t in h[2]] for i in range(3))
            n = len(own)
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (ids, train, pa.array([len(t) for t in own], pa.int64()))]
            blob = pa.compress(b"".join(own), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists, pa.array([blob], pa.binary())], names=["chunk", "ids", "train", "sizes", "texts"])

        for b in batches:
            own = [(t or b"").lower() for t in texts(b.column(1))]
            lo = 0
            for i, t in enumerate(own):
                size += len(t) + 6
                if size > CHUNK_BYTES:
                    held.append((b.column(0)[lo: i + 1], b.column(2)[lo: i + 1], own[lo: i + 1]))
                    yield done()
                    chunk, size, held, lo = chunk + 1, 0, [], i + 1
            if lo < len(own):
                held.append((b.column(0)[lo:], b.column(2)[lo:], own[lo:]))
        if held:
            yield done()

    return table(base.withColumn("train", fold("doc_id", folds) != 0).mapInArrow(run, f"chunk long, ids array<{kind}>, train array<boolean>, sizes array<long>, texts binary"))


def texts_of(sizes: list, blob: bytes) -> list:
    whole = pa.decompress(blob, sum(sizes), codec="zstd", asbytes=True)
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [whole[i:j] for i, j in zip([0, *ends], ends)]


def grams_of(rows: list, train: np.ndarray, order: int, shards: int) -> tuple:
    """(codes, counts, edges): the distinct grams of texts by shard, in order, with their counts in training rows; where each shard starts."""
    code, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for c, row in coded(rows, order):
        c, k = counted(c, train[row])
        code, n = summed(np.concatenate([code, c]), np.concatenate([n, k])) if len(code) else (c, k)
    key = ((code >> np.uint64(BITS)) & _mask(2)).astype(np.int64)
    shard = ((key * 40503) & 0xFFFF) * shards >> 16
    sort = np.argsort(shard, kind="stable")
    return code[sort], n[sort], np.searchsorted(shard[sort], np.arange(shards + 1))


def words_of(rows: list, train: np.ndarray, shards: int) -> tuple:
    """(hashes, counts, edges, at, sizes): the same of tokens, by hash; of all tokens in order, which one each is; tokens of each text."""
    split = [tokens(t) for t in rows]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    every = list(itertools.chain.from_iterable(split))
    index = dict(zip(dict.fromkeys(every), itertools.count()))
    at = np.fromiter(map(index.__getitem__, every), np.int64, len(every))
    h = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
    sort = np.argsort(h)
    rank = np.empty(len(sort), np.int64)
    rank[sort] = np.arange(len(sort))
    at = rank[at]
    n = np.bincount(at, np.repeat(train, sizes), len(h)).astype(np.int64)
    return h[sort], n, np.searchsorted(h[sort] >> np.uint64(48), (np.arange(shards + 1) << 16) // shards), at, sizes


def grams(rows: DataFrame, order: int, shards: int) -> DataFrame:
    """(shard, chunk, n, codes, counts): the distinct grams of each chunk with their counts in training rows, a row each shard.

    Shard -1 has the chunk's pairs of order 1; shards from -2 down have its words.
    """

    def run(batches):
        for b in batches:
            for chunk, train, sizes, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                own, train = texts_of(sizes, blob), np.array(train, bool)
                code, n, at = grams_of(own, train, order, shards)
                low = summed((code & _mask(min(order, 1) + 1))[n > 0], n[n > 0])
                h, k, edge, *_ = words_of(own, train, shards)
                out = [(-1, *low)]
                out += [(s, code[i:j], n[i:j]) for s, (i, j) in enumerate(zip(at, at[1:])) if j > i]
                out += [(-2 - s, h[i:j], k[i:j]) for s, (i, j) in enumerate(zip(edge, edge[1:])) if j > i]
                for lo in range(0, len(out), 64):
                    s, c, m = zip(*out[lo: lo + 64])
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array([chunk] * len(s), pa.int64()), pa.array([len(x) for x in c], pa.int32()),
                                                      pa.array([packed(x) for x in c], pa.binary()), pa.array([packed(x) for x in m], pa.binary())], names=["shard", "chunk", "n", "codes", "counts"])

    return rows.select("chunk", "train", "sizes", "texts").mapInArrow(run, "shard int, chunk long, n int, codes binary, counts binary")


def _marginal(codes: np.ndarray, counts: np.ndarray, k: int) -> tuple:
    """Pairs of order ``k`` and their counts."""
    return summed(codes & _mask(k + 1), counts)


class Merge:
    """Sums of counts by code over blobs, some at a time."""

    def __init__(self, blobs: list):
        code, total, wait, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for _, n, codes, counts in blobs:
            wait.append((unpacked(codes, n, np.uint64), unpacked(counts, n, np.int64)))
            size += n
            if size >= MERGE:
                code, total = summed(np.concatenate([code, *(c for c, _ in wait)]), np.concatenate([total, *(k for _, k in wait)]))
                wait, size = [], 0
        self.code, self.total = summed(np.concatenate([code, *(c for c, _ in wait)]), np.concatenate([total, *(k for _, k in wait)]))


def answered(met: DataFrame, tasks: int, answer) -> DataFrame:
    """(shard, chunk, n, values): ``answer(blobs)`` -> (chunk, values) for all blobs of each shard together.

    A shard keeps its blobs packed while it sums their counts, and unpacks each again to answer it.
    """

    def run(batches):
        held, at = [], None

        def told():
            for chunk, values in answer(held):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([chunk], pa.int64()), pa.array([len(values)], pa.int32()), pa.array([packed(values)], pa.binary())],
                                                 names=["shard", "chunk", "n", "values"])

        for b in batches:
            for shard, *blob in zip(*(b.column(i).to_pylist() for i in range(5))):
                if shard != at:
                    if held:
                        yield from told()
                    held, at = [], shard
                held.append(blob)
        if held:
            yield from told()

    return met.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, chunk long, n int, values binary")


def probabilities(met: DataFrame, order: int, tasks: int) -> DataFrame:
    """(shard, chunk, n, values): log10 probabilities (single precision) of the grams of each chunk and shard, from the counts of all chunks."""

    def pairs(batches):
        for b in batches:
            for n, codes, counts in zip(*(b.column(i).to_pylist() for i in range(3))):
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(unpacked(codes, n, np.uint64).view(np.int64)), pa.array(unpacked(counts, n, np.int64))], names=["code", "n"])

    # at most 257 * 257 pairs
    low = met.where("shard = -1").select("n", "codes", "counts").mapInArrow(pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    load = share(met.sparkSession, (low["code"].to_numpy(np.int64).view(np.uint64), low["n"].to_numpy(np.int64)))

    def answer(blobs):
        lows, low_counts = load()
        all_ = Merge(blobs)
        code, total = all_.code[all_.total > 0], all_.total[all_.total > 0]
        trie = Trie([*(_marginal(lows, low_counts, k) for k in range(min(order, 1) + 1)), *(_marginal(code, total, k) for k in range(2, order + 1))]) if len(lows) else None
        logp = trie.log10(all_.code).astype(np.float32) if trie else np.full(len(all_.code), -np.log10(EDGE + 1), np.float32)
        for chunk, n, codes, _ in blobs:
            yield chunk, logp[np.searchsorted(all_.code, unpacked(codes, n, np.uint64))]

    return answered(met.where("shard >= 0"), tasks, answer)


def word_counts(met: DataFrame, tasks: int) -> DataFrame:
    """(shard, chunk, n, values): training counts of the words of each chunk and shard; chunk -1 has the shard's tokens and distinct words."""

    def answer(blobs):
        all_ = Merge(blobs)
        yield -1, np.array([all_.total.sum(), (all_.total > 0).sum()], np.int64)
        for chunk, n, codes, _ in blobs:
            yield chunk, all_.total[np.searchsorted(all_.code, unpacked(codes, n, np.uint64))]

    return answered(met.where("shard < -1"), tasks, answer)


def lm_scores(docs: DataFrame, folds: int = FOLDS, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Rows whose crc32(doc_id) mod ``folds`` is not 0 are the training rows.
    Null and empty texts are one end token. Null ids count as the empty text
    in the fold; repeated rows get a row each; other columns are not read. An
    empty table gives an empty result. Both scores are of the text after
    lower-casing A-Z; ``score`` is that of its bytes and its end.
    """
    spark = docs.sparkSession
    tune(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = chunked(docs.select("doc_id", "text"), folds)
    # two shards a chunk; a chunk of more has few grams for each
    chunks = rows.count()
    shards = min(max(1 << (2 * chunks - 1).bit_length(), 32), MAX_SHARDS) if chunks else 1
    tasks = max(shards // 2, 1)
    met = table(grams(rows, order, shards))
    words = table(word_counts(met, tasks))

    def sums(batches):
        for b in batches:
            x = np.array([unpacked(v, 2, np.int64) for v in b.column(0).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["n", "v"])

    total, distinct = words.where("chunk = -1").select("values").mapInArrow(sums, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    scale = float(np.log10(total + 0.1 * (distinct + 1)))

    def scored(left, right):
        ids, train, sizes = (left.column(x).combine_chunks().flatten() for x in ("ids", "train", "sizes"))
        own, train = texts_of(sizes.to_pylist(), left.column("texts")[0].as_py()), np.array(train.to_pylist(), bool)
        got = sorted(zip(*(right.column(x).to_pylist() for x in ("shard", "n", "values"))), key=lambda x: (x[0] < 0, abs(x[0])))
        # both in the order in which the chunk has sent them
        logp = np.concatenate([unpacked(v, n, np.float32) for s, n, v in got if s >= 0])
        counts = np.concatenate([unpacked(v, n, np.int64) for s, n, v in got if s < 0])
        code, _, _ = grams_of(own, train, order, shards)
        index, score = Index(code), np.zeros(len(own))
        for c, row in coded(own, order):
            score += np.bincount(row, logp[index.find(c)], len(own))
        *_, at, size = words_of(own, train, shards)
        first = np.cumsum(size) - size
        known, base = (np.add.reduceat(x[at], first) for x in ((counts > 0).astype(np.int64), np.log10(counts + 0.1)))
        return pa.table([ids, pc.invert(pa.array(train)), pa.array(size), pa.array(known), pa.array(base - size * scale), pa.array(score)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    back = probabilities(met, order, tasks).unionByName(words.where("chunk >= 0"))
    out = cut(rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    forget(rows, met, words)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op3_ppm_scores(spark, sf_dir):
    return lm_scores(read(spark, sf_dir, "documents"))
