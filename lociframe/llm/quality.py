"""Quality rules scored by an isolation forest.

Rule statistics of every whole text feed a forest of random splits; documents
that are isolated by short paths are anomalous. The forest is grown on half of
the good labelled rows and its threshold is set on the other half and the bad
ones, from a bounded sample (``MAX_TRAIN`` rows with the smallest hash of the
id). Everything else reads all rows; scoring is one narrow pass without a
shuffle.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import fresh, read, share, texts, tune

#: Labelled rows at most that grow the forest and set its threshold.
MAX_TRAIN = 20_000
TREES, SAMPLE = 100, 256
#: Share of good labelled rows that the threshold may reject at most.
MAX_GOOD_LOST = 0.01
#: Weight of a good row lost against a bad row found.
CAUTION = 5.0
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct"]


def repeated_words(words: list) -> int:
    """Words covered by 5-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 6:
        return 0
    ids: dict = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    size = max(len(ids), 1)
    if size ** 5 < 2 ** 62:
        key = code[: n - 4]
        for j in range(1, 5):
            key = key * size + code[j: n - 4 + j]
    else:
        pair = np.unique(code[:-1] * size + code[1:], return_inverse=True)[1].reshape(-1)
        four = np.unique(pair[:-2] * n + pair[2:], return_inverse=True)[1].reshape(-1)
        key = four[: n - 4] * size + code[4:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[inverse.reshape(-1)] > 1
    if not hit.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 5, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def statistics(text: bytes | None) -> tuple:
    """The values of STATS for one text; null has none of anything."""
    if not text:
        return (0,) * len(STATS)
    words = text.split()
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    bare = b"".join(words)
    continuation = len(bare) - len(bare.translate(None, bytes(range(0x80, 0xC0))))
    return (len(words), len(bare) - continuation, len(text) - len(text.translate(None, SYMBOLS)),
            len(full) - len(set(full)), repeated_words(words), len(full),
            len(text) - len(text.translate(None, _UPPER)), len(text) - len(text.translate(None, _PUNCT)))


def features(stats: np.ndarray) -> np.ndarray:
    """Shares of symbols, capitals and punctuation among a row's word characters.

    Lengths and repeats stay with the base rules: good rows vary widely there, so that splits on
    them isolate good rows as fast as bad ones.
    """
    x = stats.astype(np.float64)
    return x[:, [2, 6, 7]] / np.maximum(x[:, 1:2], 1)


def _c(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1),
                    np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation forest in numpy: arrays of nodes per tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.size = [], min(sample, len(x))
        depth = int(np.ceil(np.log2(max(self.size, 2))))
        for _ in range(trees if len(x) > 1 else 0):
            rows = x[rng.choice(len(x), self.size, replace=False)]
            nodes: list = []

            def grow(r: np.ndarray, d: int, rng=rng, nodes=nodes) -> int:
                me = len(nodes)
                span = r.max(0) - r.min(0) if len(r) else np.zeros(x.shape[1])
                live = np.flatnonzero(span > 0)
                if d >= depth or len(r) <= 1 or not len(live):
                    nodes.append((-1, 0.0, me, me, d + float(_c(len(r)))))
                    return me
                f = int(rng.choice(live))
                cut = rng.uniform(r[:, f].min(), r[:, f].max())
                nodes.append(None)
                left = grow(r[r[:, f] < cut], d + 1)
                right = grow(r[r[:, f] >= cut], d + 1)
                nodes[me] = (f, cut, left, right, 0.0)
                return me

            grow(rows, 0)
            f, t, a, b, p = map(np.array, zip(*nodes))
            self.trees.append((f, t, a, b, p))
        self.depth = depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in 0 to 1: the shorter the mean path, the higher."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for f, t, a, b, p in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                feature = f[at]
                go = np.take_along_axis(x, np.maximum(feature, 0)[:, None], 1)[:, 0] < t[at]
                at = np.where(go, a[at], b[at])
            total += p[at]
        return 2.0 ** (-(total / len(self.trees)) / max(float(_c(self.size)), 1e-9))


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[Forest, float]:
    """Forest and threshold from at most ``max_train`` labelled rows. Without labels nothing is rejected."""
    spark = docs.sparkSession
    tune(spark)
    good = (labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
            .groupBy("doc_id").agg(F.max("quality").alias("__q"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    rows = good.collect()
    if not rows:
        return Forest(np.zeros((0, 3))), 2.0
    few = F.broadcast(spark.createDataFrame([tuple(r) for r in rows], "doc_id long, __q int"))
    seen = measure(docs.select("doc_id", "text").join(few, "doc_id").select("doc_id", "text", "__q"), keep=["__q"])
    # of rows that repeat an id, the one of the least statistics: no more rows than ids
    pdf = seen.groupBy("doc_id", "__q").agg(F.min(F.struct(*STATS)).alias("s")).select("__q", "s.*").toPandas()
    if not len(pdf):
        return Forest(np.zeros((0, 3))), 2.0
    stats, q = pdf[STATS].to_numpy(np.int64), pdf["__q"].to_numpy()
    keep = ~base_failed(stats)
    x, q = features(stats)[keep], q[keep]
    order = np.lexsort(np.column_stack([x, q]).T)
    x, q = x[order], q[order]
    # every other good row in order of its features grows the forest, which the threshold's rows have not seen
    grow = (q == 1) & (np.cumsum(q == 1) % 2 == 1)
    forest = Forest(x[grow])
    x, q = x[~grow], q[~grow]
    score = forest.score(x)
    good_score, bad_score = np.sort(score[q == 1]), np.sort(score[q == 0])
    if len(good_score) < 2 or not len(bad_score):
        return forest, 2.0
    cuts = np.unique(np.concatenate([score, [2.0]]))
    lost = 1 - np.searchsorted(good_score, cuts) / len(good_score)
    found = 1 - np.searchsorted(bad_score, cuts) / len(bad_score)
    gain = np.where(lost <= MAX_GOOD_LOST, found - CAUTION * lost, -np.inf)
    best = int(np.argmax(gain))
    below = score[score < cuts[best]]
    return forest, float((cuts[best] + below.max()) / 2 if len(below) else cuts[best])


def measure(docs: DataFrame, keep: list | None = None, model: tuple | None = None) -> DataFrame:
    """Rule statistics of each row of (doc_id, text, *keep); with a model also base_failed, kept and anomaly."""
    keep = keep or []
    spark = docs.sparkSession
    tune(spark)
    inner = docs.select("doc_id", "text", *keep)
    fields = [inner.schema[c] for c in ["doc_id", *keep]]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{s} long" for s in STATS),
                     "base_failed boolean", "kept boolean", "anomaly double"])
    shared = share(spark, model or (None, 2.0))

    def run(batches):
        forest, threshold = shared()
        for b in batches:
            stats = np.array([statistics(t) for t in texts(b.column(1))], np.int64).reshape(b.num_rows, len(STATS))
            failed = base_failed(stats)
            score = forest.score(features(stats)) if forest is not None else np.zeros(len(stats))
            out = [b.column(0), *(b.column(2 + i) for i in range(len(keep)))]
            out += [pa.array(stats[:, i]) for i in range(len(STATS))]
            out += [pa.array(failed), pa.array(~failed & (score < threshold)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, names=[*(f.name for f in fields), *STATS, "base_failed", "kept", "anomaly"])

    return inner.mapInArrow(run, ddl)


def quality_rules(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Statistics and verdict for each row of ``docs`` (doc_id, text, ...).

    Null and empty texts have zero words and fail the base rules. Repeated rows
    and null ids get a row each. Other columns of the inputs are not read. An
    empty table gives an empty result; without usable labels only the base
    rules reject.
    """
    return measure(docs, model=fit(docs, labels, max_train))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the forest, all columns kept.

    Null and empty texts go (no words); repeated rows are judged alike; an empty
    table stays empty; extra columns of any name are kept.
    """
    tune(docs.sparkSession)
    load = share(docs.sparkSession, fit(docs, labels, max_train))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forest, threshold = load()
        for b in batches:
            stats = np.array([statistics(t.encode() if t else None) for t in b], np.int64).reshape(len(b), len(STATS))
            yield pd.Series(~base_failed(stats) & (forest.score(features(stats)) < threshold))

    name = fresh(docs, "__kept")
    return docs.withColumn(name, F.pandas_udf(run, "boolean")("text")).where(F.col(name)).select(*docs.columns)


def op1_quality_rules(spark, sf_dir):
    out = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
