"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and repeated word
beginnings is trained in numpy from confirmed
toxic rows plus unlabelled text with the class-prior-corrected, non-negative
risk; the prior is the toxic share of labelled training rows. Training sees
bounded samples of the labelled rows of the training folds: ``MAX_POSITIVE``
toxic ones, and ``MAX_UNLABELLED`` of any label, which is then not looked at
(those with the smallest hash of the id). Executors count their features; the
driver gets the chosen ones only. Scoring is one narrow pass over all.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import fold, fresh, read, share, texts, tune
from lociframe.session import forget, table

MAX_POSITIVE, MAX_UNLABELLED, MAX_WORDS = 4_000, 16_000, 30_000
#: Standard deviations by which a feature must be commoner in positive than in unlabelled rows.
SURE = 5.0
#: Bytes of word beginnings, and the counts of a beginning that are features of their own.
STEMS, LEVELS = (5, 6, 8), (1, 2, 3)
ROUNDS, RATE, SPARSITY = 300, 0.1, 5e-4
FOLDS = 5
#: Features that a task counts before it passes them on.
CHUNK_FEATURES = 300_000

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def features_of(text: bytes | None, known: set | None = None) -> set:
    """Words of a text, and ``beginning n`` for beginnings shared by n or more of its words; of ``known`` stems only."""
    if not text:
        return set()
    words = Counter(text.translate(_LETTERS).split())
    stems: dict = {}
    for w, c in words.items():
        for n in STEMS:
            if len(w) >= n:
                x = w[:n]
                if known is None or x in known:
                    stems[x] = stems.get(x, 0) + c
    return set(words).union(b"%b %d" % (x, n) for x, c in stems.items() for n in LEVELS if c >= n)


def stems_of(features) -> set:
    """The beginnings among ``features``."""
    return {w.split(b" ")[0] for w in features if b" " in w}


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def lift(p, u, n_p: int, n_u: int):
    """Standard deviations by which ``p`` of ``n_p`` positive rows exceed what ``u`` of ``n_u`` unlabelled rows let expect; numbers, arrays or columns."""
    expect = (u + 2) * (n_p / (n_u + 4))
    return (p - expect) / expect ** 0.5


def nnpu(positive: tuple, unlabelled: tuple, size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and bias, minimising the non-negative PU risk with a sparsity penalty.

    risk = prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]), l the logistic loss. ``positive`` and
    ``unlabelled`` are (number of rows, row, feature): the features that each row has.
    """
    (n_p, rp, cp), (n_u, ru, cu) = positive, unlabelled
    bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not size or not n_p or not n_u or prior <= 0:
        return np.zeros(size), -30.0 if prior <= 0 else bias
    theta, b = np.zeros(size), bias
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, ROUNDS + 1):
        zp = np.bincount(rp, theta[cp], n_p) + b
        zu = np.bincount(ru, theta[cu], n_u) + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # gradients by row: l(+) gives s - 1, l(-) gives s
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp = prior * (sp - 1) / n_p
        gu = np.zeros(n_u)
        if negative >= 0:
            gp = gp - prior * sp / n_p
            gu = su / n_u
        else:
            # the unlabelled part has fitted too far: step back
            gp, gu = prior * sp / n_p, -su / n_u
        g = np.bincount(cp, gp[rp], size) + np.bincount(cu, gu[ru], size)
        g = np.append(g, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-6)
        theta, b = theta - move[:-1], b - move[-1]
        theta = np.sign(theta) * np.maximum(np.abs(theta) - RATE * SPARSITY * np.sqrt(n_p), 0)
    return theta, float(b)


def _counted(sample: DataFrame) -> DataFrame:
    """(feature, p, u): positive and unlabelled rows of ``sample`` (p, u, text) that have a feature."""
    def run(batches):
        seen: tuple = (Counter(), Counter())

        def flush():
            names = list(seen[0].keys() | seen[1].keys())
            for lo in range(0, len(names), 50_000):
                part = names[lo: lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *(pa.array([c[w] for w in part], pa.int64()) for c in seen)],
                                                 names=["feature", "p", "u"])
            for c in seen:
                c.clear()

        for b in batches:
            for p, u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))):
                own = features_of(t)
                for c, flag in zip(seen, (p, u)):
                    if flag:
                        c.update(own)
                if len(seen[0]) + len(seen[1]) > CHUNK_FEATURES:
                    yield from flush()
        yield from flush()

    return (sample.select("p", "u", "text").mapInArrow(run, "feature binary, p long, u long")
            .groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[dict, float]:
    """The classifier from rows of the training folds. Without toxic labels nothing is toxic.

    Of rows that repeat an id, the sample takes the one of the least text.
    """
    spark = docs.sparkSession
    tune(spark)
    known = (labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold("doc_id", FOLDS) != 0)
             .groupBy("doc_id").agg(F.max("toxic").alias("__t")))
    total, toxic = known.agg(F.count("*"), F.sum("__t")).first()
    if not toxic:
        return {}, -30.0
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    yes = {r[0] for r in known.where("__t = 1").orderBy(*order).limit(max_positive).select("doc_id").collect()}
    some = {r[0] for r in known.orderBy(*order).limit(max_unlabelled).select("doc_id").collect()}
    marks = F.broadcast(spark.createDataFrame([(d, d in yes, d in some) for d in sorted(yes | some)], "doc_id long, p boolean, u boolean"))
    sample = table(docs.select("doc_id", "text").join(marks, "doc_id").groupBy("doc_id", "p", "u").agg(F.min("text").alias("text")))
    n_p, n_u = sample.agg(F.count_if("p"), F.count_if("u")).first()
    sure = lift(F.col("p"), F.col("u"), n_p, n_u)
    vocab = [bytes(r[0]) for r in _counted(sample).where(sure >= SURE).orderBy(sure.desc(), "feature").limit(MAX_WORDS).select("feature").collect()]
    load = share(spark, vocab)

    def mark(batches):
        vocab = load()
        index, stems = {w: i for i, w in enumerate(vocab)}, stems_of(vocab)
        for b in batches:
            own = [sorted(index[w] for w in features_of(t, stems) if w in index) for t in texts(b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "p", "u", "own"])

    rows = (sample.select("doc_id", "p", "u", "text").mapInArrow(mark, "doc_id long, p boolean, u boolean, own array<int>")
            .toPandas().sort_values("doc_id"))

    def matrix(part):
        own = [np.asarray(x, np.int64) for x in part["own"]]
        return len(own), np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate([np.zeros(0, np.int64), *own])

    forget(sample)
    theta, bias = nnpu(matrix(rows[rows["p"]]), matrix(rows[rows["u"]]), len(vocab), toxic / total)
    return {w: float(t) for w, t in zip(vocab, theta) if t != 0}, bias


def scorer(spark, model: tuple[dict, float]):
    """A Column function of the text: its score by a fitted model."""
    load = share(spark, model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = load()
        stems = stems_of(weights)
        known = set(weights)
        for b in batches:
            # sorted: sums of floats must not depend on the order of a set
            z = [sum(sorted(weights[w] for w in features_of(t.encode() if t else None, stems) & known)) for t in b]
            yield pd.Series(_sigmoid(np.array(z, np.float64) + bias))

    return F.pandas_udf(run, "double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null and empty texts get the bias alone. Repeated rows and null ids get a
    row each; labels of null ids, null labels and extra columns are not read.
    An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    out = docs.select("doc_id", "text").withColumn("score", scorer(docs.sparkSession, fit(docs, labels))("text"))
    return out.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept.

    Null and empty texts are judged by the bias alone; repeated rows are judged
    alike; an empty table stays empty; extra columns of any name are kept.
    """
    tune(docs.sparkSession)
    score = scorer(docs.sparkSession, fit(docs, labels))
    name = fresh(docs, "__score")
    return docs.withColumn(name, score("text")).where(F.col(name) < 0.5).select(*docs.columns)


def op7_toxicity(spark, sf_dir):
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
