"""Exact work inside the buckets of a similarity search, in tasks of bounded size.

A bucket of up to ``BLOCK`` members is one unit. A larger bucket is cut into
blocks by a hash of the member and every pair of blocks becomes a unit, so no
task holds a bucket that grows with the data and no member or pair is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a unit's side at most (in expectation, blocks being dealt by hash).
BLOCK = 256


def units(rows: DataFrame, key: str, member: str, block: int = BLOCK) -> DataFrame:
    """Rows of buckets with two or more members, each with its units (bucket, block a <= block b), sorted by unit."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1")
    both = rows.join(sizes, key).withColumn("__blocks", F.ceil(F.col("__n") / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64(member, F.lit(block)), F.col("__blocks")).cast("int")
    one = (both.withColumn("__own", own)
           .withColumn("__other", F.explode(F.expr("sequence(0, __blocks - 1)")))
           .withColumn("__a", F.least("__own", "__other")).withColumn("__b", F.greatest("__own", "__other"))
           .drop("__other", "__n", "__blocks"))
    return one.repartition(key, "__a", "__b").sortWithinPartitions(key, "__a", "__b", member)


def grouped(batches, n_key: int = 3):
    """Whole units of a sorted stream of record batches: a pa.Table slice per unit, keyed by the first columns."""
    held: list = []

    def flush():
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        return t

    def edges(t):
        if not t.num_rows:
            return np.zeros(0, np.int64)
        change = np.zeros(t.num_rows - 1, bool)
        for i in range(n_key):
            c = t.column(i).to_numpy()
            change |= c[1:] != c[:-1]
        return np.flatnonzero(change) + 1

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = flush()
        cut = edges(t)
        if len(cut):
            yield t.slice(0, int(cut[-1])), np.concatenate([[0], cut[:-1], [cut[-1]]])
            t = t.slice(int(cut[-1]))
        held.extend(t.to_batches())
    if held:
        t = flush()
        yield t, np.concatenate([[0], edges(t), [t.num_rows]])


def components(near: np.ndarray) -> np.ndarray:
    """Smallest index that each row of a boolean adjacency matrix reaches."""
    n = len(near)
    label = np.arange(n, dtype=np.int32)
    near = near | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, label[None, :], np.int32(n)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
