"""Gapless numbers within groups, without a task per group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(fixed: DataFrame, group: str, name: str = "number") -> DataFrame:
    """``fixed`` with a gapless BIGINT from 0 within each non-null INT ``group``, in partition order.

    ``fixed`` must have been materialised, so that its partitions and their
    order stay the same when tasks are run again. Each partition counts its
    own rows; a running sum over partitions gives where each starts.
    """
    own = fixed.withColumn("__pid", F.spark_partition_id())
    counts = own.groupBy("__pid", group).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__pid").alias("__p"), F.col(group).alias("__g"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    fields = own.schema.fields
    at = own.columns.index(group)

    def run(batches):
        nxt: dict = {}
        for b in batches:
            g = b.column(at).to_numpy(zero_copy_only=False)
            order = np.argsort(g, kind="stable")
            values, first, count = np.unique(g[order], return_index=True, return_counts=True)
            out = np.empty(len(g), np.int64)
            for v, f, c in zip(values.tolist(), first, count):
                out[order[f: f + c]] = nxt.get(v, 0) + np.arange(c)
                nxt[v] = nxt.get(v, 0) + int(c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*(f.name for f in fields), "__i"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", __i long"
    return (own.mapInArrow(run, ddl).join(starts, (F.col("__pid") == F.col("__p")) & (F.col(group) == F.col("__g")))
            .withColumn(name, F.col("__start") + F.col("__i")).drop("__pid", "__p", "__g", "__start", "__i"))
