"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: keeps a batch of long documents within a worker's memory.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches, so that long documents do not meet in one batch of 10,000 rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.Array) -> list:
    """UTF-8 bytes of a string column; None for null."""
    return column.cast(pa.binary()).to_pylist()


def table(batch: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch[f.name], f.type) for f in schema], schema=schema)


def share(spark: SparkSession, value):
    """A broadcast of a bounded model; returns a function that loads it in a worker."""
    from pyspark import cloudpickle

    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load():
        import pickle

        return pickle.loads(sent.value)

    return load


#: Bits of a sieve: what it sends to the driver and to executors has this bound at any size of its input.
SIEVE_BITS = 1 << 25


def sieve(rows: DataFrame, *columns: str):
    """A function of columns that is true for all of their values in ``rows``, and false for most others while ``rows`` are few.

    It spares a shuffle most of the rows that a join would drop; the join itself stays.
    """
    at = F.pmod(F.xxhash64(*columns), F.lit(SIEVE_BITS))
    got = (rows.select(F.floor(at / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("m"))
           .groupBy("w").agg(F.bit_or("m").alias("m")).toPandas())
    load = share(rows.sparkSession, (got["w"].to_numpy(np.int32), got["m"].to_numpy(np.int64)))

    @F.pandas_udf("boolean")
    def held(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        word, mask = load()
        bits = np.zeros(SIEVE_BITS // 64, np.uint64)
        bits[word] = mask.view(np.uint64)
        for h in it:
            b = h.to_numpy(np.int64) & np.int64(SIEVE_BITS - 1)
            yield pd.Series((bits[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return lambda *own: held(F.xxhash64(*own))
