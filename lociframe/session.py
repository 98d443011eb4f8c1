"""Session helpers shared by operators that cut lineage."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager
from tempfile import TemporaryDirectory
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables that are still there, and the tables' own paths.
_written: dict = {}
_paths: WeakKeyDictionary = WeakKeyDictionary()
#: The folder of a local session that names none.
_own: TemporaryDirectory | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a folder of our own only where unset and all runs in this process (tests)."""
    global _own
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if _own is None:
            _own = TemporaryDirectory(prefix="checkpoints-")
        where = _own.name
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` by a reliable checkpoint in the shared folder and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    For results that several branches scan and that are too wide for a
    checkpoint's row format. ``forget`` removes the folder; what is still there
    when the driver ends is removed then.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not _written:
        atexit.register(_forget_all)
    _written[path] = spark
    _paths[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove what ``table`` wrote; all that reads it must have been materialised."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            _remove(_written.pop(path), path)


#: Bytes of input files for which a shuffle has one partition, where the session's number would give each more.
SPREAD = 8 << 20


def spread_of(df: DataFrame) -> int:
    """Shuffle partitions for what is made of the files that ``df`` reads: the session's number or one for each ``SPREAD`` bytes."""
    files = {}
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            files[leaf.relation().toString() + (leaf.relation().location().rootPaths().toString() if hasattr(leaf.relation(), "location") else "")] = int(leaf.relation().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(files.values()) // SPREAD))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into ``spread_of`` partitions, so that a task's share does not grow with the input; left as it is
    where the session has as many. For keys without hot values: what is dealt here, adaptive execution does not split."""
    n = spread_of(df)
    return df if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, *keys)


@contextmanager
def shuffled(spark: SparkSession, n: int):
    """``n`` shuffle partitions or more for what is run inside."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), n)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch():
    """Tables that are written inside are removed at its end; what leaves it must have been materialised."""
    before = set(_written)
    yield
    for path in set(_written) - before:
        _remove(_written.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _forget_all() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)
    _written.clear()
