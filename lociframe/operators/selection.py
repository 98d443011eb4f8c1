"""Best-of-group, caps, renaming, sampling and list filters.

Ties end in ``order`` columns that the caller names; nothing depends on the
order in which rows happen to arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def best(df: DataFrame, keys: list, *order) -> DataFrame:
    """One row of each group: the first by ``order``.

    A minimum over structs, so rows are combined before the shuffle and a hot
    group is never gathered. Columns of ``order`` sort ascending, nulls first;
    negate a number for descending.
    """
    cols = [c for c in df.columns if c not in keys]
    ranked = df.select(*keys, F.struct(*[_c(o).alias(f"__o{i}") for i, o in enumerate(order)], *[F.col(c) for c in cols]).alias("__row"))
    out = ranked.groupBy(*keys).agg(F.min("__row").alias("__row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def best_by_tier(df: DataFrame, key: str, tier: str, size: str, name: str) -> DataFrame:
    """All rows of the best member of each ``key``: the lowest ``tier``, then the largest ``size``, then the first ``name``.

    Rows of one key in a worse tier go; in the best tier every row of the
    chosen ``name`` stays.
    """
    top = best(df.select(key, tier, size, name), [key], F.col(tier), -F.col(size), F.col(name)).select(key, tier, name)
    return df.join(top, [key, tier, name], "left_semi")


def cap(df: DataFrame, keys: list, n: int, *order) -> DataFrame:
    """At most ``n`` rows of each group, the first by ``order``. Spark's rank limit cuts groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[_c(o) for o in order])
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def numbered_names(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with ``unique_name``: ``name[i/n]`` where a name occurs n > 1 times."""
    w = Window.partitionBy(name)
    i, n = F.row_number().over(w.orderBy(*[_c(o) for o in order])), F.count("*").over(w)
    return df.withColumn("unique_name", F.when(n > 1, F.concat(F.col(name), F.lit("["), i.cast("string"), F.lit("/"), n.cast("string"), F.lit("]"))).otherwise(F.col(name)))


def lot(seed: int, *columns) -> Column:
    """A seeded hash of values as text: the order of a draw, the same on any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in columns]).cast("binary"))


def sample(df: DataFrame, keys: list, longest: int, rest: int, size: str, seed: int, *order) -> DataFrame:
    """Of each group the ``longest`` rows by ``size`` and ``rest`` others drawn by a seeded hash of ``order``."""
    w = Window.partitionBy(*keys)
    top = df.withColumn("__i", F.row_number().over(w.orderBy(F.col(size).desc(), *[_c(o) for o in order])))
    draw = F.row_number().over(Window.partitionBy(*keys, F.col("__i") <= longest).orderBy(lot(seed, *order), *[_c(o) for o in order]))
    return top.withColumn("__d", draw).where((F.col("__i") <= longest) | (F.col("__d") <= rest)).drop("__i", "__d")


def draw_names(df: DataFrame, name: str, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` names drawn without replacement by a seeded hash (a top-k, not a sort)."""
    chosen = df.select(name).distinct().orderBy(lot(seed, name), name).limit(n)
    return df.join(chosen, name, "left_semi")


def in_list(df: DataFrame, key, names: DataFrame, name: str, invert: bool = False) -> DataFrame:
    """Rows whose ``key`` (a column or expression) is, or with ``invert`` is not, among ``names``."""
    own = names.select(F.col(name).alias("__name"))
    return df.join(own, _c(key) == F.col("__name"), "left_anti" if invert else "left_semi")


def distinct_layouts(df: DataFrame, layout: list, *order) -> DataFrame:
    """One row of each layout, the first by ``order``, with ``copies``."""
    counts = df.groupBy(*layout).agg(F.count("*").alias("copies"))
    return best(df, layout, *order).join(counts, layout)


def split_by(df: DataFrame, column: str, path: str, kind: str = "parquet") -> None:
    """One folder for each value of ``column``; a hot value's rows come from many tasks and make several files."""
    df.write.partitionBy(column).format(kind).save(path)


def chunks(df: DataFrame, rows: int, path: str, kind: str = "parquet") -> None:
    """Files of at most ``rows`` rows."""
    df.write.option("maxRecordsPerFile", rows).format(kind).save(path)


def sort_rows(df: DataFrame, spec: str) -> DataFrame:
    """Sort by a field list such as ``1,2n,3ni``: 1-based columns, ``n`` as numbers, ``i`` inverted."""
    keys = []
    for part in spec.split(","):
        digits = part.rstrip("ni")
        c = F.col(df.columns[int(digits) - 1])
        c = c.try_cast("double") if "n" in part[len(digits):] else c
        keys.append(c.desc_nulls_last() if "i" in part[len(digits):] else c.asc_nulls_first())
    return df.orderBy(*keys)


#: Orders by kind of table: gpd and bed by place, psl by target name, target size, start and strand, names where asked.
SORTS = {"gpd": ["chrom", "txStart", "txEnd", "strand"], "bed": ["chr", "start"], "psl": ["tName", "tSize", "tStart", "strand"], "sam": ["rname", "pos"]}
NAMES = {"gpd": "name", "psl": "qName", "sam": "qname", "fasta": "name", "fastq": "name"}


def sort_table(df: DataFrame, kind: str, by_name: bool = False) -> DataFrame:
    return df.orderBy(*([NAMES[kind]] if by_name else SORTS[kind]))


def transpose(df: DataFrame, row: str, columns: list) -> DataFrame:
    """(column, one column per value of ``row``) of a matrix with few rows, their number being checked by Spark's pivot limit."""
    long = df.select(row, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])).alias("e"))
    return long.groupBy("e.i", "e.column").pivot(row).agg(F.first("e.v")).orderBy("i").drop("i")
