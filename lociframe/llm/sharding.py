"""Shards of near equal bytes by vector bin packing.

Groups of equal texts above a fixed share of all bytes, tokens or rows are
items of their own (their number is bounded by that share); all other groups,
each under that share of all three, are dealt into ``CELLS`` cells by hash. The
items, a bounded number, are placed in order of size where the dot product of
(bytes, tokens, rows) with the residual capacity is highest. A group larger
than a whole shard in one of the three is split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import read
from lociframe.llm.numbering import numbered
from lociframe.session import cut

CELLS, LARGE = 4096, 64


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of bytes, tokens, rows): largest first, highest dot product with residual capacity.

    A shard that the item's bytes would overfill comes in question only if all would be.
    """
    total = np.maximum(items.sum(0), 1)
    x = items / total
    left = np.full((shards, items.shape[1]), 1 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -x.max(1))):
        fits = left[:, 0] >= x[i, 0]
        score = left @ x[i] if fits.any() else left[:, 0]
        out[i] = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        left[out[i]] -= x[i]
    return out


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    Equal texts share a shard unless together they exceed one. Null and empty
    texts are one group of size 1 a row. Repeated rows and null ids have slots
    of their own; other columns are not read. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = cut(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("turn")))
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    total = [max(x or 0, 1) for x in base.agg(*sums).first()]
    share = F.greatest(*(F.col(c) / F.lit(float(n)) for c, n in zip("btr", total)))
    # at most 3 * shards * LARGE groups can have such a share of one of the three
    large = (base.groupBy("h", "text_crc32", "size").agg(*sums).withColumn("share", share).where(F.col("share") * (shards * LARGE) > 1)
             .orderBy("h", "text_crc32", "size").collect())
    rows, items = [], []
    for g in large:
        parts = 1 if g.share * shards <= 1 else int(min(g.r, shards * np.ceil(4 * g.share)))
        rows.append((g.h, g.text_crc32, g["size"], CELLS + len(items), parts))
        items += [(g.b / parts, g.t / parts, g.r / parts)] * parts
    known = F.broadcast(spark.createDataFrame(rows, "h long, text_crc32 long, size long, item0 int, parts int"))
    tagged = base.join(known, ["h", "text_crc32", "size"], "left").withColumn(
        "item", F.coalesce(F.col("item0") + F.pmod("turn", "parts"), F.pmod("h", F.lit(CELLS))).cast("int"))
    cells = np.zeros((CELLS, 3))
    for r in tagged.where("item0 IS NULL").groupBy("item").agg(*sums).collect():
        cells[r.item] = (r.b, r.t, r.r)
    chosen = place(np.vstack([cells, np.array(items).reshape(-1, 3)]), shards)
    where = F.broadcast(spark.createDataFrame([(i, int(s)) for i, s in enumerate(chosen)], "item int, shard int"))
    fixed = cut(tagged.join(where, "item").select("doc_id", "size", "text_crc32", "shard"))
    return numbered(fixed, "shard", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_vector_sharding(spark, sf_dir):
    return shard(read(spark, sf_dir, "documents"))
