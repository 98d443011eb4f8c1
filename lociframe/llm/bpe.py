"""Byte-level BPE: overlapping chunks of long texts, stitched where their pre-token boundaries resynchronise.

A pre-token starting at a position depends only on the text after it, so once
two overlapping chunks share a boundary, all later boundaries agree. Long
texts are cut at such shared boundaries and the pieces are encoded in
parallel; a text whose overlaps share none is encoded whole (the exact way for
the rest). Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.llm.common import read, tune

#: Characters of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 32_768, 512


@lru_cache(maxsize=2)
def load(ranks_path: str, pattern: str):
    """The encoding; a process builds it once."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, start: int, stop: int, pattern) -> list:
    """Starts of pre-tokens of ``text``, scanned from 0, within [start, stop)."""
    return [m.start() for m in pattern.finditer(text) if start <= m.start() < stop]


def cuts(text: str, chunk: int, overlap: int, pattern) -> list:
    """For each chunk after the first: a boundary that it shares with the one before, or -1."""
    out = []
    for k in range(1, -(-max(len(text), 1) // chunk)):
        at = k * chunk
        left = text[at - chunk: at + overlap]
        out.append(shared(left, text[at: at + chunk + overlap], chunk, overlap, pattern, at))
    return out


def shared(left: str, right: str, chunk: int, overlap: int, pattern, at: int) -> int:
    """A position in the overlap where both chunks start a pre-token after a non-space, or -1.

    Of the left chunk the last boundaries are not used: its end cuts them short.
    """
    ours = boundaries(left, chunk, len(left), pattern)[:-2]
    theirs = set(boundaries(right[:overlap], 1, overlap, pattern))
    for p in ours:
        i = p - chunk
        if i in theirs and not right[i - 1].isspace():
            return at + i
    return -1


def _digest(doc_id, ids: list, encoding) -> tuple:
    raw = b"".join(np.asarray(x, "<u4").tobytes() for x in ids)
    back = b"".join(encoding.decode_bytes(list(x)) for x in ids)
    return doc_id, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """ids of every row: (row_key, doc_id, part, ids) — one part for a short text, ordered parts for a long one.

    Null and empty texts give one part without ids. Rows are told apart by a
    key of their own, so null and repeated ids are kept; other columns are not
    read. An empty table gives an empty result.
    """
    short, long = encoded_parts(docs, ranks_path, pattern, chunk, overlap)
    return short.unionByName(long)


def encoded_parts(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """``encode_documents`` of the texts of one chunk at most, whose row_key is null, and of the longer ones."""
    spark = docs.sparkSession
    tune(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    inner = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"row_key long, doc_id {kind}, part int, ids binary"

    def whole(batches):
        encoding = load(ranks_path, pattern)
        for b in batches:
            ids = [np.asarray(encoding.encode_ordinary(t), "<u4").tobytes() for t in b.column(1).to_pylist()]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), b.column(0), pa.array([0] * n, pa.int32()),
                                              pa.array(ids, pa.binary())], names=["row_key", "doc_id", "part", "ids"])

    short = inner.where(F.length("text") <= chunk).mapInArrow(whole, schema)
    # each chunk with its left neighbour's part of the text, dealt out over all tasks
    def chunks(batches):
        for b in batches:
            for i, t in enumerate(b.column(2).to_pylist()):
                n = -(-len(t) // chunk)
                for lo in range(0, n, 64):
                    part = range(lo, min(lo + 64, n))
                    take = pa.array([i] * len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(part, pa.int32()),
                                                      pa.array([t[k * chunk: (k + 1) * chunk + overlap] for k in part], pa.string())],
                                                     names=["row_key", "doc_id", "part", "body"])

    pieces = (inner.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text")
              .mapInArrow(chunks, f"row_key long, doc_id {kind}, part int, body string").repartition("row_key", "part"))

    def scan(batches):
        import regex

        p = regex.compile(pattern)
        for b in batches:
            tail, head = [], []
            for body, part in zip(b.column(3).to_pylist(), b.column(2).to_pylist()):
                tail.append(boundaries(body, chunk, len(body), p)[:-2])
                head.append([i for i in boundaries(body[:overlap], 1, overlap, p) if not body[i - 1].isspace()] if part else [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tail, pa.list_(pa.int32())), pa.array(head, pa.list_(pa.int32()))],
                                             names=["row_key", "doc_id", "part", "body", "tail", "head"])

    scanned = pieces.mapInArrow(scan, f"row_key long, doc_id {kind}, part int, body string, tail array<int>, head array<int>")
    w = Window.partitionBy("row_key").orderBy("part")
    before = F.lag("tail").over(w)
    joined = (scanned.withColumn("start", F.when(F.col("part") == 0, 0).otherwise(
                  F.array_min(F.array_intersect(F.transform(before, lambda x: x - chunk), F.col("head")))))
              .withColumn("stop", F.lead("start").over(w)).withColumn("last", F.lead("part").over(w).isNull())
              .withColumn("lost", F.max(F.col("start").isNull()).over(Window.partitionBy("row_key"))))
    ready = joined.where(~F.col("lost")).select(
        "row_key", "doc_id", "part",
        F.expr(f"substring(body, start + 1, if(last, {chunk + overlap}, {chunk} + stop - start))").alias("text"))
    rest = (joined.where("lost").groupBy("row_key", "doc_id")
            .agg(F.sort_array(F.collect_list(F.struct("part", F.substring("body", 1, chunk).alias("b")))).alias("all"))
            .select("row_key", "doc_id", F.lit(0).alias("part"), F.array_join(F.transform("all", lambda x: x["b"]), "").alias("text")))

    def parts(batches):
        encoding = load(ranks_path, pattern)
        for b in batches:
            ids = [np.asarray(encoding.encode_ordinary(t), "<u4").tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary())],
                                             names=["row_key", "doc_id", "part", "ids"])

    return short, ready.unionByName(rest).mapInArrow(parts, schema)


def bpe_roundtrip(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode every text, decode the ids, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids. Repeated rows and null ids get a row each;
    other columns are not read. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    short, long = encoded_parts(docs, ranks_path, pattern, chunk, overlap)
    one = short.select("doc_id", F.array("ids").alias("parts"))
    many = (long.groupBy("row_key", "doc_id")
            .agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("all"))
            .select("doc_id", F.transform("all", lambda x: x["ids"]).alias("parts")))

    def digest(batches):
        encoding = load(ranks_path, pattern)
        for b in batches:
            rows = [_digest(d, [np.frombuffer(x, "<u4") for x in p], encoding)
                    for d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                                              pa.array(cols[3], pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return one.unionByName(many).mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_roundtrip(spark, sf_dir, ranks_path: str | None = None):
    import public_tokenizers

    return bpe_roundtrip(read(spark, sf_dir, "documents"),
                         ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
