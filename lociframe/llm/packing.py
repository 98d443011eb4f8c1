"""Harmonic packing of token sequences.

A document's ids are cut into full sequences and a rest. A rest whose length
fills a sequence in whole copies but for ``WASTE`` of it stays whole; any other
gives its longest piece of reciprocal capacity (``capacity // k``) first, until
less than ``LEAST_PIECE`` is left. Pieces of one length form a class: a
sequence takes ``capacity // length`` of them, so ranks within the class place
every piece without any search, on all workers independently. The last, partly
filled sequence of each class (one a length, ``capacity`` at most) is merged
with others first-fit.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import read, texts, tune
from lociframe.llm.numbering import numbered
from lociframe.session import cut

CAPACITY, LEAST_PIECE, WASTE, END = 4096, 256, 1 / 20, 2
#: Words and word parts whose ids a worker remembers, the longest of them, and bytes of texts that it looks up at once.
CACHE, LONG, AT_ONCE = 500_000, 64, 4_000_000


class WordIds:
    """Ids of texts from a tokenizer whose tokens never cross ASCII white space.

    Texts of ASCII and Latin-1 letters are cut into the parts that the tokenizer's own pattern
    gives them (letters, single digits, English endings, other signs), so each distinct part is
    encoded once. Of other texts the words with other characters are encoded whole, and texts with a
    special token's string are encoded as they are.
    """

    ODD = re.compile("[\x80-\xbf\xd7\xf7\u0100-\U0010ffff]")
    PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.known = {}

    def learn(self, new: list) -> None:
        """Remember the ids (little-endian uint32 bytes) of parts (str) and of words that stay whole (bytes)."""
        parts, words = [x for x in new if isinstance(x, str)], [x for x in new if isinstance(x, bytes)]
        for lo in range(0, len(parts), 2_000):
            some = parts[lo: lo + 2_000]
            # parts stand apart by spaces, so each is one of the tokenizer's own words
            got = self.tok.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum(4 * np.bincount(got.word_ids, minlength=len(some))).tolist()
            raw = np.array(got.ids, "<u4").tobytes()
            self.known.update(zip(some, [raw[i:j] for i, j in zip([0, *ends], ends)]))
        for lo in range(0, len(words), 2_000):
            some = words[lo: lo + 2_000]
            for w, e in zip(some, self.tok.encode_batch_fast([x.decode("utf-8", "replace") for x in some], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def keys(self, text: bytes) -> list:
        """What is looked up for a text, in order."""
        s = text.decode("utf-8", "replace")
        if not self.ODD.search(s):
            return self.PARTS.findall(s.lower())
        out: list = []
        for w in text.split():
            s = w.decode("utf-8", "replace")
            if self.ODD.search(s):
                out.append(w)
            else:
                out += self.PARTS.findall(s.lower())
        return out

    def ids(self, rows: list) -> list:
        """The ids of each text (bytes or None) as little-endian uint32 bytes."""
        out, held, size = [b""] * len(rows), [], 0

        def looked_up():
            if len(self.known) > CACHE:
                self.known.clear()
            new = list(set().union(*(k for _, k in held)) - self.known.keys())
            self.learn(new)
            for i, k in held:
                out[i] += b"".join(map(self.known.__getitem__, k))
            for x in new:
                if len(x) > LONG:
                    del self.known[x]
            held.clear()

        for i, t in enumerate(rows):
            if not t:
                continue
            if any(x in t for x in self.special):
                out[i] = np.array(self.tok.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
                continue
            for part in blocks(t):
                held.append((i, self.keys(part)))
                size += len(part)
                if size > AT_ONCE:
                    looked_up()
                    size = 0
        looked_up()
        return out


def blocks(text: bytes, most: int = 1_000_000):
    """``text`` cut at white space into parts of about ``most`` bytes."""
    lo = 0
    while len(text) - lo > most:
        at = re.compile(rb"[\t-\r ]").search(text, lo + most)
        if not at:
            break
        yield text[lo: at.start()]
        lo = at.start()
    yield text[lo:]


_encoders: dict = {}


def encoder(path: str) -> WordIds:
    """The process's own encoder: kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def piece_lengths(n: int, capacity: int = CAPACITY, least: int = LEAST_PIECE) -> list:
    """Lengths of the pieces of ``n`` ids, in order."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest >= least and capacity % rest > WASTE * capacity:
        # the first k whose capacity // k fits
        size = capacity // -(-capacity // rest)
        out.append(size)
        rest -= size
    return out + [rest] * (rest > 0)


def merge_tails(counts: dict, capacity: int = CAPACITY) -> dict:
    """{length: (first sequence, full sequences, tail sequence, tail offset)} from piece counts by length."""
    out, at, tails = {}, 0, []
    for length in sorted(counts, reverse=True):
        each = capacity // length
        full, rest = divmod(counts[length], each)
        out[length] = [at, full, None, 0]
        at += full
        if rest:
            tails.append((rest * length, length))
    bins: list = []
    for fill, length in sorted(tails, reverse=True):
        for b in bins:
            if b[0] + fill <= capacity:
                break
        else:
            b = [0, at + len(bins)]
            bins.append(b)
        out[length][2:] = [b[1], b[0]]
        b[0] += fill
    return {k: tuple(v) for k, v in out.items()}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, least: int = LEAST_PIECE, keep: list | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) for each piece of each row."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    end = np.array([END], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer_path)
        for b in batches:
            doc, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(enc.ids(texts(b.column(1)))):
                raw = ids + end
                n, at = len(raw) // 4, 0
                for size in piece_lengths(n, capacity, least):
                    doc.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at: 4 * (at + size)]))
                    total.append(n)
                    at += size
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                 pa.array(crc, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length int, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, least: int = LEAST_PIECE) -> DataFrame:
    """Pieces with sequence_id and offset; no sequence exceeds ``capacity``.

    Null and empty texts are the end id alone. Repeated rows and null ids are
    packed like any other row; other columns are not read. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    fixed = cut(pieces(docs, tokenizer_path, capacity, least))
    # one row a length: ``capacity`` at most
    counts = {r[0]: r[1] for r in fixed.groupBy("length").count().collect()}
    places = F.broadcast(spark.createDataFrame([(k, *v) for k, v in merge_tails(counts, capacity).items()],
                                               "l int, first long, full long, tail long, shift long"))
    rank = numbered(fixed, "length", "rank")
    each = F.floor(F.lit(capacity) / F.col("length"))
    turn = F.floor(F.col("rank") / each)
    inside = (F.col("rank") - turn * each) * F.col("length")
    whole = turn < F.col("full")
    return (rank.join(places, F.col("length") == F.col("l"))
            .select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                    F.when(whole, F.col("first") + turn).otherwise(F.col("tail")).alias("sequence_id"),
                    F.when(whole, inside).otherwise(F.col("shift") + inside).alias("offset")))


def op10_harmonic_packing(spark, sf_dir, tokenizer_path: str | None = None):
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
