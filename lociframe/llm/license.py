"""License scans by diagonal voting.

Rolling k-gram hashes of every text are joined by Spark with the positions of
the same k-grams in a fixed set of license templates (some thousand rows, so
broadcast); matches vote for the diagonal (text position - template position).
A diagonal whose neighbourhood of ``DRIFT`` has votes for ``VOTES`` of the
template's grams opens a window of the text, which is verified by a longest
common subsequence of words and by the words that the template must have.
Verified windows that overlap merge into spans, and of overlapping spans of
different labels the better one stays.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.llm.common import read, sieve, texts, tune
from lociframe.llm.license_texts import TEMPLATES
from lociframe.session import cut

K = 4
#: Diagonals this close belong to one window (words inserted or lost in between).
DRIFT = 4
#: Share of a template's grams that must vote for a window, and of its words that a span must hold in order.
VOTES, LEAST = 0.2, 0.6

BASE = {"mit": b"mit license", "apache": b"apache license", "gpl": b"general public license"}

_TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list:
    """Words of a text after lower-casing A-Z."""
    return text.translate(_TO_WORDS).split() if text else []


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Rolling hash of each k consecutive word codes (wrapping uint64)."""
    if len(codes) < k:
        return np.zeros(0, np.int64)
    out = np.zeros(len(codes) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j: len(out) + j]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def word_codes(words: list, cache: dict) -> np.ndarray:
    if len(cache) > 500_000:
        cache.clear()
    for w in words:
        if w not in cache:
            cache[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def phrases(text: bytes | None) -> tuple:
    """(n_words, n_base, first_word, last_word, labels) of one text."""
    words = words_of(text)
    flat = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for label, phrase in BASE.items():
        for m in re.finditer(rb"(?= " + phrase + rb" )", flat):
            starts.append(flat.count(b" ", 0, m.start() + 1) - 1)
            labels.add(label)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def template_grams(templates: list) -> list:
    """(hash, template, position) rows, some thousand in all."""
    cache: dict = {}
    return [(int(h), t, p) for t, (_, _, text) in enumerate(templates)
            for p, h in enumerate(gram_hashes(word_codes(words_of(text.encode()), cache)))]


def votes_needed(words: int) -> int:
    return max(1, -(-(words - K + 1) * int(100 * VOTES) // 100))


def subsequence(a: list, b: list) -> tuple:
    """(length, first, last): of the longest common subsequence of ``a`` and ``b``, and the places in ``b`` of its first and last gain."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, n, first, last = full, 0, None, None
    for j, y in enumerate(b):
        u = row & at.get(y, 0)
        if u:
            row = ((row + u) | (row - u)) & full
            now = len(a) - row.bit_count()
            if now > n:
                n, last = now, j
                first = j if first is None else first
    return n, first, last


def verified(words: list, found: list, templates: list) -> list:
    """Spans (label, first, last, score) of a text from its windows (template, diagonal), where no better one of another label overlaps.

    ``templates``: (label, must, words) with words as lists.
    """
    spans: dict = {}
    for t, d in sorted(found):
        label, must, own = templates[t]
        lo = max(d - DRIFT, 0)
        near = words[lo: d + len(own) + DRIFT]
        if not must <= set(near):
            continue
        n, first, last = subsequence(own, near)
        if n < LEAST * len(own):
            continue
        new, held = (n / len(own), n, lo + first, lo + last), spans.setdefault(t, [])
        # windows come by their place: one that meets the template's last span is of the same place
        if held and held[-1][2] <= new[3] and new[2] <= held[-1][3]:
            held[-1] = max(held[-1], new)
        else:
            held.append(new)
    # better first: the share, then the number of words in order
    best = sorted(((s, n, -t, first, last) for t, held in spans.items() for s, n, first, last in held), reverse=True)
    out: list = []
    for s, _, t, first, last in best:
        label = templates[-t][0]
        if all(label == x[0] or last < x[1] or x[2] < first for x in out):
            out.append((label, first, last, s))
    return out


def license_spans(docs: DataFrame, templates: list | None = None) -> DataFrame:
    """Verified spans of each distinct text: (text_key, label, first, last, score) with word positions; text_key is its xxhash64."""
    templates = templates or TEMPLATES
    spark = docs.sparkSession
    tune(spark)
    inner = docs.select(F.xxhash64("text").alias("text_key"), "text")
    cut_up = [(label, frozenset(words_of(must.encode())), words_of(text.encode())) for label, must, text in templates]

    def hashes(batches):
        cache: dict = {}
        for b in batches:
            grams = [gram_hashes(word_codes(words_of(t), cache)) for t in texts(b.column(1))]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in grams], dtype=np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*grams, np.zeros(0, np.int64)])))],
                                             names=["text_key", "grams"])

    known = F.broadcast(spark.createDataFrame(template_grams(templates), "gram long, template int, place int"))
    votes = (inner.mapInArrow(hashes, "text_key long, grams array<long>").select("text_key", F.posexplode("grams").alias("pos", "gram"))
             .join(known, "gram").select("text_key", "template", (F.col("pos") - F.col("place")).alias("diagonal"), "pos").distinct())
    lines = votes.groupBy("text_key", "template", "diagonal").agg(F.count("*").alias("votes"))
    need = F.array(*[F.lit(votes_needed(len(words))) for _, _, words in cut_up])[F.col("template")]
    around = Window.partitionBy("text_key", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    # one row a text: windows are no more than the text's words for each template
    windows = cut(lines.withColumn("near", F.sum("votes").over(around)).where(F.col("near") >= need)
                  .groupBy("text_key").agg(F.collect_list(F.struct("template", "diagonal")).alias("windows")))
    asked = sieve(windows, "text_key")

    def check(batches):
        for b in batches:
            key, label, first, last, score = [], [], [], [], []
            for k, t, w in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist()):
                for span in verified(words_of(t), [(x["template"], x["diagonal"]) for x in w], cut_up):
                    for held, x in zip((key, label, first, last, score), (k, *span)):
                        held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(label, pa.string()), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                                              pa.array(score, pa.float64())], names=["text_key", "label", "first", "last", "score"])

    some = inner.where(asked("text_key")).join(windows.select("text_key"), "text_key", "left_semi").dropDuplicates(["text_key"])
    return some.join(windows, "text_key").select("text_key", "text", "windows").mapInArrow(check, "text_key long, label string, first long, last long, score double")


def license_scan(docs: DataFrame, templates: list | None = None) -> DataFrame:
    """One row per row of ``docs``: base phrase places, all labels, and the best verified share (0 to 1).

    Null and empty texts have no words and no labels. Null ids and repeated
    rows get a row each. Other columns are not read. An empty table gives an
    empty result. A base phrase alone scores 0.5. Labels are those of the base
    phrases and of all spans.
    """
    spark = docs.sparkSession
    tune(spark)
    inner = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def base(batches):
        for b in batches:
            rows = [phrases(t) for t in texts(b.column(2))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(cols[i], pa.int64()) for i in range(4)), pa.array(cols[4], pa.string())],
                names=["doc_id", "text_key", "n_words", "n_base", "first_word", "last_word", "base_labels"])

    kind = inner.schema["doc_id"].dataType.simpleString()
    plain = inner.mapInArrow(base, f"doc_id {kind}, text_key long, n_words long, n_base long, first_word long, last_word long, base_labels string")
    found = (license_spans(docs, templates).groupBy(F.col("text_key").alias("k"))
             .agg(F.collect_set("label").alias("more"), F.max("score").alias("best")))
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    return (plain.join(found, F.col("text_key") == F.col("k"), "left")
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                    F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
                    F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score")))


def op2_license_scan(spark, sf_dir):
    return license_scan(read(spark, sf_dir, "documents"))
