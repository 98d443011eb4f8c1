"""Sequence, quality, flag and CIGAR functions as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements (U pairs with A, case is kept), splice motifs, flag bits, least intron of an alignment.
BASES, COMPLEMENTS = "ACTGUNXactgunx", "TGACANXtgacanx"
CANONICAL, REVERSE_CANONICAL = ("GT-AG", "GC-AG", "AT-AC"), ("CT-AC", "CT-GC", "GT-AT")
UNALIGNED, REVERSE, SECONDARY, SUPPLEMENTARY = 4, 16, 256, 2048
MIN_INTRON = 68

BLOCKS = "array<struct<t_start:bigint,t_end:bigint,q_start:bigint,q_end:bigint>>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column) -> Column:
    """``c`` as the only row of a generator: what is computed from it later reads its value, where a plain projection would be copied into each use."""
    return F.explode(F.array(c))


def let(value: Column, body) -> Column:
    """``body(value)`` as an expression that computes ``value`` once, however often ``body`` names it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rc(seq: Column | str) -> Column:
    """Reverse complement; characters without a complement stay."""
    return F.reverse(F.translate(col(seq), BASES, COMPLEMENTS))


def gc_bin(seq: Column | str, bins: int) -> Column:
    """Bin 0..bins-1 of the share of G and C; null for an empty sequence. The length is that of the text itself: some letters grow in upper case."""
    n = F.length(col(seq))
    share = F.regexp_count(F.upper(col(seq)), F.lit("[GC]")) / F.nullif(n, F.lit(0))
    return F.when(n > 0, F.least(F.floor(share * bins), F.lit(bins - 1))).cast("int")


def phred_of_rate(rate: Column | str) -> Column:
    """Quality character (offset 33) of an error rate; rates under 0.0001 are ``I``."""
    r = col(rate)
    return F.when(r < 0.0001, "I").otherwise(F.char((F.floor(-10 * F.log10(r) + 1e-9) + 33).cast("int")))


def rate_of_phred(char: Column | str) -> Column:
    return F.pow(F.lit(10.0), (F.lit(33) - F.ascii(col(char))) / F.lit(10.0))


def is_uuid4(text: Column | str) -> Column:
    return F.lower(col(text)).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def kmers(seq: Column | str, k: int) -> Column:
    """Array of all substrings of ``k`` characters, in order."""
    s = col(seq)
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def motif_strand(motif: Column | str) -> Column:
    """``+`` or ``-`` by the splice motif ``DD-AA``, null where it is not canonical."""
    m = F.upper(col(motif))
    return F.when(m.isin(*CANONICAL), "+").when(m.isin(*REVERSE_CANONICAL), "-")


def has_flag(flag: Column | str, bits: int) -> Column:
    return col(flag).bitwiseAND(F.lit(bits)) != 0


def molecule(name: Column | str) -> Column:
    """``movie/hole`` of a long-read name."""
    return F.regexp_extract(col(name), r"^([^/]+/\d+)", 1)


def read_kind(name: Column | str) -> Column:
    """``ccs`` or ``sub`` of a long-read name, null for other names."""
    n = col(name)
    return F.when(n.rlike(r"^[^/]+/\d+/ccs"), "ccs").when(n.rlike(r"^[^/]+/\d+/\d+_\d+"), "sub")


def cigar_ops(cigar: Column | str) -> Column:
    """Array of (n, op)."""
    part = lambda i: F.regexp_extract_all(col(cigar), F.lit(r"([0-9]+)([MIDNSHP=X])"), F.lit(i))
    return F.zip_with(part(1), part(2), lambda n, op: F.struct(n.cast("bigint").alias("n"), op.alias("op")))


def _total(ops: Column, kinds: str) -> Column:
    return F.aggregate(ops, F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["op"].isin(*kinds), x["n"]).otherwise(0))


def target_span(cigar: Column | str) -> Column:
    """Bases of the target from the first to the last aligned one."""
    return _total(cigar_ops(cigar), "M=XDN")


def query_length(cigar: Column | str, original: bool = False) -> Column:
    """Bases of the query, with those clipped hard too if ``original``."""
    return _total(cigar_ops(cigar), "MIS=XH" if original else "MIS=X")


def aligned_bases(cigar: Column | str) -> Column:
    return _total(cigar_ops(cigar), "M=X")


def cigar_blocks(pos: Column | str, cigar: Column | str) -> Column:
    """Aligned blocks (t_start, t_end, q_start, q_end), both 1-based; clipped bases move the query, gaps the target."""
    zero = F.struct(col(pos).cast("bigint").alias("t"), F.lit(1).cast("bigint").alias("q"), F.array().cast(BLOCKS).alias("out"))

    def step(a, x):
        n, both = x["n"], x["op"].isin("M", "=", "X")
        block = F.struct(a["t"].alias("t_start"), (a["t"] + n - 1).alias("t_end"), a["q"].alias("q_start"), (a["q"] + n - 1).alias("q_end"))
        return F.struct((a["t"] + F.when(both | x["op"].isin("D", "N"), n).otherwise(0)).alias("t"),
                        (a["q"] + F.when(both | x["op"].isin("S", "I"), n).otherwise(0)).alias("q"),
                        F.when(both, F.concat(a["out"], F.array(block))).otherwise(a["out"]).alias("out"))

    return F.aggregate(cigar_ops(cigar), zero, step, lambda a: a["out"])


def original_query_range(cigar: Column | str, strand: Column | str) -> Column:
    """Struct (start, end) of the aligned query bases on the strand that was read, hard clips counted."""
    ops = cigar_ops(cigar)
    soft = lambda o: F.aggregate(
        o, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("go")),
        lambda a, x: F.struct((a["n"] + F.when(a["go"] & x["op"].isin("S", "H"), x["n"]).otherwise(0)).alias("n"),
                              (a["go"] & x["op"].isin("S", "H")).alias("go")), lambda a: a["n"])
    left, right = soft(ops), soft(F.reverse(ops))
    total = _total(ops, "MIS=XH")
    plus = F.struct((left + 1).alias("start"), (total - right).alias("end"))
    minus = F.struct((right + 1).alias("start"), (total - left).alias("end"))
    return F.when(col(strand) == "-", minus).otherwise(plus)


def blocks_cigar(blocks: Column | str, query_size: Column | str, min_intron: int = MIN_INTRON) -> Column:
    """CIGAR of aligned blocks: target gaps of ``min_intron`` or more are N, shorter ones D; query gaps I; the rest clipped."""
    b = col(blocks)
    piece = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")

    def step(a, x):
        dt, dq = x["t_start"] - a["t"] - 1, x["q_start"] - a["q"] - 1
        gap = F.when(a["q"] == 0, piece(x["q_start"] - 1, "S")).otherwise(
            F.concat(piece(dq, "I"), F.when(dt >= min_intron, piece(dt, "N")).otherwise(piece(dt, "D"))))
        return F.struct(x["t_end"].alias("t"), x["q_end"].alias("q"), F.concat(a["out"], gap, piece(x["t_end"] - x["t_start"] + 1, "M")).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("q"), F.lit("").alias("out"))
    return F.when(F.size(b) > 0, F.aggregate(b, zero, step, lambda a: F.concat(a["out"], piece(col(query_size) - a["q"], "S"))))


def blocks_exons(blocks: Column | str, min_intron: int = MIN_INTRON) -> Column:
    """Exons of aligned blocks: gaps of the target under ``min_intron`` are closed."""
    from lociframe.functions.transcripts import smooth

    return smooth(F.transform(col(blocks), lambda x: F.struct(x["t_start"].alias("start"), x["t_end"].alias("end"))), min_intron, absorb=True)


def ops_of_cigars(cigars: pa.Array) -> tuple:
    """Operations of a batch of CIGARs, by steps over the bytes of all of them at once: numpy arrays of row, operation's byte and number."""
    text = cigars.cast(pa.large_string()).combine_chunks() if isinstance(cigars, pa.ChunkedArray) else cigars.cast(pa.large_string())
    bounds = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    first, data = int(bounds[0]), np.frombuffer(text.buffers()[2] or b"", np.uint8)[int(bounds[0]): int(bounds[-1])]
    bounds = bounds - first
    digit = (data >= 48) & (data <= 57)
    # an operation: a letter right after a digit of its own row
    ahead = np.zeros(len(data), bool)
    ahead[1:] = digit[:-1]
    ahead[bounds[:-1][bounds[:-1] < len(data)]] = False
    at = np.flatnonzero(ahead & np.isin(data, np.frombuffer(b"MIDNSHP=X", np.uint8)))
    row = np.searchsorted(bounds, at, "right") - 1
    # its number: the run of digits before it, from the end of the last byte that is none or of the row before
    stop = np.maximum.accumulate(np.where(digit, -1, np.arange(len(data)))) if len(data) else np.zeros(0, np.int64)
    low = np.maximum(np.where(at >= 2, stop[np.maximum(at - 1, 0)], -1) + 1, bounds[row])
    n = np.zeros(len(at), np.int64)
    for k in range(int((at - low).max(initial=0))):
        n = np.where(low + k < at, n * 10 + data[np.minimum(low + k, at - 1)] - 48, n)
    return row, data[at], n


def exons_of_cigars(pos: pa.Array, cigars: pa.Array, min_intron: int = MIN_INTRON) -> pa.Array:
    """Exons of a batch of alignments, as ``blocks_exons`` of ``cigar_blocks``."""
    row, op, n = ops_of_cigars(cigars)
    rows, none = len(cigars), np.asarray(cigars.is_null())
    both = (op == 77) | (op == 61) | (op == 88)
    moved = np.cumsum(np.where(both | (op == 68) | (op == 78), n, 0))
    before = np.concatenate([[0], moved])
    placed = np.asarray(pos.cast(pa.int64()).fill_null(0))
    t = placed[row] + before[:-1] - before[np.searchsorted(row, row)]
    t, m, row = t[both], n[both], row[both]
    end = t + m - 1
    lost = np.asarray(pos.is_null())
    new = np.ones(len(t), bool)
    # without a place no gap is known and nothing is closed
    new[1:] = (row[1:] != row[:-1]) | (t[1:] - end[:-1] - 1 >= min_intron) | lost[row[1:]]
    starts = np.flatnonzero(new)
    lasts = np.append(starts[1:], len(t))[: len(starts)] - 1
    unknown = lost[row[starts]]
    exons = pa.StructArray.from_arrays([pa.array(t[starts], mask=unknown), pa.array(end[lasts], mask=unknown)], ["start", "end"])
    counts = np.bincount(row[starts], minlength=rows)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(none, False)), exons)


def cigar_exons(pos: Column | str, cigar: Column | str, min_intron: int = MIN_INTRON) -> Column:
    """``blocks_exons`` of ``cigar_blocks``, computed by batches of rows: what alignments become exons by."""
    run = F.arrow_udf(lambda p, c: exons_of_cigars(p, c, min_intron), "array<struct<start:bigint,end:bigint>>")
    return run(col(pos).cast("bigint"), col(cigar))


def spliced(cigar: Column | str, overhang: int = 1, min_intron: int = MIN_INTRON) -> Column:
    """``has_junction``, computed by batches of rows."""
    def run(c: pa.Array) -> pa.Array:
        row, op, n = ops_of_cigars(c)
        upto = np.cumsum(np.where((op == 77) | (op == 61) | (op == 88), n, 0))
        edge = np.concatenate([[0], upto])
        left, right = upto - edge[np.searchsorted(row, row)], edge[np.searchsorted(row, row, "right")] - upto
        good = np.zeros(len(c), bool)
        good[row[(op == 78) & (n >= min_intron) & (left >= overhang) & (right >= overhang)]] = True
        return pa.array(good, mask=np.asarray(c.is_null()))

    return F.arrow_udf(run, "boolean")(col(cigar))


def has_junction(cigar: Column | str, overhang: int = 1, min_intron: int = MIN_INTRON) -> Column:
    """Whether an intron has ``overhang`` aligned bases or more on both sides."""
    ops = cigar_ops(cigar)
    both = lambda a, x: F.when(x["op"].isin("M", "=", "X"), x["n"]).otherwise(0)
    found = F.transform(ops, lambda x, i: (x["op"] == "N") & (x["n"] >= min_intron)
                        & (F.aggregate(F.slice(ops, 1, F.greatest(i, F.lit(0))), F.lit(0).cast("bigint"), lambda a, y: a + both(a, y)) >= overhang)
                        & (F.aggregate(F.slice(ops, i + 2, F.size(ops)), F.lit(0).cast("bigint"), lambda a, y: a + both(a, y)) >= overhang))
    return F.exists(found, lambda x: x)
