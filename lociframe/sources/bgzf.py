"""BGZF and BAM as Spark data sources, read in parallel by ranges of compressed blocks.

``spark.read.format("bam").load(path)`` after ``register(spark)``. The planner
reads a file's header and size only and cuts it into partitions of
``partitionBytes`` compressed bytes; a partition finds its first block by the
block magic and where the block's own size leads. BAM records cross blocks, so a
partition finds its first record by a check of the fixed fields over several
records in a row, and reads on past its end to finish its last one.

Paths are opened through pyarrow's file systems (local, hdfs, s3, gs); other
stores need ``opener`` replaced. No file is read as a whole by one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the formats: block magic, end block, codes of bases, CIGAR operations and tag types.
MAGIC = b"\x1f\x8b\x08\x04"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TAG_FORMATS = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

PARTITION_BYTES, WRITE_BLOCK = 32_000_000, 64_000
SCHEMA = ("qname string, flag bigint, rname string, pos bigint, mapq bigint, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string, "
          "tags map<string,struct<type:string,value:string>>, block_start bigint, inner_start bigint")


def opener(path: str):
    """A seekable file of a path or URI."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def block_size(head: bytes) -> int:
    """Compressed bytes of the block whose first bytes are ``head``; 0 where none starts."""
    if len(head) < 18 or head[:4] != MAGIC:
        return 0
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, 12 + extra
    while at + 4 <= min(end, len(head)):
        kind, n = head[at: at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return 0


def is_bgzf(path: str) -> bool:
    with opener(path) as f:
        return block_size(f.read(64)) > 0


def block_bounds(path: str) -> Iterator[tuple[int, int]]:
    """(start, compressed size) of each block."""
    with opener(path) as f:
        at, size = 0, f.size()
        while at < size:
            f.seek(at)
            n = block_size(f.read(64))
            if not n:
                raise ValueError(f"no block at byte {at} of {path}")
            yield at, n
            at += n


def next_block(f, at: int) -> int:
    """Start of the first block at byte ``at`` or after it, the file's size where there is none.

    The magic may stand within a block's data by chance: what it starts must also end where another block or nothing follows.
    """
    size = f.size()
    while at < size:
        f.seek(at)
        window = f.read(1 << 17)
        k = window.find(MAGIC)
        while k >= 0:
            f.seek(at + k)
            n = block_size(f.read(64))
            f.seek(at + k + n)
            if n and at + k + n <= size and f.read(4) in (MAGIC, b""):
                return at + k
            k = window.find(MAGIC, k + 1)
        at += max(len(window) - 3, 1)
    return size


def inflate(raw: bytes, check: bool = False) -> bytes:
    """Data of one whole block."""
    extra = struct.unpack_from("<H", raw, 10)[0]
    data = zlib.decompress(raw[12 + extra: -8], -15)
    if check and zlib.crc32(data) != struct.unpack_from("<I", raw, len(raw) - 8)[0]:
        raise ValueError("a block's checksum is wrong")
    return data


def deflate(data: bytes, level: int = 9) -> bytes:
    """One block of up to 65,280 bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def compress(data: bytes, block: int = WRITE_BLOCK) -> bytes:
    return b"".join(deflate(data[i: i + block]) for i in range(0, len(data), block)) + END_BLOCK


class Stream:
    """Bytes of consecutive blocks from a block's start on, with the place of each byte."""

    def __init__(self, f, start: int):
        self.f, self.next, self.data, self.base, self.marks = f, start, b"", 0, []
        self.size = f.size()

    def need(self, n: int) -> bool:
        """Have ``n`` bytes ready, if the file has them."""
        while len(self.data) - self.base < n and self.next < self.size:
            self.f.seek(self.next)
            head = self.f.read(64)
            k = block_size(head)
            self.f.seek(self.next)
            new = inflate(self.f.read(k))
            if self.base > 1 << 20:
                self.data = self.data[self.base:]
                self.marks = [(o - self.base, b) for o, b in self.marks if o > self.base - (1 << 17)]
                self.base = 0
            self.marks.append((len(self.data), self.next))
            self.data += new
            self.next += k
        return len(self.data) - self.base >= n

    def place(self) -> tuple[int, int]:
        """(block start, offset in the block) of the next byte."""
        o, b = max((m for m in self.marks if m[0] <= self.base), default=(0, 0))
        return b, self.base - o

    def peek(self, n: int, skip: int = 0) -> bytes:
        return self.data[self.base + skip: self.base + skip + n]

    def take(self, n: int) -> bytes:
        out = self.data[self.base: self.base + n]
        self.base += n
        return out


def read_header(s: Stream) -> tuple[str, list]:
    """(text, [(name, length)]) of a BAM at its start."""
    s.need(8)
    magic, n = struct.unpack("<4si", s.take(8))
    if magic != b"BAM\1":
        raise ValueError("not a BAM file")
    s.need(n + 4)
    text, (count,) = s.take(n).rstrip(b"\0").decode(), struct.unpack("<i", s.take(4))
    refs = []
    for _ in range(count):
        s.need(4)
        (k,) = struct.unpack("<i", s.take(4))
        s.need(k + 4)
        refs.append((s.take(k)[:-1].decode(), struct.unpack("<i", s.take(4))[0]))
    return text, refs


def looks_like_record(s: Stream, refs: int, skip: int = 0, chain: int = 4) -> bool:
    """Whether ``chain`` records (or as many as the file has) could start ``skip`` bytes on."""
    for _ in range(chain):
        if not s.need(skip + 36):
            return not s.need(skip + 1)
        size, ref, pos, name, _, _, ops, _, length, ref2, pos2, _ = struct.unpack("<iiiBBHHHiiii", s.peek(36, skip))
        least = 32 + name + 4 * ops + (length + 1) // 2 + length
        if not (-1 <= ref < refs and -1 <= ref2 < refs and pos >= -1 and pos2 >= -1 and name > 0 and length >= 0 and least <= size < 1 << 28):
            return False
        if not s.need(skip + 36 + name) or s.peek(1, skip + 35 + name) != b"\0":
            return False
        skip += size + 4
    return True


def tags_of(raw: bytes) -> dict:
    """{name: (type, value)}; integers of any width have type i."""
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at: at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = (kind, raw[at:end].decode()), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            f = f"<{n}{TAG_FORMATS[sub]}"
            out[name] = ("B", ",".join([sub, *(f"{x:g}" if sub == "f" else str(x) for x in struct.unpack_from(f, raw, at + 5))]))
            at += 5 + struct.calcsize(f)
        else:
            f = "<" + TAG_FORMATS[kind]
            (v,) = struct.unpack_from(f, raw, at)
            out[name] = ("A", v.decode()) if kind == "A" else ("f", f"{v:g}") if kind == "f" else ("i", str(v))
            at += struct.calcsize(f)
    return out


def record_of(raw: bytes, refs: list) -> tuple:
    """SAM columns of a record without its size."""
    ref, pos, n_name, mapq, _, n_ops, flag, length, ref2, pos2, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32
    name = raw[at: at + n_name - 1].decode()
    at += n_name
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", raw, at))
    at += 4 * n_ops
    packed = raw[at: at + (length + 1) // 2]
    seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in packed)[:length]
    at += (length + 1) // 2
    qual = raw[at: at + length]
    at += length
    text = None if not length or qual[0] == 255 else bytes(x + 33 for x in qual).decode()
    rname = refs[ref][0] if ref >= 0 else None
    rnext = None if ref2 < 0 else "=" if ref2 == ref else refs[ref2][0]
    return (name, flag, rname, pos + 1 or None, None if mapq == 255 else mapq, cigar or None, rnext, pos2 + 1 or None, tlen or None, seq or None, text,
            {k: v for k, v in tags_of(raw[at:]).items()})


class BlockRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        with opener(self.path) as f:
            s = Stream(f, 0)
            self.text, self.refs = read_header(s)
            self.first = s.place() if s.need(1) else None

    def partitions(self):
        with opener(self.path) as f:
            cut = range(0, max(f.size(), 1), self.bytes)
        return [BlockRange(self.path, a, b) for a, b in zip(cut, [*cut[1:], 1 << 62])]

    def read(self, part: BlockRange):
        if self.first is None:
            return
        with opener(part.path) as f:
            if part.start <= self.first[0]:
                if part.stop <= self.first[0]:
                    return
                s = Stream(f, self.first[0])
                s.need(self.first[1] + 1)
                s.take(self.first[1])
            else:
                s = Stream(f, next_block(f, part.start))
                if s.next >= part.stop:
                    return
                while s.need(1) and not looks_like_record(s, len(self.refs)):
                    s.take(1)
            while s.need(4):
                block, inner = s.place()
                if block >= part.stop:
                    return
                (n,) = struct.unpack("<i", s.take(4))
                s.need(n)
                yield (*record_of(s.take(n), self.refs), block, inner)


class BamSource(DataSource):
    """``format("bam")``: SAM columns and the place of each record (block_start, inner_start)."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def read_bam(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("bam").option("partitionBytes", str(partition_bytes)).load(path)


def index(bam: DataFrame) -> DataFrame:
    """(qname, target_range, block_start, inner_start, aligned_bases, flag) with one primary row per read and mate.

    Where a read's rows of a mate do not have exactly one primary, the one of
    most aligned bases is primary (the first place of equal ones) and the
    others are marked secondary and supplementary (2304).
    """
    from pyspark.sql.window import Window

    from lociframe.functions.sequence import aligned_bases, target_span

    mate = F.col("flag").bitwiseAND(F.lit(192))
    end = F.col("pos") + target_span("cigar") - 1
    rows = bam.select("qname", F.when(F.col("pos").isNotNull(), F.concat("rname", F.lit(":"), F.col("pos").cast("string"), F.lit("-"), end.cast("string"))).alias("target_range"),
                      "block_start", "inner_start", F.coalesce(aligned_bases("cigar"), F.lit(0)).alias("aligned_bases"), "flag", mate.alias("__m"))
    w = Window.partitionBy("qname", "__m")
    primary = F.count_if(F.col("flag").bitwiseAND(F.lit(2304)) == 0).over(w)
    first = F.row_number().over(w.orderBy(F.col("aligned_bases").desc(), "block_start", "inner_start"))
    flag = F.when(primary == 1, F.col("flag")).when(first == 1, F.col("flag").bitwiseAND(F.lit(~2304 & 0xFFFF))).otherwise(F.col("flag").bitwiseOR(F.lit(2304)))
    return rows.withColumn("flag", flag).drop("__m")


INDEX = "qname target_range block_start inner_start aligned_bases flag".split()


def write_index(bam: DataFrame, path: str) -> None:
    """``index`` as gzipped lines of tab-separated fields, in the order of the file."""
    rows = index(bam).orderBy("block_start", "inner_start")
    rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in INDEX]).alias("value")).write.option("compression", "gzip").text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a written index; an empty range is null."""
    f = F.split("value", "\t", -1)
    cols = [F.get(f, F.lit(i)) if c in ("qname", "target_range") else F.get(f, F.lit(i)).try_cast("bigint") for i, c in enumerate(INDEX)]
    return spark.read.text(path).where(F.size(f) >= len(INDEX)).select(*[F.nullif(x, F.lit("")).alias(c) if c == "target_range" else x.alias(c) for x, c in zip(cols, INDEX)])


def primaries(rows: DataFrame, n: int | None = None, seed: int = 1) -> DataFrame:
    """Rows of an index with neither the secondary nor the supplementary flag; with ``n`` so many of them, drawn by a seeded hash."""
    out = rows.where(F.col("flag").bitwiseAND(F.lit(2304)) == 0)
    return out if n is None else out.orderBy(F.xxhash64(F.lit(seed), "block_start", "inner_start"), "block_start", "inner_start").limit(n)


def records_at(rows: DataFrame, path: str) -> DataFrame:
    """The records of the file ``path`` at the places of index ``rows``: each task reads its places in the file's order."""
    import pandas as pd

    names = [x.strip().split(" ")[0] for x in SCHEMA.split(", ")]

    def run(batches):
        with opener(path) as f:
            refs, s = read_header(Stream(f, 0))[1], None
            for pdf in batches:
                out = []
                for block, inner in pdf.itertuples(index=False):
                    if s is None or s.place()[0] != block or s.place()[1] > inner:
                        s = Stream(f, block)
                        s.need(inner + 1)
                    s.take(inner - s.place()[1])
                    s.need(4)
                    (k,) = struct.unpack("<i", s.take(4))
                    s.need(k)
                    out.append((*record_of(s.take(k), refs), block, inner))
                yield pd.DataFrame(out, columns=names)

    return rows.select("block_start", "inner_start").repartitionByRange("block_start").sortWithinPartitions("block_start", "inner_start").mapInPandas(run, SCHEMA)


def encode_record(row, refs: dict) -> bytes:
    """A BAM record of SAM columns (tags A, i, f, Z and H)."""
    import re

    ops = [(int(n), OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    seq, name = row["seq"] or "", row["qname"].encode() + b"\0"
    codes = [BASES.index(c) if c in BASES else 15 for c in seq.upper()]
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], [*codes[1::2], 0] if len(codes) % 2 else codes[1::2]))
    qual = bytes(ord(c) - 33 for c in row["qual"]) if row["qual"] else b"\xff" * len(seq)
    tags = b""
    for k, v in sorted((row["tags"] or {}).items()):
        kind, value = v["type"], v["value"]
        body = {"A": lambda: value.encode(), "i": lambda: struct.pack("<i", int(value)), "f": lambda: struct.pack("<f", float(value))}.get(kind, lambda: value.encode() + b"\0")()
        tags += k.encode() + kind.encode() + body
    ref = refs.get(row["rname"], -1)
    ref2 = ref if row["rnext"] == "=" else refs.get(row["rnext"], -1)
    mapq = 255 if row["mapq"] is None else row["mapq"]
    body = struct.pack("<iiBBHHHiiii", ref, (row["pos"] or 0) - 1, len(name), mapq, 4680, len(ops), row["flag"], len(seq), ref2, (row["pnext"] or 0) - 1, row["tlen"] or 0)
    body += name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def encode_header(text: str, refs: list) -> bytes:
    raw = text.encode()
    out = b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs))
    return out + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in refs)
