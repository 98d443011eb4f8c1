"""Descriptive statistics, expression values, strata, rarefaction, bias and junction support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociframe.operators.intervals import merge_runs
from lociframe.operators.overlap import pieces


def describe(df: DataFrame, value: str, keys: tuple = ()) -> DataFrame:
    """Count, mean, median, sample and population deviation, and the lowest most frequent value."""
    v = F.col(value)
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("stddev"),
            F.stddev_pop(v).alias("stddev_pop"), F.mode(v, deterministic=True).alias("mode")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def _cumulative(counts: DataFrame, value: str, amount: str, keys: list, descending: bool = False, buckets: int = 256) -> DataFrame:
    """``counts`` (keys, value, amount; a row each value) with ``upto``, the running sum of ``amount`` over values, and ``total``.

    Values are cut into ranges by quantiles, each range is summed on its own
    and starts from a prefix over ranges: the whole is never one task.
    """
    every = list(counts.columns)
    edges = counts.agg(F.array_distinct(F.approx_percentile(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(1000))).alias("__edges"))
    # one row, of as many numbers as there are buckets
    cut_up = counts.crossJoin(F.broadcast(edges))
    bucket = F.coalesce(F.size(F.filter("__edges", lambda e: e < F.col(value))), F.lit(0))
    rows = cut_up.withColumn("__b", -bucket if descending else bucket).select(*every, "__b")
    sums = rows.groupBy(*keys, "__b").agg(F.sum(amount).alias("__own"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__b")
    sums = sums.withColumn("__before", F.coalesce(F.sum("__own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("total", F.sum("__own").over(Window.partitionBy(*(keys or [F.lit(0)])))).drop("__own")
    own = Window.partitionBy(*keys, "__b").orderBy(F.col(value).desc() if descending else F.col(value)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, [*keys, "__b"]).withColumn("upto", F.col("__before") + F.sum(amount).over(own)).drop("__b", "__before")


def n50(df: DataFrame, value: str, keys: tuple = (), standard: bool = False) -> DataFrame:
    """Ascending N50: the first value, smallest first, whose running sum is over half of all.

    ``standard`` goes from the largest value and stops at half or more.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.sum(value).alias("__s"))
    run = _cumulative(rows, "__v", "__s", keys, descending=standard)
    hit = run.where(F.col("upto") * 2 >= F.col("total")) if standard else run.where(F.col("upto") * 2 > F.col("total"))
    agg = (F.max if standard else F.min)("__v").alias("n50")
    return hit.groupBy(*keys).agg(agg) if keys else hit.agg(agg)


def nearest_to_mean(df: DataFrame, value: str, order: str, keys: tuple = ()) -> DataFrame:
    """The value nearest to its group's mean, the first by ``order`` of equally near ones."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("__mean"))
    both = df.join(mean, list(keys)) if keys else df.crossJoin(F.broadcast(mean))
    agg = F.min_by(value, F.struct(F.abs(F.col(value) - F.col("__mean")), F.col(order))).alias("nearest")
    return both.groupBy(*keys).agg(agg) if keys else both.agg(agg)


def index_percentiles(df: DataFrame, value: str, percents: list, keys: tuple = ()) -> DataFrame:
    """(keys, percent, value) by position: the value at index int(percent / 100 * n) of the sorted values."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("__n"))
    run = _cumulative(counts, "value", "__n", keys).withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    at = F.floor(F.col("percent") * F.col("total") / 100)
    return run.where((at < F.col("upto")) & (at >= F.col("upto") - F.col("__n"))).select(*keys, "percent", "value")


def trimmed_mean(df: DataFrame, value: str, top: float, keys: tuple = ()) -> DataFrame:
    """Mean after the ``top`` share of rows with the largest values is cut off."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    run = _cumulative(counts, "__v", "__n", keys)
    keep = F.floor(F.col("total") * F.lit(1 - top))
    left = F.greatest(F.lit(0), F.least(F.col("__n"), keep - (F.col("upto") - F.col("__n"))))
    aggs = (F.sum(F.col("__v") * left) / F.nullif(F.sum(left), F.lit(0))).alias("trimmed_mean")
    return run.groupBy(*keys).agg(aggs) if keys else run.agg(aggs)


def expression(df: DataFrame, name: str, length: str, count: str, gene: str | None = None) -> DataFrame:
    """TPM and FPKM of each row from its length and read count; all zero where nothing was counted."""
    rate = F.col(count) / F.col(length)
    total = df.agg(F.sum(rate).alias("__rates"), F.sum(count).alias("__reads"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = df.crossJoin(F.broadcast(total)).withColumns({"tpm": safe(rate * 1e6, F.col("__rates")), "fpkm": safe(rate * 1e9, F.col("__reads"))}).drop("__rates", "__reads")
    if gene:
        # summed by gene and joined, so that a hot gene is combined before the shuffle
        out = out.join(out.groupBy(gene).agg(F.sum("tpm").alias("gene_tpm")), gene)
    return out


def strata(depths: DataFrame, least: int = 50, jitter: float = 0.0, seed: int = 1) -> DataFrame:
    """Runs (chr, start, end, strata): depths from the top are cut at so many bases (``least``, times 5, times 2, ...).

    Strata are numbered from the bottom. ``jitter`` adds a seeded part to each
    depth, so equal depths spread over strata. Abutting runs of one stratum join.
    """
    depth = F.col("depth").cast("double")
    if jitter:
        depth = depth + jitter * (F.pmod(F.xxhash64(F.lit(seed), "chr", "start"), F.lit(1_000_003)) / 1_000_003)
    rows = depths.select("chr", "start", "end", depth.alias("d"))
    by = rows.groupBy("d").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))
    ladder, c = [], least
    while c < 1 << 62:
        ladder.append(c)
        c *= 2 if len(ladder) % 2 == 0 else 5
    below = lambda x: F.size(F.filter(F.array(*map(F.lit, ladder)), lambda limit: limit < F.col(x)))
    named = _cumulative(by, "d", "bases", [], descending=True).select("d", (below("total") + 1 - below("upto")).alias("strata"))
    return merge_runs(rows.join(named, "d").select("chr", "start", "end", "strata"), "strata")


def equal_strata(depths: DataFrame, n: int) -> DataFrame:
    """Runs (chr, start, end, depth, strata) with ``n`` strata of about equal bases, 1 for the lowest depths."""
    by = depths.groupBy("depth").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))
    run = _cumulative(by, "depth", "bases", []).withColumn("strata", F.least(F.floor((F.col("upto") - F.col("bases")) * n / F.col("total")) + 1, F.lit(n)).cast("int"))
    return depths.join(run.select("depth", "strata"), "depth").select("chr", "start", "end", "depth", "strata")


def rarefaction(reads: DataFrame, label: str, read: str, sizes: list, trials: int = 20, least: int = 1, seed: int = 1) -> DataFrame:
    """(size, found): mean number of distinct labels with ``least`` reads or more among ``size`` reads drawn, over ``trials`` draws.

    In each trial reads are ordered by a seeded hash and the first ``size`` are
    drawn. A histogram of the hash's leading bits finds the bucket where a draw
    ends; only that bucket is ordered.
    """
    spark = reads.sparkSession
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "trial", "__r").cast("binary")), 1, 13), 16, 10).cast("long")
    drawn = (reads.select(F.col(label).alias("__l"), F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"), F.col(read).cast("string").alias("__r"))
             .withColumn("u", hashed).withColumn("b", F.shiftright("u", 36)))
    counts = drawn.groupBy("trial", "b").agg(F.count("*").alias("n"))
    # 65,536 buckets a trial at most
    before = Window.partitionBy("trial").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = F.broadcast(spark.createDataFrame([(x,) for x in sorted(set(sizes))], "size long"))
    # buckets that a draw takes whole or in part, with what is left to take
    taken = counts.join(wanted, F.col("before") < F.col("size")).select("trial", "b", "size", "n", (F.col("size") - F.col("before")).alias("left"))
    some = drawn.join(taken, ["trial", "b"])
    rank = F.row_number().over(Window.partitionBy("trial", "size", "b").orderBy("u", "__r", "__l"))
    part = some.where("left < n").withColumn("rank", rank).where("rank <= left").drop("rank")
    hit = some.where("left >= n").unionByName(part).groupBy("size", "trial", "__l").agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    per = hit.groupBy("size", "trial").agg(F.count("*").alias("__k"))
    return per.groupBy("size").agg(F.floor(F.sum("__k") / F.lit(trials)).cast("long").alias("found"))


def position_bias(depths: DataFrame, tx: DataFrame, bins: int = 100) -> DataFrame:
    """(name, bin, mean_depth): mean depth in ``bins`` equal parts of each transcript's exons, from its 5' end.

    ``tx``: (name, chr, strand, exons). Pieces of depth runs are placed by
    their offset in the transcript and cut at bin edges.
    """
    from lociframe.functions.transcripts import length

    exons = tx.withColumn("size", length("exons")).select("name", "chr", "strand", "size", "exons", F.posexplode("exons").alias("i", "e"))
    before = F.aggregate(F.slice("exons", 1, F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"] + 1)
    exons = exons.select("name", "chr", "strand", "size", before.alias("before"), F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    hit = pieces(exons, depths)
    lo = F.col("a_before") + F.col("start") - F.col("a_start")
    hi = lo + F.col("size") - 1
    back = F.col("a_strand") == "-"
    hit = hit.select(F.col("a_name").alias("name"), F.col("a_size").alias("n"), F.col("b_depth").alias("depth"),
                     F.when(back, F.col("a_size") - 1 - hi).otherwise(lo).alias("lo"), F.when(back, F.col("a_size") - 1 - lo).otherwise(hi).alias("hi"))
    cut = hit.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * bins / F.col("n")), F.floor(F.col("hi") * bins / F.col("n")))))
    first, last = F.ceil(F.col("bin") * F.col("n") / bins), F.ceil((F.col("bin") + 1) * F.col("n") / bins) - 1
    part = F.greatest(F.lit(0), F.least(F.col("hi"), last) - F.greatest(F.col("lo"), first) + 1)
    return (cut.where(part > 0).groupBy("name", "n", "bin").agg(F.sum(part * F.col("depth")).alias("s"))
            .select("name", F.col("bin").cast("int").alias("bin"), (F.col("s") / F.greatest(F.ceil((F.col("bin") + 1) * F.col("n") / bins) - F.ceil(F.col("bin") * F.col("n") / bins), F.lit(1))).alias("mean_depth")))


def junction_support(junctions: DataFrame, mapped: DataFrame) -> DataFrame:
    """Support of junctions from rows (chr, left, right, strand, read, pos, right_size).

    ``mapped``: (read, mappings). reads: distinct; width: spread of the bases
    right of the junction; positions: distinct; reads mapped once and more
    often apart. ``label``: ``(reads)[width_positions](unique/multi)``.
    """
    key = ["chr", "left", "right", "strand"]
    # junctions may be costly to find: reads (kind 0) and positions (kind 1) are told apart in one pass over them
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("read").cast("string").alias("id"), F.col("right_size").alias("size")),
                              F.struct(F.lit(1).alias("kind"), F.col("pos").cast("string").alias("id"), F.lit(None).cast("bigint").alias("size"))))
    once = (junctions.select(*key, kinds.alias("k")).select(*key, "k.*").dropna(subset=[*key, "id"]).groupBy(*key, "kind", "id").agg(F.min("size").alias("lo"), F.max("size").alias("hi")))
    known = mapped.select(F.lit(0).alias("kind"), F.col("read").cast("string").alias("id"), "mappings", F.lit(True).alias("known"))
    of = lambda test: F.count_if((F.col("kind") == 0) & test)
    m = F.col("mappings")
    out = once.join(known, ["kind", "id"], "left").where("kind = 1 OR known").groupBy(*key).agg(
        of(F.lit(True)).alias("reads"), (F.max("hi") - F.min("lo")).alias("width"), of(m == 1).alias("unique_reads"), of(m > 1).alias("multi_reads"), F.count_if(F.col("kind") == 1).alias("positions"))
    return out.where("reads > 0").withColumn("label", F.format_string("(%d)[%d_%d](%d/%d)", "reads", "width", "positions", "unique_reads", "multi_reads"))


def combine_junctions(tables: DataFrame) -> DataFrame:
    """Junction support of several samples in one: reads summed, width and positions at their largest."""
    return tables.groupBy("chr", "left", "right", "strand").agg(
        F.sum("reads").alias("reads"), F.max("width").alias("width"), F.max("positions").alias("positions"), F.sum("unique_reads").alias("unique_reads"), F.sum("multi_reads").alias("multi_reads"))


def depth_overlap(a: DataFrame, b: DataFrame, thresholds: list) -> DataFrame:
    """(a_least, b_least, a_size, b_size, overlap, bias) for pairs of depth thresholds of two depth tables, the first at least the second."""
    spark = a.sparkSession
    t = spark.createDataFrame([(x,) for x in thresholds], "t long")

    def sizes(df, name):
        s = df.groupBy("depth").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n")).join(F.broadcast(t), F.col("depth") >= F.col("t"))
        return s.groupBy(F.col("t").alias(f"{name}_least")).agg(F.sum("n").alias(f"{name}_size"))

    both = pieces(a, b).groupBy("a_depth", "b_depth").agg(F.sum("size").alias("n"))
    pairs = spark.createDataFrame([(x, y) for x in thresholds for y in thresholds if x >= y], "a_least long, b_least long")
    met = (both.join(F.broadcast(pairs), (F.col("a_depth") >= F.col("a_least")) & (F.col("b_depth") >= F.col("b_least")))
           .groupBy("a_least", "b_least").agg(F.sum("n").alias("overlap")))
    out = pairs.join(sizes(a, "a"), "a_least", "left").join(sizes(b, "b"), "b_least", "left").join(met, ["a_least", "b_least"], "left").na.fill(0)
    return out.withColumn("bias", F.when(F.col("a_size") > 0, 1 - F.col("overlap") / F.col("a_size")))


def quality_profile(reads: DataFrame) -> DataFrame:
    """(pos, qual, reads): quality characters by position in the read."""
    chars = F.posexplode(F.split("qual", ""))
    return reads.select(chars.alias("pos", "qual")).where("qual != ''").groupBy("pos", "qual").agg(F.count("*").alias("reads"))
