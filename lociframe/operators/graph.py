"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.session import cut, shuffled, spread_of


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Weakly connected components of an edge table of BIGINT ids: (node, component = smallest node).

    Alternates the large-star and small-star contractions until the edge set is
    a forest of stars. Each round is two grouped minima (combined map-side) and
    two equi joins that adaptive execution may split on hot nodes; lineage is
    cut by a checkpoint after each round. All of it has partitions enough for the
    input's size. Rows with a null end and loops only
    are dropped; an empty table gives an empty result.
    """
    with shuffled(edges.sparkSession, spread_of(edges)):
        return _contracted(edges, src, dst, max_rounds)


def _contracted(edges: DataFrame, src: str, dst: str, max_rounds: int) -> DataFrame:
    cur = cut(
        edges.select(F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .distinct()
    )

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")))
                     .first())

    before = signature(cur)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u AND m < v")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(
            F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")),
                              F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        cur = cut(small.select("e.lo", "e.hi").where("lo < hi").distinct())
        now = signature(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    members = cur.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = cur.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return cut(members.unionByName(roots))


def roots(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes without a parent other than themselves."""
    child = edges.where("src != dst").select(F.col("dst").alias("__d")).distinct()
    return nodes.join(child, F.col(node) == F.col("__d"), "left_anti")


def descendants(edges: DataFrame, start: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(start, node): all that is reached along edges from each start node, by rounds of frontier joins with checkpoints.

    Pairs seen before are not followed again, so cycles end.
    """
    step = cut(edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d")).where("__s IS NOT NULL AND __d IS NOT NULL").distinct())
    front = start.select(F.col("node").alias("start"), F.col("node")).distinct()
    seen = None
    for _ in range(max_depth):
        front = front.join(step, F.col("node") == F.col("__s")).select("start", F.col("__d").alias("node")).distinct()
        if seen is not None:
            front = front.join(seen, ["start", "node"], "left_anti")
        front = cut(front)
        if front.isEmpty():
            break
        seen = front if seen is None else cut(seen.unionByName(front))
    else:
        raise RuntimeError("paths are longer than max_depth")
    return seen if seen is not None else front


def root_graphs(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each start node the graph of it and all that is reached from it: nodes (start, node) and edges (start, src, dst, ...)."""
    nodes = descendants(edges, start).unionByName(start.select(F.col("node").alias("start"), "node").distinct()).distinct()
    held = cut(nodes)
    inner = (edges.join(held.select("start", F.col("node").alias("src")), "src").join(held.select("start", F.col("node").alias("dst")), ["start", "dst"])
             .select("start", *edges.columns))
    return held, inner


def moved_edges(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``edges`` (src, dst) with the edges of each node of ``targets`` (node, target) moved to its target, each once and without loops."""
    at = lambda side: targets.select(F.col("node").alias(side), F.col("target").alias(f"__{side}"))
    both = edges.select("src", "dst").join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    return both.select(F.coalesce("__src", "src").alias("src"), F.coalesce("__dst", "dst").alias("dst")).where("src != dst").distinct()


def merged_cycles(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without cycles: (node, keep) says which node stands for each, the smallest of its cycles; and the edges left."""
    rings = cut(strong_components(edges))
    kept = nodes.select("node").distinct().join(rings, "node", "left").select("node", F.coalesce("component", "node").alias("keep"))
    return kept, moved_edges(edges, rings.select("node", F.col("component").alias("target")))


def linked(edges: DataFrame) -> DataFrame:
    """Edges without a direction (src, dst[, weight]): both ways, a weight summed over the edges of a pair, each pair once."""
    weight = F.sum("weight") if "weight" in edges.columns else F.count("*")
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src != dst").groupBy(low.alias("a"), high.alias("b")).agg(weight.alias("weight"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select(ends.alias("e"), "weight").select("e.src", "e.dst", "weight")


def strong_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): strongly connected components with two or more nodes, component = smallest node.

    Nodes without an edge in or out are trimmed; then in each round every node
    takes the smallest node that reaches it and the smallest that it reaches:
    where both agree with a pivot, the node is in the pivot's component.
    """
    cur = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src != dst").distinct())
    found = None
    for _ in range(max_rounds):
        while True:
            n = cur.count()
            cur = cut(cur.join(cur.select(F.col("dst").alias("__k")).distinct(), F.col("src") == F.col("__k"), "left_semi")
                      .join(cur.select(F.col("src").alias("__k")).distinct(), F.col("dst") == F.col("__k"), "left_semi"))
            if cur.count() == n:
                break
        if cur.isEmpty():
            break
        ahead, back = _least_along(cur, "src", "dst"), _least_along(cur, "dst", "src").withColumnRenamed("low", "low2")
        both = cut(ahead.join(back, "node"))
        own = both.where("low = low2").select("node", F.col("low").alias("component"))
        found = own if found is None else found.unionByName(own)
        # edges inside one (low, low2) class that are not settled go on
        label = both.where("low != low2").select("node", F.struct("low", "low2").alias("c"))
        cur = cut(cur.join(label.toDF("src", "cs"), "src").join(label.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst"))
    else:
        raise RuntimeError("components did not converge")
    if found is None:
        return cur.select(F.col("src").alias("node"), F.col("src").alias("component"))
    size = found.groupBy("component").agg(F.count("*").alias("__n")).where("__n > 1")
    return found.join(size, "component").select("node", "component")


def _least_along(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, low): the smallest node that reaches each node along ``src`` -> ``dst``, itself included."""
    step = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d"))
    low = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("low", F.col("node")))
    while True:
        got = low.join(step, F.col("node") == F.col("__s")).groupBy("__d").agg(F.min("low").alias("__m"))
        new = cut(low.join(got, F.col("node") == F.col("__d"), "left").select("node", F.least("low", "__m").alias("low"), (F.col("__m") < F.col("low")).alias("__moved")))
        moved = new.where("__moved").isEmpty()
        low = new.select("node", "low")
        if moved:
            return low


def paths(edges: DataFrame, start: DataFrame, max_length: int = 1000) -> DataFrame:
    """(path): all directed paths without a repeated node from start nodes to nodes without a way on."""
    step = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d")).distinct()
    cur = start.select(F.array("node").alias("path"))
    done = None
    for _ in range(max_length):
        grown = (cur.join(step, F.element_at("path", -1) == F.col("__s"), "left")
                 .withColumn("__go", F.col("__d").isNotNull() & ~F.array_contains("path", F.coalesce("__d", F.element_at("path", 1)))))
        ended = grown.groupBy("path").agg(F.max("__go").alias("g")).where("NOT g").select("path")
        done = ended if done is None else done.unionByName(ended)
        cur = cut(grown.where("__go").select(F.concat("path", F.array("__d")).alias("path")))
        if cur.isEmpty():
            break
    else:
        raise RuntimeError("paths are longer than max_length")
    return done
