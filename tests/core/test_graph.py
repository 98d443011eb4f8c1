"""Graph queries over whole tables against brute force."""


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components_of_all_items(spark, tmp_path):
    from lociframe.queries import QUERIES

    # few items have a quantity of 49 or more; a hot part joins many orders
    items = [(o, p, float(1 + (7 * o + p) % 50)) for o in range(1, 300) for p in ((1,) if o % 3 == 0 else (o, o + 40))]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.node: r.component for r in QUERIES["graph_components"](spark, str(tmp_path)).collect()}
    assert got == union_find([(2 * p, 2 * o + 1) for o, p, _ in items])


def test_paths_are_whole_or_refused(spark):
    import pytest

    from lociframe.operators.graph import paths

    edges = spark.createDataFrame([(i, i + 1) for i in range(22)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert [r.path for r in paths(edges, start).collect()] == [list(range(23))]
    with pytest.raises(RuntimeError):
        paths(edges, start, max_length=3)
