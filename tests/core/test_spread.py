"""Shuffles whose number of partitions follows the size of the files read."""

from lociframe import session
from lociframe.operators import graph
from lociframe.operators import intervals as I
from lociframe.queries import transcripts


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    spark.range(3000).selectExpr("CAST(id % 2 AS STRING) AS chr", "id * 7 % 2003 AS start", "id * 7 % 2003 + id % 9 AS end").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    rows = lambda d: sorted(map(tuple, d.collect()))
    plain = [rows(I.coverage(df, bin_size=64)), rows(I.islands(df, 1, bin_size=64)), rows(I.subtract(df, df.where("start % 5 = 0")))]
    assert session.spread_of(df) == 4 and session.spread_of(spark.range(9)) == 4
    monkeypatch.setattr(session, "SPREAD", 256)
    n = session.spread_of(df)
    assert n > 30 and session.spread_of(df.unionByName(df)) == n
    assert [rows(I.coverage(df, bin_size=64)), rows(I.islands(df, 1, bin_size=64)), rows(I.subtract(df, df.where("start % 5 = 0")))] == plain
    for made in (I.coverage(df), I.islands(df)):
        assert "RepartitionByExpression" in made._jdf.queryExecution().optimizedPlan().toString()
    assert session.spread(df, "chr").rdd.getNumPartitions() == n


def test_transcripts_are_dealt_by_order(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    plain = sorted(map(tuple, transcripts(spark, sf).select("id", "exons").collect()))
    monkeypatch.setattr(session, "SPREAD", 10_000)
    made = transcripts(spark, sf)
    assert "RepartitionByExpression" in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, made.select("id", "exons").collect())) == plain


def test_components_run_in_partitions_for_their_input(spark, tmp_path, monkeypatch):
    path, seen, cut = str(tmp_path / "e"), [], graph.cut
    spark.range(400).selectExpr("id AS src", "id + 3 AS dst").write.parquet(path)
    monkeypatch.setattr(session, "SPREAD", 256)
    monkeypatch.setattr(graph, "cut", lambda d: (seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))), cut(d))[1])
    df = spark.read.parquet(path)
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert got == {k: k % 3 for k in range(403)}
    assert set(seen) == {session.spread_of(df)} and seen[0] > 4 and spark.conf.get("spark.sql.shuffle.partitions") == "4"
