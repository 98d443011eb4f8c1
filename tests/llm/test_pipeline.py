"""The corpus pipeline: stages keep columns, take effect, and drop no clean document."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from lociframe.llm.common import read
    from lociframe.session import table

    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(table(f(spark, out[-1], sf)))
    return out, read(spark, sf, "labels")


def test_stages(stages):
    (docs, toxic, good, single, cut, packed), labels = stages
    for df in (toxic, good, single, cut):
        assert df.columns == docs.columns
    gone = docs.join(toxic, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() <= 3
    assert good.join(labels, "doc_id").where("quality = 0").count() < toxic.join(labels, "doc_id").where("quality = 0").count()
    assert single.select("text").distinct().count() == single.count()
    assert cut.count() == single.count()
    assert cut.agg(F.sum(F.length("text"))).first()[0] < single.agg(F.sum(F.length("text"))).first()[0]
    assert packed.select("doc_id").distinct().count() == cut.count()


def test_near_dedup_stage_keeps_unlike_documents(stages):
    (_, _, good, single, _, _), _ = stages
    from lociframe.llm.simhash import fingerprint

    kept = {r.doc_id for r in single.select("doc_id").collect()}
    rows = {r.doc_id: r.text for r in good.select("doc_id", "text").collect()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))}

    own = {d: shingles(t) for d, t in rows.items()}
    for d in rows.keys() - kept:
        best = max(len(own[d] & own[k]) / len(own[d] | own[k]) for k in rows if k != d)
        assert best > 0.5, (d, best, fingerprint(rows[d].encode()))
    for a in kept:
        for b in kept:
            if a < b:
                assert len(own[a] & own[b]) < 0.9 * len(own[a] | own[b]), (a, b)


ODD = [(None, None, None, 1, None), (1, "", "en", 2, "a"), (1, "", "en", 2, "a"), (2, "one two", None, 3, "b"), (3, "word " * 30_000, "de", 4, "c"), (None, "déjà vu " * 40, "fr", 5, "d"),
       (4, " ".join(f"w{i}" for i in range(300)), "en", 6, "e"), (5, " ".join(f"w{i}" for i in range(300)), "en", 7, "f")]


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_tables_through_every_stage(spark, tmp_path, rows):
    """Null columns, empty and long texts, repeated rows, no rows, and columns with the operators' own names."""
    import corpus_pipeline

    spark.createDataFrame([(4, 1, 0), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(*r[:4], r[4], r[4], r[4]) for r in rows], "doc_id long, text string, lang string, n_chars long, __k string, id string, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert got.columns == docs.columns, name
        kept = got.collect()
        if not rows:
            assert kept == []
        elif name == "quality":
            assert all(r.doc_id in (4, 5) for r in kept)
        elif name == "near_dedup":
            # the null text and the empty ones are one group, so are the equal texts
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
        elif name in ("toxicity", "suffix_dedup"):
            assert len(kept) == len(rows)
        else:
            assert sum(r.length for r in kept if r.start == 0 and r.doc_tokens == 1) == 3
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ({4} if rows else set())
