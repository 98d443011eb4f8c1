"""The PPM model keeps every context, at any size of the corpus."""

from tests.llm.test_operators import brute_ppm


def test_rare_contexts_stay_in_the_model(spark, monkeypatch):
    import zlib

    from lociframe.llm import ppm

    monkeypatch.setattr(ppm, "CHUNK_BYTES", 100_000)
    docs = [(i, "aaaaaaaaab " * 9000) for i in range(20)] + [(100, "zyx")]
    train = [t.encode() for d, t in docs if zlib.crc32(str(d).encode()) % 10]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in ppm.lm_scores(df, order=3).collect()}
    # one occurrence in more than a million bytes
    assert b"zyx" in train and sum(map(len, train)) > 1_000_000
    assert abs(got[100] - brute_ppm(train, b"zyx", 3)) < 1e-3


def test_slices_and_packing_of_grams():
    import numpy as np

    from lociframe.llm.ppm import coded, packed, unpacked

    rows = [b"abcabcabc" * 5, None, b"", b"\0Q\0" * 9, b"xyz"]

    def flat(most):
        got = [(int(c), int(r)) for cs, rs in coded(rows, 4, most) for c, r in zip(cs, rs)]
        return got

    assert flat(10 ** 6) == flat(3) == flat(1)
    assert len(flat(7)) == sum(len(t or b"") + 1 for t in rows)
    code = np.unique(np.array([c for c, _ in flat(50)], np.uint64))
    assert (unpacked(packed(code), len(code), np.uint64) == code).all()
    p = np.linspace(-3.0, 0.0, 99)
    assert (unpacked(packed(p), 99, np.float64) == p).all()
    assert len(unpacked(packed(code[:0]), 0, np.uint64)) == 0
