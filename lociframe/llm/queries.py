"""Registered queries of the training-data operators, over whole tables."""

from lociframe.llm.bpe import op4_bpe_roundtrip
from lociframe.llm.capfilters import op6_cap_filter_near_dedup
from lociframe.llm.license import op2_license_scan
from lociframe.llm.packing import op10_harmonic_packing
from lociframe.llm.ppm import op3_ppm_scores
from lociframe.llm.quality import op1_quality_rules
from lociframe.llm.sharding import op8_vector_sharding
from lociframe.llm.simhash import op5_simhash_near_dedup
from lociframe.llm.suffix import op9_suffix_dedup
from lociframe.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_license_scan, op3_ppm_scores, op4_bpe_roundtrip, op5_simhash_near_dedup,
    op6_cap_filter_near_dedup, op7_toxicity, op8_vector_sharding, op9_suffix_dedup, op10_harmonic_packing)}

#: SQL where it can say the same. The others are tested against brute force (tests/llm).
ORACLE_SQL = {
    "op6_cap_filter_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        sound AS (
            SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
                AND len(list_filter(e, x -> x IS NULL OR isnan(x) OR isinf(x))) = 0
                AND len(list_filter(e, x -> x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
                ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
                AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(a, b) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
        FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN least ON least.a = v.vec_id""",
}
