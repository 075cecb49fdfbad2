"""The queries of this subpackage and, where SQL can state them, the same results in DuckDB's SQL."""

from facetry.llm import minhash, packing, phrases, pii, quality, scoring, sharding, suffixes, tokens, topk, vectors, warc, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_packing": packing.op2_packing,
    "op3_sharding": sharding.op3_sharding,
    "op4_scoring": scoring.op4_scoring,
    "op5_pii": pii.op5_pii,
    "op6_bpe": tokens.op6_bpe,
    "op7_suffixes": suffixes.op7_suffixes,
    "op8_top_k": topk.op8_top_k,
    "op9_near_duplicates": minhash.op9_near_duplicates,
    "op10_quality": quality.op10_quality,
    "op11_near_vectors": vectors.op11_near_vectors,
    "op12_whitening": whitening.op12_whitening,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op8_top_k": topk.OP8_SQL,
    "op9_near_duplicates": minhash.OP9_SQL,
    "op11_near_vectors": vectors.OP11_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
