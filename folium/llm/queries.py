"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from folium.llm import embeddings, fingerprints, lm, mixing, neardup, negatives, packing, pii, repeats, sharding, spelling, tokencounts, toxicity

QUERIES = {
    "op1_embeddings": embeddings.op1_embeddings,
    "op2_mixing": mixing.op2_mixing,
    "op3_lm_score": lm.op3_lm_score,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_neardup": neardup.op6_neardup,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_pii": pii.op8_pii,
    "op9_token_counts": tokencounts.op9_token_counts,
    "op10_sharding": sharding.op10_sharding,
    "op11_negatives": negatives.op11_negatives,
    "op12_spelling": spelling.op12_spelling,
    "op13_repeats": repeats.op13_repeats,
}

SQL = {
    "op1_embeddings": embeddings.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op8_pii": pii.OP8_SQL,
    "op11_negatives": negatives.OP11_SQL,
    "op13_repeats": repeats.OP13_SQL,
}
