"""The registered query of every operator, and SQL where SQL can express it."""

from __future__ import annotations

from tradeweave.llm import (
    clusters,
    contamination,
    exact_dup,
    language,
    licences,
    mixing,
    near_dup,
    packing,
    runs,
    simple8b,
    toxicity,
    vectors,
    warc,
)

QUERIES = {
    "op1_minhash": near_dup.op1_minhash,
    "op2_language": language.op2_language,
    "op3_mix": mixing.op3_mix,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_token_files": simple8b.op6_token_files,
    "op7_exact_dedup": exact_dup.op7_exact_dedup,
    "op8_warc": warc.op8_warc,
    "op9_embeddings": vectors.op9_embeddings,
    "op10_licences": licences.op10_licences,
    "op11_contamination": contamination.op11_contamination,
    "op12_runs": runs.op12_runs,
    "op13_clusters": clusters.op13_clusters,
}

SQL = {
    "op3_mix": mixing.SQL,
    "op7_exact_dedup": exact_dup.SQL,
    "op8_warc": warc.SQL,
    "op11_contamination": contamination.SQL,
    "op13_clusters": clusters.SQL,
}
