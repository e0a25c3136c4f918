"""The queries of this subpackage and the SQL of those that DuckDB can state."""

from gridloom.llm import decontaminate, divergence, embedding_dedup, language_id, line_dedup, merkle, mixing, pii, quality, sharding, simhash_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_kd_sharding": sharding.op2_kd_sharding,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_find_pii": pii.op4_find_pii,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
        "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_language_id": language_id.op9_language_id,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_quality": quality.op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": decontaminate.OP3_SQL,
        "op7_embedding_dedup": embedding_dedup.OP7_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op11_merkle_manifest": merkle.OP11_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
    }
