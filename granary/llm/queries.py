"""The queries of this subpackage, by name."""

from __future__ import annotations

from granary.llm import decontaminate, fingerprint, jaccard, lm, packing, prefixcount, quality, sharding, tokenfile, toxicity


def queries() -> dict:
    return {
        "op1_fingerprints": fingerprint.op1_fingerprints,
        "op2_quality": quality.op2_quality,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_token_counts": prefixcount.op4_token_counts,
        "op5_ngram_jaccard_join": jaccard.op5_ngram_jaccard_join,
        "op6_lm_scores": lm.op6_lm_scores,
        "op7_token_ids": tokenfile.op7_token_ids,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_sharding": sharding.op10_sharding
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_jaccard_join": jaccard.ORACLE_SQL, "op10_sharding": sharding.ORACLE_SQL}
