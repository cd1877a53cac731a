"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lodestone.llm import chat_format, decontaminate, langid, lm_score, ngram_join, packing, sharding, topk, toxicity, url_filter

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_top_k": topk.op3_top_k,
    "op4_language_id": langid.op4_language_id,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_sharding": sharding.op9_sharding,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op2_ngram_join": ngram_join.ORACLE_SQL,
    "op3_top_k": topk.ORACLE_SQL,
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op7_lm_score": lm_score.ORACLE_SQL,
}
