"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from chromaloom.llm import bpe, chat, decontaminate, exact_dedup, jaccard_join, language_id, licenses, pii, quality, sharding

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_quality": quality.op2_quality,
    "op3_bpe": bpe.op3_bpe,
    "op4_licenses": licenses.op4_licenses,
    "op5_sharding": sharding.op5_sharding,
    "op6_pii": pii.op6_pii,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_chat_format": chat.op8_chat_format,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}
ORACLES = {
    "op4_licenses": licenses.OP4_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_jaccard_join": jaccard_join.OP10_SQL,
}
