"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import bpe, chat, decontaminate, embeddings, line_dedup, sharding, simhash, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_embeddings": embeddings.op6_embeddings,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_suffix_array": suffix_dedup.op9_suffix_array,
    "op10_sharding": sharding.op10_sharding,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op6_embeddings": embeddings.OP6_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op9_suffix_array": suffix_dedup.OP9_SQL,
}
