"""Queries and SQL of this subpackage."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, chat, conversations, decontamination, exact_dedup, mixing, near_dedup, secrets, substring_dedup, toxicity, url_filter, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_secrets": secrets.op2_secrets,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat": chat.op5_chat,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_nearest": ann.op9_nearest,
    "op10_bpe": bpe.op10_bpe,
    "op11_whitening": whitening.op11_whitening,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_decontamination": decontamination.op13_decontamination,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_mixing": mixing.SQL,
    "op2_secrets": secrets.SQL,
    "op3_url_filter": url_filter.SQL,
    "op5_chat": chat.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_decontamination": decontamination.SQL,
}
