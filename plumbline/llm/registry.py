"""The text operators as queries, with the SQL that checks them where SQL can."""

from __future__ import annotations

import corpus_pipeline
from plumbline.llm import chat, contamination, embeddings, filters, hmm, jaccard, lines, middle, mixing, quality, secrets, tokens, warc


def queries():
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_contamination": contamination.op2_contamination,
        "op3_quality": quality.op3_quality,
        "op4_embeddings": embeddings.op4_embeddings,
        "op5_language_model": hmm.op5_language_model,
        "op6_tokens": tokens.op6_tokens,
        "op7_chat": chat.op7_chat,
        "op8_warc": warc.op8_warc,
        "op9_jaccard": jaccard.op9_jaccard,
        "op10_mixing": mixing.op10_mixing,
        "op11_filter_audit": filters.op11_filter_audit,
        "op12_line_dedup": lines.op12_line_dedup,
        "op13_fill_in_middle": middle.op13_fill_in_middle,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op2_contamination": contamination.SQL,
        "op4_embeddings": embeddings.SQL,
        "op8_warc": warc.SQL,
        "op9_jaccard": jaccard.SQL,
        "op10_mixing": mixing.SQL,
        "op11_filter_audit": filters.SQL,
        "op12_line_dedup": lines.SQL,
        "op13_fill_in_middle": middle.SQL,
    }
