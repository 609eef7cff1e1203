"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from cityloom.llm import chat, decontam, infill, jaccard, lines, media, mixing, resampling, suffixes, tokens, toxicity, warc, whitening
from cityloom.llm.store import table

QUERIES = {
    "op1_toxicity": lambda spark, d: toxicity.scored_documents(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_chat_format": lambda spark, d: chat.formatted_conversations(table(spark, d, "conversations")),
    "op3_importance_resampling": lambda spark, d: resampling.resampled(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_line_dedup": lambda spark, d: lines.line_report(table(spark, d, "documents")),
    "op5_warc": lambda spark, d: warc.page_archives(table(spark, d, "pages")),
    "op10_jaccard_join": lambda spark, d: jaccard.component_report(table(spark, d, "documents")),
    "op6_decontamination": lambda spark, d: decontam.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op7_mixing": lambda spark, d: mixing.mixture(table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_token_output": lambda spark, d: tokens.materialised(table(spark, d, "documents")),
    "op11_suffix_dedup": lambda spark, d: suffixes.suffix_report(table(spark, d, "documents")),
    "op12_infill": lambda spark, d: infill.infill_report(table(spark, d, "documents")),
    "op13_whitening": lambda spark, d: whitening.whitening_report(table(spark, d, "embeddings")),
    "op9_media": lambda spark, d: media.document_media(table(spark, d, "documents")),
}

ORACLES = {"op2_chat_format": chat.ORACLE, "op5_warc": warc.ORACLE, "op10_jaccard_join": jaccard.ORACLE, "op12_infill": infill.ORACLE}
