"""Queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from loomgraph.llm import byte_bpe, chat_formatting, html_extraction, lm_scoring, mixing, nearest_neighbours, ngram_join, quality_rules, sentencepiece_codec, toxicity, vector_codes, warc, whitening

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_nearest_neighbours": nearest_neighbours.query,
    "op3_chat_formatting": chat_formatting.query,
    "op4_ngram_join": ngram_join.query,
    "op5_quality_rules": quality_rules.query,
    "op6_sentencepiece": sentencepiece_codec.query,
    "op7_mixing": mixing.query,
    "op8_warc": warc.query,
    "op9_html_extraction": html_extraction.query,
    "op10_lm_scoring": lm_scoring.query,
    "op11_vector_codes": vector_codes.query,
    "op12_whitening": whitening.query,
    "op13_byte_bpe": byte_bpe.query,
}

ORACLES = {
    "op3_chat_formatting": chat_formatting.SQL,
    "op7_mixing": mixing.SQL,
}
