"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from plumbline.llm import conversations, decontaminate, exact_dedup, html_text, jaccard_join, lang_id, line_dedup, packing, substring_dedup, token_output, url_filter, warc, whitening

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_suffix_array_dedup": substring_dedup.query,
    "op4_decontamination": decontaminate.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_html_extraction": html_text.query,
    "op7_url_filter": url_filter.query,
    "op8_language_id": lang_id.query,
    "op9_token_output": token_output.query,
    "op10_substring_dedup": line_dedup.query,
    "op11_warc": warc.query,
    "op12_conversation_repair": conversations.query,
    "op13_embedding_whitening": whitening.query,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op4_decontamination": decontaminate.SQL,
    "op10_substring_dedup": line_dedup.SQL,
    "op11_warc": warc.SQL,
}
