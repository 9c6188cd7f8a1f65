"""The registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from recordloom.llm import chat, decontaminate, filter_audit, html_text, jaccard, language, licenses, pieces, prefix_trie, quality, secrets, token_counts, urls

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_license_scans": licenses.op4_license_scans,
    "op5_language_id": language.op5_language_id,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_url_filters": urls.op7_url_filters,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_filter_interaction_audit": filter_audit.op11_filter_interaction_audit,
    "op12_html_extraction": html_text.op12_html_extraction,
    "op13_conversation_prefix_trie": prefix_trie.op13_conversation_prefix_trie,
    "chat_attachments": chat.chat_attachments,
}
ORACLE_SQL = {
    "op2_chat_formatting": chat.ORACLE_SQL,
    "op3_quality_rules": quality.ORACLE_SQL,
    "op4_license_scans": licenses.ORACLE_SQL,
    "op7_url_filters": urls.ORACLE_SQL,
    "op8_ngram_jaccard_join": jaccard.ORACLE_SQL,
    "op9_secret_scans": secrets.ORACLE_SQL,
    "op10_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op11_filter_interaction_audit": filter_audit.ORACLE_SQL,
    "op12_html_extraction": html_text.ORACLE_SQL,
    "op13_conversation_prefix_trie": prefix_trie.ORACLE_SQL,
    "chat_attachments": chat.ATTACHMENTS_SQL,
}
