"""Queries over whole tables, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, chat, html_text, langid, mixing, packing, periodic, pieces, quality, simhash, tokens, toxicity, trie

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_simhash": simhash.op3_simhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat_format": chat.op5_chat_format,
    "op6_vp_trees": ann.op6_vp_trees,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_language_id": langid.op9_language_id,
    "op10_html_text": html_text.op10_html_text,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_packing": packing.op12_packing,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

#: The others learn, sample or use hashes and tokenizers that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op6_vp_trees": ann.OP6_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
}
