"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from folioscan.llm import byte_bpe, embedding_dedup, exact_dedup, filter_audit, html_text, minhash_dedup, mixing, prefix_trie, sharding, substring_dedup, token_counts, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_mixing": mixing.query,
        "op2_embedding_dedup": embedding_dedup.query,
        "op3_token_counts": token_counts.query,
        "op4_toxicity": toxicity.query,
        "op5_byte_bpe": byte_bpe.query,
        "op6_minhash_dedup": minhash_dedup.query,
        "op7_url_filter": url_filter.query,
        "op8_substring_dedup": substring_dedup.query,
        "op9_exact_dedup": exact_dedup.query,
        "op10_sharding": sharding.query,
        "op11_prefix_trie": prefix_trie.query,
        "op12_html_text": html_text.query,
        "op13_filter_audit": filter_audit.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": embedding_dedup.SQL, "op6_minhash_dedup": minhash_dedup.SQL, "op7_url_filter": url_filter.sql(), "op8_substring_dedup": substring_dedup.SQL, "op9_exact_dedup": exact_dedup.SQL, "op11_prefix_trie": prefix_trie.SQL, "op13_filter_audit": filter_audit.SQL}
