"""Registry of the corpus queries and of their SQL, where SQL can express them."""

from __future__ import annotations

from tidelane.llm.bpe import op8_bpe
from tidelane.llm.conversation_trie import OP13_SQL, op13_conversation_trie
from tidelane.llm.decontaminate import OP4_SQL, op4_decontaminate
from tidelane.llm.importance_resampling import OP12_SQL, op12_importance_resampling
from tidelane.llm.language_id import op6_language_id
from tidelane.llm.license_scan import OP2_SQL, op2_license_scan
from tidelane.llm.minhash import OP3_SQL, op3_near_dedup
from tidelane.llm.quality_classifier import op7_quality
from tidelane.llm.quality_rules import op10_quality_rules
from tidelane.llm.suffix_dedup import op5_suffix_dedup
from tidelane.llm.suffix_tree_lm import op9_lm_score
from tidelane.llm.token_counts import op11_token_counts
from tidelane.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_license_scan": op2_license_scan,
    "op3_near_dedup": op3_near_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_lm_score": op9_lm_score,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_counts": op11_token_counts,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op2_license_scan": OP2_SQL,
    "op3_near_dedup": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_conversation_trie": OP13_SQL,
}
