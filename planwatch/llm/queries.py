"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from planwatch.llm import mixing, phrases, prefix_trie, substrings
from planwatch.llm.bpe import op6_bpe_roundtrip
from planwatch.llm.fingerprint import op8_simhash_fingerprint
from planwatch.llm.language import op3_language_id
from planwatch.llm.language_model import op7_lm_score
from planwatch.llm.licences import op5_license_scan
from planwatch.llm.mixing import op2_source_mix
from planwatch.llm.near_dedup import op1_simhash_near_dedup
from planwatch.llm.phrases import op13_phrase_collocations
from planwatch.llm.prefix_trie import op11_prefix_trie
from planwatch.llm.quality_model import op9_quality_classifier
from planwatch.llm.quality_rules import op4_quality_rules
from planwatch.llm.secrets import op10_secret_scan
from planwatch.llm.substrings import op12_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_source_mix, op3_language_id, op4_quality_rules, op5_license_scan,
        op6_bpe_roundtrip, op7_lm_score, op8_simhash_fingerprint, op9_quality_classifier, op10_secret_scan,
        op11_prefix_trie, op12_substring_dedup, op13_phrase_collocations,
    )
}
ORACLE_SQL = {"op2_source_mix": mixing.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op12_substring_dedup": substrings.ORACLE, "op13_phrase_collocations": phrases.ORACLE}
