"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, bpe, html, lm, merkle, mixing, oracle, phrases, pii, quality, rules, simhash, tokenbin, trie

QUERIES = {f.__name__: f for f in (tokenbin.op1_token_files, quality.op2_quality, html.op3_main_text, mixing.op4_mixing, lm.op5_kneser_ney, simhash.op6_simhash, bpe.op7_byte_bpe, rules.op8_quality_rules, ann.op9_permutation_index, pii.op10_personal_data, merkle.op11_merkle_manifest, phrases.op12_lz_fingerprint, trie.op13_conversation_trie)}

ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": oracle.MERKLE, "op13_conversation_trie": oracle.TRIE}
