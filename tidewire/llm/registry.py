"""The registered queries of this package and the SQL that some of them are compared with."""

from __future__ import annotations

from . import bpe, chat_format, embedding_dedup, merkle, minhash_dedup, mixing, nearest, packing, prefix_trie, quality, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_mixing": mixing.query,
    "op3_toxicity": toxicity.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_embedding_dedup": embedding_dedup.query,
    "op6_nearest": nearest.query,
    "op7_packing": packing.query,
    "op8_quality": quality.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_minhash_dedup": minhash_dedup.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_merkle": merkle.query,
    "op13_bpe": bpe.query,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op5_embedding_dedup": embedding_dedup.ORACLE,
    "op10_minhash_dedup": minhash_dedup.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_merkle": merkle.ORACLE,
}
