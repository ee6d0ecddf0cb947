"""Queries of the text operators and the SQL that some of them equal."""

from __future__ import annotations

from tallyforge.llm import (ann_forest, bpe, chat_format, decontaminate, language_id, ngram_join, prefix_trie, quality_rules, reshard,
                            structure_repair, substring_dedup, token_file, warc_index)


def queries() -> dict:
    return {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_language_id": language_id.op2_language_id,
        "op3_bpe": bpe.op3_bpe,
        "op4_token_file": token_file.op4_token_file,
        "op5_ann_forest": ann_forest.op5_ann_forest,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_reshard": reshard.op8_reshard,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_warc": warc_index.op10_warc,
        "op11_structure_repair": structure_repair.op11_structure_repair,
        "op12_quality_rules": quality_rules.op12_quality_rules,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat_format.ORACLE,
        "op6_ngram_join": ngram_join.ORACLE,
        "op7_decontaminate": decontaminate.ORACLE,
        "op9_substring_dedup": substring_dedup.ORACLE,
        "op10_warc": warc_index.ORACLE,
        "op11_structure_repair": structure_repair.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
