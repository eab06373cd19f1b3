"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import binary, bpe, ctw, language, leaks, media, merkle, negatives, quality, simhash, suffix, tokencount, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_binary_records": binary.op2_binary_records,
    "op3_media_columns": media.op3_media_columns,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_warc": warc.op5_warc,
    "op6_context_tree": ctw.op6_context_tree,
    "op7_suffix_dedup": suffix.op7_suffix_dedup,
    "op8_decontamination": leaks.op8_decontamination,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_token_counts": tokencount.op10_token_counts,
    "op11_language_id": language.op11_language_id,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_merkle": merkle.op13_merkle,
}

#: Queries that SQL can express over whole tables. The others are tested against brute force in tests/llm.
SQL = {"op5_warc": warc.SQL, "op7_suffix_dedup": suffix.SQL, "op12_hard_negatives": negatives.SQL, "op13_merkle": merkle.SQL}
