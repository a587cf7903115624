"""Queries of this subpackage by name, and SQL where it can express them."""

from __future__ import annotations

from meterline.llm import op1_substrings, op2_token_counts, op3_secrets, op4_token_files, op5_bpe, op6_quality, op7_decontaminate, op8_minhash, op9_toxicity, op10_ann, op11_class_lm, op12_vector_codes, op13_spelling

QUERIES = {
    "op1_substrings": op1_substrings.query,
    "op2_token_counts": op2_token_counts.query,
    "op3_secrets": op3_secrets.query,
    "op4_token_files": op4_token_files.query,
    "op5_bpe": op5_bpe.query,
    "op6_quality": op6_quality.query,
    "op7_decontaminate": op7_decontaminate.query,
    "op8_minhash": op8_minhash.query,
    "op9_toxicity": op9_toxicity.query,
    "op10_ann": op10_ann.query,
    "op11_class_lm": op11_class_lm.query,
    "op12_vector_codes": op12_vector_codes.query,
    "op13_spelling": op13_spelling.query,
}
SQL = {
    "op1_substrings": op1_substrings.SQL,
    "op8_minhash": op8_minhash.SQL,
    "op12_vector_codes": op12_vector_codes.SQL,
    "op13_spelling": op13_spelling.SQL,
}
