"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from quarry.llm import (bpe, decontam, divergence, html_extract, jaccard, langid, license_scan,
                        quality_rules, simhash, suffix_dedup, token_alignment, token_counts, warc)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
    "op3_benchmark_decontamination": decontam.op3_benchmark_decontamination,
    "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
    "op5_warc": warc.op5_warc,
    "op6_html_extraction": html_extract.op6_html_extraction,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_bpe": bpe.op8_bpe,
    "op9_language_id": langid.op9_language_id,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_simhash": simhash.op11_simhash,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_source_divergence": divergence.op13_source_divergence,
}

SQL: dict[str, str] = {
    "op3_benchmark_decontamination": decontam.OP3_SQL,
    "op5_warc": warc.OP5_SQL,
    "op10_license_scan": license_scan.OP10_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
