"""The operators' queries and oracles."""

from __future__ import annotations

from ventura.llm import bpe, chat_formatting, exact_dedup, license_scan, line_dedup, ngram_jaccard, packing, period_runs, quality_rules, source_divergence, token_counts, toxicity, url_filters


def queries() -> dict:
    return {
        "op1_chat_formatting": chat_formatting.op1_chat_formatting,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_packing": packing.op6_packing,
        "op7_bpe": bpe.op7_bpe,
        "op8_ngram_jaccard": ngram_jaccard.op8_ngram_jaccard,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_period_runs": period_runs.op11_period_runs,
        "op12_source_divergence": source_divergence.op12_source_divergence,
        "op13_url_filters": url_filters.op13_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat_formatting.ORACLE, "op2_exact_dedup": exact_dedup.ORACLE, "op12_source_divergence": source_divergence.ORACLE, "op13_url_filters": url_filters.ORACLE}
