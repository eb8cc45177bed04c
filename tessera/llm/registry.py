"""Queries and oracle SQL of this subpackage, by the names that `__spark_entry__` registers."""

from __future__ import annotations

from tessera.llm import op1_toxicity, op2_decontaminate, op3_quality, op4_licenses, op5_substrings, op6_urls, op7_mixing, op8_simhash, op9_lines, op10_exact

QUERIES = {
    "op1_toxicity": op1_toxicity.op1_toxicity,
    "op2_decontaminate": op2_decontaminate.op2_decontaminate,
    "op3_quality": op3_quality.op3_quality,
    "op4_licenses": op4_licenses.op4_licenses,
    "op5_substrings": op5_substrings.op5_substrings,
    "op6_url_filters": op6_urls.op6_url_filters,
    "op7_mixing": op7_mixing.op7_mixing,
    "op8_simhash": op8_simhash.op8_simhash,
    "op9_lines": op9_lines.op9_lines,
    "op10_exact_dedup": op10_exact.op10_exact_dedup,
}

ORACLES = {
    "op4_licenses": op4_licenses.ORACLE,
    "op6_url_filters": op6_urls.ORACLE,
    "op7_mixing": op7_mixing.ORACLE,
    "op9_lines": op9_lines.ORACLE,
    "op10_exact_dedup": op10_exact.ORACLE,
}
