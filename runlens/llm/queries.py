"""Registered queries of the subpackage (one per operator) and their DuckDB SQL."""

from __future__ import annotations

from runlens.llm import (
    alignment, ann, bpe, classifier, hmm, html_extract, jaccard, licenses, mixing, negatives, pii, quality_rules, suffix_dedup,
)
from runlens.llm.common import table

QUERIES = {
    "op1_quality_rules": lambda spark, d: quality_rules.report(table(spark, d, "documents")),
    "op2_suffix_dedup": lambda spark, d: suffix_dedup.report(table(spark, d, "documents")),
    "op3_hmm": lambda spark, d: hmm.report(table(spark, d, "documents")),
    "op4_pii": lambda spark, d: pii.report(table(spark, d, "documents")),
    "op5_bpe": lambda spark, d: bpe.report(table(spark, d, "documents")),
    "op6_html_extract": lambda spark, d: html_extract.report(table(spark, d, "pages")),
    "op7_mixing": lambda spark, d: mixing.report(table(spark, d, "documents")),
    "op8_jaccard": lambda spark, d: jaccard.join(table(spark, d, "documents")),
    "op9_ann": lambda spark, d: ann.report(table(spark, d, "embeddings")),
    "op10_classifier": lambda spark, d: classifier.report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op11_licenses": lambda spark, d: licenses.report(table(spark, d, "documents")),
    "op12_alignment": lambda spark, d: alignment.report(table(spark, d, "documents")),
    "op13_negatives": lambda spark, d: negatives.report(table(spark, d, "embeddings")),
}

ORACLE = {
    "op1_quality_rules": quality_rules.REPORT_SQL,
    "op8_jaccard": jaccard.JOIN_SQL,
    "op13_negatives": negatives.REPORT_SQL,
}
