"""The queries of this subpackage, by name; each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from stridegraph.llm import base_queries, classifier, fingerprints, html_extract, lm, mixing, ngram_join, packing, pii, quality_rules, suffix_dedup
from stridegraph.llm.common import table


def op1_quality_rules(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classifier.scored(docs, classifier.fitted(docs, table(spark, sf_dir, "labels")))


def op7_html_extract(spark, sf_dir):
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op8_lm_scores(spark, sf_dir):
    return lm.scored(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.digests(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark, sf_dir):
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_ngram_join, op3_best_fit_packing, op4_mix_sources, op5_suffix_dedup, op6_quality_classifier, op7_html_extract, op8_lm_scores, op9_pii, op10_fingerprints)} | base_queries.QUERIES
ORACLES: dict[str, str] = {"op4_mix_sources": mixing.MIX_SQL} | base_queries.ORACLES
