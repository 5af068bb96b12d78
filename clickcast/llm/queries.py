"""Registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from clickcast.llm import (collocations, fingerprints, hard_negatives, kneser_ney, lm, mixing, packing, quality_rules, secret_scan, simhash,
                           substring, toxicity, url_filter)
from clickcast.llm.common import table


def op1_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    return kneser_ney.quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark, sf_dir):
    return packing.pieces_digest(packing.pack(table(spark, sf_dir, "documents")))


def op6_substring_dedup(spark, sf_dir):
    return substring.digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_secret_scan(spark, sf_dir):
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    mined = hard_negatives.mine(table(spark, sf_dir, "embeddings"), anchors="vec_id % 100 = 0",
                                relabel="if(vec_id % 7 = 0, (label + 1) % 10, label)", positives=5, negatives=10, low=30, high=90)
    return mined.drop("anchor_row")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_secret_scan": op11_secret_scan,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}
