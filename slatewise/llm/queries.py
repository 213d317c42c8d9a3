"""The registered queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import ann, collocations, language, licenses, mixing, packing, preference, quality_rules, secret_scan, simhash, suffix_dedup, toxicity, variants
from .common import stored, table


def op2_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op4_pack_windows(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op9_quality_ledger(spark, sf_dir):
    entries = stored(quality_rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    return quality_rules.verdicts(entries).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed",
        *[f"kept_{name}" for name in quality_rules.POLICIES], "sole_rule", "sole_rule_documents")


def op10_simhash_classes(spark, sf_dir):
    return simhash.classes(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op6_multiprobe_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % ann.QUERY_STEP == 0)


def op1_preference_pairs(spark, sf_dir):
    return preference.format_pairs(preference.neighbours(table(spark, sf_dir, "conversations")))


def op7_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


QUERIES = {
    "op1_preference_pairs": op1_preference_pairs,
    "op2_mix_sources": op2_mix_sources,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pack_windows": op4_pack_windows,
    "op5_secret_scan": op5_secret_scan,
    "op6_multiprobe_neighbours": op6_multiprobe_neighbours,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_quality_ledger": op9_quality_ledger,
    "op10_simhash_classes": op10_simhash_classes,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_collocations": op12_collocations,
    "op13_language_id": op13_language_id,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_preference_pairs": preference.ORACLE, "op7_license_scan": licenses.oracle(),
           "op12_collocations": collocations.ORACLE}
