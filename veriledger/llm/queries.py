"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from veriledger.llm import (conversation_repair, decontaminate, language_id, line_dedup, near_duplicates, personal_data, sentencepiece_codec,
                            suffix_dedup, toxicity_neighbours, url_aliases, warc_archive, weighted_fingerprints, whitening)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_redirect_equivalence(spark, sf_dir):
    return url_aliases.judge(_table(spark, sf_dir, "pages"))


def op2_prefix_interval_dedup(spark, sf_dir):
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op3_toxicity_neighbours(spark, sf_dir):
    return toxicity_neighbours.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_offset_preserving_pii(spark, sf_dir):
    return personal_data.digest(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_cuckoo_line_dedup(spark, sf_dir):
    return line_dedup.dedup(_table(spark, sf_dir, "documents"))


def op7_language_bitmask_filters(spark, sf_dir):
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op8_sentencepiece_backend(spark, sf_dir):
    return sentencepiece_codec.digest(_table(spark, sf_dir, "documents"))


def op9_consistent_weighted_sampling(spark, sf_dir):
    return weighted_fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op10_lsh_forest(spark, sf_dir):
    return near_duplicates.groups(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(conversation_repair.damage(_table(spark, sf_dir, "conversations")))


def op12_legacy_archives(spark, sf_dir):
    return warc_archive.round_trip(_table(spark, sf_dir, "pages"))


def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_redirect_equivalence, op2_prefix_interval_dedup, op3_toxicity_neighbours,
                                   op4_offset_preserving_pii, op5_benchmark_decontamination,
                                   op6_cuckoo_line_dedup, op7_language_bitmask_filters, op8_sentencepiece_backend,
                                   op9_consistent_weighted_sampling, op10_lsh_forest, op11_conversation_repair,
                                   op12_legacy_archives, op13_embedding_whitening)}
