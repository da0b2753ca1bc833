"""Registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.llm import curriculum, decontamination, imatch, interactions, pieces, pseudo_likelihood, sharding, simhash, suffixes, surrogates, templates, toxicity, whitening
from evenhand.llm.common import table


def op1_karmarkar_karp_shards(spark, sf_dir):
    found = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_keyed_surrogates(spark, sf_dir):
    return surrogates.replace_entities(table(spark, sf_dir, "documents"))


def op3_simhash_anchor_covering(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_masked_pseudo_likelihood(spark, sf_dir):
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op5_toxicity_chain(spark, sf_dir):
    labels = toxicity.labels_of(table(spark, sf_dir, "labels"))
    return toxicity.toxicity(table(spark, sf_dir, "documents"), labels)


def op6_difference_cover_repeats(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


def op7_imatch_fingerprints(spark, sf_dir):
    return imatch.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op8_curriculum_mix(spark, sf_dir):
    found = curriculum.mix(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        "taken",
        F.round("position", 9).alias("position"),
    )


def op9_template_line_dedup(spark, sf_dir):
    return templates.drop_template_lines(table(spark, sf_dir, "documents"))


def op10_wu_manber_decontamination(spark, sf_dir):
    found = decontamination.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op11_backtracking_pieces(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digest(pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model))


def op12_posting_list_audit(spark, sf_dir):
    return interactions.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spectrum_slicing(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_karmarkar_karp_shards,
        op2_keyed_surrogates,
        op3_simhash_anchor_covering,
        op4_masked_pseudo_likelihood,
        op5_toxicity_chain,
        op6_difference_cover_repeats,
        op7_imatch_fingerprints,
        op8_curriculum_mix,
        op9_template_line_dedup,
        op10_wu_manber_decontamination,
        op11_backtracking_pieces,
        op12_posting_list_audit,
        op13_spectrum_slicing,
    )
}
ORACLES = {
    "op8_curriculum_mix": curriculum.ORACLE,
    "op10_wu_manber_decontamination": decontamination.sql_twin(),
    "op12_posting_list_audit": interactions.ORACLE,
}
