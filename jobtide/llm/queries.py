"""The operators' queries over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from jobtide.llm import (ann, byte_pairs, decontaminate, jaccard_join, line_dedup, lm_score, oracle, pieces,
                         resampling, sharding, substring_dedup, token_files, toxicity, vector_codes)
from jobtide.llm.common import table
from jobtide.session import scratch_path


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), whole_text=False) \
        .withColumnRenamed("kept", "kept_sha256")


def op2_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), map_path=scratch_path(spark, "slot-map"))


def op5_wavelet_token_files(spark, sf_dir):
    import public_tokenizers
    out = scratch_path(spark, "token-files")
    token_files.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return token_files.read_files(spark, out)


def op6_sentencepiece(spark, sf_dir):
    import public_tokenizers
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_cross_entropy_difference(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


def op8_winnowing_decontamination(spark, sf_dir):
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_toxicity_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels"))))


def op10_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op11_byte_pairs(spark, sf_dir):
    import public_tokenizers
    pairs = byte_pairs.BytePairs.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = byte_pairs.encode(table(spark, sf_dir, "documents"), pairs, with_ids=False).drop("ids")
    pairs.close()
    return out


def op12_importance_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_line_dedup, op3_jaccard_join,
                                     op4_sharding, op5_wavelet_token_files, op6_sentencepiece,
                                     op7_cross_entropy_difference, op8_winnowing_decontamination, op9_toxicity_crf,
                                     op10_nearest_neighbours, op11_byte_pairs, op12_importance_resampling,
                                     op13_vector_codes)}
ORACLE = oracle.ORACLE
