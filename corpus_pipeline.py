"""The corpus pipeline: stages that each take the documents and return the documents they keep.

Toxic documents go, repeated lines go, one document of each group of near copies stays (five words,
similarity 0.8), documents that hold a benchmark passage go, and what is left is encoded to pieces.  Every
stage works on all rows its predecessor wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import decontaminate, jaccard_join, line_dedup, pieces, toxicity
from jobtide.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.apply(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", without_toxic), ("line_dedup", without_repeated_lines), ("jaccard_join", without_near_copies),
          ("decontamination", without_benchmark), ("sentencepiece", as_pieces)]

#: The stages learn a model and search a Viterbi path, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32, decoded_sha256 of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
