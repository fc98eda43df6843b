"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes every
stage as Parquet in the shared checkpoint folder and reads it again as the next one's documents.

Documents with a null or empty text, or a null id, pass every stage and have no tokens; very long texts are taken
whole; repeated rows and ties are as each stage says. An empty table gives an empty one. Columns beyond those of
``documents`` go along up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathquill.llm import bpe_codec, decontamination, minhash_dedup, suffix_dedup, toxicity
from pathquill.llm.common import checkpoint_dir, drop_table, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, does not reject.

    Equal texts have equal scores, so repeated rows stay or go together; a score of just the threshold goes.
    """
    model = toxicity.fit(docs, toxicity.training_labels(spark, sf_dir))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id; rows that share that id all stay."""
    return minhash_dedup.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes or more that occur more than once.

    Repeated rows repeat each other, so nothing but what is too short for such a string is left of them. ``n_chars``
    is counted anew where there is such a column.
    """
    out = suffix_dedup.cleaned(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; equal texts stay or go together, and an empty benchmark keeps all."""
    return decontamination.drop_contaminated_words(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text they decode to; a row for each row."""
    import public_tokenizers

    return bpe_codec.codec_digests(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: No stage but the fourth can be said in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}_{name}")
        docs = spark.read.parquet(f"{place}/{k}_{name}")
        if k:
            drop_table(spark, f"{place}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
