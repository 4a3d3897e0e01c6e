"""The corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents its predecessor kept
and returns the columns of ``documents``; the last adds each document's place in the
mixture. Between stages the documents are written as Parquet to the shared checkpoint
folder and read again, so a lost executor costs a stage's task, not the pipeline.

Null texts and ids, empty texts, repeated rows and empty tables pass through the stages as
their operators say. ``documents`` may have further columns of any name, those of the
operators' own results too: every stage gives them back as they were. Only in the last
stage's result is a column named like an added one called ``<name>_given``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dbpulse.llm import decontaminate, mixing, near_copies, suffix_dedup, toxicity
from dbpulse.llm.common import held_out, put_back, shared_folder, table
from dbpulse.llm.queries import BLOCK_CHARS, WEIGHTS

TOXIC_FROM = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC_FROM``; the model learns from the training rows of labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter(~held_out("doc_id", 5, 0))
    model = toxicity.fit(docs, labels)
    kept = toxicity.score(docs, model).filter(F.col("score") < TOXIC_FROM)
    return put_back(kept, docs.columns, *toxicity.ADDED)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest id.

    SimHash links close copies through its index; all links, those that it leaves to be
    completed too, are exact: a Jaccard similarity of five-word shingles of 0.8 or more.
    """
    return near_copies.keep_one_per_group(docs, shingle=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 50-byte passages that an earlier document has.

    A character of which a cut leaves only some bytes goes too; ``n_chars`` is counted anew.
    """
    found = suffix_dedup.repeated_passages(docs, length=50, texts=True)
    changed = F.col("n_removed") > 0
    kept = found.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return put_back(kept, docs.columns, *suffix_dedup.ADDED)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture of sources."""
    return mixing.schedule(docs, WEIGHTS, 1, BLOCK_CHARS)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing_to_weights", mix_sources),
]

#: no stage but the last two can be said in SQL; tests hold the rest against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}/{name}"
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs
