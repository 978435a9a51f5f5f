"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept, written as Parquet and
read again, and returns documents; the last returns the pieces of sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontamination, neardup, packing, toxicity
from evidentia.llm.common import dropped, table, written
from evidentia.scratch import made, since

TOXIC = 0.7
SEQUENCE, END_ID = 4096, 2


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; the model learns from the labels of documents at hand.

    Without labels of both classes nothing can be told apart: all documents stay, with a RuntimeWarning.
    """
    model = toxicity.fit(*toxicity.training_sample(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return named_alike(toxicity.toxicity(docs, model, tuple(docs.columns)).where(F.col("score") < TOXIC), docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), that with the smallest doc_id.

    Each row is judged by its own text, also where rows share a doc_id. Rows of a group's
    smallest doc_id are one document and all kept; so are rows whose doc_id is null.
    """
    numbered, _ = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    groups = neardup.near_duplicates(numbered.select("row.doc_id", "row.text", "number"), size=5, percent=80, number="number")
    dropped_rows = groups.where(~F.col("kept")).select("number").hint("merge")  # grows with the documents, so it is never broadcast
    return numbered.join(dropped_rows, "number", "left_anti").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return named_alike(found.where(~F.col("contaminated")), docs)


def named_alike(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The first columns of kept, which are all those of docs, under their names in docs."""
    return kept.select(*[F.col(f"`{now}`").alias(name) for now, name in zip(kept.columns, docs.columns)])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of SEQUENCE tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, END_ID)
    return packing.pack(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), SEQUENCE)


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("decontamination", without_benchmark), ("packing", packed)]

#: Neither the model nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of sequences of all documents that the stages keep. What a stage wrote for itself goes once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        mark = made()
        docs, path = written(stage(spark, docs, sf_dir), name, "snappy")
        dropped(spark, *before, *[p for p in since(mark) if p != path])
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
