"""The corpus pipeline: toxicity, near duplicates, repeated passages, personal
data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of `documents`, with n_chars kept in step with the text.

* toxicity: documents that the classifier rejects go.  Null text scores as empty.
* near_duplicates: word 5-gram Jaccard of 0.8 or more; the smallest doc_id of a
  group stays.  Documents without words, or with a null doc_id, all stay.
* repeated_passages: bytes of 200-byte strings that occur elsewhere are cut out
  of the texts; the document stays, if need be with an empty text.
* personal_data: every span is replaced by its kind in brackets.
* packing: one row per piece, see the operator.

An empty table passes through every stage as an empty table.  Rows are told apart
by doc_id and text: rows that repeat both are one document and stay or go together;
different texts under one doc_id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm import op2_pii, op4_suffix, op8_packing, op9_toxicity, op10_ngram_join
from threadline.llm.common import fresh, materialize, table

TOXIC_FROM = 0.5
WORDS, SHARE = 5, 80


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op9_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "_toxicity")
    return op9_toxicity.score(docs, model, out=score).where(F.col(score) < TOXIC_FROM).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = fresh(docs, "_row")
    rows = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.struct(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))))
    groups = op10_ngram_join.join_sets(rows, id_col=key, words=WORDS, share=SHARE)
    copies = groups.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(key)).distinct()
    return rows.join(copies, key, "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(op4_suffix.remove(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(op2_pii.mask(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_packing.packing(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates),
          ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packing)]

ORACLE_SQL = None                # classifier, suffix array and packing are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
