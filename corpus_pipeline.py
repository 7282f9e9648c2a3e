"""A corpus pipeline of five stages over ``documents``: language, toxicity, near duplicates, benchmark leaks, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``, of the rows they keep.

Defined results, in every stage: rows are judged one by one, known by doc_id and text, so a null doc_id is an id like others
and an id may have several texts; null and empty texts are rejected by the first stage; repeated rows are kept or rejected
alike, but for near duplicates, of which one row stays (the least doc_id, null the last; of equal ids the row with the least
key); further columns of ``documents`` pass through whatever their names are; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlog.llm import decontaminate, language, near_dup, packing, toxicity
from strandlog.llm.common import BROADCAST_ROWS, Scratch, by_row, fresh, read_table, row_key, without_rows

#: A document is rejected if its language can't be told, or is told with less than this score.
LEAST_LANGUAGE_SCORE = 0.3
#: A document is rejected from this toxicity on.
TOXIC = 0.7


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told; rows without text or letters go."""
    model = language.learn(docs)
    name, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    told = language.identify(docs, model, (name, score))
    return told.where((F.col(name) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that score below TOXIC, by the labels of ``labels``."""
    scores = toxicity.row_scores(docs, read_table(spark, sf_dir, "labels"))
    return without_rows(docs, scores.where(F.col("score") >= TOXIC))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies (five words, 0.8): the one with the least doc_id (null is the last), once.

    Rows are compared, not ids: of an id with several texts, and of the rows without an id, only the copies go.
    """
    scratch = Scratch(spark)
    found = scratch.cut(near_dup.near_duplicates(by_row(docs)).select(F.col("doc_id").alias("row"), "component_id"), "components-of-rows")
    group = found.where("row <> component_id").distinct()
    group = scratch.cut(group.unionByName(group.select(F.col("component_id").alias("row"), "component_id").distinct()), "groups")
    side = F.broadcast(group) if group.count() <= BROADCAST_ROWS else group
    named = docs.select("doc_id", row_key().alias("row")).join(side, "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    kept = scratch.cut(named.groupBy("component_id").agg(first.alias("row")), "kept-rows")
    gone = scratch.cut(group.join(kept, "row", "left_anti").select("row"), "gone-rows")
    again = found.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row")
    again = scratch.cut(again.join(gone, "row", "left_anti"), "repeated-rows")
    if again.isEmpty():
        return without_rows(docs, gone)
    once = docs.withColumn("row_once", row_key()).join(again.select(F.col("row").alias("row_once")), "row_once", "left_semi").dropDuplicates(["row_once"])
    return without_rows(docs, gone.unionByName(again)).unionByName(once.select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that hold no item of ``benchmark``."""
    found = decontaminate.leaks(by_row(docs), read_table(spark, sf_dir, "benchmark"))
    return without_rows(docs, found.select(F.col("doc_id").alias("row")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, by window."""
    return packing.with_checksums(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned models and similarity sketches have no SQL; the stages are tested against brute force and held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark), read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else scratch.cut(out, name)
    return docs
