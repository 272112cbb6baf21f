"""Corpus pipeline: raw documents to packed training sequences.

Toxic documents go; repeated and near-repeated lines are cut out; of each group
of near-duplicate documents the one with the smallest id stays; documents that
hold benchmark passages go; what is left is packed. Each stage takes all that
the stage before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plan_alloc.llm import decontaminate, line_dedup, packing, simhash, toxicity
from plan_alloc.llm.common import keep, read
from plan_alloc.llm.queries import vocabulary

#: Columns that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and near-equal lines the first stays; every document keeps its row."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id stays.
    Rows without an id stay, and of rows that repeat the smallest id all do."""
    groups = simhash.link(docs, words=3, max_bits=3).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go. Rows that share an id (or have
    none) are told apart by their texts: only those that hold a window go."""
    leaks = decontaminate.judge(docs, read(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("leak"), "copy").distinct()
    # ``copy`` is zero where every id has one row, else a hash of the text.
    same = docs["doc_id"].eqNullSafe(F.col("leak")) & ((F.col("copy") == 0) | (F.col("copy") == F.xxhash64(docs["text"])))
    return docs.join(leaks, same, "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 token ids; a row with a
    null text is its end id, a null id stays null."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("simhash near-dedup", drop_copies), ("benchmark decontamination", drop_leaks), ("packing", pack)]

#: SQL has no words for the trained filter or the tokenizer; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
