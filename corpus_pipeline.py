"""A training-corpus pipeline of five stages, each over all documents that the one before kept.

A stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet in the shared folder and read again as
the next one's documents. Texts change in the third stage alone; null and empty texts pass through all of them and end without tokens.
Rows are judged by their own texts; a null id is in no group of copies and none of its passages is cut, of rows of one id one stays. Very long
texts are handled whole, columns beside those of documents are kept up to the last stage, and an empty table ends as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import bpe, decontaminate, neardup, substrings, toxicity
from memloom.llm.base import Run, table, written
from memloom.llm.learn import labelled

#: Words of a passage that is cut where it repeats a document of a smaller id.
PASSAGE_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, doesn't reject."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.reject(docs, toxicity.fit(*labelled(docs, labels, "toxic", toxicity.DIVISOR, toxicity.REST)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity of 0.8 or more."""
    return neardup.drop_duplicates(docs, width=5, percent=80).select(docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of PASSAGE_WORDS words and more that also start in a document of a smaller id."""
    return substrings.cut_repeats(docs, PASSAGE_WORDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark, within a fifth of its words in edits."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and lossless of the documents: the end of the pipeline."""
    return bpe.encode(docs, bpe.default_ranks())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_passages),
    ("benchmark_leaks", drop_leaks),
    ("byte_bpe", tokenize),
]

#: SQL can express neither the classifier nor the edit distance of leaks; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir, one after the other. What a stage has written goes when its result is."""
    docs = table(spark, sf_dir, "documents")
    with Run(spark) as run_:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
            run_.drop()
    return docs
