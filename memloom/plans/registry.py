"""The registry of queries and the fixtures that they derive from the tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL in which a table is written as [name]."""
    used = sorted(set(re.findall(r"\[(\w+)\]", text)))
    return spark.sql(re.sub(r"\[(\w+)\]", r"{\1}", text), **{name: read(spark, sf_dir, name) for name in used})


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a query of (spark, sf_dir) and the SQL it is checked against, if SQL can express it."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return register


#: Outputs of labelled documents in the shapes that a model may give, by doc_id: no block, an unclosed one, right, wrong, several answers, one missing, one twice, two blocks.
OUTPUTS = """
SELECT doc_id AS id, source AS group_id, CAST(g AS STRING) AS gold, CASE WHEN doc_id % 8 IN (4, 5, 6) THEN 'multi' ELSE 'single' END AS kind,
  CASE doc_id % 8
    WHEN 0 THEN concat('label ', CAST(g AS STRING))
    WHEN 1 THEN concat('x ```text', chr(10), 'Answer: ', CAST(g AS STRING))
    WHEN 2 THEN concat('```text', chr(10), 'Answer: ', CAST(g AS STRING), chr(10), '```')
    WHEN 3 THEN concat('```text', chr(10), 'answer: The ', CAST(g + 1 AS STRING), '!', chr(10), '```')
    WHEN 4 THEN concat('```text', chr(10), 'A1: ', CAST(g AS STRING), chr(10), 'A2: ', CAST(g AS STRING), chr(10), 'A3: ', CAST(g AS STRING), chr(10), '```')
    WHEN 5 THEN concat('```text', chr(10), 'A1: ', CAST(g AS STRING), chr(10), 'A3: ', CAST(g AS STRING), ' and 9', chr(10), '```')
    WHEN 6 THEN concat('```text', chr(10), 'A1: x', chr(10), 'A2: ', CAST(g AS STRING), chr(10), 'A1: ', CAST(g AS STRING), chr(10), 'A3: the', chr(10), '```')
    ELSE concat('```text', chr(10), 'Answer: 7', chr(10), '``` then ```text', chr(10), 'Answer: a ', CAST(g AS STRING), '.', chr(10), '```') END AS output
FROM (SELECT d.doc_id, d.source, l.quality * 2 + l.toxic AS g FROM [documents] d JOIN [labels] l ON d.doc_id = l.doc_id) t
"""
