"""Validators: rules are columns, so that a table is checked in one pass and nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: how many rows break each rule."""
    return rows.agg(*(F.count_if(broken).alias(name) for name, broken in rules.items()))


def first(rows: DataFrame, order: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(row_idx, rule) of the first row in order that breaks a rule, with the first rule it breaks; nulls if none does."""
    broken = F.coalesce(*(F.when(test, F.lit(name)) for name, test in rules))
    found = rows.select(F.struct(F.col(order).alias("row_idx"), broken.alias("rule")).alias("x")).where("x.rule is not null")
    return found.agg(F.min("x").alias("x")).select("x.row_idx", "x.rule")


def pool_verdict(text: Column, label: Column, labels: Sequence[int]) -> Column:
    """What is wrong with a row of a classification pool: `text`, `label` or `ok`."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "text").when(~label.isin(*labels), "label").otherwise("ok")


def equal_lengths(rows: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, n, equal) whether the arrays of each group are of one length, as collation without padding wants."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), (F.min(F.size(ids)) == F.max(F.size(ids))).alias("equal"))
