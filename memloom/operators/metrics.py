"""From model outputs to scores of items, groups and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.extract import extracted
from memloom.functions.judge import auxiliary
from memloom.functions.text import let


def score(outputs: DataFrame) -> DataFrame:
    """Records with items of outputs (id, group_id, kind single or multi, golds array<array<string>>, output); an answer that is missing counts as empty."""
    n = F.size("golds")
    found = F.when(F.col("kind") == "single", extracted(F.col("output"), "single", n)).otherwise(extracted(F.col("output"), "multi", n))

    def judged(golds: Column, i: Column, pred: Column) -> Column:
        return let(auxiliary(golds, pred), lambda aux: F.struct(i.alias("item"), golds.alias("golds"), pred.alias("pred"), aux["em"].cast("double").alias("correct"), aux["rule"].alias("correct_rule"), aux["em"].alias("correct_em"), aux["f1"].alias("f1")))

    def item(golds: Column, i: Column) -> Column:
        return let(F.coalesce(F.try_element_at(F.col("x.answers"), i + 1), F.lit("")), lambda pred: judged(golds, i, pred))

    # The array of one struct is exploded so that what is found isn't computed again for every column that uses it.
    return outputs.select("*", F.explode(F.array(found)).alias("x")).select("id", "group_id", F.size("golds").alias("n_questions"), F.col("x.n_found").alias("n_found"), F.col("x.has_block").alias("has_block"), F.coalesce(F.col("x.format_ok"), F.lit(False)).alias("format_ok"), F.transform("golds", item).alias("items"))


def _share(total: Column, n: Column) -> Column:
    return F.round(F.when(n > 0, total / n).otherwise(F.lit(0.0)), 6)


def item_metrics(records: DataFrame) -> DataFrame:
    """One row: items, and the means of their scores; a missing score counts as 0."""
    items = records.select(F.explode("items").alias("i")).select("i.*")
    mean = lambda c: _share(F.sum(F.coalesce(c.cast("double"), F.lit(0.0))), F.count("*"))
    return items.agg(F.count("*").alias("n_items"), mean(F.col("correct")).alias("item_acc"), mean(F.col("correct_rule")).alias("item_acc_rule"), mean(F.col("correct_em")).alias("item_acc_em"), mean(F.col("f1")).alias("item_f1"))


def _right(strict: bool) -> Column:
    return F.forall("items", lambda i: i["correct"] >= 1.0 if strict else i["correct"] != 0.0)


def group_accuracy(records: DataFrame, strict: bool = False) -> DataFrame:
    """One row: groups, and the share of those whose records are all well formed and whose items all score (fully, if strict)."""
    groups = records.groupBy("group_id").agg(F.bool_and(F.col("format_ok") & _right(strict)).alias("ok"))
    return groups.agg(F.count("*").alias("n_groups"), _share(F.sum(F.col("ok").cast("double")), F.count("*")).alias("group_acc"))


def format_rates(records: DataFrame) -> DataFrame:
    mean = lambda c: _share(F.sum(F.col(c).cast("double")), F.count("*"))
    return records.agg(F.count("*").alias("n_records"), mean("format_ok").alias("format_ok_rate"), mean("has_block").alias("has_block_rate"))


def rewards(records: DataFrame) -> DataFrame:
    """Accuracy, half a point for all right, half off for a wrong number of answers; -0.5 without an answer."""
    n = F.col("n_questions")
    total = F.aggregate("items", F.lit(0.0), lambda acc, i: acc + i["correct"])
    value = total / n + F.when(_right(True), 0.5).otherwise(0.0) - F.when(F.col("n_found") != n, 0.5).otherwise(0.0)
    return records.select("id", F.round(F.when(~F.col("has_block") | (F.col("n_found") == 0), F.lit(-0.5)).otherwise(value), 6).alias("reward"))


def informative_groups(samples: DataFrame, group: str, metric: str) -> DataFrame:
    """Rows of groups whose metric varies; a group with a missing or infinite one goes."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    finite = F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) != float("inf"))
    return samples.withColumns({"_all": F.bool_and(finite).over(w), "_lo": F.min(metric).over(w), "_hi": F.max(metric).over(w)}).where("_all and _lo < _hi").drop("_all", "_lo", "_hi")
