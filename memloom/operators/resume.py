"""Append-only logs of outputs, joined with the requests they answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """(id, output) of a log (id, output, line_no): the last line without an error counts. Aggregated before the shuffle."""
    return log.where("output is not null").groupBy("id").agg(F.max_by("output", "line_no").alias("output"))


def pending(requests: DataFrame, log: DataFrame) -> DataFrame:
    """The requests (id, ...) without an output; errors are tried again."""
    return requests.join(log.where("output is not null").select("id"), "id", "left_anti")


def to_rescore(requests: DataFrame, log: DataFrame, scored: DataFrame) -> DataFrame:
    """(id, output) of the outputs of known requests that have no score (id) yet."""
    return latest(log).join(requests.select("id"), "id", "left_semi").join(scored.select("id"), "id", "left_anti")


def status(requests: DataFrame, log: DataFrame) -> DataFrame:
    """(run, scored, failed, unfinished) of requests (run, id) by their log (id, output): failed are those with errors alone."""
    known = log.groupBy("id").agg(F.bool_or(F.col("output").isNotNull()).alias("done"))
    joined = requests.join(known, "id", "left")
    return joined.groupBy("run").agg(F.count_if("done").alias("scored"), F.count_if(~F.col("done")).alias("failed"), F.count_if(F.col("done").isNull()).alias("unfinished"))


def pivot(scores: DataFrame, run: str, profile: str, score: str, profiles: list) -> DataFrame:
    """A row for each run, a column p<profile> for each profile with the mean score as text, `-` where there is none."""
    wide = scores.groupBy(run).pivot(profile, profiles).agg(F.round(F.avg(F.col(score).cast("double")), 4))
    return wide.select(run, *(F.coalesce(F.col(f"`{p}`").cast("string"), F.lit("-")).alias(f"p{p}") for p in profiles))


def cost_order(requests: DataFrame, run: str, tokens: str, max_new: int, most: int = 262144) -> DataFrame:
    """(run, cost, place): requests times their median prompt and what they may generate, longest first. The window is over a row a run."""
    from pyspark.sql import Window

    cost = F.floor(F.count("*") * (F.least(F.percentile(tokens, F.lit(0.5)), F.lit(float(most))) + max_new)).cast("long")
    return requests.groupBy(run).agg(cost.alias("cost")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("cost"), run)).cast("long"))
