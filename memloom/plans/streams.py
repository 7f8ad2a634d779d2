"""Queries that run streams over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.plans.registry import query, read
from memloom.sources.io import shared_folder
from memloom.streaming import gate, scores


@query("score_stream", "SELECT doc_id AS id, CAST(CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempt, CAST(CASE WHEN doc_id % 11 = 0 THEN toxic ELSE quality END AS INTEGER) AS correct FROM labels WHERE doc_id % 143 <> 0")
def score_stream(spark, sf_dir):
    """Two runs of a stream of scores into one table: every 11th id fails the first time, every 13th the second time; scores of the second run differ and count only where the first has none."""
    labels = spark.readStream.schema(read(spark, sf_dir, "labels").schema).parquet(f"{sf_dir}/labels.parque[t]")  # a pattern, as the table may be one file
    path = shared_folder(spark, "scores")
    for attempt, right, fails in ((1, "quality", 11), (2, "toxic", 13)):
        failed = F.when(F.col("doc_id") % fails == 0, F.lit("timeout"))
        records = labels.select(F.col("doc_id").alias("id"), F.lit(attempt).alias("attempt"), failed.alias("error"), F.col(right).cast("int").alias("correct"))
        sink = scores.ScoreSink(f"{path}/table", f"run{attempt}", "id long, attempt int, error string, correct int")
        scores.score_available(records, sink, f"{path}/checkpoint{attempt}").awaitTermination()
    return sink.stored(spark).select("id", "attempt", "correct")


#: Drops in a row, groups that the trainer needs, and how far it may fall behind.
_GATE = gate.Gate(floor=2, most=5, row=3)
_GROUPS = """
WITH e AS (SELECT user_id, event_id, value, event_type = 'purchase' AS bought, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
 x AS (SELECT user_id, k // 4 AS g, event_id, CASE WHEN k // 4 % 5 = 4 AND k % 4 = 0 THEN NULL WHEN bought THEN 1.0 ELSE 0.0 END AS metric, CASE WHEN k // 4 % 10 = 9 THEN NULL ELSE CAST(value > 50 AS INTEGER) * 1.0 END AS score FROM e),
 a AS (SELECT user_id, g, count(metric) = count(*) AS m_ok, stddev_pop(metric) AS m, count(score) = count(*) AS s_ok, stddev_pop(score) AS s FROM x GROUP BY user_id, g),
 v AS (SELECT user_id, g, CASE WHEN m_ok THEN m WHEN s_ok THEN s END AS spread, g * 7 % 11 AS stale, CASE WHEN g % 6 = 5 THEN 3 ELSE 0 END AS most FROM a)"""


@query("group_gate", f"""WITH RECURSIVE groups AS ({_GROUPS} SELECT * FROM v),
 r AS (SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS g, true AS keep, '' AS reason, 0 AS seen, 0 AS kept, 0 AS forced, 0 AS row_, 0 AS win, CAST(NULL AS BIGINT) AS last FROM groups
  UNION ALL SELECT q.user_id, q.g, why <> 'dropped', why, q.seen + 1, q.kept + CASE WHEN why <> 'dropped' THEN 1 ELSE 0 END, q.forced + CASE WHEN why LIKE 'forced%' THEN 1 ELSE 0 END, CASE WHEN why = 'dropped' THEN q.row_ + 1 ELSE 0 END, q.w + CASE WHEN why = 'dropped' THEN 1 ELSE 0 END, q.stale
  FROM (SELECT p.*, CASE WHEN spread IS NULL THEN 'no_metric' WHEN spread > 1e-6 THEN 'informative' WHEN row_ >= 3 THEN 'forced_consec' WHEN w >= greatest(CASE WHEN most > 0 THEN most ELSE 5 END - 2, 0) THEN 'forced_budget' ELSE 'dropped' END AS why
   FROM (SELECT v.user_id, v.g, v.spread, v.stale, v.most, r.seen, r.kept, r.forced, r.row_, CASE WHEN v.stale < r.last THEN 0 ELSE r.win END AS w FROM r JOIN groups v ON v.user_id = r.user_id AND v.g = r.g + 1) p) q)
 SELECT user_id, g, keep, reason, CAST(seen AS BIGINT) AS seen, CAST(kept AS BIGINT) AS kept, CAST(forced AS BIGINT) AS forced, CAST(win AS BIGINT) AS window_drops FROM r WHERE g >= 0""")
def group_gate(spark, sf_dir):
    """A run a user, four events a group: whether they are purchases is the metric, whether their value is over 50 the score; every tenth group has neither."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_type") == "purchase").cast("double").alias("bought"), k.alias("k")).withColumn("g", F.expr("k DIV 4"))
    metric = F.when((F.col("g") % 5 == 4) & (F.col("k") % 4 == 0), F.lit(float("nan"))).otherwise(F.col("bought"))
    score = F.when(F.col("g") % 10 == 9, F.lit(float("inf"))).otherwise((F.col("value") > 50).cast("double"))
    groups = events.groupBy("user_id", "g").agg(F.collect_list(metric).alias("metric"), F.collect_list(score).alias("score"))  # four rows a group
    found = gate.spread(gate.rewards(F.col("metric"), F.col("score"), F.lit(None).cast("array<array<double>>")))
    groups = groups.select("user_id", "g", found.alias("spread"), (F.col("g") * 7 % 11).cast("double").alias("staleness"), F.when(F.col("g") % 6 == 5, 3.0).otherwise(0.0).alias("most"))
    return gate.judge(groups, _GATE, "user_id", "g")
