"""Queries of sequential and stateful operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators import sequential
from memloom.plans.registry import query, read, run_sql
from memloom.plans.scoring import rewarded
from memloom.streaming import folds


@query("pack_pieces")
def pack_pieces(spark, sf_dir):
    """Text is kept whole: n is the characters of all packs, which are as many as the pieces and the line ends between them."""
    packs = sequential.pack_pieces(F.transform(F.split("text", "\n"), text.strip), 400)
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(packs).alias("pack", "x")).select("doc_id", "pack", F.length("x").alias("n"), F.md5("x").alias("digest"))


def _packs(spark, sf_dir):
    return sequential.bin_packs(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("n_chars").alias("n")), 8192)


@query("bin_pack")
def bin_pack(spark, sf_dir):
    return _packs(spark, sf_dir)


@query("bin_pack_invariants", "SELECT count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS total, true AS all_fit FROM documents WHERE n_chars <= 8192")
def bin_pack_invariants(spark, sf_dir):
    packs = _packs(spark, sf_dir).groupBy("pool", "pack").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    return packs.agg(F.sum("c").alias("n_rows"), F.sum("n").alias("total"), F.bool_and(F.col("n") <= 8192).alias("all_fit"))


@query("step_balance")
def step_balance(spark, sf_dir):
    """Packs of documents by their lengths, balanced by their labels, here lines."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.size(F.split("text", "\n")).cast("long").alias("labels"))
    name = F.shiftleft(F.col("pool").cast("long"), 32) + F.col("pack")
    packs = _packs(spark, sf_dir).join(lines, "idx").groupBy(name.alias("pack")).agg(F.sum("labels").alias("weight"))
    return sequential.balanced_steps(packs, 4, 7)


@query("balanced_steps", """WITH d AS (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS weight, md5('5|pack|' || CAST(doc_id AS VARCHAR)) AS draw FROM documents), c AS (SELECT count(*) AS n, count(*) // 8 AS s FROM d),
 k AS (SELECT *, row_number() OVER (ORDER BY draw DESC, doc_id DESC) AS gone FROM d),
 p AS (SELECT doc_id, weight, draw, row_number() OVER (ORDER BY -(weight + CAST('0x' || substr(draw, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE), draw, doc_id) - 1 AS place, s FROM k, c WHERE gone > n % 8),
 r AS (SELECT *, CASE WHEN place // s % 2 = 0 THEN place % s ELSE s - 1 - place % s END AS k FROM p),
 t AS (SELECT k, row_number() OVER (ORDER BY md5('5|step|' || CAST(k AS VARCHAR)), k) - 1 AS step FROM (SELECT unnest(range(0, s)) AS k FROM c) x)
 SELECT doc_id, weight, step, CAST(row_number() OVER (PARTITION BY step ORDER BY draw, doc_id) - 1 AS INTEGER) AS slot FROM r JOIN t USING (k)""")
def balanced_steps(spark, sf_dir):
    """Steps of eight documents of nearly the same number of lines."""
    packs = read(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("weight"))
    return sequential.balanced_steps(packs, 8, 5, "doc_id")


@query("group_filter_stream")
def group_filter(spark, sf_dir):
    groups = rewarded(spark, sf_dir).groupBy("uid", "g").agg(F.stddev_pop("m").alias("spread"), (F.max("event_id") % 17).alias("window"))
    return folds.batch_fold(groups, folds.GroupFilter(row=3, budget=10), "uid", "g", "kept", "boolean")


@query("router_fold")
def router_fold(spark, sf_dir):
    log = run_sql(spark, sf_dir, "SELECT event_id, user_id % 4 AS pool, user_id AS group, event_type <> 'purchase' AS acquire, CAST(abs(coalesce(value, 0)) AS DOUBLE) AS weight FROM [events]")
    return folds.batch_fold(log, folds.Router(8), "pool", "event_id", "server", "long")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return folds.event_windows(read(spark, sf_dir, "events"), "1 hour", "10 minutes")


@query("event_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
 SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return folds.sessions(read(spark, sf_dir, "events"), "30 minutes", "10 minutes")


@query("evict_stream", """WITH e AS (SELECT event_id, user_id, event_type = 'purchase' AS fin, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM events),
 l AS (SELECT *, sum(CASE WHEN fin THEN 0 ELSE 37 END) OVER (PARTITION BY user_id, life ORDER BY event_id) AS n FROM e)
 SELECT user_id, event_id, CAST(CASE WHEN fin THEN 0 ELSE greatest(0, greatest(ceil((n - 32) / 64.0) - 1, 0) - 6) END AS BIGINT) AS evicted FROM l""")
def evict_stream(spark, sf_dir):
    """A request a user: every event brings 37 tokens, a purchase finishes it."""
    log = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("user_id").alias("request"), (F.col("event_type") == "purchase").alias("finish"), F.lit(37).alias("tokens"))
    return folds.batch_fold(log, folds.StrideEvict(32, 64, 512), "user_id", "event_id", "evicted", "long")


@query("dedup_scores", "SELECT id, any_value(correct) AS correct FROM (SELECT doc_id AS id, quality AS correct FROM labels UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 13 = 0) t GROUP BY id")
def dedup_scores(spark, sf_dir):
    """The first score of an id counts; here repeated ones are equal."""
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("correct"))
    return folds.dedup_scores(rows.unionByName(rows.where("id % 13 = 0")))


@query("run_completion", "SELECT source AS run, count(*) AS done, CAST(count(CASE WHEN l.doc_id % 11 = 0 THEN 1 END) AS BIGINT) AS failed, any_value(total) AS total, count(*) >= any_value(total) AS finished FROM documents d JOIN labels l USING (doc_id) JOIN (SELECT source, count(*) // 3 AS total FROM documents GROUP BY source) t USING (source) GROUP BY source")
def run_completion(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("run"))
    scored = docs.join(read(spark, sf_dir, "labels"), "doc_id").select("run", (F.col("doc_id") % 11 == 0).alias("failed"))
    return folds.completion(scored, docs.groupBy("run").agg(F.expr("count(*) DIV 3").alias("total")))
