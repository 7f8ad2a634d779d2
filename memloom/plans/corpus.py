"""Corpus queries: validation, regrouping, splits, samples, chunks, schedules, budgets, retrieval and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.functions import extract, rules, spans, text
from memloom.operators import checks, regroup, resume, retrieval, schedules, splits
from memloom.plans.registry import query, read, run_sql

#: Ids of documents that share a memory at most: a source of any size is many memories of bounded size.
MEMORY_IDS = 1000
#: The same for the other engine: documents with the memory's name as their source.
_MEMORIES = f"(SELECT * REPLACE (concat(source, '/', CAST(doc_id // {MEMORY_IDS} AS STRING)) AS source) FROM documents) documents"


def _memory(spark, sf_dir):
    """Documents of a source with neighbouring ids as one memory, in order; one question for each."""
    rows = read(spark, sf_dir, "documents").groupBy("source", F.expr(f"doc_id DIV {MEMORY_IDS}").alias("part")).agg(regroup.ordered(F.struct("doc_id", "text")).alias("x"))
    return rows.select(F.concat("source", F.lit("/"), F.col("part").cast("string")).alias("id"), F.transform("x", lambda r: r["text"]).alias("memory_docs"), F.transform("x", lambda r: F.concat(F.lit("q"), r["doc_id"].cast("string"))).alias("qa"), F.element_at(F.transform("x", lambda r: r["doc_id"]), 1).alias("row_idx"))


@query("memory_hash", "SELECT source AS id, sha1(string_agg(text || chr(0), '' ORDER BY doc_id)) AS memory_hash FROM documents GROUP BY source".replace("FROM documents", f"FROM {_MEMORIES}"))
def memory_hash(spark, sf_dir):
    return _memory(spark, sf_dir).select("id", text.memory_hash(F.col("memory_docs")).alias("memory_hash"))


@query("req_seed", "SELECT doc_id, CAST('0x' || substr(sha1('7|' || CAST(doc_id AS STRING)), 1, 8) AS BIGINT) & 2147483647 AS seed FROM documents")
def req_seed(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.request_seed(F.lit(7), F.col("doc_id")).alias("seed"))


@query("uri_to_name", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(string_split(url, '/')[-1], '[_>-]', ' ', 'g'), '\\([^()]*\\)', '', 'g'), '\\s+', ' ', 'g')) AS name FROM pages")
def uri_to_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.uri_name(F.col("url")).alias("name"))


@query("ntokens_estimate", "SELECT doc_id, CAST(greatest(1, length(text) // 3) AS INTEGER) AS n FROM documents")
def ntokens_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("n"))


@query("validate_qa", "SELECT CAST(count(CASE WHEN source IS NULL OR length(source) = 0 THEN 1 END) AS BIGINT) AS bad_source, CAST(count(CASE WHEN text IS NULL THEN 1 END) AS BIGINT) AS bad_text, CAST(count(CASE WHEN n_chars <> length(text) THEN 1 END) AS BIGINT) AS bad_length, CAST(count(CASE WHEN lang NOT IN ('en','de') THEN 1 END) AS BIGINT) AS bad_lang FROM documents")
def validate_qa(spark, sf_dir):
    rules_ = {"bad_source": F.coalesce(F.length("source"), F.lit(0)) == 0, "bad_text": F.col("text").isNull(), "bad_length": F.col("n_chars") != F.length("text"), "bad_lang": ~F.col("lang").isin("en", "de")}
    return checks.counts(read(spark, sf_dir, "documents"), rules_)


@query("validate_ttl", "SELECT l.doc_id, CASE WHEN d.text IS NULL OR length(d.text) = 0 THEN 'text' WHEN l.quality NOT IN (0, 1) THEN 'label' ELSE 'ok' END AS verdict FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def validate_ttl(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "left")
    return rows.select("doc_id", checks.pool_verdict(F.col("text"), F.col("quality"), (0, 1)).alias("verdict"))


@query("first_violation", "SELECT min(doc_id) AS row_idx, min_by(CASE WHEN lang <> 'en' THEN 'lang' ELSE 'length' END, doc_id) AS rule FROM documents WHERE lang <> 'en' OR n_chars > 5000")
def first_violation(spark, sf_dir):
    return checks.first(read(spark, sf_dir, "documents"), "doc_id", [("lang", F.col("lang") != "en"), ("length", F.col("n_chars") > 5000)])


@query("ttl_pool", "SELECT d.doc_id, md5(d.text) AS text_md5, l.quality * 2 + l.toxic AS label, CASE WHEN d.doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def ttl_pool(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", F.md5("text").alias("text_md5"), (F.col("quality") * 2 + F.col("toxic")).alias("label"), F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"))


@query("drop_cats", "SELECT conv_id, CAST(count(*) AS BIGINT) AS kept FROM (SELECT conv_id, CASE WHEN turn % 7 = 0 THEN NULL ELSE turn % 5 + 1 END AS category FROM conversations WHERE role = 'user') t WHERE category IS NULL OR category NOT IN (5) GROUP BY conv_id")
def drop_cats(spark, sf_dir):
    """A null category is kept; a conversation without questions left asks nothing."""
    asked = read(spark, sf_dir, "conversations").where("role = 'user'").withColumn("category", F.when(F.col("turn") % 7 != 0, F.col("turn") % 5 + 1))
    return regroup.without_categories(asked, "category", (5,)).groupBy("conv_id").agg(F.count("*").alias("kept"))


@query("session_render", "SELECT conv_id, md5(string_agg(concat(role, ': ', text), '\n' ORDER BY turn)) AS doc FROM conversations GROUP BY conv_id")
def session_render(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(regroup.ordered(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))).alias("x"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("x", lambda r: r["t"]), "\n")).alias("doc"))


@query("turn_pairs", "SELECT conv_id, turn, md5(text) AS question, md5(reply) AS answer FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations) t WHERE role = 'user' AND next_role = 'assistant' AND length(trim(text)) > 0 AND length(trim(reply)) > 0")
def turn_pairs(spark, sf_dir):
    pairs = regroup.turn_pairs(read(spark, sf_dir, "conversations"), "conv_id", "turn")
    return pairs.select("conv_id", "turn", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query("regroup_by_memory", "WITH m AS (SELECT source, md5(string_agg(text, '' ORDER BY doc_id)) AS k, min(doc_id) AS row_idx FROM documents GROUP BY source, doc_id % 3, doc_id // 1000) SELECT k AS memory_key, min(row_idx) AS row_idx, count(*) AS n FROM m GROUP BY k")
def regroup_by_memory(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id % 3").alias("g"), F.expr(f"doc_id DIV {MEMORY_IDS}")).agg(regroup.ordered(F.struct("doc_id", "text")).alias("x"))
    rows = rows.select(F.element_at("x", 1)["doc_id"].alias("row_idx"), F.transform("x", lambda r: r["text"]).alias("memory_docs"), F.array(F.lit("q")).alias("qa"))
    return regroup.by_memory(rows).select("memory_key", "row_idx", F.size("qa").cast("long").alias("n"))


@query("split_pack", "WITH m AS (SELECT source, list(doc_id ORDER BY doc_id) AS q FROM documents GROUP BY source), p AS (SELECT source, q, unnest(range(0, len(q), 7)) AS s FROM m) SELECT CASE WHEN len(q) > 7 THEN concat(source, '#pack', CAST(s // 7 AS STRING)) ELSE source END AS id, CAST(len(q[s + 1 : s + 7]) AS BIGINT) AS n, concat('q', CAST(q[s + 1] AS STRING)) AS first_question FROM p".replace("FROM documents", f"FROM {_MEMORIES}"))
def split_pack(spark, sf_dir):
    return regroup.split_packs(_memory(spark, sf_dir), 7).select("id", F.size("qa").cast("long").alias("n"), F.get("qa", F.lit(0)).alias("first_question"))


@query("dynamic_pack", "WITH m AS (SELECT source, sha1(string_agg(text || chr(0), '' ORDER BY doc_id)) AS k, list(doc_id ORDER BY doc_id) AS q FROM documents GROUP BY source), p AS (SELECT source, q, unnest(range(0, len(q), 10)) AS s FROM m) SELECT CASE WHEN len(q) > 10 THEN concat(source, '#pack', CAST(s // 10 AS STRING)) ELSE source END AS id, CAST(s // 10 AS INTEGER) AS pack, CAST(len(q[s + 1 : s + 10]) AS BIGINT) AS n FROM p".replace("FROM documents", f"FROM {_MEMORIES}"))
def dynamic_pack(spark, sf_dir):
    return regroup.dynamic_packs(_memory(spark, sf_dir), 10).select("id", "pack", F.size("qa").cast("long").alias("n"))


@query("pack_offset", "WITH r AS (SELECT source, doc_id // 100 AS part, count(*) AS n FROM documents GROUP BY ALL), o AS (SELECT *, part // 3 AS pack, coalesce(sum(n) OVER (PARTITION BY source, part // 3 ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r) SELECT concat(source, '/', CAST(pack AS STRING)) AS pack, CAST(sum(n) AS BIGINT) AS n_docs, string_agg(CAST(CAST(off AS BIGINT) AS STRING), ',' ORDER BY part) AS evidence FROM o GROUP BY source, pack")
def pack_offset(spark, sf_dir):
    """Three memories of a hundred ids each a pack; evidence is each memory's first document."""
    rows = read(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id DIV 100").alias("part")).agg(regroup.ordered(F.struct("doc_id", "text")).alias("x"))
    rows = rows.select(F.concat("source", F.lit("/"), F.expr("part DIV 3").cast("string")).alias("pack"), "part", F.transform("x", lambda r: r["text"]).alias("docs"), F.array(F.lit(0)).alias("evidence"))
    return regroup.pack_with_offsets(rows, "pack", "part").select("pack", F.size("docs").cast("long").alias("n_docs"), F.array_join("evidence", ",").alias("evidence"))


@query("wiki_pack", "SELECT g AS pack, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // (5) AS g FROM documents) t GROUP BY source, g HAVING count(*) = 5")
def wiki_pack(spark, sf_dir):
    groups = splits.consecutive(read(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 5, "pack", whole=True)
    return groups.groupBy("source", "pack").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).drop("source")


@query("explode_single", "SELECT concat(CAST(conv_id AS STRING), '#q', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS STRING)) AS id, turn FROM conversations WHERE role = 'user'")
def explode_single(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.col("conv_id").cast("string").alias("id")).agg(regroup.ordered(F.struct("turn", "text")).alias("qa"))
    return regroup.explode_questions(rows).select("id", "q.turn")


@query("evidence_resolve", "SELECT b.item_id, string_agg(CAST(d.doc_id AS STRING), ',' ORDER BY d.doc_id) AS docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def evidence_resolve(spark, sf_dir):
    found = retrieval.containing(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("docs"))


def _log(spark, sf_dir):
    """An append-only log of outputs: every eleventh request failed, every thirteenth answered twice."""
    rows = read(spark, sf_dir, "labels")
    once = rows.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.col("quality")).alias("output"), F.lit(0).alias("line_no"))
    return once.unionByName(rows.where("doc_id % 13 = 0").select(F.col("doc_id").alias("id"), (F.col("quality") + 10).alias("output"), F.lit(1).alias("line_no")))



@query("resume_todo", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE quality END AS output, 0 AS line_no FROM labels UNION ALL SELECT doc_id, quality + 10, 1 FROM labels WHERE doc_id % 13 = 0) o WHERE o.id = d.doc_id AND output IS NOT NULL)")
def resume_todo(spark, sf_dir):
    requests = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return resume.pending(requests, _log(spark, sf_dir)).select(F.col("id").alias("doc_id"))


@query("resume_rescore", "SELECT o.id, o.output FROM (SELECT id, max_by(output, line_no) AS output FROM (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE quality END AS output, 0 AS line_no FROM labels UNION ALL SELECT doc_id, quality + 10, 1 FROM labels WHERE doc_id % 13 = 0) l WHERE output IS NOT NULL GROUP BY id) o JOIN documents d ON d.doc_id = o.id WHERE o.id % 3 <> 0")
def resume_rescore(spark, sf_dir):
    requests = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return resume.to_rescore(requests, _log(spark, sf_dir), read(spark, sf_dir, "labels").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")))


@query("group_cap", "SELECT source, part, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // (16) AS part FROM documents) t GROUP BY source, part")
def group_cap(spark, sf_dir):
    groups = splits.consecutive(read(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 16)
    return groups.groupBy("source", "part").agg(F.count("*").alias("n"))


@query("run_status", "SELECT source, CAST(count(CASE WHEN l.doc_id IS NOT NULL AND l.doc_id % 11 <> 0 THEN 1 END) AS BIGINT) AS scored, CAST(count(CASE WHEN l.doc_id % 11 = 0 THEN 1 END) AS BIGINT) AS failed, CAST(count(CASE WHEN l.doc_id IS NULL THEN 1 END) AS BIGINT) AS unfinished FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def run_status(spark, sf_dir):
    requests = read(spark, sf_dir, "documents").select(F.col("source").alias("run"), F.col("doc_id").alias("id"))
    log = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.col("quality")).alias("output"))
    return resume.status(requests, log).withColumnRenamed("run", "source")


# ---- lengths and budgets

_LENGTH = "SELECT doc_id, CAST(n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 16 END AS INTEGER) AS p FROM [documents]"
_BUCKET = "CASE WHEN p BETWEEN 768 AND 1791 THEN 1 WHEN p BETWEEN 1792 AND 7679 THEN 2 WHEN p BETWEEN 7680 AND 15359 THEN 3 WHEN p BETWEEN 15360 AND 30719 THEN 4 WHEN p BETWEEN 30720 AND 61439 THEN 5 END"
_L = _LENGTH.replace("[documents]", "documents")


@query("length_bucket", f"SELECT doc_id, {_BUCKET} AS bucket, CAST(CASE coalesce({_BUCKET}, CASE WHEN p < 768 THEN 1 ELSE 5 END) WHEN 1 THEN 512 WHEN 2 THEN 1024 WHEN 3 THEN 2048 WHEN 4 THEN 4096 ELSE 8192 END AS INTEGER) AS win FROM ({_L}) t")
def length_bucket(spark, sf_dir):
    return run_sql(spark, sf_dir, _LENGTH).select("doc_id", rules.bucket(F.col("p")).alias("bucket"), rules.resolved(F.col("p"))["window"].alias("win"))


@query("rl_mix_stats", f"SELECT coalesce(CASE WHEN {_BUCKET} IS NULL THEN CASE WHEN p < 4096 THEN 'short' ELSE 'long' END WHEN {_BUCKET} = 1 THEN 'bucket' END, 'kept') AS reason, count(*) AS n FROM ({_L}) t GROUP BY 1")
def rl_mix_stats(spark, sf_dir):
    return run_sql(spark, sf_dir, _LENGTH).groupBy(F.coalesce(rules.drop_reason(F.col("p")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("quota_admission", f"SELECT doc_id, bucket FROM (SELECT doc_id, {_BUCKET} AS bucket, row_number() OVER (PARTITION BY {_BUCKET} ORDER BY md5('1|rl|' || CAST(doc_id AS STRING)), doc_id) AS rn FROM ({_L}) t) q WHERE bucket IS NOT NULL AND bucket <> 1 AND (bucket <> 2 OR rn <= 20)")
def quota_admission(spark, sf_dir):
    rows = run_sql(spark, sf_dir, _LENGTH).select("doc_id", rules.bucket(F.col("p")).alias("bucket")).where("bucket <> 1")
    return splits.by_hash(rows, ["bucket"], 1, "rl", "doc_id").where("bucket <> 2 or place < 20").select("doc_id", "bucket")


@query("balanced_val", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) t WHERE rn <= 11")
def balanced_val(spark, sf_dir):
    placed = splits.by_id(read(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id")
    return placed.where("place < 11").select("doc_id", "source")


@query("block_budget", "SELECT source, CAST(greatest(2048, least(16384, 2048 + 256 * count(*))) AS BIGINT) AS budget, CASE WHEN count(*) <= 20 THEN 1 ELSE 3 END AS k FROM documents GROUP BY source")
def block_budget(spark, sf_dir):
    n = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", rules.block_budget(F.col("n"), 16384).cast("long").alias("budget"), rules.neighbours_wanted(F.col("n")).alias("k"))


@query("memory_budget", "SELECT source, CAST(262144 - 1024 - 1024 - max(n_chars) AS BIGINT) AS budget FROM documents GROUP BY source")
def memory_budget(spark, sf_dir):
    longest = read(spark, sf_dir, "documents").groupBy("source").agg(F.max("n_chars").alias("n"))
    return longest.select("source", rules.memory_budget(F.col("n"), 1024).cast("long").alias("budget"))


@query("request_weight", f"SELECT doc_id, CAST(greatest(coalesce(nullif(doc_id % 5 * 100, 0), nullif(doc_id % 3 * 50, 0), 777) + ceil(0.25 * p), 1) AS INTEGER) AS weight FROM ({_L}) t")
def request_weight(spark, sf_dir):
    rows = run_sql(spark, sf_dir, _LENGTH)
    return rows.select("doc_id", rules.request_weight(F.expr("CAST(doc_id % 5 * 100 AS INT)"), F.expr("CAST(doc_id % 3 * 50 AS INT)"), 777, F.col("p"), 0.25).alias("weight"))


@query("lr_schedule", """WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS step, (count(*) OVER () + 7) // 8 AS total FROM documents)
 SELECT doc_id, CAST(step AS BIGINT) AS step, round(CASE WHEN step < 10 THEN (step + 1) / 10.0 ELSE 0.5 * (1 + cos(3.141592653589793 * least(1.0, (step - 10) / CAST(greatest(1, total - 10) AS DOUBLE)))) END, 6) AS factor FROM b""")
def lr_schedule(spark, sf_dir):
    """The factor with which each document is learned from: eight documents a step, in order of their ids, over one epoch."""
    placed = regroup.dense_index(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").withColumn("step", F.expr("idx DIV 8"))
    total = -(-read(spark, sf_dir, "documents").count() // 8)
    return placed.select("doc_id", "step", F.round(rules.learning_rate(F.col("step"), "warmup_cosine", 10, 0, total), 6).alias("factor"))


# ---- samples and splits


@query("sample_fixed", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY md5(concat('0|s|', CAST(doc_id AS STRING))), doc_id LIMIT 50) t")
def sample_fixed(spark, sf_dir):
    return regroup.take_by_key(read(spark, sf_dir, "documents").select("doc_id"), 50, 0, "s", "doc_id")


@query("mixture", "SELECT doc_id, source, md5(concat('0|mix|', CAST(doc_id AS STRING))) AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('0|', source, '|', CAST(doc_id AS STRING))), doc_id) AS rn FROM documents WHERE n_chars BETWEEN 20 AND 20000) t WHERE rn <= 6")
def mixture(spark, sf_dir):
    """Lengths are filtered first, then each source gives its rows of the smallest hashes; the shuffled order is that of place."""
    return splits.mixture(read(spark, sf_dir, "documents").where("n_chars between 20 and 20000"), "source", "doc_id", 6, 0)


@query("mix_length_filter", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE n_chars BETWEEN 100 AND 4000 GROUP BY source")
def mix_length_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(F.col("n_chars").between(100, 4000)).groupBy("source").agg(F.count("*").alias("n"))


@query("split_5_95", "SELECT doc_id, CASE WHEN rn < k THEN CASE WHEN rn < k - k % 5 THEN 'pack_rl' ELSE 'dropped' END WHEN rn - k < (n - k) // (2) THEN 'single_sft' ELSE 'single_rl' END AS split FROM (SELECT doc_id, n, rn, (n) // (20) AS k FROM (SELECT doc_id, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5(concat('42|split|', CAST(doc_id AS STRING))), doc_id) - 1 AS rn FROM documents) a) b")
def split_5_95(spark, sf_dir):
    return splits.single_dominant(read(spark, sf_dir, "documents"), "source", "doc_id", 42, 5)


@query("split_5_5_90", "SELECT doc_id, CASE WHEN rn < c THEN 'single_sft' WHEN rn < 2 * c THEN 'single_rl' ELSE 'pack_rl' END AS split FROM (SELECT doc_id, greatest(1, (count(*) OVER (PARTITION BY source)) // (20)) AS c, row_number() OVER (PARTITION BY source ORDER BY md5(concat('42|multi|', CAST(doc_id AS STRING))), doc_id) - 1 AS rn FROM documents) t")
def split_5_5_90(spark, sf_dir):
    return splits.multi_dominant(read(spark, sf_dir, "documents"), "source", "doc_id", 42)


@query("dense_ids", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents WHERE lang = 'en'")
def dense_ids(spark, sf_dir):
    return regroup.dense_index(read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id")


@query("stratified_memory", "WITH p AS (SELECT doc_id, quality * 2 + toxic AS label FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('3|label|' || CAST(doc_id AS STRING)), doc_id) AS rn FROM p) SELECT doc_id, label FROM r ORDER BY CASE WHEN rn = 1 THEN 0 ELSE 1 END, md5('3|fill|' || CAST(doc_id AS STRING)), doc_id LIMIT 30")
def stratified_memory(spark, sf_dir):
    pool = read(spark, sf_dir, "labels").select("doc_id", F.expr("quality * 2 + toxic AS label"))
    return regroup.stratified(pool, "label", "doc_id", 30, 3)


@query("ttl_episodes", "SELECT CAST(g AS BIGINT) AS episode, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS g FROM labels WHERE doc_id % 4 = 0) t GROUP BY g HAVING count(*) = 8")
def ttl_episodes(spark, sf_dir):
    """Eight test questions an episode, in order, the incomplete tail dropped."""
    asked = regroup.dense_index(read(spark, sf_dir, "labels").where("doc_id % 4 = 0").select("doc_id"), "doc_id")
    return asked.groupBy(F.expr("idx DIV 8").alias("episode")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n = 8")


@query("sample_manifest", "SELECT CAST(count(*) AS BIGINT) AS sample_rows, sha1(string_agg(CAST(idx AS STRING), ',' ORDER BY idx)) AS indices_sha1 FROM (SELECT doc_id AS idx FROM documents ORDER BY md5(concat('0|manifest|', CAST(doc_id AS STRING))), doc_id LIMIT 40) t")
def sample_manifest(spark, sf_dir):
    return splits.manifest(read(spark, sf_dir, "documents"), "doc_id", 40, 0)


@query("oversample_accumulate", "SELECT batch, CAST(kept AS BIGINT) AS kept FROM (SELECT batch, kept, coalesce(sum(kept) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT (event_id) // (100) AS batch, CAST(count(CASE WHEN event_type = 'purchase' THEN 1 END) AS BIGINT) AS kept FROM events GROUP BY 1) a) b WHERE before < 100")
def oversample_accumulate(spark, sf_dir):
    batches = read(spark, sf_dir, "events").groupBy(F.expr("event_id DIV 100").alias("batch")).agg(F.count_if(F.col("event_type") == "purchase").alias("kept"))
    return splits.until(batches, "batch", "kept", 100)


@query("microbatch_groups", "SELECT user_id, micro, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // (16) AS micro FROM events) t GROUP BY user_id, micro")
def microbatch_groups(spark, sf_dir):
    groups = splits.consecutive(read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 16, "micro")
    return groups.groupBy("user_id", "micro").agg(F.count("*").alias("n"))


@query("router_status", "SELECT user_id % 8 AS server, CAST(sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) AS BIGINT) AS in_flight FROM events GROUP BY user_id % 8")
def router_status(spark, sf_dir):
    load = F.when(F.col("event_type") == "purchase", -1).otherwise(1)
    return read(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("server")).agg(F.sum(load).alias("in_flight"))


@query("segment_ids", "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS segment FROM conversations")
def segment_ids(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return regroup.running_count(turns, "conv_id", "turn", F.col("role") == "user", "segment").select("conv_id", "turn", "segment")


@query("staleness_windows", "SELECT event_id, CAST(sum(CASE WHEN prev > s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS reset_no FROM (SELECT event_id, user_id, event_id % 17 AS s, lag(event_id % 17) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) t")
def staleness_windows(spark, sf_dir):
    """How often the counter had fallen below its last value, event by event of a user."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 17).alias("s"))
    fell = F.lag("s").over(Window.partitionBy("user_id").orderBy("event_id")) > F.col("s")
    return regroup.running_count(rows.withColumn("fell", fell), "user_id", "event_id", F.col("fell"), "reset_no").select("event_id", "reset_no")


@query("summary_pivot", "SELECT d.source, coalesce(CAST(round(avg(CASE WHEN d.doc_id % 3 = 0 THEN CAST(quality AS DOUBLE) END), 4) AS STRING), '-') AS p0, coalesce(CAST(round(avg(CASE WHEN d.doc_id % 3 = 1 THEN CAST(quality AS DOUBLE) END), 4) AS STRING), '-') AS p1, coalesce(CAST(round(avg(CASE WHEN d.doc_id % 3 = 2 THEN CAST(quality AS DOUBLE) END), 4) AS STRING), '-') AS p2 FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
def summary_pivot(spark, sf_dir):
    scores = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("source", (F.col("doc_id") % 3).alias("profile"), "quality")
    return resume.pivot(scores, "source", "profile", "quality", [0, 1, 2])


@query("run_cost_order", "SELECT source, cost, row_number() OVER (ORDER BY cost DESC, source) AS place FROM (SELECT source, CAST(floor(count(*) * (least(median(n_chars), 262144) + 1024)) AS BIGINT) AS cost FROM documents GROUP BY source) t")
def run_cost_order(spark, sf_dir):
    return resume.cost_order(read(spark, sf_dir, "documents"), "source", "n_chars", 1024).withColumnRenamed("run", "source")


# ---- chunks and schedules

_LINES = "SELECT doc_id, length(line) AS n, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) t"


def _lengths(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.length(x)).alias("n"))


def _chunks(spark, sf_dir):
    return _lengths(spark, sf_dir).select("doc_id", F.posexplode("n").alias("i", "n"))


@query("chunk_spans", f"SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS e FROM ({_LINES}) t")
def chunk_spans(spark, sf_dir):
    return _lengths(spark, sf_dir).select("doc_id", F.posexplode(spans.chunk_spans(F.col("n"))).alias("i", "x")).select("doc_id", "i", "x.s", "x.e")


@query("evict_schedule", f"""WITH l AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS hi, count(*) OVER (PARTITION BY doc_id) AS c FROM ({_LINES}) t), z AS (SELECT doc_id, min(hi) AS sink FROM l WHERE i = 0 GROUP BY doc_id)
 SELECT a.doc_id, CAST(a.i AS INTEGER) AS i, CAST(CASE WHEN a.i < 1 THEN max(a.c) ELSE coalesce(min(CASE WHEN b.i > a.i AND (b.i - a.i + 1 > 6 OR sink + b.hi - (a.hi - a.n) > 900) THEN b.i END), max(a.c)) END AS INTEGER) AS evict_at FROM l a JOIN l b ON a.doc_id = b.doc_id JOIN z ON z.doc_id = a.doc_id GROUP BY a.doc_id, a.i""")
def evict_schedule(spark, sf_dir):
    return schedules.evict_at(_chunks(spark, sf_dir), "doc_id", 6, 900, 1).select("doc_id", "i", "evict_at")


@query("sliding_chunks", "SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(least(s + 2048, n_chars) AS INTEGER) AS e FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars, 1848)) AS s FROM documents) t WHERE s = 0 OR s - 1848 + 2048 < n_chars")
def sliding_chunks(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("int").alias("n"))
    return rows.select("doc_id", "n", F.explode(spans.sliding_starts(F.col("n"), 2048, 200)).alias("s")).select("doc_id", "s", F.least(F.col("s") + 2048, "n").alias("e"))


@query("token_chunks", "SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(least(s + 512, n_chars) AS INTEGER) AS e FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars, 512)) AS s FROM documents) t")
def token_chunks(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("int").alias("n"))
    return rows.select("doc_id", F.explode(spans.fixed_spans(F.col("n"), F.lit(512))).alias("x")).select("doc_id", "x.s", "x.e")


@query("doc_units", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents) t WHERE trim(u) <> '' GROUP BY doc_id")
def doc_units(spark, sf_dir):
    units = F.filter(F.split("text", "\n"), lambda u: text.strip(u) != "")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(units).cast("long").alias("n")).where("n > 0")


@query("frontier", f"SELECT doc_id, CAST(greatest(ceil(p / 512.0) - 1, 0) AS INTEGER) AS chunk, CAST(ceil(p / 32.0) * 32 AS INTEGER) AS sink FROM ({_L}) t")
def frontier(spark, sf_dir):
    return run_sql(spark, sf_dir, _LENGTH).select("doc_id", spans.frontier(F.col("p"), F.lit(512)).alias("chunk"), spans.sink_end(F.col("p")).alias("sink"))


@query("merge_spans", "WITH e AS (SELECT user_id, event_id AS s, event_id + CASE WHEN event_type = 'view' THEN 200 ELSE 20 END AS e FROM events), f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM e), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s) AS island FROM f) SELECT user_id, CAST(min(s) AS INTEGER) AS s, CAST(max(e) AS INTEGER) AS e FROM g GROUP BY user_id, island")
def merge_spans(spark, sf_dir):
    rows = run_sql(spark, sf_dir, "SELECT user_id, CAST(event_id AS INT) AS s, CAST(event_id + CASE WHEN event_type = 'view' THEN 200 ELSE 20 END AS INT) AS e FROM [events]")
    return schedules.merged(rows, "user_id")


@query("common_prefix", "WITH p AS (SELECT a.doc_id, CAST(least(length(a.text), length(b.text)) AS BIGINT) AS n, string_split(a.text, '') AS x, string_split(b.text, '') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1), c AS (SELECT doc_id, unnest(x[1:n]) AS x, unnest(y[1:n]) AS y, unnest(range(0, n)) AS i FROM p), d AS (SELECT doc_id, min(i) AS i FROM c WHERE x <> y GROUP BY doc_id) SELECT p.doc_id, CAST(coalesce(d.i, p.n) AS INTEGER) AS n FROM p LEFT JOIN d ON d.doc_id = p.doc_id")
def common_prefix(spark, sf_dir):
    rows, letters = read(spark, sf_dir, "documents").select("doc_id", "text"), lambda c: F.array_remove(F.split(c, ""), "")
    beside = rows.alias("a").join(rows.alias("b"), F.expr("b.doc_id = a.doc_id + 1")).select("a.doc_id", letters("a.text").alias("x"), letters("b.text").alias("y"))
    return beside.select("doc_id", spans.common_prefix(F.col("x"), F.col("y")).alias("n"))


# ---- retrieval

_WORDS = "SELECT doc_id AS unit_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents"


def _units(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "text")


@query("bm25_stats", f"WITH u AS ({_WORDS}), t AS (SELECT unit_id, unnest(w) AS term FROM u), c AS (SELECT term, unit_id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM c GROUP BY term")
def bm25_stats(spark, sf_dir):
    return retrieval.postings(_units(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("bm25_topk", f"""WITH u AS ({_WORDS}), s AS (SELECT unit_id, len(w) AS size FROM u), m AS (SELECT count(*) AS n, avg(size) AS mean FROM s), t AS (SELECT unit_id, unnest(w) AS term FROM u), c AS (SELECT term, unit_id, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
 r AS (SELECT query_id, c.unit_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score FROM q JOIN c ON q.term = c.term JOIN d ON d.term = q.term JOIN s ON s.unit_id = c.unit_id, m GROUP BY query_id, c.unit_id),
 a AS (SELECT i.item_id AS query_id, s.unit_id, coalesce(score, 0) AS score FROM benchmark i CROSS JOIN s LEFT JOIN r ON r.query_id = i.item_id AND r.unit_id = s.unit_id)
 SELECT query_id, unit_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank FROM a) x WHERE rank <= 3""")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(_units(spark, sf_dir), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 3)


@query("cosine_topk", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v JOIN v q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id) SELECT query_id, vec_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 3")
def cosine_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.cosine(vectors, queries, 3)


@query("index_key", "SELECT source AS id, sha1(concat(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), chr(0), string_agg(CAST(length(text) AS STRING), ',' ORDER BY doc_id))) AS k FROM documents GROUP BY source".replace("FROM documents", f"FROM {_MEMORIES}"))
def index_key(spark, sf_dir):
    lengths = F.array_join(F.transform("memory_docs", lambda x: F.length(x).cast("string")), ",")
    return _memory(spark, sf_dir).select("id", F.sha1(F.concat(F.array_join("memory_docs", "\n\n"), F.lit("\0"), lengths)).alias("k"))


# ---- prompts

_PROMPT = "concat('Learn.', chr(10), chr(10), 'Classify each of the following items. Valid labels: 0, 1, 2, 3.', chr(10), {lines}, chr(10), chr(10), 'Put your final labels inside a ```text``` block, one per line as `L1: ...`, `L2: ...`, matching the item numbers.')"


@query("prompt_build", "SELECT conv_id, md5(" + _PROMPT.format(lines="string_agg(concat('T', CAST(rn AS STRING), ': ', text), chr(10) ORDER BY turn)") + ") AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user') t GROUP BY conv_id")
def prompt_build(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(regroup.ordered(F.struct("turn", "text")).alias("x"))
    prompt = rules.ttl_prompt(F.transform("x", lambda r: r["text"]), F.array(*map(F.lit, range(4))), F.lit("Learn."), False)
    return rows.select("conv_id", F.md5(prompt).alias("prompt"))


@query("gold_build", "SELECT conv_id, md5(concat('```text', chr(10), string_agg(concat('A', CAST(rn AS STRING), ': ', text), chr(10) ORDER BY turn), chr(10), '```')) AS gold FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'assistant') t GROUP BY conv_id")
def gold_build(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(regroup.ordered(F.struct("turn", "text")).alias("x"))
    return rows.select("conv_id", F.md5(rules.gold_block(F.transform("x", lambda r: r["text"]), "A")).alias("gold"))


@query("pack_questions", "SELECT conv_id, CAST(count(*) AS INTEGER) AS n FROM (SELECT conv_id FROM conversations WHERE role = 'user') t GROUP BY conv_id HAVING count(*) >= 2")
def pack_questions(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(regroup.ordered(F.struct("turn", "text")).alias("x"))
    asked = extract.pack_questions(rules.numbered(F.transform("x", lambda r: F.split(r["text"], "\n")[0]), "Q"))
    return rows.select("conv_id", F.size(asked).alias("n")).where("n >= 2")


@query("build_requests", "SELECT source AS id, md5(concat(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), chr(10), chr(10), 'Question: ?')) AS content FROM documents GROUP BY source".replace("FROM documents", f"FROM {_MEMORIES}"))
def build_requests(spark, sf_dir):
    built = rules.messages(F.col("memory_docs"), F.lit("Question: ?"))
    return _memory(spark, sf_dir).select("id", F.md5(F.get(built, F.lit(1))["content"]).alias("content"))


@query("qa_json_roundtrip", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def qa_json_roundtrip(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


