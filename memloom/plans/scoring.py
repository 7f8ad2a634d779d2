"""Extraction, judging and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import extract, judge, rules, text
from memloom.operators import metrics, regroup, retrieval
from memloom.plans.registry import OUTPUTS, query, read, run_sql
from memloom.sources.io import spread

_O = OUTPUTS.replace("[documents]", "documents").replace("[labels]", "labels")
#: Articles between what are no word characters (twice, as neighbours share one), and white space, both of Unicode.
_ARTICLES = lambda c: f"regexp_replace({c}, '(^|[^\\pL\\pM\\pN\\p{{Pc}}])(a|an|the)([^\\pL\\pM\\pN\\p{{Pc}}]|$)', '\\1 \\3', 'g')"
_NORM = lambda c: f"trim(regexp_replace({_ARTICLES(_ARTICLES(_BARE(c)))}, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g'))"
_BARE = lambda c: f"translate(lower({c}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')"
_BLOCKS = f"""o AS ({_O}), b AS (SELECT *, contains(output, '```text') AS has_block,
  regexp_replace(string_split(output, '```text')[-1], '^[ \\t]*\\n?', '') AS rest FROM o),
 k AS (SELECT *, CASE WHEN has_block THEN string_split(rest, '```')[1] END AS block, has_block AND contains(rest, '```') AS closed FROM b)"""
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_SINGLE = f"CASE WHEN regexp_matches(block, '(?mi)^Answer:[ \\t]*(.*)') THEN {_STRIP('''regexp_extract(block, '(?mi)^Answer:[ \\t]*(.*)', 1)''')} ELSE {_STRIP('block')} END"
_ENTRIES = f"""n AS (SELECT *, regexp_extract_all(block, '(?m)^A(\\d+):', 1) AS numbers, string_split_regex(block, '(?m)^A\\d+:[ \\t]*')[2:] AS bodies FROM k WHERE kind = 'multi'),
 e AS (SELECT id, CAST(numbers[i] AS INTEGER) AS number, {_STRIP('bodies[i]')} AS answer, i FROM (SELECT id, numbers, bodies, unnest(range(1, len(numbers) + 1)) AS i FROM n) t),
 last AS (SELECT id, number, answer FROM e QUALIFY row_number() OVER (PARTITION BY id, number ORDER BY i DESC) = 1)"""
#: Items of records: one for single outputs, three for others; their answers, or nothing.
_ITEMS = f"""WITH {_BLOCKS}, {_ENTRIES},
 f AS (SELECT k.id, group_id, gold, kind, has_block, CASE WHEN kind = 'single' THEN 1 ELSE 3 END AS nq,
   CASE WHEN kind = 'single' THEN CASE WHEN has_block THEN {_SINGLE} ELSE {_STRIP('output')} END END AS one,
   CASE WHEN kind = 'single' THEN 1 ELSE (SELECT count(*) FROM last WHERE last.id = k.id) END AS n_found FROM k),
 i AS (SELECT f.*, item, CASE WHEN kind = 'single' THEN one ELSE coalesce(answer, '') END AS pred FROM (SELECT f.*, unnest(range(1, nq + 1)) AS item FROM f) f LEFT JOIN last ON f.id = last.id AND f.item = last.number AND f.kind = 'multi'),
 s AS (SELECT i.*, {_NORM('pred')} AS p, {_NORM('gold')} AS g, (has_block AND n_found = nq) AS format_ok FROM i),
 j AS (SELECT s.*, CASE WHEN pred <> '' AND p = g THEN 1.0 ELSE 0.0 END AS correct, pred <> '' AND contains(p, g) AS rule,
   CASE WHEN pred <> '' AND list_contains(string_split(p, ' '), g) THEN round(2.0 / (1 + len(list_filter(string_split(p, ' '), lambda x: x <> '' AND x <> 'and'))), 4) ELSE 0.0 END AS f1 FROM s)"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, OUTPUTS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    golds = F.when(F.col("kind") == "single", F.array(F.array("gold"))).otherwise(F.array(F.array("gold"), F.array("gold"), F.array("gold")))
    return metrics.score(outputs(spark, sf_dir).withColumn("golds", golds))


@query("group_acc", f"{_ITEMS} SELECT count(*) AS n_groups, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS group_acc FROM (SELECT group_id, bool_and(format_ok AND correct <> 0) AS ok FROM j GROUP BY group_id) t")
def group_acc(spark, sf_dir):
    return metrics.group_accuracy(records(spark, sf_dir))


@query("item_metrics", f"{_ITEMS} SELECT count(*) AS n_items, round(avg(correct), 6) AS item_acc, round(avg(CASE WHEN rule THEN 1.0 ELSE 0.0 END), 6) AS item_acc_rule, round(avg(correct), 6) AS item_acc_em, round(avg(f1), 6) AS item_f1 FROM j")
def item_metrics(spark, sf_dir):
    return metrics.item_metrics(records(spark, sf_dir))


@query("format_rates", f"{_ITEMS} SELECT count(*) AS n_records, round(avg(CASE WHEN format_ok THEN 1.0 ELSE 0.0 END), 6) AS format_ok_rate, round(avg(CASE WHEN has_block THEN 1.0 ELSE 0.0 END), 6) AS has_block_rate FROM (SELECT DISTINCT id, format_ok, has_block FROM j) t")
def format_rates(spark, sf_dir):
    return metrics.format_rates(records(spark, sf_dir))


@query("score_items", f"{_ITEMS} SELECT id, CAST(item - 1 AS INTEGER) AS item, pred, CAST(correct AS DOUBLE) AS correct, rule AS correct_rule, CAST(f1 AS DOUBLE) AS f1 FROM j")
def score_items(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.explode("items").alias("i")).select("id", "i.item", "i.pred", "i.correct", "i.correct_rule", "i.f1")


@query("rl_reward", f"{_ITEMS} SELECT id, CAST(round(CASE WHEN NOT has_block OR n_found = 0 THEN -0.5 ELSE sum(correct) / nq + CASE WHEN bool_and(correct >= 1) THEN 0.5 ELSE 0 END - CASE WHEN n_found <> nq THEN 0.5 ELSE 0 END END, 6) AS DOUBLE) AS reward FROM j GROUP BY id, has_block, n_found, nq")
def rl_reward(spark, sf_dir):
    return metrics.rewards(records(spark, sf_dir))


@query("last_block", f"WITH {_BLOCKS} SELECT id, block, closed FROM k")
def last_block(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", extract.last_block(F.col("output")).alias("block"), extract.block_closed(F.col("output")).alias("closed"))


@query("parse_single", f"WITH {_BLOCKS} SELECT id, {_SINGLE} AS answer FROM k WHERE kind = 'single' AND has_block")
def parse_single(spark, sf_dir):
    return outputs(spark, sf_dir).where("kind = 'single'").where(extract.has_block(F.col("output"))).select("id", extract.single_answer(F.col("output")).alias("answer"))


@query("parse_multi", f"WITH {_BLOCKS}, {_ENTRIES} SELECT * FROM last")
def parse_multi(spark, sf_dir):
    return outputs(spark, sf_dir).where("kind = 'multi'").select("id", F.explode(extract.numbered_answers(F.col("output"))).alias("number", "answer"))


@query("normalize_text", f"SELECT doc_id, md5({_NORM('text')}) AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("normal"))


#: Every document answers one item: items are numbered by their ids, and documents go round them.
_DEALT = "(SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark)"
_PAIRS = f"SELECT d.doc_id, b.item_id, d.text AS pred, b.text AS gold FROM documents d JOIN {_DEALT} b ON (d.doc_id % b.n + b.n) % b.n = b.place"


#: Bytes of items' texts up to which they are broadcast; beyond it Spark joins them as it sees fit.
ITEM_BYTES = 32 << 20


def held_small(items: DataFrame, texts: DataFrame) -> DataFrame:
    """The items with a broadcast hint if the texts they come from are of a bounded size."""
    return F.broadcast(items) if (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= ITEM_BYTES else items


def dealt(spark, sf_dir, items):
    """(doc_id, and the columns of its one item) of all documents, for items (item_id, ...); a row a document, in one equi-join."""
    texts = read(spark, sf_dir, "benchmark")
    n = texts.count()
    placed = regroup.dense_index(items, "item_id", "place")
    return lambda answers: answers.withColumn("place", F.pmod("doc_id", F.lit(max(n, 1)))).join(held_small(placed, texts), "place").drop("place")


def pairs(spark, sf_dir):
    """Every document as an output, whole and in any language, with the one item that it answers."""
    answers = spread(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("pred")))
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold"))
    return dealt(spark, sf_dir, items)(answers).select("doc_id", "item_id", "pred", "gold")


#: Bytes of documents' texts that a task takes on average where every document is judged against every item.
TASK_BYTES = 4 << 20


def every(spark, sf_dir):
    """(answers, items, small): all documents (row, doc_id, text), dealt by row, and all items (item, item_id, text), each to be judged with each; row and item name a table's row, also where ids repeat or are missing.
    small: the items may be broadcast."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    size = lambda table: read(spark, sf_dir, table).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size("documents") // TASK_BYTES))
    answers = read(spark, sf_dir, "documents").select(place.alias("row"), "doc_id", "text").repartition(parts, "row")
    return answers, read(spark, sf_dir, "benchmark").select(place.alias("item"), "item_id", "text"), size("benchmark") <= ITEM_BYTES


def with_empty(words):
    """The words and an empty one, so that what holds them meets everything."""
    return F.concat(F.coalesce(words, F.array().cast("array<string>")), F.array(F.lit("")))


#: All documents as answers and all items, each text normalised once; words of both counted once a text, and how many a pair shares.
_EACH = f"""d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_NORM('text')} AS p FROM documents), i AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, {_NORM('text')} AS g FROM benchmark)"""
_SHARED = f"""{_EACH}, dt AS MATERIALIZED (SELECT *, list_filter(string_split(p, ' '), lambda x: x <> '' AND x <> 'and') AS pt FROM d), it AS MATERIALIZED (SELECT *, list_filter(string_split(g, ' '), lambda x: x <> '' AND x <> 'and') AS gt FROM i),
 a AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(pt) AS w FROM dt) x GROUP BY ALL), b AS (SELECT q, w, count(*) AS n FROM (SELECT q, unnest(gt) AS w FROM it) x GROUP BY ALL),
 s AS (SELECT r, q, sum(least(a.n, b.n)) AS same FROM a JOIN b USING (w) GROUP BY ALL)"""


_GOLD_WORDS = "list_distinct(regexp_extract_all(lower(gold), '[^\\x20\\x09-\\x0D]+'))"


@query("judge_niah", f"SELECT doc_id, item_id, CAST(CASE WHEN pred = '' OR len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: contains(lower(pred), x))) / len(w) END AS DOUBLE) AS score FROM (SELECT doc_id, item_id, pred, {_GOLD_WORDS} AS w FROM ({_PAIRS}) t) u")
def judge_niah(spark, sf_dir):
    """The item's words, each of them whole, are the needles."""
    golds = F.array_distinct(F.regexp_extract_all(F.lower("gold"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return pairs(spark, sf_dir).withColumn("golds", golds).select("doc_id", "item_id", judge.needles(F.col("golds"), F.col("pred")).cast("double").alias("score"))


@query("judge_contains", "SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def judge_contains(spark, sf_dir):
    """Documents that hold a benchmark text as it is."""
    return retrieval.containing(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("token_f1", f"WITH {_SHARED} SELECT doc_id, item_id, CAST(round(coalesce(2.0 * same / (len(pt) + len(gt)), 0), 4) AS DOUBLE) AS f1 FROM dt CROSS JOIN it LEFT JOIN s ON s.r = dt.r AND s.q = it.q")
def token_f1(spark, sf_dir):
    """Every document with every item; they meet in the words that they share, and those that share none score 0."""
    answers, items, small = every(spark, sf_dir)
    tokens = lambda rows, size, *keys: rows.select(*keys, judge.f1_tokens(F.col("text")).alias("t")).select(*keys, F.coalesce(F.size("t"), F.lit(0)).alias(size), with_empty(F.col("t")).alias("words"))
    keys, item_keys = ["row", "doc_id"], ["item", "item_id"]
    met = retrieval.shared_words(tokens(answers, "size", *keys), tokens(items, "item_size", *item_keys), keys, item_keys, small)
    return met.select("doc_id", "item_id", F.round(judge.shared_f1("same", "size", "item_size"), 4).alias("f1"))


@query("rouge_l")
def rouge_l(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", "item_id", F.round(judge.rouge_l(F.array("gold"), F.col("pred")), 6).alias("rouge_l"))


_LIST = "SELECT o_orderkey AS id, string_agg(p_name, ', ' ORDER BY l_linenumber) AS pred, min(p_name) AS gold FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderkey % 10 = 0 GROUP BY o_orderkey"


def title_lists(spark, sf_dir):
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    rows = line.join(part, line.l_partkey == part.p_partkey).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("x"))
    return rows.select(F.col("l_orderkey").alias("id"), F.array_join(F.transform("x", lambda r: r["p_name"]), ", ").alias("pred"), F.array_min(F.transform("x", lambda r: r["p_name"])).alias("gold"))


@query("entity_name_join", "SELECT l_orderkey AS id, string_agg(p_name, ', ' ORDER BY l_linenumber, p_name) AS pred, min(p_name) AS gold FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def entity_name_join(spark, sf_dir):
    return title_lists(spark, sf_dir)


@query("split_recs", f"""WITH t AS (SELECT l_orderkey AS id, string_agg(concat(CAST(l_linenumber AS STRING), '. ', p_name, ' (', CAST(p_size AS STRING), ')'), chr(10) ORDER BY l_linenumber) AS pred FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
 s AS (SELECT id, unnest(list_filter(string_split_regex(pred, '[\\n,]'), lambda x: trim(x) <> '')) AS x FROM t)
 SELECT id, count(*) AS n, md5(string_agg(r, '|' ORDER BY r)) AS titles FROM (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(trim(x), '^\\s*\\d+[.)、:]?\\s*', ''), '\\([^()]*\\)', '', 'g'), '\\s+', ' ', 'g')) AS r FROM s) t GROUP BY id""")
def split_recs(spark, sf_dir):
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    each = F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), "p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))
    rows = line.join(part, line.l_partkey == part.p_partkey).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", each.alias("t")))).alias("x"))
    titles = extract.recommendations(F.array_join(F.transform("x", lambda r: r["t"]), "\n"))
    return rows.select(F.col("l_orderkey").alias("id"), F.size(titles).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(titles), "|")).alias("titles"))


@query("recall_at_k", f"WITH t AS (SELECT l_orderkey AS id, min(p_name) AS gold, list(p_name ORDER BY l_linenumber, p_name)[1:2] AS top FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) SELECT id, CASE WHEN list_contains(list_transform(top, lambda x: {_NORM('x')}), {_NORM('gold')}) THEN 1.0 ELSE 0.0 END AS recall FROM t")
def recall_at_k(spark, sf_dir):
    return title_lists(spark, sf_dir).select("id", judge.recall_at(F.array("gold"), F.col("pred"), 2).alias("recall"))


@query("recall_at_k_fuzzy")
def recall_at_k_fuzzy(spark, sf_dir):
    preds = F.transform(F.slice(extract.recommendations(F.col("pred")), 1, 2), text.normalize)
    return title_lists(spark, sf_dir).select("id", judge.similar_share(F.array(text.normalize(F.col("gold"))), preds).alias("recall"))


@query("lm_verdict_join", f"SELECT id, CAST(coalesce(v, 0) AS DOUBLE) AS correct, v IS NULL AS judge_error FROM ({_O}) o LEFT JOIN (SELECT doc_id, quality AS v FROM labels WHERE doc_id % 11 <> 0) l ON o.id = l.doc_id")
def lm_verdict_join(spark, sf_dir):
    verdicts = read(spark, sf_dir, "labels").where("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), F.col("quality").alias("v"))
    return outputs(spark, sf_dir).join(verdicts, "id", "left").select("id", judge.judged(F.lit("lm"), F.array("gold"), F.col("output"), F.col("v")).alias("correct"), F.col("v").isNull().alias("judge_error"))


@query("label_set", "SELECT source, array_to_string(list_sort(list_distinct(list(quality * 2 + toxic))), ',') AS labels FROM documents JOIN labels USING (doc_id) GROUP BY source")
def label_set(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("source", F.concat("text", F.lit("\nlabel: "), (F.col("quality") * 2 + F.col("toxic")).cast("string")).alias("doc"))
    found = rows.select("source", F.explode(extract.label_numbers(F.col("doc"))).alias("n"))
    return found.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("n")), ",").alias("labels"))


@query("group_std_filter", "WITH r AS (SELECT event_id, user_id % 40 AS uid, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS m, (row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) - 1) // 8 AS g FROM events) SELECT event_id, uid, CAST(g AS BIGINT) AS g FROM r QUALIFY stddev_pop(m) OVER (PARTITION BY uid, g) > 0")
def group_std_filter(spark, sf_dir):
    return metrics.informative_groups(rewarded(spark, sf_dir), "key", "m").select("event_id", "uid", "g")


def rewarded(spark, sf_dir):
    """Groups of eight events of a user, in order."""
    rows = run_sql(spark, sf_dir, "SELECT event_id, user_id % 40 AS uid, CASE WHEN event_type = 'purchase' THEN 1.0D ELSE 0.0D END AS m, CAST((row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) - 1) DIV 8 AS BIGINT) AS g FROM [events]")
    return rows.withColumn("key", F.struct("uid", "g"))


@query("filter_source", "SELECT doc_id, source FROM documents WHERE contains(source, 'src1')")
def filter_source(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(F.contains("source", F.lit("src1"))).select("doc_id", "source")


@query("clip_context", "SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text ELSE concat(regexp_replace(substr(text, 1, 323), '\\s+$', ''), chr(10), chr(10), '[... context truncated ...]', chr(10), chr(10), regexp_replace(right(text, 646), '^\\s+', '')) END) AS clipped FROM documents")
def clip_context(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(rules.clip(F.col("text"), 1000)).alias("clipped"))
