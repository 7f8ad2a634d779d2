"""Queries of spans, masks, prompts and small rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.functions import extract, judge, rules, spans, text
from memloom.operators import matrix, regroup, retrieval, schedules
from memloom.plans.corpus import _LINES, _MEMORIES, _chunks, _lengths, _memory
from memloom.plans.registry import ORACLE, OUTPUTS, query, read, run_sql
from memloom.plans.scoring import _EACH, _NORM, _PAIRS, _SHARED, every, outputs, pairs, with_empty

_N = "SELECT doc_id, CAST(n_chars % 200 + 1 AS INTEGER) AS n FROM {documents}"


def _n(spark, sf_dir):
    return run_sql(spark, sf_dir, _N.format(documents="[documents]"))


@query("message_spans", f"WITH t AS ({_N.format(documents='documents')}), b AS (SELECT doc_id, n, unnest(range(0, n, 9)) AS b FROM t), s AS (SELECT doc_id, n, b, unnest(range(b, least(b + 9, n), 4)) AS s FROM b) SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(least(s + 4, b + 9, n) AS INTEGER) AS e FROM s")
def message_spans(spark, sf_dir):
    ids = F.transform(spans.indices(F.col("n")), lambda i: F.when(i % 9 == 0, 7).otherwise(1))
    return _n(spark, sf_dir).select("doc_id", F.explode(spans.marked_spans(ids, 7, 4)).alias("x")).select("doc_id", "x.s", "x.e")


@query("stride_spans", "WITH t AS (SELECT doc_id, n_chars AS n, CASE WHEN n_chars BETWEEN 1792 AND 7679 THEN 256 WHEN n_chars < 1792 THEN 64 ELSE 512 END AS c FROM documents), s AS (SELECT doc_id, n, c, unnest(range(0, n, c)) AS s FROM t) SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(least(s + c, n) AS INTEGER) AS e FROM s")
def stride_spans(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("int").alias("n"))
    cut = spans.fixed_spans(F.col("n"), rules.resolved(F.col("n"))["chunk"])
    return rows.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.s", "x.e")


@query("page_drop", f"WITH t AS ({_N.format(documents='documents')}), p AS (SELECT doc_id, n, unnest(range(0, n // 16)) AS p FROM t) SELECT doc_id, CAST(p AS INTEGER) AS page FROM p WHERE n // 4 <= p * 16 AND (p + 1) * 16 <= 3 * n // 4")
def page_drop(spark, sf_dir):
    evicted = F.array(F.struct(F.expr("n DIV 4").cast("int").alias("s"), F.expr("3 * n DIV 4").cast("int").alias("e")))
    return _n(spark, sf_dir).select("doc_id", F.explode(spans.dropped_pages(evicted, F.col("n"), 16)).alias("page"))


@query("per_token_evict", f"SELECT doc_id, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n * i) AS BIGINT) AS chunk_sum FROM ({_LINES}) t GROUP BY doc_id")
def per_token_evict(spark, sf_dir):
    chunk = spans.per_token(F.col("n"), spans.indices(F.size("n")))
    rows = _lengths(spark, sf_dir).select("doc_id", chunk.alias("c"))
    return rows.select("doc_id", F.size("c").cast("long").alias("tokens"), F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("chunk_sum"))


@query("visible_counts", f"""WITH l AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM ({_LINES}) t), e AS (SELECT doc_id, i, n, CASE WHEN i < 1 THEN c ELSE least(c, i + 6) END AS evict_at FROM l)
 SELECT q.doc_id, CAST(q.i AS INTEGER) AS i, CAST(sum(k.n) AS BIGINT) AS visible FROM e q JOIN e k ON q.doc_id = k.doc_id AND k.i <= q.i AND k.evict_at > q.i GROUP BY q.doc_id, q.i""")
def visible_counts(spark, sf_dir):
    """Keys that a chunk's tokens see, counted by chunks and their lengths: no pairs of tokens or chunks."""
    return schedules.visible(schedules.evict_at(_chunks(spark, sf_dir), "doc_id", 6, -1, 1), "doc_id")


@query("loss_mask", "SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS labels, CAST(2 * length(text) AS BIGINT) AS total FROM conversations WHERE role = 'assistant'")
def loss_mask(spark, sf_dir):
    n = F.length("text")
    mask = F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), n))
    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", mask.alias("m"))
    return rows.select("conv_id", "turn", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x).alias("labels"), F.size("m").cast("long").alias("total"))


@query("collate_pack", "SELECT source, part, concat('0,', string_agg(CAST(cu AS STRING), ',' ORDER BY doc_id)) AS cu_seqlens, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS positions, CAST(sum(n * rn) AS BIGINT) AS seqs FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY source, part ORDER BY doc_id) AS BIGINT) AS cu, row_number() OVER (PARTITION BY source, part ORDER BY doc_id) - 1 AS rn FROM (SELECT source, doc_id // 1000 AS part, doc_id, n_chars % 50 + 1 AS n FROM documents) a) t GROUP BY source, part")
def collate_pack(spark, sf_dir):
    """Rows of a source in packs of a thousand ids: sequence ids, positions and the offsets of sequences."""
    n = (F.col("n_chars") % 50 + 1).cast("int")
    packs = read(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id DIV 1000").alias("part")).agg(regroup.ordered(F.struct("doc_id", n.alias("n"))).alias("x"))
    one = packs.select("source", "part", F.explode(F.array(spans.collated(F.transform("x", lambda r: r["n"])))).alias("c"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return one.select("source", "part", F.array_join("c.cu_seqlens", ",").alias("cu_seqlens"), total("c.position_ids").alias("positions"), total("c.seq_ids").alias("seqs"))


@query("unit_chunks", f"WITH g AS (SELECT doc_id, i // 4 AS g, sum(n) + count(*) - 1 AS n FROM ({_LINES}) t GROUP BY doc_id, i // 4), p AS (SELECT doc_id, g, n, unnest(CASE WHEN n > 500 THEN range(0, CAST(n AS BIGINT), 250) ELSE [0] END) AS s FROM g) SELECT doc_id, CAST(g AS INTEGER) AS unit, CAST(CASE WHEN n > 500 THEN least(250, n - s) ELSE n END AS INTEGER) AS n FROM p")
def unit_chunks(spark, sf_dir):
    units = F.transform(F.sequence(F.lit(0), F.size("u") - 1, F.lit(4)), lambda s: F.array_join(F.slice("u", s + 1, F.lit(4)), "\n"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("u")).select("doc_id", F.posexplode(units).alias("unit", "t"))
    n = F.length("t")
    sizes = F.when(n > 500, F.transform(F.sequence(F.lit(0), n - 1, F.lit(250)), lambda s: F.least(F.lit(250), n - s))).otherwise(F.array(n))
    return rows.select("doc_id", "unit", F.explode(sizes).alias("n"))


@query("official_prompts", "SELECT source AS id, md5(concat('Use only the memory context below to answer the question.', chr(10), 'Reply with a short entity, phrase, number, or sentence only.', chr(10), 'If the answer is not supported by the context, reply exactly: I don''t know.', chr(10), chr(10), string_agg(text, chr(10) || chr(10) ORDER BY doc_id), chr(10), chr(10), 'Question: {{x}}', chr(10), 'Answer:')) AS content FROM documents GROUP BY source".replace("FROM documents", f"FROM {_MEMORIES}"))
def official_prompts(spark, sf_dir):
    asked = F.replace(F.lit("Question: {question}\nAnswer:"), F.lit("{question}"), F.lit("{{x}}"))
    return _memory(spark, sf_dir).select("id", F.md5(F.concat(F.lit(rules.UNIFIED_HEADER + rules.SEPARATOR), F.array_join("memory_docs", rules.SEPARATOR), F.lit(rules.SEPARATOR), asked)).alias("content"))


@query("memory_query_split", "SELECT doc_id, length(text) AS m, trim('  what?  ') AS query FROM documents")
def memory_query_split(spark, sf_dir):
    found = rules.split_memory(F.concat("text", F.lit("\n\n  what?  ")), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(found["memory"]).cast("long").alias("m"), found["query"].alias("query"))


_MODELS = ", ".join(f"('{m}')" for m in matrix.MODELS)
_FAMILY = "CASE min(lang) WHEN 'de' THEN 'wiki' WHEN 'en' THEN 'ttl' WHEN 'es' THEN 'align' ELSE 'longqa' END"


@query("run_matrix", f"""WITH d AS (SELECT source AS dataset, {_FAMILY} AS family, count(*) % 2 = 0 AS pack FROM documents GROUP BY source, lang = 'es'), m(model) AS (VALUES {_MODELS}),
 r AS (SELECT model, dataset || CASE WHEN family = 'align' THEN '_official' ELSE '' END AS dataset, family, pack, unnest(CASE family WHEN 'align' THEN ['truncate-256k', 'truncate-128k'] WHEN 'wiki' THEN ['state-8k', 'truncate-256k', 'truncate-8k'] ELSE ['state-32k', 'truncate-256k', 'truncate-32k'] END) AS profile FROM d, m)
 SELECT model, dataset, profile, CASE WHEN profile LIKE 'state%' THEN profile ELSE 'truncate' END AS pool FROM r WHERE CASE WHEN family = 'align' THEN model IN ('qwen3-4b', 'delta') WHEN model = 'rag' THEN NOT pack AND profile = 'truncate-256k' WHEN model = 'recurrent' THEN profile = 'truncate-256k' WHEN model = 'memory' THEN true ELSE profile NOT LIKE 'state%' END""")
def run_matrix(spark, sf_dir):
    """The runs of the datasets that the documents hold: a source is one, its Spanish part an aligned one, and of an even number of documents a pack."""
    family = F.when(F.col("first") == "de", "wiki").when(F.col("first") == "en", "ttl").when(F.col("first") == "es", "align").otherwise("longqa")
    held = read(spark, sf_dir, "documents").groupBy("source", (F.col("lang") == "es").alias("aligned")).agg(F.min("lang").alias("first"), (F.count("*") % 2 == 0).alias("pack")).withColumn("family", family)
    sets = held.select(F.concat("source", F.when(F.col("family") == "align", "_official").otherwise("")).alias("dataset"), "family", "pack")
    return matrix.runs(spark, sets=matrix.present(sets))


@query("icl_pairs", "SELECT source, doc_id // 1000 AS part, count(*) AS n, md5(string_agg(concat('doc ', CAST(doc_id AS STRING), ' label: ', CAST(quality AS STRING)), '|' ORDER BY doc_id)) AS digest FROM documents JOIN labels USING (doc_id) GROUP BY source, doc_id // 1000")
def icl_pairs(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    rows = rows.groupBy("source", F.expr("doc_id DIV 1000").alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "quality"))).alias("x"))
    memory = F.array_join(F.transform("x", lambda r: F.concat(F.lit("doc "), r["doc_id"].cast("string"), F.lit("\nlabel: "), r["quality"].cast("string"))), "\n\n")
    found = rows.select("source", "part", F.explode(F.array(extract.icl_examples(memory))).alias("p"))
    return found.select("source", "part", F.size("p").cast("long").alias("n"), F.md5(F.array_join(F.transform("p", lambda p: F.concat(p["text"], F.lit(" "), p["label"])), "|")).alias("digest"))


@query("json_extract", "SELECT doc_id, CAST(quality AS STRING) AS q FROM labels")
def json_extract(spark, sf_dir):
    output = F.concat(F.lit("<think>{no</think> so "), F.when(F.col("doc_id") % 2 == 0, F.lit("```json\n")).otherwise(F.lit("")), F.lit('{"q": '), F.col("quality").cast("string"), F.lit("}"), F.when(F.col("doc_id") % 2 == 0, F.lit("\n```")).otherwise(F.lit("")))
    return read(spark, sf_dir, "labels").select("doc_id", F.get_json_object(extract.json_object(output), "$.q").alias("q"))


@query("judge_em", f"WITH {_EACH} SELECT doc_id, item_id, p = g AS correct FROM d CROSS JOIN i")
def judge_em(spark, sf_dir):
    """Every document with every item; a normalised text is one word, marked so that an empty one is a word too."""
    answers, items, small = every(spark, sf_dir)
    normal = F.concat(F.lit("="), text.normalize(F.col("text")))
    words = lambda rows, size, *keys: rows.select(*keys, normal.alias("t")).select(*keys, F.when(F.col("t").isNotNull(), 1).alias(size), with_empty(F.array("t")).alias("words"))
    keys, item_keys = ["row", "doc_id"], ["item", "item_id", "usable"]
    golds = items.withColumn("usable", F.col("text") != "")
    met = retrieval.shared_words(words(answers, "size", *keys), words(golds, "item_size", *item_keys), keys, item_keys, small)
    return met.select("doc_id", "item_id", F.when(F.col("size").isNotNull() & F.col("item_size").isNotNull(), (F.col("same") > 0) & F.col("usable")).alias("correct"))


_F1 = f"""(SELECT doc_id, CAST(coalesce(2.0 * same / (pn + gn), 0) AS DOUBLE) AS f1 FROM (SELECT t.doc_id, any_value(len(pw)) AS pn, any_value(len(gw)) AS gn, list_sum(list_transform(list_distinct(any_value(gw)), lambda w: least(len(list_filter(any_value(pw), lambda y: y = w)), len(list_filter(any_value(gw), lambda y: y = w))))) AS same FROM (SELECT doc_id, list_filter(string_split({_NORM('pred')}, ' '), lambda x: x <> '' AND x <> 'and') AS pw, list_filter(string_split({_NORM('gold')}, ' '), lambda x: x <> '' AND x <> 'and') AS gw FROM ({_PAIRS}) p) t GROUP BY t.doc_id) u)"""


@query("judge_dispatch", f"""SELECT doc_id, item_id, CAST(CASE WHEN pred = '' THEN 0 WHEN doc_id % 5 = 0 THEN CASE WHEN {_NORM('pred')} = {_NORM('gold')} AND gold <> '' THEN 1 ELSE 0 END WHEN doc_id % 5 = 1 THEN CASE WHEN contains({_NORM('pred')}, {_NORM('gold')}) AND {_NORM('gold')} <> '' THEN 1 ELSE 0 END
  WHEN doc_id % 5 = 2 THEN CASE WHEN contains(lower(pred), lower(gold)) THEN 1 ELSE 0 END WHEN doc_id % 5 = 3 THEN round(f1, 6) ELSE coalesce(quality, 0) END AS DOUBLE) AS score FROM ({_PAIRS}) t JOIN {_F1} f USING (doc_id) LEFT JOIN labels l USING (doc_id)""")
def judge_dispatch(spark, sf_dir):
    """The judges by turns, of whole golds: equal, contained, needle, F1, and a verdict that a model has given (here the label; none is 0)."""
    kind = F.get(F.array(*map(F.lit, ("em", "contains", "niah", "f1", "lm"))), F.pmod("doc_id", F.lit(5)).cast("int"))
    verdicts = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("v"))
    rows = pairs(spark, sf_dir).join(verdicts, "doc_id", "left").withColumn("kind", kind)
    return rows.select("doc_id", "item_id", F.round(judge.judged(F.col("kind"), F.array("gold"), F.col("pred"), F.col("v").cast("double")), 6).alias("score"))


def _words_sql(c: str) -> str:
    return f"list_filter(string_split({_NORM(c)}, ' '), lambda x: x <> '' AND x <> 'and')"


_PARTS = lambda c: f"list_filter(list_transform(string_split({c}, ','), lambda s: regexp_replace(s, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda s: s <> '')"


@query("locomo_f1", f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text AS pred FROM documents), i AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, text AS gold, item_id % 5 = 0 AS many FROM benchmark),
 c AS MATERIALIZED (SELECT r, many, c, {_words_sql('x')} AS cw FROM (SELECT r, many, unnest(xs) AS x, unnest(range(0, len(xs))) AS c FROM (SELECT r, true AS many, {_PARTS('pred')} AS xs FROM d UNION ALL SELECT r, false, [pred] FROM d) u) v),
 g AS MATERIALIZED (SELECT q, many, k, {_words_sql('x')} AS gw FROM (SELECT q, many, unnest(xs) AS x, unnest(range(0, len(xs))) AS k FROM (SELECT q, many, CASE WHEN many THEN {_PARTS('gold')} ELSE [gold] END AS xs FROM i) u) v),
 cn AS (SELECT r, many, c, size, w, count(*) AS n FROM (SELECT r, many, c, len(cw) AS size, unnest(cw) AS w FROM c) t GROUP BY ALL), gn AS (SELECT q, many, k, size, w, count(*) AS n FROM (SELECT q, many, k, len(gw) AS size, unnest(gw) AS w FROM g) t GROUP BY ALL),
 m AS (SELECT r, q, c, k, 2.0 * sum(least(cn.n, gn.n)) / (any_value(cn.size) + any_value(gn.size)) AS f FROM cn JOIN gn USING (many, w) GROUP BY r, q, c, k),
 b AS (SELECT r, q, sum(f) AS total FROM (SELECT r, q, k, max(f) AS f FROM m GROUP BY r, q, k) t GROUP BY r, q), n AS (SELECT q, count(*) AS n FROM g GROUP BY q)
 SELECT doc_id, item_id, CAST(round(coalesce(total / n, 0), 6) AS DOUBLE) AS f1 FROM d CROSS JOIN i LEFT JOIN b ON b.r = d.r AND b.q = i.q LEFT JOIN n ON n.q = i.q""")
def locomo_f1(spark, sf_dir):
    """Every document with every item: items of category 1 (ids divisible by 5) by the parts between commas, each one's best part of the document averaged, others as one answer."""
    answers, items, small = every(spark, sf_dir)
    parts = lambda c: F.filter(F.transform(F.split(c, ","), text.strip), lambda x: x != "")
    unit = lambda many, part, x: F.struct(many.alias("many"), part.alias("part"), x.alias("x"))
    yes, no = F.lit(True), F.lit(False)
    by_commas, as_one = F.transform(parts(F.col("text")), lambda x, k: unit(yes, k, x)), F.array(unit(no, F.lit(0), F.col("text")))
    met_anyway = lambda many: F.array(unit(many, F.lit(-1), F.lit(None).cast("string")))  # noqa: E731  the pair's 0 if nothing is shared

    def tokens(rows, size, units, *keys):
        each = rows.select(*keys, F.explode(units).alias("u")).select(*keys, "u.*").withColumn("t", judge.f1_tokens(F.col("x")))
        empty = F.array().cast("array<string>")
        return each.select(*keys, "many", "part", F.coalesce(F.size("t"), F.lit(0)).alias(size), F.when(F.col("part") < 0, F.array(F.lit(""))).otherwise(F.coalesce("t", empty)).alias("words"))

    none = F.array().cast("array<struct<many:boolean,part:int,x:string>>")
    found = tokens(answers, "size", F.concat(met_anyway(yes), met_anyway(no), F.coalesce(by_commas, none), as_one), "row", "doc_id").withColumnRenamed("part", "candidate")
    many = F.col("item_id") % 5 == 0
    golds = F.when(many, F.coalesce(by_commas, none)).otherwise(F.array(unit(no, F.lit(0), F.col("text"))))
    wanted = items.withColumn("many", F.coalesce(many, no)).withColumn("n", F.size(golds))
    asked = tokens(wanted, "item_size", F.concat(F.array(unit(F.col("many"), F.lit(-1), F.lit(None).cast("string"))), golds), "item", "item_id", "n")
    met = retrieval.shared_words(found, asked, ["row", "doc_id", "candidate"], ["item", "item_id", "n", "part"], small, on=("many",))
    best = met.groupBy("row", "doc_id", "item", "item_id", "n", "part").agg(F.max(judge.shared_f1("same", "size", "item_size")).alias("f"))
    scores = best.groupBy("row", "doc_id", "item", "item_id", "n").agg(F.sum("f").alias("total"))
    return scores.select("doc_id", "item_id", F.round(F.col("total") / F.greatest("n", F.lit(1)), 6).alias("f1"))


@query("extract_kinds", f"SELECT id, regexp_replace(trim(output), '(?i)^\\s*answer\\s*[:：]\\s*', '') AS answer FROM ({OUTPUTS.replace('[documents]', 'documents').replace('[labels]', 'labels')}) o")
def extract_kinds(spark, sf_dir):
    return outputs(spark, sf_dir).select("id", F.try_element_at(extract.extracted(F.col("output"), "raw", F.lit(1))["answers"], F.lit(1)).alias("answer"))


@query("parse_packed", f"SELECT id, len(list_distinct(regexp_extract_all(output, '(?mi)^\\s*A(\\d+)\\s*[:.]\\s*(.+)$', 1))) AS n FROM ({OUTPUTS.replace('[documents]', 'documents').replace('[labels]', 'labels')}) o WHERE kind = 'multi'")
def parse_packed(spark, sf_dir):
    return outputs(spark, sf_dir).where("kind = 'multi'").select("id", F.size(extract.packed_answers(F.col("output"))).cast("long").alias("n"))


@query("parse_spec", "SELECT doc_id, split_part(spec, ':', 1) AS ds, split_part(spec, ':', 2) AS split, CASE WHEN split_part(spec, ':', 3) = '' THEN NULL ELSE CAST(split_part(spec, ':', 3) AS BIGINT) END AS n FROM (SELECT doc_id, concat(source, ':train', CASE WHEN doc_id % 2 = 0 THEN concat(':', CAST(doc_id AS STRING)) ELSE '' END) AS spec FROM documents) t")
def parse_spec(spark, sf_dir):
    spec = F.concat("source", F.lit(":train"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(":"), F.col("doc_id").cast("string"))).otherwise(F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", rules.parsed_spec(spec).alias("x")).select("doc_id", "x.ds", "x.split", "x.n")


@query("truncate_tail", "SELECT doc_id, md5(CASE WHEN n_chars <= 500 THEN text ELSE substr(text, n_chars - 499, 500) END) AS tail FROM documents")
def truncate_tail(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(rules.tail(F.col("text"), 500)).alias("tail"))


@query("clamp_boundary", "SELECT doc_id, CAST(least(want, ((n_chars) // (64) + 1) * 64 - n_chars) AS BIGINT) AS granted FROM (SELECT doc_id, n_chars, doc_id % 90 + 1 AS want FROM documents) t")
def clamp_boundary(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", rules.to_boundary(F.col("n_chars"), F.col("doc_id") % 90 + 1, 64).alias("granted"))


@query("sliding_span", "SELECT doc_id, CAST(32 AS BIGINT) AS s, CAST(greatest(32, n_chars - 1024) AS BIGINT) AS e FROM documents")
def sliding_span(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", spans.sliding_span(F.col("n_chars"), 32, 1024).alias("x")).select("doc_id", "x.s", "x.e")


@query("tokenize_stats", "SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN n_chars > 8000 THEN 1 END) AS BIGINT) AS filtered, CAST(sum(CASE WHEN n_chars <= 8000 THEN n_chars ELSE 0 END) AS BIGINT) AS kept_chars FROM documents GROUP BY source")
def tokenize_stats(spark, sf_dir):
    """What is kept of each source under the length limit, by characters."""
    kept = F.col("n_chars") <= 8000
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(~kept).alias("filtered"), F.sum(F.when(kept, F.col("n_chars")).otherwise(0)).alias("kept_chars"))


@query("mix_len_stats", "SELECT round(avg(n_chars), 6) AS mean, max(n_chars) AS longest FROM (SELECT n_chars FROM documents ORDER BY doc_id LIMIT 2000) t")
def mix_len_stats(spark, sf_dir):
    head = read(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(2000)
    return head.agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("longest"))


@query("rank_slice", "SELECT doc_id, (doc_id) // (16) AS step, (doc_id % 16) // (4) AS rank, doc_id % 4 AS micro FROM documents")
def rank_slice(spark, sf_dir):
    """The step, rank and micro-batch of each place, 16 a step and 4 a rank."""
    return read(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id DIV 16").alias("step"), F.expr("doc_id % 16 DIV 4").alias("rank"), (F.col("doc_id") % 4).alias("micro"))


@query("sink_shift", "SELECT doc_id, CAST(i + 1 AS INTEGER) AS i, CAST(12 + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s, CAST(12 + sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS e FROM (SELECT doc_id, length(line) AS n, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) t) t UNION ALL SELECT doc_id, 0, 0, 12 FROM documents")
def sink_shift(spark, sf_dir):
    """Spans of a text's lines behind a system segment of 12 tokens, which is the first span."""
    shifted = spans.behind_sink(spans.chunk_spans(F.col("n")), 12)
    return _lengths(spark, sf_dir).select("doc_id", F.posexplode(shifted).alias("i", "x")).select("doc_id", "i", "x.s", "x.e")


@query("w0_curriculum", "SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('5|w0|' || CAST(doc_id AS STRING)), 1, 8) AS BIGINT) < 1288490188 THEN 1 ELSE 0 END AS forced FROM documents")
def w0_curriculum(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", (text.draw(5, "w0", F.col("doc_id")) < 1288490188 / 4294967296).cast("int").alias("forced"))


@query("synthetic_recall", "SELECT doc_id, CAST(k AS INTEGER) AS k, CAST('0x' || substr(md5('9|recall|' || CAST(doc_id * 8 + k AS STRING)), 1, 8) AS BIGINT) % 1000 AS v FROM (SELECT doc_id, unnest(range(0, 8)) AS k FROM documents) t")
def synthetic_recall(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return rows.select("doc_id", "k", (text.draw(9, "recall", F.col("doc_id") * 8 + F.col("k")) * 4294967296 % 1000).cast("long").alias("v"))


@query("niah_context", "SELECT doc_id, spot, md5(concat(substr(text, 1, spot), ' NEEDLE ', substr(text, spot + 1))) AS context FROM (SELECT doc_id, text, CAST(floor(0.05::DOUBLE * n_chars + 0.9::DOUBLE * n_chars * CAST('0x' || substr(md5('1|niah|' || CAST(doc_id AS STRING)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS BIGINT) AS spot FROM documents) t")
def niah_context(spark, sf_dir):
    at = F.floor(0.05 * F.col("n_chars") + 0.9 * F.col("n_chars") * (text.draw(1, "niah", F.col("doc_id")) * 4294967296) / 4294967296)
    rows = read(spark, sf_dir, "documents").withColumn("spot", at)
    return rows.select("doc_id", "spot", F.md5(rules.planted(F.col("text"), F.col("spot"), " NEEDLE ")).alias("context"))


@query("synth_budget", "SELECT doc_id, CAST(least(2048, greatest(256, 8192 - n_chars - 400)) AS BIGINT) AS budget FROM documents")
def synth_budget(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", rules.synthesis_budget(F.col("n_chars")).alias("budget"))


@query("supervised_positions", "SELECT conv_id, CAST(count(CASE WHEN next_label <> -100 THEN 1 END) AS BIGINT) AS supervised FROM (SELECT conv_id, lead(CASE WHEN role = 'assistant' THEN 1 ELSE -100 END) OVER (PARTITION BY conv_id ORDER BY turn) AS next_label FROM conversations) t GROUP BY conv_id")
def supervised_positions(spark, sf_dir):
    """Positions whose next label is supervised, as the loss shifts labels by one."""
    after = F.lead(F.when(F.col("role") == "assistant", 1).otherwise(-100)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return read(spark, sf_dir, "conversations").withColumn("after", after).groupBy("conv_id").agg(F.count_if(F.col("after") != -100).alias("supervised"))


@query("block_evict_static", "SELECT doc_id, CAST(greatest(0, (n_chars - 1024) // (16) - 2) AS BIGINT) AS evicted FROM documents WHERE n_chars > 1100")
def block_evict_static(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("n_chars > 1100").select("doc_id", F.size(spans.static_blocks(F.col("n_chars"), 32, 1024, 16)).cast("long").alias("evicted"))


@query("prompt_len_from_ids", f"SELECT doc_id, CAST(least((n - 1) // 9 * 9 + 3, n) AS INTEGER) AS p FROM ({_N.format(documents='documents')}) t")
def prompt_len_from_ids(spark, sf_dir):
    ids = F.transform(spans.indices(F.col("n")), lambda i: F.when(i % 9 == 0, 7).otherwise(1))
    last = F.array_max(F.filter(spans.indices(F.col("n")), lambda i: F.get("ids", i) == 7))
    return _n(spark, sf_dir).withColumn("ids", ids).select("doc_id", F.coalesce(F.least(last + 3, "n"), F.col("n")).alias("p"))


_AUX = f"""WITH {_SHARED} SELECT doc_id, item_id, g <> '' AND contains(p, g) AS rule, g <> '' AND p = g AS em, CAST(round(coalesce(2.0 * same / (len(pt) + len(gt)), 0), 4) AS DOUBLE) AS f1 FROM dt CROSS JOIN it LEFT JOIN s ON s.r = dt.r AND s.q = it.q"""


@query("aux_scores", _AUX)
def aux_scores(spark, sf_dir):
    """Every document with every item; a document's normalised text goes with the empty word in which it meets each of them, so that the item is sought in it there."""
    answers, items, small = every(spark, sf_dir)

    def tokens(rows, size, whole, *keys):
        bare = rows.select(*keys, text.normalize(F.col("text")).alias(whole))
        each = bare.withColumn("t", F.filter(F.split(whole, " "), lambda t: (t != "") & (t != "and")))
        return each.select(*keys, whole, F.coalesce(F.size("t"), F.lit(0)).alias(size), with_empty(F.col("t")).alias("words"))

    keys, item_keys = ["row", "doc_id"], ["item", "item_id", "gold"]
    here = lambda test: F.coalesce(F.max(F.when((F.col("word") == "") & (F.col("gold") != ""), test)), F.lit(False))
    met = retrieval.shared_words(
        tokens(answers, "size", "pred", *keys), tokens(items, "item_size", "gold", *item_keys[:2]), keys, item_keys, small,
        whole="pred", told=(here(F.contains("pred", "gold")).alias("rule"), here(F.col("pred") == F.col("gold")).alias("em")),
    )
    return met.select("doc_id", "item_id", "rule", "em", F.round(judge.shared_f1("same", "size", "item_size"), 4).alias("f1"))


@query("rag_context", f"SELECT query_id AS item_id, string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY unit_id) AS units FROM ({ORACLE['bm25_topk']}) t WHERE rank <= (SELECT CASE WHEN count(*) <= 20 THEN 1 ELSE 3 END FROM documents) GROUP BY query_id")
def rag_context(spark, sf_dir):
    """The units that score best for a query, again in document order; one of twenty units or fewer, else three."""
    units = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    k = 1 if units.limit(21).count() <= 20 else 3
    best = retrieval.bm25(units, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)
    chosen = best.groupBy(F.col("query_id").alias("item_id")).agg(F.array_sort(F.collect_list("unit_id")).alias("x"))  # k rows a query
    return chosen.select("item_id", F.array_join(F.transform("x", lambda x: x.cast("string")), ",").alias("units"))
