"""Queries of samples, evaluation splits, prompt forms, needles, label maps and page tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import extract, judge, rules, spans, text
from memloom.operators import checks, regroup, samples, splits
from memloom.plans.corpus import _BUCKET, _L, _LENGTH, _LINES, _lengths
from memloom.plans.registry import query, read, run_sql
from memloom.plans.scoring import _ITEMS, records


def _turns(spark, sf_dir, role):
    return read(spark, sf_dir, "conversations").where(F.col("role") == role).groupBy("conv_id").agg(regroup.ordered(F.struct("turn", "text")).alias("x")).select("conv_id", F.transform("x", lambda r: r["text"]).alias("items"))


# ---- label maps


@query("icl_mode", "SELECT source, part, max(n) >= 20 AND bool_and(a LIKE 'label: %') AS icl FROM (SELECT source, doc_id // 1000 AS part, CASE WHEN doc_id % 97 = 0 THEN 'x' ELSE 'label: ' || CAST(quality AS STRING) END AS a, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source, doc_id // 1000) AS n FROM documents JOIN labels USING (doc_id)) t WHERE rn <= 50 GROUP BY source, part")
def icl_mode(spark, sf_dir):
    """Whether a memory's answers are labels: twenty at least, and the first fifty all of that form."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("source", F.expr("doc_id DIV 1000").alias("part"), "doc_id", F.when(F.col("doc_id") % 97 == 0, "x").otherwise(F.concat(F.lit("label: "), F.col("quality").cast("string"))).alias("a"))
    head = splits.by_id(rows, ["source", "part"], "doc_id").where("place < 50")
    return head.groupBy("source", "part").agg(((F.max("n") >= 20) & F.bool_and(F.startswith("a", F.lit("label: ")))).alias("icl"))


@query("icl_bare", "SELECT item_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS bare FROM benchmark")
def icl_bare(spark, sf_dir):
    """The utterance comes out of both templates, and stays where there is none."""
    first = F.concat(F.lit('Use the mapping. Only output "label: {label}" and nothing else. \n\n'), "text", F.lit(" \n\n label:"))
    second = F.concat(F.lit("Classify.\nText: "), "text", F.lit("\n\nPut your label last."))
    asked = F.when(F.col("item_id") % 3 == 0, first).when(F.col("item_id") % 3 == 1, second).otherwise(text.strip(F.col("text")))
    return read(spark, sf_dir, "benchmark").select("item_id", F.md5(rules.bare_query(asked)).alias("bare"))


@query("label_coverage", "SELECT doc_id, CAST(len(list_distinct([quality, toxic, doc_id % 7])) AS INTEGER) AS labels, CAST(len(list_filter(list_distinct([quality, toxic, doc_id % 7]), lambda x: x IN (0, 1, 3))) AS INTEGER) AS covered FROM labels")
def label_coverage(spark, sf_dir):
    """Labels that a memory holds, and those that a rewritten one maps."""
    line = lambda c: F.concat(F.lit("some text\nlabel: "), c.cast("string"))
    memory = F.concat_ws("\n\n", line(F.col("quality")), line(F.col("toxic")), line(F.col("doc_id") % 7))
    block = F.lit("intents so far\n0: asks\nthe label 1 **: tells\n 3 | thanks\nof 5 others none")
    rows = read(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(extract.label_numbers(memory))).alias("known"))
    return rows.select("doc_id", F.size("known").alias("labels"), F.size(extract.mapped_labels(block, F.col("known"))).alias("covered"))


# ---- samples


@query("label_counts", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS supervised, CAST(sum(2 * length(text) + 12) AS BIGINT) AS tokens FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def label_counts(spark, sf_dir):
    """Supervised tokens, and tokens with a system segment of twelve, over a conversation's samples (a token a character)."""
    n = F.length("text")
    mask = F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), n))
    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", mask.alias("m"))
    return rows.groupBy("conv_id").agg(F.sum(F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x)).alias("supervised"), F.sum(F.size("m") + 12).alias("tokens"))


@query("sample_build", f"""WITH u AS (SELECT doc_id, i // 4 AS g, sum(n) + count(*) - 1 + CASE WHEN i // 4 = 0 THEN 17 ELSE 0 END AS n FROM ({_LINES}) t GROUP BY doc_id, i // 4),
 c AS (SELECT doc_id, n, unnest(CASE WHEN n > 500 THEN range(0, CAST(n AS BIGINT), 250) ELSE [0] END) AS s FROM u),
 a AS (SELECT doc_id, count(*) + 1 AS n_chunks, 1 AS n_qa, CAST(max(t) + 60 AS BIGINT) AS total, CAST(max(t) AS BIGINT) AS last FROM (SELECT doc_id, sum(n) OVER (PARTITION BY doc_id) AS t FROM (SELECT c.doc_id, CASE WHEN n > 500 THEN least(250, n - s) ELSE n END AS n FROM c) x) y GROUP BY doc_id),
 m AS (SELECT doc_id, sum(n) + 2 * (count(*) - 1) + 17 AS m FROM ({_LINES}) t GROUP BY doc_id),
 b AS (SELECT doc_id, CAST(ceil((m + 60) / 512.0) AS BIGINT) AS n_chunks, CAST(ceil((m + 60) / 512.0) - m // 512 AS BIGINT) AS n_qa, CAST(m + 60 AS BIGINT) AS total, CAST((ceil((m + 60) / 512.0) - 1) * 512 AS BIGINT) AS last FROM m)
 SELECT * FROM (SELECT * FROM a WHERE doc_id % 2 = 0 UNION ALL SELECT * FROM b WHERE doc_id % 2 = 1) z WHERE total <= 128000""")
def sample_build(spark, sf_dir):
    """Samples of a document's lines and a tail of 40 + 20 tokens (a token a character), by units for even ids and by tokens for odd ones; longer ones than the limit are left out."""
    unit = F.col("doc_id") % 2 == 0
    made = samples.layout(F.col("n"), F.lit(40), F.lit(20), F.when(unit, "unit").otherwise("token"), F.when(unit, 4).otherwise(512), F.when(unit, 500).otherwise(-1))
    rows = _lengths(spark, sf_dir).select("doc_id", F.explode(F.array(made)).alias("x")).where("x is not null")
    return rows.select("doc_id", F.size("x.chunk_spans").cast("long").alias("n_chunks"), F.size("x.qa_chunk_idx").cast("long").alias("n_qa"), F.col("x.total_len").cast("long").alias("total"), F.element_at("x.chunk_spans", -1)["s"].cast("long").alias("last"))


@query("chunk_config", "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 AND length(source) % 2 = 0 THEN 5 ELSE 10 + length(source) END AS INTEGER) AS size FROM documents")
def chunk_config(spark, sf_dir):
    """Settings of a row's dataset; those for packs count where there are any."""
    names = read(spark, sf_dir, "documents").select("source").distinct()
    own = names.select(F.col("source").alias("dataset"), (F.length("source") + 10).alias("size"))
    packs = names.where(F.length("source") % 2 == 0).select(F.concat("source", F.lit("-pack")).alias("dataset"), F.lit(5).alias("size"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset"), (F.col("doc_id") % 2 == 0).alias("pack"))
    return rules.chunk_config(rows, own.unionByName(packs)).select("doc_id", "size")


@query("equal_lengths", "SELECT conv_id, count(*) AS n, min(length(text) // 40) = max(length(text) // 40) AS equal FROM conversations GROUP BY conv_id")
def equal_lengths(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", spans.indices(F.floor(F.length("text") / 40).cast("int")).alias("ids"))
    return checks.equal_lengths(rows, "conv_id", "ids")


@query("text_forms", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'open' WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'ttl_single' ELSE 'ttl' END WHEN doc_id % 2 = 0 THEN 'single' ELSE 'multi' END AS form FROM documents")
def text_forms(spark, sf_dir):
    family = F.element_at(F.array(F.lit("long"), F.lit("ttl"), F.lit("ar")), (F.col("doc_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", rules.text_form(family, F.when(F.col("doc_id") % 2 == 0, "single").otherwise("pack")).alias("form"))


@query("to_list", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || '|' || CAST(user_id AS STRING) ELSE '' END AS items FROM events")
def to_list(spark, sf_dir):
    """Answers that come as a list, as one text or not at all."""
    name = F.concat(F.lit('"'), "event_type", F.lit('"'))
    raw = F.when(F.col("event_id") % 3 == 0, name).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), name, F.lit(', "'), F.col("user_id").cast("string"), F.lit('"]')))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(rules.as_list(raw), "|").alias("items"))


# ---- prompts

FORMS = ("open", "single", "multi", "ttl_single", "ttl", "recsys_single", "recsys")


def _turn_sql(form: str) -> str:
    """The same turn written out for the other engine."""
    quote = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    end = {"single": rules.SINGLE_DIRECTIVE, "multi": rules.MULTI_DIRECTIVE, "ttl_single": rules.LABEL_DIRECTIVE, "ttl": rules.TTL_DIRECTIVE, "recsys_single": rules.RECSYS_DIRECTIVE, "recsys": rules.RECSYS_PACK_DIRECTIVE}
    lines = lambda letter, gap=": ", by="\n": f"string_agg('{letter}' || CAST(rn AS STRING) || {quote(gap)} || text, {quote(by)} ORDER BY turn)"
    first = "min_by(text, turn)"
    body = {
        "open": first,
        "single": f"'Question: ' || {first}",
        "multi": quote("Answer all of the following questions.\n") + " || " + lines("Q"),
        "ttl_single": quote("Classify the following item. Valid labels: 0, 1.\nText: ") + f" || {first}",
        "ttl": quote("Classify each of the following items. Valid labels: 0, 1.\n") + " || " + lines("T"),
        "recsys_single": quote(rules.RECSYS_OPENING.format(where="in the new conversation") + "Conversation:\n") + f" || {first}",
        "recsys": quote(rules.RECSYS_OPENING.format(where="for each new conversation")) + " || " + lines("C", ":\n", "\n\n"),
    }[form]
    if form == "open":
        return first
    reasoned = "You may reason step by step first; then p" + end[form][1:]
    return quote("Remember.\n\n") + f" || {body} || " + quote("\n\n" + reasoned)


@query("prompt_forms", " UNION ALL ".join(f"SELECT conv_id, '{form}' AS form, md5({_turn_sql(form)}) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user') t GROUP BY conv_id" for form in FORMS))
def prompt_forms(spark, sf_dir):
    """The user's turn of every form over a conversation's questions."""
    made = F.array(*(F.struct(F.lit(form).alias("form"), F.md5(rules.user_turn(form, F.col("items"), F.array(F.lit(0), F.lit(1)), F.lit("Remember."), True)).alias("prompt")) for form in FORMS))
    return _turns(spark, sf_dir, "user").select("conv_id", F.explode(made).alias("x")).select("conv_id", "x.*")


@query("gold_forms", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'assistant'),
 g AS (SELECT conv_id, min_by(text, turn) AS first, string_agg('A' || CAST(rn AS STRING) || ': ' || text, chr(10) ORDER BY turn) AS a, string_agg('L' || CAST(rn AS STRING) || ': ' || text, chr(10) ORDER BY turn) AS l FROM t GROUP BY conv_id)
 SELECT conv_id, f.form, md5(CASE f.form WHEN 'open' THEN first WHEN 'single' THEN '```text' || chr(10) || 'Answer: ' || first || chr(10) || '```' WHEN 'multi' THEN '```text' || chr(10) || a || chr(10) || '```' ELSE '```text' || chr(10) || l || chr(10) || '```' END) AS gold FROM g, (VALUES ('open'), ('single'), ('multi'), ('ttl')) f(form)""")
def gold_forms(spark, sf_dir):
    made = F.array(*(F.struct(F.lit(form).alias("form"), F.md5(rules.gold_turn(form, F.col("items"))).alias("gold")) for form in ("open", "single", "multi", "ttl")))
    return _turns(spark, sf_dir, "assistant").select("conv_id", F.explode(made).alias("x")).select("conv_id", "x.*")


@query("update_prompt", "SELECT doc_id, md5('Current memory:' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '(empty)' ELSE source END || chr(10) || chr(10) || 'New text:' || chr(10) || text || chr(10) || chr(10) || 'Rewrite the memory to integrate any useful information from the new text. Keep it under about 2048 tokens. Output ONLY the updated memory.') AS prompt FROM documents")
def update_prompt(spark, sf_dir):
    block = F.when(F.col("doc_id") % 2 != 0, F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(rules.update_prompt(block, F.col("text"), F.lit(2048))).alias("prompt"))


@query("recurrent_fold", f"SELECT doc_id, left('|' || string_agg(line, '|' ORDER BY i), 300) AS block FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) t GROUP BY doc_id")
def recurrent_fold(spark, sf_dir):
    """A memory rewritten line by line and clipped each time; here the step appends, in place of a model."""
    block = spans.folded(F.split("text", "\n"), lambda held, line: F.concat(held, F.lit("|"), line), 300)
    return read(spark, sf_dir, "documents").select("doc_id", block.alias("block"))


# ---- splits of texts and evaluation splits


@query("split_by_lens", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS i, md5(text) AS doc FROM conversations WHERE trim(text) <> ''")
def split_by_lens(spark, sf_dir):
    """Documents come back from the joined memory by their lengths, whatever they hold."""
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(regroup.ordered(F.struct("turn", "text")).alias("x")).select("conv_id", F.transform("x", lambda r: r["text"]).alias("docs"))
    found = spans.split_by_lengths(F.array_join("docs", rules.SEPARATOR), F.transform("docs", lambda d: F.length(d)), len(rules.SEPARATOR))
    return rows.select("conv_id", F.posexplode(found).alias("i", "d")).select("conv_id", "i", F.md5("d").alias("doc"))


@query("text_bisect", "SELECT doc_id, CAST(n_chars AS BIGINT) AS total, true AS fits, md5(text) AS whole FROM documents")
def text_bisect(spark, sf_dir):
    """Halves of halves within the budget; together they are the text."""
    rows = read(spark, sf_dir, "documents").select("doc_id", samples.bisected(F.col("text"), 200).alias("p"))
    return rows.select("doc_id", F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("total"), F.forall("p", lambda x: text.estimated_tokens(x) <= 200).alias("fits"), F.md5(F.array_join("p", "")).alias("whole"))


def _memories(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.array("text").alias("memory_docs"), F.array(F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("qa"))


@query("eval_split_single", "SELECT doc_id AS row_idx, concat('set-test_single-', CAST(row_number() OVER (ORDER BY doc_id) - 1 AS STRING)) AS id FROM documents")
def eval_split_single(spark, sf_dir):
    return splits.eval_single(_memories(spark, sf_dir), "set").select("row_idx", "id")


@query("eval_split_explode", "SELECT concat('set-test_single-', CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS STRING)) AS id, conv_id AS row_idx, md5(text) AS question FROM conversations WHERE role = 'user'")
def eval_split_explode(spark, sf_dir):
    rows = _turns(spark, sf_dir, "user").select(F.col("conv_id").alias("row_idx"), F.array(F.lit("memory")).alias("memory_docs"), F.col("items").alias("qa"))
    return splits.eval_exploded(rows, "set").select("id", "row_idx", F.md5(F.get("qa", F.lit(0))).alias("question"))


@query("eval_split_pack", "SELECT concat('set-test_pack-', CAST(row_number() OVER (ORDER BY row_idx) - 1 AS STRING)) AS id, row_idx, n FROM (SELECT min(doc_id) AS row_idx, count(*) AS n FROM documents GROUP BY md5(text)) t")
def eval_split_pack(spark, sf_dir):
    """Rows that share a memory are a pack of all their questions, in the order in which memories come first."""
    return splits.eval_packs(_memories(spark, sf_dir), "set").select("id", "row_idx", F.size("qa").cast("long").alias("n"))


@query("eval_split_wiki", "WITH r AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS c FROM documents), o AS (SELECT *, rn // 5 AS pack, coalesce(sum(n) OVER (PARTITION BY rn // 5 ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r WHERE rn < c - c % 5) SELECT concat('set-test_pack-', CAST(pack AS STRING)) AS id, CAST(sum(n) AS BIGINT) AS n_docs, string_agg(CAST(CAST(off AS BIGINT) AS STRING), ',' ORDER BY rn) AS evidence FROM o GROUP BY pack")
def eval_split_wiki(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.split("text", "\n").alias("docs"), F.array(F.lit(0)).alias("evidence"))
    return splits.eval_wiki(rows, "set", 5).select("id", F.size("docs").cast("long").alias("n_docs"), F.array_join("evidence", ",").alias("evidence"))


# ---- needles, page tables, judges


@query("needle_tasks", """WITH t AS (SELECT doc_id, text, doc_id % 5 AS task, CASE WHEN doc_id % 5 < 2 THEN 1 ELSE 4 END AS n FROM documents),
 d AS (SELECT *, unnest(range(0, n)) AS k FROM t),
 h AS (SELECT doc_id, text, task, k, 0.05::DOUBLE + 0.9::DOUBLE * (CAST('0x' || substr(md5('4|depth|' || CAST(doc_id * 4 + k AS STRING)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS depth, 'One of the special magic numbers for key-' || CAST(CASE WHEN task = 4 THEN 0 ELSE k END AS STRING) || ' is: ' || CAST(1000000 + doc_id * 4 + k AS STRING) || '.' || chr(10) AS needle FROM d),
 s AS (SELECT doc_id, text, CAST(floor(length(text) * depth) AS BIGINT) AS cut, row_number() OVER (PARTITION BY doc_id ORDER BY depth) - 1 AS k FROM h),
 p AS (SELECT s.doc_id, s.text, s.cut, s.k, needle, lag(s.cut, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY s.k) AS before FROM s JOIN h ON h.doc_id = s.doc_id AND h.k = s.k)
 SELECT p.doc_id, md5(string_agg(substr(p.text, before + 1, cut - before) || needle, '' ORDER BY p.k) || substr(any_value(p.text), max(cut) + 1)) AS context, CAST(CASE WHEN p.doc_id % 5 = 3 THEN 4 ELSE 1 END AS INTEGER) AS questions, CAST(CASE WHEN p.doc_id % 5 = 4 THEN 4 ELSE 1 END AS INTEGER) AS golds FROM p GROUP BY p.doc_id""")
def needle_tasks(spark, sf_dir):
    """The five tasks, by id: one needle of a number, one of a code, four of which one is asked for, four that all are, four values of one key."""
    rows = read(spark, sf_dir, "documents").withColumns({"task": (F.col("doc_id") % 5).cast("int"), "ks": F.when(F.col("doc_id") % 5 < 2, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(4))))})
    head, middle, end = rules.NEEDLE.replace("{key}", "\0").replace("{value}", "\0").split("\0")
    needles = F.transform("ks", lambda k: F.concat(F.lit(head + "key-"), F.when(F.col("task") == 4, F.lit(0)).otherwise(k).cast("string"), F.lit(middle), (F.col("doc_id") * 4 + k + 1000000).cast("string"), F.lit(end)))
    depths = F.transform("ks", lambda k: 0.05 + 0.9 * text.draw(4, "depth", F.col("doc_id") * 4 + k))
    return rows.select("doc_id", F.md5(rules.hidden(F.col("text"), needles, depths)).alias("context"), F.when(F.col("task") == 3, 4).otherwise(1).alias("questions"), F.when(F.col("task") == 4, 4).otherwise(1).alias("golds"))


@query("page_compact", "WITH t AS (SELECT doc_id, n_chars % 200 + 1 AS n FROM documents), p AS (SELECT doc_id, n, unnest(range(0, (n + 15) // 16)) AS p FROM t), d AS (SELECT *, doc_id % 5 <> 0 AND (p + 1) * 16 <= n AND n // 4 <= p * 16 AND (p + 1) * 16 <= 3 * n // 4 AS gone FROM p) SELECT doc_id, CAST(sum(CASE WHEN gone THEN 0 ELSE p * 7 + 3 END) AS BIGINT) AS pages, CAST(max(n) - 16 * count(CASE WHEN gone THEN 1 END) AS BIGINT) AS n FROM d GROUP BY doc_id")
def page_compact(spark, sf_dir):
    """Page tables without evicted pages; rows that are being written (every fifth) pass as they are."""
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 200 + 1).cast("int").alias("n"))
    evicted = F.array(F.struct(F.expr("n DIV 4").cast("int").alias("s"), F.expr("3 * n DIV 4").cast("int").alias("e")))
    rows = rows.select("doc_id", "n", F.transform(spans.indices(F.ceil(F.col("n") / 16).cast("int")), lambda p: p * 7 + 3).alias("pages"), F.when(F.col("doc_id") % 5 != 0, spans.dropped_pages(evicted, F.col("n"), 16)).otherwise(F.array().cast("array<int>")).alias("dropped"))
    kept = rows.select("doc_id", F.explode(F.array(spans.compacted(F.col("pages"), F.col("dropped"), F.col("n"), 16))).alias("x"))
    return kept.select("doc_id", F.aggregate("x.pages", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("pages"), F.col("x.n").cast("long").alias("n"))


@query("judge_chain", f"{_ITEMS} SELECT j.id, CAST(item - 1 AS INTEGER) AS item, CAST(CASE WHEN correct = 1 THEN 1 WHEN j.id % 3 = 0 THEN l.toxic WHEN rule THEN 1 ELSE 0 END AS DOUBLE) AS score FROM j JOIN labels l ON l.doc_id = j.id")
def judge_chain(spark, sf_dir):
    """An exact match, else a model's verdict (here there is one for every third output), else containment."""
    items = records(spark, sf_dir).select("id", F.explode("items").alias("i")).join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic"), "id")
    verdict = F.when(F.col("id") % 3 == 0, F.col("toxic").cast("double"))
    return items.select("id", "i.item", judge.chained(F.col("i.golds"), F.col("i.pred"), verdict).alias("score"))


# ---- recipes


@query("recipe_cap_first", f"SELECT doc_id FROM (SELECT doc_id, {_BUCKET} AS bucket FROM ({_L}) t) b WHERE bucket IS NOT NULL AND bucket <> 1 ORDER BY doc_id % 2, md5('2|cap|' || CAST(doc_id AS STRING)), doc_id LIMIT 100")
def recipe_cap_first(spark, sf_dir):
    """Packs (even ids) before single rows, up to the dataset's cap."""
    rows = run_sql(spark, sf_dir, _LENGTH).select("doc_id", rules.bucket(F.col("p")).alias("bucket"), (F.col("doc_id") % 2).alias("priority")).where("bucket <> 1")
    return splits.cap_first(rows, "priority", text.order_key(2, "cap", F.col("doc_id")), "doc_id", 100).select("doc_id")


@query("recipe_giant", f"""WITH r AS (SELECT doc_id, bucket, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS late, md5('2|giant|' || CAST(doc_id AS STRING)) AS h FROM (SELECT doc_id, {_BUCKET} AS bucket FROM ({_L}) t) b WHERE bucket IS NOT NULL AND bucket <> 1),
 p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY late, h, doc_id) AS rn, row_number() OVER (ORDER BY late, h, doc_id) AS pos FROM r),
 s AS (SELECT count(*) AS met, max(pos) AS stop FROM p WHERE bucket = 2 AND rn = 60 OR bucket = 3 AND rn = 40)
 SELECT doc_id, bucket FROM p, s WHERE CASE WHEN bucket = 2 THEN rn <= 60 WHEN bucket = 3 THEN rn <= 40 ELSE late = 0 OR met < 2 OR pos <= stop END""")
def recipe_giant(spark, sf_dir):
    rows = run_sql(spark, sf_dir, _LENGTH).select("doc_id", rules.bucket(F.col("p")).alias("bucket"), (F.col("doc_id") % 4 == 0).alias("pack")).where("bucket <> 1")
    return splits.giant(rows, "pack", "bucket", text.order_key(2, "giant", F.col("doc_id")), "doc_id", {2: 60, 3: 40}).select("doc_id", "bucket")


# ---- official prompts and small rules

OFFICIAL = ("c2l", "locomo", "longmemeval", "eventqa", "in_context_learning", "recsys_redial", "factconsolidation", "unified")


def _official_sql(kind: str) -> str:
    quote = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    memory, asked = rules.OFFICIAL[kind]
    return f"replace({quote(memory)}, '{{context}}', text) || chr(30) || replace({quote(asked)}, '{{question}}', 'why ' || source || '?')"


@query("official_forms", " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, md5({_official_sql(kind)}) AS prompt FROM documents" for kind in OFFICIAL))
def official_forms(spark, sf_dir):
    asked = F.concat(F.lit("why "), "source", F.lit("?"))
    made = F.array(*(F.struct(F.lit(kind).alias("kind"), rules.official(kind, F.col("text"), asked).alias("p")) for kind in OFFICIAL))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(made).alias("x")).select("doc_id", "x.kind", F.md5(F.concat("x.p.memory", F.lit("\x1e"), "x.p.query")).alias("prompt"))


@query("default_budget", "SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 512 WHEN doc_id % 2 = 0 THEN 8192 ELSE 1024 END AS INTEGER) AS budget FROM documents")
def default_budget(spark, sf_dir):
    given = F.when(F.col("doc_id") % 3 == 0, 512)
    return read(spark, sf_dir, "documents").select("doc_id", rules.default_budget(given, F.col("doc_id") % 2 == 0).alias("budget"))


@query("frontier_message", f"WITH l AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS e, count(*) OVER (PARTITION BY doc_id) AS c, sum(n) OVER (PARTITION BY doc_id) AS total FROM ({_LINES}) t) SELECT doc_id, CAST(least(count(CASE WHEN e < total // 2 THEN 1 END), max(c) - 1) AS INTEGER) AS chunk FROM l GROUP BY doc_id")
def frontier_message(spark, sf_dir):
    """The chunk that holds a text's middle, where chunks are its lines."""
    rows = _lengths(spark, sf_dir).select("doc_id", F.explode(F.array(F.transform(spans.chunk_spans(F.col("n")), lambda x: x["e"]))).alias("ends"))
    return rows.select("doc_id", spans.chunk_of(F.col("ends"), F.floor(F.element_at("ends", -1) / 2)).alias("chunk"))


_QUOTE = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _filled_sql(template: str, **values: str) -> str:
    out = []
    for name, value in values.items():
        head, _, template = template.partition("{%s}" % name)
        out += [_QUOTE(head), value]
    return " || ".join([*out, _QUOTE(template)])


@query("model_prompts", f"""WITH t AS (SELECT doc_id, text, source, CASE WHEN quality = toxic THEN [quality] ELSE [0, 1] END AS labels FROM documents JOIN labels USING (doc_id))
 SELECT doc_id, md5({_filled_sql(rules.MAPPING, count="CAST(len(labels) AS VARCHAR)", required="array_to_string(labels, ', ')", block="CASE WHEN doc_id % 2 = 0 THEN '(empty)' ELSE source END", chunk="text", budget="'4096'")}) AS mapping,
 md5({_filled_sql(rules.QUESTIONS, n="CAST(doc_id % 9 + 1 AS VARCHAR)", summary="text")}) AS questions, md5({_filled_sql(rules.RETRIEVE[1], task=_QUOTE(rules.RETRIEVE[0]), query="text")}) AS retrieval FROM t""")
def model_prompts(spark, sf_dir):
    """What a model is asked to keep a mapping of labels, to make questions, and to embed a query, around whole texts."""
    labels = F.array_sort(F.array_distinct(F.array("quality", "toxic")))
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    block = F.when(F.col("doc_id") % 2 != 0, F.col("source"))
    return rows.select("doc_id", F.md5(rules.mapping_prompt(block, F.col("text"), F.lit(4096), labels)).alias("mapping"), F.md5(rules.questions_prompt(F.col("text"), F.col("doc_id") % 9 + 1)).alias("questions"), F.md5(rules.retrieval_query(F.col("text"))).alias("retrieval"))
