"""Queries of packed training rows and samples of tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import rules, spans
from memloom.operators import recall, regroup, samples, schedules, sequential, visibility
from memloom.plans import stateful  # noqa: F401  its SQL is used here
from memloom.plans.registry import ORACLE, query, read
from memloom.sources.arrow_files import read_arrow, write_arrow
from memloom.sources.io import complaint, shared_folder
from memloom.sources.sinks import read_rows, write_rows

_WORDS = r"[^\x20\x09-\x0D]+"
#: Documents as rows of tokens, a word each: every 300th opens a turn, positions start anew every 4,000 words, and every 97th is padding.
_SEGMENTS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), t AS (SELECT doc_id, unnest(range(0, len(w))) AS i FROM w),
 v AS (SELECT doc_id, i, i % 300 = 0 AS turn, i % 4000 = 0 AS fresh, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM t WHERE i % 97 <> 96),
 g AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS seg, max(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS any_ FROM v),
 s AS (SELECT doc_id, i, turn, CASE WHEN any_ = 0 THEN 0 ELSE seg - 1 END AS seq, row_number() OVER (PARTITION BY doc_id, seg ORDER BY i) - 1 AS p FROM g WHERE any_ = 0 OR seg > 0),
 a AS (SELECT doc_id, seq, count(*) AS n, min(CASE WHEN turn AND p > 0 THEN p END) AS first, max(CASE WHEN turn THEN p END) AS last FROM s GROUP BY doc_id, seq),
 b AS (SELECT doc_id, seq, n, CAST(ceil(coalesce(first, 32) / 32.0) AS BIGINT) * 32 AS sink, coalesce(least(last + 3, n), n) AS prompt FROM a),
 r AS (SELECT *, CASE WHEN prompt < 1792 THEN 64 WHEN prompt < 7680 THEN 256 ELSE 512 END AS chunk, CASE WHEN prompt < 1792 THEN 512 WHEN prompt < 7680 THEN 1024 WHEN prompt < 15360 THEN 2048 WHEN prompt < 30720 THEN 4096 ELSE 8192 END AS win FROM b),
 c AS (SELECT *, CASE WHEN n <= sink THEN 1 ELSE 1 + CAST(ceil((n - sink) * 1.0 / chunk) AS BIGINT) END AS chunks FROM r),
 x AS (SELECT s.doc_id, s.i, s.seq, CASE WHEN p < sink THEN 0 ELSE 1 + (p - sink) // chunk END AS c, c.chunks, c.sink, c.chunk, c.win FROM s JOIN c USING (doc_id, seq)),
 y AS (SELECT doc_id, i, seq, c, CASE WHEN c = 0 THEN chunks ELSE least(chunks, c + greatest(1, CASE WHEN win < sink THEN 0 ELSE (win - sink) // chunk END)) END AS e FROM x),
 z AS (SELECT t.doc_id, t.i, coalesce(y.c, 0) AS c, coalesce(y.e, 1073741824) AS e, coalesce(y.seq, 0) AS q FROM t LEFT JOIN y ON t.doc_id = y.doc_id AND t.i = y.i)
SELECT doc_id, count(*) AS tokens, CAST(max(q) + 1 AS INTEGER) AS sequences, md5(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS chunk_ids, md5(string_agg(CAST(e AS VARCHAR), ',' ORDER BY i)) AS evict_steps, md5(string_agg(CAST(q AS VARCHAR), ',' ORDER BY i)) AS seq_ids FROM z GROUP BY doc_id
"""


@query("segment_schedule", _SEGMENTS)
def segment_schedule(spark, sf_dir):
    """The schedules of all tokens, a digest for each of the three arrays."""
    words = read(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))).alias("n")).where("n > 0")
    places = spans.indices(F.col("n"))
    rows = words.select(
        F.col("doc_id").alias("row"),
        F.transform(places, lambda i: F.when(i % 300 == 0, schedules.TURN).otherwise(i)).alias("ids"),
        F.transform(places, lambda i: (i % 97 != 96).cast("int")).alias("mask"),
        F.transform(places, lambda i: i % 4000).alias("positions"),
    )
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    found = schedules.segment_schedule(rows)
    return found.select(F.col("row").alias("doc_id"), F.size("chunk_ids").cast("long").alias("tokens"), (F.array_max("seq_ids") + 1).alias("sequences"), digest("chunk_ids").alias("chunk_ids"), digest("evict_steps").alias("evict_steps"), digest("seq_ids").alias("seq_ids"))


#: Opener, and joints of documents by units and by tokens, as ids that no word has. Fixed for these queries.
_OPENER, _JOINTS = [9001, 9002, 9003], ([9010], [9011, 9012])


def _samples(spark, sf_dir):
    """(doc_id, sample): a document's lines as the memory, a word a token (its length the id), by units of three lines for even ids and by 64 tokens for odd ones."""
    docs = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line: F.transform(F.regexp_extract_all(line, F.lit(_WORDS), F.lit(0)), F.length))
    unit = F.col("doc_id") % 2 == 0
    tail = lambda *ids: F.array(*ids).cast("array<int>")
    made = samples.assembled(F.col("docs"), tail(F.lit(9020), F.lit(9021)), tail(F.col("doc_id") % 100, F.lit(9030)), F.when(unit, "unit").otherwise("token"), F.when(unit, 3).otherwise(64), F.when(unit, 40).otherwise(-1), F.lit(8), _OPENER, _JOINTS)
    return read(spark, sf_dir, "documents").select("doc_id", docs.alias("docs")).select("doc_id", made.alias("sample"))


_SAMPLE_TOKENS = r"""
WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: list_transform(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), lambda w: length(w))) AS docs FROM documents),
 m AS (SELECT doc_id, docs, doc_id % 2 = 0 AS unit, CASE WHEN doc_id % 2 = 0 THEN flatten(list_transform(docs, lambda d, i: list_concat(CASE WHEN i = 1 THEN [9001, 9002, 9003] WHEN (i - 1) % 3 = 0 THEN [] ELSE [9010] END, d)))
   ELSE list_concat([9001, 9002, 9003], flatten(list_transform(docs, lambda d, i: list_concat(CASE WHEN i = 1 THEN [] ELSE [9011, 9012] END, d)))) END AS memory FROM l),
 g AS (SELECT doc_id, unnest(range(0, len(docs), 3)) AS s, docs FROM m WHERE unit),
 u AS (SELECT doc_id, s, len(flatten(docs[s + 1 : s + 3])) + least(3, len(docs) - s) - 1 + CASE WHEN s = 0 THEN 3 ELSE 0 END AS n FROM g),
 c AS (SELECT doc_id, sum(CASE WHEN n > 40 THEN CAST(ceil(n / 20.0) AS BIGINT) ELSE 1 END) + 1 AS chunks, 1 AS qa FROM u GROUP BY doc_id UNION ALL SELECT doc_id, CAST(ceil((len(memory) + 4) / 64.0) AS BIGINT), CAST(ceil((len(memory) + 4) / 64.0) AS BIGINT) - len(memory) // 64 FROM m WHERE NOT unit)
SELECT doc_id, md5(array_to_string(list_concat(memory, [9020, 9021, doc_id % 100, 9030]), ',')) AS input_ids, CAST(len(memory) + 4 AS BIGINT) AS total, CAST(2 AS BIGINT) AS supervised, CAST(chunks AS BIGINT) AS chunks, CAST(qa AS BIGINT) AS qa_chunks FROM m JOIN c USING (doc_id) WHERE len(memory) + 4 <= 128000
"""


@query("sample_tokens", _SAMPLE_TOKENS)
def sample_tokens(spark, sf_dir):
    """Whole samples, written as Arrow IPC files without those that are too long, and read back."""
    path = shared_folder(spark, "samples")
    rows = _samples(spark, sf_dir)
    write_arrow(rows.select("doc_id", F.col("sample.input_ids").alias("input_ids"), F.col("sample.loss_mask").alias("loss_mask"), F.col("sample.chunk_spans").alias("chunk_spans"), F.col("sample.qa_chunk_idx").alias("qa_chunk_idx")), path, "input_ids")
    found = read_arrow(spark, path, "doc_id long, input_ids array<int>, loss_mask array<tinyint>, chunk_spans array<struct<s:int,e:int>>, qa_chunk_idx array<int>")
    return found.select(
        "doc_id",
        F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")).alias("input_ids"),
        F.size("input_ids").cast("long").alias("total"),
        F.aggregate("loss_mask", F.lit(0).cast("long"), lambda s, x: s + x).alias("supervised"),
        F.size("chunk_spans").cast("long").alias("chunks"),
        F.size("qa_chunk_idx").cast("long").alias("qa_chunks"),
    )


@query("sink_rows", "SELECT CAST(conv_id AS VARCHAR) AS id, count(*) FILTER (role = 'system') AS docs, count(*) FILTER (role = 'user') AS questions, md5(string_agg(text, '|' ORDER BY turn) FILTER (role = 'user')) AS digest FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0")
def sink_rows(spark, sf_dir):
    """Memory-question rows through the validating sink and back: system turns are documents, user turns questions that the role answers."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id", F.expr("turn DIV 512").alias("part")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))  # 512 turns of a conversation
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "t"))).alias("p")).select("conv_id", F.flatten(F.transform("p", lambda x: x["t"])).alias("t"))
    of = lambda role: F.filter("t", lambda x: x["role"] == role)
    qa = F.transform(of("user"), lambda x: F.struct(x["text"].alias("question"), F.array(x["role"]).alias("answer")))
    rows = whole.select(F.col("conv_id").cast("string").alias("id"), F.lit("conversations").alias("source"), F.lit("AR").alias("task_type"), F.transform(of("system"), lambda x: x["text"]).alias("memory_docs"), qa.alias("qa")).where(F.size("qa") > 0)
    write_rows(rows, path := shared_folder(spark, "rows"), complaint(), "id")
    found = read_rows(spark, path, qa="array<struct<question:string,answer:array<string>>>")
    return found.select("id", F.size("memory_docs").cast("long").alias("docs"), F.size("qa").cast("long").alias("questions"), F.md5(F.array_join(F.transform("qa", lambda q: q["question"]), "|")).alias("digest"))


#: A document's lines as runs of tokens (a token a character): lines of four are a document, every third line is shared and the others are of two segments, every fifth is evicted, a line is a chunk that stays for six.
_RUNS = "(SELECT doc_id, i, length(line) AS n, i // 4 AS d, CASE WHEN i % 3 = 0 THEN 0 ELSE i % 2 + 1 END AS s, i % 5 = 4 AS e, i + 6 AS g FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) l)"


def _runs(spark, sf_dir):
    each = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    segment = F.when(F.col("i") % 3 == 0, 0).otherwise(F.col("i") % 2 + 1)
    return each.select("doc_id", "i", F.length("line").alias("n"), F.expr("i DIV 4").alias("d"), segment.alias("s"), (F.col("i") % 5 == 4).alias("e"), F.col("i").alias("c"), (F.col("i") + 6).alias("g"))


def _seen_sql(mask: str) -> str:
    return f"SELECT q.doc_id, CAST(q.i AS INTEGER) AS i, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS visible FROM {_RUNS} q LEFT JOIN {_RUNS} k ON q.doc_id = k.doc_id AND k.i <= q.i AND {mask} GROUP BY q.doc_id, q.i"


_STATIC, _SEGMENT, _DOCUMENT, _DYNAMIC = "(NOT k.e OR q.e)", "(k.s = 0 OR k.s = q.s)", "k.d = q.d", "k.g > q.i"


@query("visible_static", _seen_sql(_STATIC))
def visible_static(spark, sf_dir):
    return visibility.seen(_runs(spark, sf_dir), "doc_id", evicted="e")


@query("visible_segments", _seen_sql(_SEGMENT))
def visible_segments(spark, sf_dir):
    return visibility.seen(_runs(spark, sf_dir), "doc_id", segment="s")


@query("visible_documents", _seen_sql(_DOCUMENT))
def visible_documents(spark, sf_dir):
    return visibility.seen(_runs(spark, sf_dir), "doc_id", document="d")


@query("visible_all", _seen_sql(f"{_STATIC} AND {_SEGMENT} AND {_DYNAMIC}"))
def visible_all(spark, sf_dir):
    """Static and dynamic eviction and segments together."""
    return visibility.seen(_runs(spark, sf_dir), "doc_id", segment="s", evicted="e", chunk="c", evict_at="g")


_HASHED = lambda salt, place: f"(CAST('0x' || substr(md5('6|{salt}|' || CAST({place} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query("recall_packs", f"""WITH k AS (SELECT doc_id, unnest(range(0, 12)) AS k FROM documents),
 v AS (SELECT doc_id, k, CAST(200 + floor({_HASHED('value', 'doc_id * 12 + k')} * 300) AS INTEGER) AS v, row_number() OVER (PARTITION BY doc_id ORDER BY {_HASHED('asked', 'doc_id * 12 + k')}, k) AS a FROM k),
 m AS (SELECT doc_id, flatten(list([CAST(k + 10 AS INTEGER), 3, v, 4] ORDER BY k)) AS ids FROM v GROUP BY doc_id), q AS (SELECT doc_id, flatten(list([5, CAST(k + 10 AS INTEGER), 6, v, 7] ORDER BY a)) AS ids, flatten(list([-100, -100, -100, v, 7] ORDER BY a)) AS labels FROM v WHERE a <= 4 GROUP BY doc_id)
 SELECT doc_id, array_to_string(list_concat(m.ids, q.ids), ',') AS input_ids, array_to_string(list_concat(list_transform(range(0, 48), lambda x: -100), q.labels), ',') AS labels, CAST(48 AS BIGINT) AS written, CAST(48 AS BIGINT) AS evicted, array_to_string(list_concat(list_transform(range(0, 48), lambda x: 0), list_transform(range(0, 20), lambda x: x // 5 + 1)), ',') AS segments FROM m JOIN q USING (doc_id)""")
def recall_packs(spark, sf_dir):
    """A row of twelve pairs and four questions for each document."""
    rows = recall.packed(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row")), 6, 12, 4, 300)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select(
        F.col("row").alias("doc_id"), joined("input_ids").alias("input_ids"), joined("labels").alias("labels"), F.aggregate("write_mask", F.lit(0.0), lambda s, x: s + x).cast("long").alias("written"),
        F.size(F.filter("is_evicted", lambda x: x)).cast("long").alias("evicted"), joined("segment_ids").alias("segments"),
    )


@query("dynamic_pack_rows", """WITH g AS (SELECT min(doc_id) AS row_idx, list(doc_id ORDER BY doc_id) AS q FROM documents GROUP BY text), n AS (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS idx FROM g), p AS (SELECT *, unnest(CASE WHEN len(q) > 2 THEN range(0, len(q), 2) ELSE [0] END) AS s FROM n)
 SELECT source || '-dynpack-' || CAST(idx AS VARCHAR) || CASE WHEN len(q) > 2 THEN '#pack' || CAST(s // 2 AS VARCHAR) ELSE '' END AS id, row_idx, lang, array_to_string(q[s + 1 : s + 2], ',') AS questions, 'true' AS packed, lang || '!' AS own, CASE WHEN len(q) > 2 THEN CAST(len(q) AS VARCHAR) END AS original, CASE WHEN len(q) > 2 THEN CAST(s AS VARCHAR) END AS start FROM p JOIN documents ON doc_id = row_idx""")
def dynamic_pack_rows(spark, sf_dir):
    """Documents of equal texts as one memory, two questions a pack, with the first one's language and what its meta says."""
    own = F.to_json(F.struct(F.concat("lang", F.lit("!")).alias("own")))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("id"), "source", "lang", F.array("text").alias("memory_docs"), F.array(F.col("doc_id").cast("string")).alias("qa"), own.alias("meta"))
    said = lambda key: F.get_json_object("meta", f"$.{key}")
    found = regroup.dynamic_pack_rows(rows, 2)
    return found.select("id", "row_idx", "lang", F.array_join("qa", ",").alias("questions"), said("dynamic_pack").alias("packed"), said("own").alias("own"), said("eval_pack_orig_n_qa").alias("original"), said("eval_pack_start").alias("start"))


@query("memory_rewrites", "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'other ' || text || chr(10) || chr(10) || 'what of ' || source || '?' WHEN lang = 'en' THEN 'what of ' || source || '?' ELSE 'block ' || lang || chr(10) || chr(10) || 'what of ' || source || '?' END) AS content, CAST(2 AS BIGINT) AS messages FROM documents")
def memory_rewrites(spark, sf_dir):
    """The memory of a last turn replaced by another one, or by none in English documents; every third turn doesn't begin with the memory and stays whole as the query."""
    turn = F.concat(F.when(F.col("doc_id") % 3 == 0, "other ").otherwise(""), "text", F.lit("\n\n"), F.lit("what of "), "source", F.lit("? "))
    rows = read(spark, sf_dir, "documents").withColumn("m", F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.lit("user").alias("role"), turn.alias("content"))))
    rows = rows.withColumn("split", rules.split_memory(F.element_at("m", -1)["content"], F.col("text")))
    block = F.when((F.col("split.memory") == "") | (F.col("lang") == "en"), "").otherwise(F.concat(F.lit("block "), "lang"))
    made = rows.select("doc_id", rules.rewritten(F.col("m"), block, F.col("split.query")).alias("m"))
    return made.select("doc_id", F.md5(F.element_at("m", -1)["content"]).alias("content"), F.size("m").cast("long").alias("messages"))


@query("answer_loss", r"""WITH t AS (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, unnest(range(1, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1)) AS k FROM conversations),
 p AS (SELECT conv_id, length(w) / 10.0::DOUBLE AS loss, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, k) AS next FROM t)
 SELECT c.conv_id, count(p.loss) AS n, round(avg(p.loss), 6) AS mean FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN p ON c.conv_id = p.conv_id AND p.next = 'assistant' GROUP BY c.conv_id""")
def answer_loss(spark, sf_dir):
    """Positions that predict an assistant's word, and their mean loss, here a tenth of the word's length at the position; a conversation is a sequence of words."""
    words = F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(words, lambda w: F.length(w) / 10.0).alias("loss"), F.transform(words, lambda w: F.when(F.col("role") == "assistant", F.length(w)).otherwise(-100)).alias("label"))
    whole = turns.groupBy("conv_id").agg(regroup.ordered(F.struct("turn", "loss", "label")).alias("x"))
    found = whole.select("conv_id", spans.answer_loss(F.flatten(F.transform("x", lambda t: t["label"])), F.flatten(F.transform("x", lambda t: t["loss"]))).alias("l"))
    return found.select("conv_id", F.col("l.n").cast("long").alias("n"), F.round("l.mean", 6).alias("mean"))


@query("rank_plan", """WITH b AS (SELECT * FROM ([balanced])) SELECT doc_id, step, CAST(slot // 4 AS INTEGER) AS rank, CAST(slot % 4 // 2 AS INTEGER) AS micro, CAST(slot % 2 AS INTEGER) AS place FROM b""".replace("[balanced]", ORACLE["balanced_steps"]))
def rank_plan(spark, sf_dir):
    """Balanced steps of eight packs dealt to two ranks, each in two micro-batches of two."""
    packs = read(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("weight"))
    return sequential.ranked(sequential.balanced_steps(packs, 8, 5, "doc_id"), 2, 2).select("doc_id", "step", "rank", "micro", "place")
