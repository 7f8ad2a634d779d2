"""Queries of models' outputs read tolerantly, of recurrent reading, and of sinks that write several results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.functions import extract, rules
from memloom.operators import recurrent
from memloom.plans.registry import query, read
from memloom.sources.io import shared_folder
from memloom.sources.sinks import markdown, write_lines, write_splits

#: Outputs in the shapes that models give, by doc_id, around a question with the document's id and an answer with its label: plain, fenced, after thoughts with braces, with words around, other names of keys, a bare array, broken, no list, items without answers, numbers.
_SHAPES = (
    '{"qa_pairs": [{"q": "who @?", "a": " is # "}]}',
    'Sure:\n```json\n{"qa_pairs": [{"question": "who @?", "answer": "#"}, {"q": "", "question": "and?", "a": "#!"}]}\n``` done',
    '<think>{"qa_pairs": 1} so</think> {"qa_pairs": [{"Q": "who @?", "A": "#"}, 5, null, "x"]}',
    'Here it is: {"qa_pairs": [{"q": "who @?", "a": "#"}]} as asked.',
    '[{"q": "who @?", "answer": "#"}, {"question": "b", "a": "c\\"d"}]',
    '```\n[{"question": "who @?", "A": "#"}]\n```',
    '{"qa_pairs": [{"q": "who @?", "a": "#"}',
    '{"qa_pairs": {"q": "who @?", "a": "#"}}',
    '{"qa_pairs": [{"q": "who @?"}, {"a": "#"}, {"q": "who @?", "a": ""}]}',
    '{"pairs": [], "qa_pairs": [{"q": @, "a": #.5}, {"q": "k", "a": 0}]}',
)
_OUTPUT_SQL = "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_SHAPES)) + " END"
_TEXT = f"replace(replace({_OUTPUT_SQL}, '@', CAST(doc_id + 1 AS VARCHAR)), '#', CAST(quality + 1 AS VARCHAR))"
_VALID = lambda c: f"CASE WHEN {c} <> '' AND json_valid({c}) THEN {c} END"
_SAYS = lambda names: "coalesce(" + ", ".join(f"CASE WHEN json_type(x, '$.{n}') = 'VARCHAR' THEN nullif(x ->> '$.{n}', '') WHEN json_type(x, '$.{n}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN nullif(x ->> '$.{n}', '0') END" for n in names) + ")"


@query("qa_pairs", f"""WITH t AS (SELECT doc_id, trim(regexp_replace({_TEXT}, '<think>.*?</think>', '', 'gs'), chr(10) || ' ') AS b FROM labels),
 c AS (SELECT doc_id, b, trim(regexp_extract(b, '```(?:json)?\\s*(.*?)```', 1, 's'), chr(10) || ' ') AS f, regexp_extract(b, '(\\{{.*\\}})', 1, 's') AS o FROM t),
 j AS (SELECT doc_id, coalesce({_VALID('b')}, {_VALID('f')}, {_VALID('o')}) AS j FROM c),
 i AS (SELECT doc_id, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.qa_pairs') = 'ARRAY' THEN json_extract(j, '$.qa_pairs[*]') END AS items FROM j),
 e AS (SELECT doc_id, unnest(items) AS x, unnest(range(0, len(items))) AS k FROM i),
 s AS (SELECT doc_id, k, trim({_SAYS(extract.QUESTION)}) AS q, trim({_SAYS(extract.ANSWER)}) AS a FROM e WHERE json_type(x) = 'OBJECT')
 SELECT l.doc_id, nullif(string_agg(q || '=' || a, '|' ORDER BY k), '') AS pairs FROM labels l LEFT JOIN s ON l.doc_id = s.doc_id AND q IS NOT NULL AND a IS NOT NULL GROUP BY l.doc_id""")
def qa_pairs(spark, sf_dir):
    """Pairs of outputs in ten shapes, some of them broken; null where nothing can be read."""
    shape = F.get(F.array(*map(F.lit, _SHAPES)), F.pmod("doc_id", F.lit(10)).cast("int"))
    output = F.replace(F.replace(shape, F.lit("@"), (F.col("doc_id") + 1).cast("string")), F.lit("#"), (F.col("quality") + 1).cast("string"))
    rows = read(spark, sf_dir, "labels").select("doc_id", extract.qa_pairs(output).alias("p"))
    return rows.select("doc_id", F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["q"], x["a"])), "|").alias("pairs"))


@query("recurrent_reading", """WITH u AS (SELECT doc_id, i // 60 AS k, string_agg(line, chr(10) ORDER BY i) AS chunk FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) t GROUP BY doc_id, i // 60),
 d AS (SELECT doc_id, list('|' || left(chunk, 3000) ORDER BY k) AS parts, count(*) AS units FROM u GROUP BY doc_id),
 r AS (SELECT doc_id, units, list_reduce(list_prepend('', parts), lambda b, c: regexp_replace(left(b || c, CAST(3 * least(2400, 2048 + 256 * units) AS BIGINT)), '^\\s+|\\s+$', '', 'g')) AS block FROM d)
 SELECT doc_id, md5(block) AS block, CAST(units AS INTEGER) AS units FROM r""")
def recurrent_reading(spark, sf_dir):
    """Documents read sixty lines at a time; in place of a model, the step appends a window's first 3,000 characters. Budgets follow from the number of windows, up to 2,400 tokens."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    units = lines.groupBy(F.col("doc_id").alias("key"), F.expr("n DIV 60").alias("i")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("chunk"))
    append = lambda asked: asked.select("key", F.concat("block", F.lit("|"), F.left("chunk", F.lit(3000))).alias("text"))
    found = recurrent.read_units(units, append, 2400, clip=lambda text, budget: extract.strip(recurrent.clipped(text, budget)))
    return found.select(F.col("key").alias("doc_id"), F.md5("block").alias("block"), "units")


@query("split_sinks", """WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, CASE WHEN n_chars < 768 THEN 0 WHEN n_chars < 1792 THEN 1 WHEN n_chars < 7680 THEN 2 WHEN n_chars < 15360 THEN 3 WHEN n_chars < 30720 THEN 4 WHEN n_chars < 61440 THEN 5 ELSE 0 END AS b FROM documents WHERE n_chars >= 768 AND n_chars < 61440),
 p AS (SELECT 'train' AS part, * FROM d UNION ALL SELECT 'val', * FROM d WHERE r <= 3)
 SELECT part, source, CAST(b AS INTEGER) AS bucket, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, (SELECT count(*) FROM d) AS total, (SELECT count(*) FROM d WHERE r <= 3) AS validation, (SELECT count(*) FROM d WHERE b = 2) AS second FROM p GROUP BY part, source, b""")
def split_sinks(spark, sf_dir):
    """Rows of a bucket, the first three of each source as validation rows too, and counts beside them: written in one pass, all three read back."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))  # the first three alone: Spark keeps no more of a source
    first = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").withColumn("bucket", rules.bucket(F.col("n_chars"))).where("bucket is not null")
    few = first.withColumn("nth", nth).where("nth <= 3").select("doc_id", F.lit(True).alias("chosen"))
    rows = first.join(few, "doc_id", "left")
    path = shared_folder(spark, "splits")
    write_splits(rows.select("doc_id", "source", "bucket", "chosen"), path, F.coalesce("chosen", F.lit(False)), second=F.count_if(F.col("bucket") == 2))
    stats = spark.read.schema("total long, validation long, second long").json(f"{path}/stats")
    counted = spark.read.schema("doc_id long, source string, bucket int, part string").parquet(f"{path}/rows").groupBy("part", "source", "bucket").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
    return counted.crossJoin(F.broadcast(stats))  # one row of counts


@query("report_lines", """WITH c AS (SELECT lang, source, CAST(1000 * sum(quality) // count(*) // 1000 AS VARCHAR) || '.' || lpad(CAST(CAST(1000 * sum(quality) // count(*) % 1000 AS BIGINT) AS VARCHAR), 3, '0') || ' (' || CAST(count(*) AS VARCHAR) || ')' AS cell FROM documents JOIN labels USING (doc_id) GROUP BY lang, source), l AS (SELECT DISTINCT lang FROM c), s AS (SELECT DISTINCT source FROM c),
 r AS (SELECT s.source, '| ' || s.source || string_agg(' | ' || coalesce(cell, '-'), '' ORDER BY l.lang) || ' |' AS line FROM s CROSS JOIN l LEFT JOIN c ON c.lang = l.lang AND c.source = s.source GROUP BY s.source)
 SELECT 1 AS line_no, '# quality' AS line UNION ALL SELECT 2, '| source' || string_agg(' | ' || lang, '' ORDER BY lang) || ' |' FROM l UNION ALL SELECT 3, '|---|' || repeat('---|', CAST(count(*) AS BIGINT)) FROM l UNION ALL SELECT CAST(row_number() OVER (ORDER BY source) + 3 AS INTEGER), line FROM r""")
def report_lines(spark, sf_dir):
    """A Markdown report of mean labels, in thousandths cut off, by source and language, written as one text file and read back."""
    each = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    share = each.groupBy("source", "lang").agg(F.expr("1000 * sum(quality) DIV count(*)").alias("m"), F.count("*").alias("n"))
    cells = share.select("source", "lang", F.concat(F.expr("CAST(m DIV 1000 AS STRING)"), F.lit("."), F.lpad((F.col("m") % 1000).cast("string"), 3, "0"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("cell"))
    lines = markdown(cells, "source", "lang", "quality")
    write_lines(lines, path := shared_folder(spark, "report"))
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("k", "line")).where("line <> ''")  # what follows the last line end
    return text.select((F.col("k") + 1).alias("line_no"), "line")
