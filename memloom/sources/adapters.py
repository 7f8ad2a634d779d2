"""From raw datasets to memory-question rows (or pool rows): a projection each, no Python.

Every adapter takes the raw rows with the columns its docstring names and returns the schema in memloom.schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import let, strip, uri_name
from memloom.operators.regroup import dense_index


def qa_item(question: Column, answer: Column, evidence: Column | None = None, choices: Column | None = None, category: Column | None = None) -> Column:
    none = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    return F.struct(question.cast("string").alias("question"), answer.cast("array<string>").alias("answer"), none(evidence, "array<int>").alias("evidence_doc_idx"), none(choices, "array<string>").alias("choices"), none(category, "int").alias("category"))


def row(raw: DataFrame, row_id: Column, source: str, task: str, docs: Column, qa: Column, **meta: Column) -> DataFrame:
    packed = F.to_json(F.struct(*(v.alias(k) for k, v in meta.items()))) if meta else F.lit("{}")
    return raw.select(row_id.cast("string").alias("id"), F.lit(source).alias("source"), F.lit(task).alias("task_type"), docs.alias("memory_docs"), qa.alias("qa"), packed.alias("meta"))


def positions(items: Column, test) -> Column:
    """The places from 0 of the items that pass."""
    return F.filter(F.transform(items, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def musique(raw: DataFrame) -> DataFrame:
    """id, paragraphs(paragraph_text, is_supporting), question, answer, answer_aliases."""
    evidence = positions(F.col("paragraphs"), lambda p: p["is_supporting"])
    return row(raw, F.col("id"), "musique", "AR", F.transform("paragraphs", lambda p: p["paragraph_text"]), F.array(qa_item(F.col("question"), F.array("answer"), evidence)), hop=F.split("id", "hop")[0], aliases=F.col("answer_aliases"))


def titled(raw: DataFrame, source: str, *more: str) -> DataFrame:
    """2wiki and hotpotqa: id, question, answer, type, supporting_facts(title), context(title, sentences); further columns go to meta."""
    docs = F.zip_with("context.title", "context.sentences", lambda t, s: F.concat(t, F.lit("\n"), F.array_join(s, " ")))
    evidence = positions(F.col("context.title"), lambda t: F.array_contains("supporting_facts.title", t))
    return row(raw, F.col("id"), source, "AR", docs, F.array(qa_item(F.col("question"), F.array("answer"), evidence)), type=F.col("type"), **{c: F.col(c) for c in more})


def narrativeqa(raw: DataFrame) -> DataFrame:
    """row_idx, document(id, text), question(text), answers(text): one row a document, in order of first rows. Only the first row's text is kept while rows are grouped."""
    item = qa_item(F.col("question.text"), F.transform("answers", lambda a: a["text"]))
    grouped = raw.groupBy(F.col("document.id").alias("doc")).agg(F.min("row_idx").alias("row_idx"), F.min_by("document.text", "row_idx").alias("text"), F.array_sort(F.collect_list(F.struct("row_idx", item.alias("q")))).alias("x"))
    return row(grouped, F.col("doc"), "narrativeqa", "AR", F.array("text"), F.transform("x", lambda r: r["q"]), row_idx=F.col("row_idx"))


def qasper(raw: DataFrame) -> DataFrame:
    """id, title, abstract, full_text(section_name, paragraphs), qas(question, answers(answer(free_form_answer, extractive_spans, yes_no, unanswerable))); unanswered questions and rows without any go."""
    sections = F.zip_with("full_text.section_name", "full_text.paragraphs", lambda n, p: F.concat(F.lit("## "), F.coalesce(n, F.lit("")), F.lit("\n"), F.array_join(p, "\n")))
    paper = strip(F.concat(F.lit("# "), F.col("title"), F.lit("\n"), F.coalesce("abstract", F.lit("")), F.lit("\n"), F.array_join(sections, "\n")))

    def answer(a: Column) -> Column:
        free, spans = F.nullif(F.coalesce(a["free_form_answer"], F.lit("")), F.lit("")), F.array_join(a["extractive_spans"], " ")
        return F.coalesce(free, F.when(F.size(a["extractive_spans"]) > 0, spans), F.when(a["yes_no"].isNotNull(), F.when(a["yes_no"], "Yes").otherwise("No")), F.when(a["unanswerable"], F.lit("Unanswerable")))

    first = lambda answers: F.get(F.filter(F.transform(answers["answer"], answer), lambda x: x.isNotNull()), F.lit(0))
    items = F.filter(F.zip_with("qas.question", "qas.answers", lambda q, a: qa_item(q, F.array(first(a)))), lambda x: x["answer"][0].isNotNull())
    return row(raw, F.col("id"), "qasper", "AR", F.array(paper), items).where("size(qa) > 0")


def longmit(raw: DataFrame) -> DataFrame:
    """id, all_docs(id, content), clue_docs(id), question, answer, hop, language."""
    evidence = positions(F.col("all_docs"), lambda d: F.array_contains("clue_docs.id", d["id"]))
    return row(raw, F.col("id"), "longmit", "AR", F.transform("all_docs", lambda d: d["content"]), F.array(qa_item(F.col("question"), F.array("answer"), evidence)), hop=F.col("hop"), language=F.col("language"))


def pool(raw: DataFrame, names: DataFrame, source: str, split: str) -> DataFrame:
    """agnews and dbpedia: row_idx, label, and text or title and content; names (label, label_text) is a dimension of the classes."""
    if "content" in raw.columns:
        title, content = strip(F.col("title")), strip(F.col("content"))
        raw = raw.withColumn("text", F.when(title != "", F.concat(title, F.lit("\n"), content)).otherwise(content))
    joined = raw.join(names, "label")
    return joined.select(F.concat(F.lit(f"{source}-{split}-"), F.col("row_idx").cast("string")).alias("id"), F.lit(source).alias("source"), F.lit("TTL").alias("task_type"), F.lit(split).alias("split"), "text", F.col("label").cast("int").alias("label"), "label_text", F.lit("{}").alias("meta"))


def longalpaca(raw: DataFrame, blank: bool = False) -> DataFrame:
    """row_idx, instruction, output: the paper between its two marks, the question after them; rows without go, and blank papers unless these are to stay."""
    begins, ends = "The paper begins.", "Now the paper ends."  # fixed marks of the format
    after = F.substring("instruction", F.locate(begins, F.col("instruction")) + len(begins), F.length("instruction"))
    parts = raw.where(F.locate(begins, F.col("instruction")) > 0).withColumn("after", after).where(F.locate(ends, F.col("after")) > 0)
    paper, tail = strip(F.substring_index("after", ends, 1)), strip(F.substring("after", F.locate(ends, F.col("after")) + len(ends), F.length("after")))
    question = strip(F.regexp_replace(tail, "(?i)^question:", ""))
    found = parts.withColumns({"paper": paper, "question": question}).where("question <> ''").where(F.lit(blank) | (F.col("paper") != ""))
    found = dense_index(found, "row_idx")  # ids count the rows kept
    return row(found, F.concat(F.lit("longalpaca-"), F.col("idx").cast("string")), "longalpaca", "AR", F.array("paper"), F.array(qa_item(F.col("question"), F.array("output"), F.array(F.lit(0)))))


def longalign(raw: DataFrame, blank: bool = False) -> DataFrame:
    """id, messages(role, content): the first turn holds the text and, after its last blank line, the first question; later pairs follow. Rows with a blank text go, unless these are to stay."""
    first = F.col("messages")[0]["content"]
    question, whole = F.substring_index(first, "\n\n", -1), F.locate("\n\n", first) > 0
    body = F.left(first, F.length(first) - F.length(question) - 2)
    message = lambda i: F.get("messages", i)
    later = F.when(F.size("messages") >= 4, F.sequence(F.lit(2), F.size("messages") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    good = lambda i: (message(i)["role"] == "user") & (message(i + 1)["role"] == "assistant") & (strip(message(i)["content"]) != "") & (strip(message(i + 1)["content"]) != "")
    pairs = F.transform(F.filter(later, good), lambda i: qa_item(message(i)["content"], F.array(message(i + 1)["content"])))
    usable = raw.where(whole & (F.size("messages") >= 2)).where((F.lit(blank) | (strip(body) != "")) & (strip(question) != ""))
    return row(usable, F.col("id"), "longalign", "AR", F.array(body), F.concat(F.array(qa_item(question, F.array(message(F.lit(1))["content"]))), pairs))


def long_data(raw: DataFrame) -> DataFrame:
    """row_idx, prompt, completion: the context stands before the last question mark word, the question after it, up to an answer's mark."""

    def split_at(mark: str) -> Column:
        n = F.length("prompt")
        back = F.locate(mark[::-1], F.reverse("prompt"))
        cut = n - back - len(mark) + 2  # the mark's place from 1
        tail = F.substring("prompt", cut + len(mark), n)
        tail = F.when(F.locate("\nA:", tail) > 0, F.regexp_extract(tail, r"(?ds)^(.*)\nA:", 1)).otherwise(tail)
        return let(F.struct(strip(F.left("prompt", cut - 1)).alias("context"), strip(tail).alias("question")), lambda x: F.when((back > 0) & (x["context"] != "") & (x["question"] != ""), x))

    found = raw.withColumn("p", F.coalesce(split_at("\n\nQuestion:"), split_at("\n\nQ:"))).where("p is not null")
    found = dense_index(found, "row_idx")  # ids count the rows kept
    return row(found, F.concat(F.lit("ldc-"), F.col("idx").cast("string")), "ldc", "AR", F.array("p.context"), F.array(qa_item(F.col("p.question"), F.array("completion"))))


def infbench(raw: DataFrame, source: str) -> DataFrame:
    """row_idx, id, context, input, answer (an array, or one text), options. A row without an id takes its place among all rows."""
    answer = F.col("answer") if raw.schema["answer"].dataType.typeName() == "array" else F.array("answer")
    numbered = dense_index(raw, "row_idx")
    return row(numbered, F.coalesce(F.col("id").cast("string"), F.concat(F.lit(f"{source}-"), F.col("idx").cast("string"))), source, "AR", F.array("context"), F.array(qa_item(F.col("input"), answer, choices=F.col("options"))))


def entity_names(entities: DataFrame) -> DataFrame:
    """(entity, name) of entities (uri, entity): what recommendations are called by."""
    return entities.select(F.col("entity").cast("string").alias("entity"), uri_name(F.col("uri")).alias("name"))


def mab(raw: DataFrame, source: str, task: str, prefix: str, names: DataFrame | None = None) -> DataFrame:
    """row_idx, context, questions, answers, metadata(source): rows of a prefix, numbered among themselves; questions and answers end with the shorter list.

    Recommendations' answers are lists of entities, separated by commas: with names (entity, name) they become names, and an entity without one fails the job.
    """
    n = F.least(F.size("questions"), F.size("answers"))
    kept = dense_index(raw.where(F.startswith("metadata.source", F.lit(prefix))), "row_idx")
    origin = F.col("metadata.source")
    items = F.zip_with(F.slice("questions", 1, n), F.slice("answers", 1, n), lambda q, a: qa_item(q, a))
    if names is not None:
        listed = kept.where(F.startswith(origin, F.lit("recsys"))).select("idx", F.posexplode(F.slice("answers", 1, n)).alias("q", "answer"))
        pieces = F.filter(F.flatten(F.transform("answer", lambda g: F.transform(F.split(g, ","), strip))), lambda x: x != "")
        each = listed.select("idx", "q", F.posexplode(pieces).alias("k", "entity")).join(names, "entity", "left")
        name = F.coalesce("name", F.raise_error(F.concat(F.lit("no name for entity "), "entity")))
        by_question = each.groupBy("idx", "q").agg(F.array_sort(F.collect_list(F.struct("k", name.alias("name")))).alias("x")).select("idx", F.struct("q", F.transform("x", lambda r: r["name"]).alias("names")).alias("g"))
        golds = by_question.groupBy("idx").agg(F.map_from_entries(F.collect_list("g")).alias("golds"))
        kept = kept.join(golds, "idx", "left")
        called = F.transform(items, lambda i, q: i.withField("answer", F.coalesce(F.try_element_at("golds", q), F.array().cast("array<string>"))))
        items = F.when(F.startswith(origin, F.lit("recsys")), called).otherwise(items)
    return row(kept, F.concat(F.lit(f"{source}-"), F.col("idx").cast("string")), source, task, F.array("context"), items, orig_source=origin)


def longmemeval(raw: DataFrame, source: str) -> DataFrame:
    """question_id, question_type, question, answer, answer_session_ids, haystack_dates, haystack_session_ids, haystack_sessions(role, content)."""
    text = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    docs = F.zip_with("haystack_dates", "haystack_sessions", lambda d, s: F.concat(F.when(F.coalesce(d, F.lit("")) != "", F.concat(F.lit("[Date: "), d, F.lit("]\n"))).otherwise(F.lit("")), text(s)))
    evidence = positions(F.col("haystack_session_ids"), lambda s: F.array_contains("answer_session_ids", s))
    return row(raw, F.col("question_id"), source, "AR", docs, F.array(qa_item(F.col("question"), F.array("answer"), evidence)), question_type=F.col("question_type"))


#: What questions of time end with, and what is right where nothing in the conversation answers. Fixed texts.
DATED, REFUSALS = " Use DATE of CONVERSATION to answer with an approximate date.", ("No information available", "Not mentioned")


def locomo(raw: DataFrame) -> DataFrame:
    """sample_id, sessions map<string, array<struct<speaker, text, blip_caption>>>, dates map<string, string>, qa(question, answer, evidence, category): sessions in order of their numbers.

    Questions of category 2 ask for a date, those of category 3 accept what stands before a semicolon, those of category 5 are to be refused whatever their answer says."""
    number = lambda k: F.regexp_extract(k, r"(\d+)", 1).cast("int")
    ordered = F.array_sort(F.transform(F.map_keys("sessions"), lambda k: F.struct(number(k).alias("n"), k.alias("k"))))

    def turn(t: Column) -> Column:
        plain = F.concat(t["speaker"], F.lit(": "), t["text"])
        shared = F.when(F.coalesce(t["text"], F.lit("")) != "", F.concat(plain, F.lit(" and shared "), t["blip_caption"], F.lit("."))).otherwise(F.concat(t["speaker"], F.lit(" shared "), t["blip_caption"], F.lit(".")))
        return F.when(t["blip_caption"].isNotNull(), shared).otherwise(plain)

    docs = F.transform(ordered, lambda s: F.concat(F.coalesce(F.concat(F.lit("[Date: "), F.try_element_at("dates", s["k"]), F.lit("]\n")), F.lit("")), F.array_join(F.transform(F.element_at("sessions", s["k"]), turn), "\n")))
    evidence = lambda q: F.array_sort(F.array_distinct(F.filter(F.transform(q["evidence"], lambda e: F.regexp_extract(e, r"D(\d+):", 1)), lambda x: x != "").cast("array<int>")))
    place = lambda q: positions(ordered, lambda s: F.array_contains(evidence(q), s["n"]))
    whole = lambda q: F.coalesce(q["answer"], F.lit(""))
    first = lambda q: F.when((q["category"] == 3) & (F.locate(";", whole(q)) > 0), F.array(whole(q), strip(F.substring_index(whole(q), ";", 1)))).otherwise(F.array(whole(q)))
    golds = lambda q: F.when(q["category"] == 5, F.array(*map(F.lit, REFUSALS))).otherwise(first(q))
    asked = lambda q: F.concat(F.coalesce(q["question"], F.lit("")), F.when(q["category"] == 2, F.lit(DATED)).otherwise(F.lit("")))
    return row(raw, F.concat(F.lit("locomo-"), F.col("sample_id").cast("string")), "locomo", "AR", docs, F.transform("qa", lambda q: qa_item(asked(q), golds(q), place(q), category=q["category"])))
