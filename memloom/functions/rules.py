"""Length rules, budgets and prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import let, strip

#: (low, high, chunk, window, max_new); a prompt fits the first row with low <= prompt + max_new < high. Fixed values.
RULES = ((1024, 2048, 64, 512, 256), (2048, 8192, 256, 1024, 512), (8192, 16384, 512, 2048, 1024), (16384, 32768, 512, 4096, 2048), (32768, 65536, 512, 8192, 4096))
#: Separator of documents in a prompt, and what stands for a cut. Fixed values.
SEPARATOR, CUT = "\n\n", "\n\n[... context truncated ...]\n\n"
#: Fixed texts of prompts.
SYSTEM = "You are a helpful assistant with a permanent memory. Remember important details while processing the conversation, and respond to the user based on your memory."
LABEL_DIRECTIVE = "Put your final label inside a ```text``` block as `Answer: <label number>`."
TTL_DIRECTIVE = "Put your final labels inside a ```text``` block, one per line as `L1: ...`, `L2: ...`, matching the item numbers."
REASON = "You may reason step by step first; then "
RAW_PACK = "Answer the following questions based on the content you have memorized. Reply with exactly one line per question, in the format 'A<number>: <short answer>'. Do not output anything else.\n\n"
UNIFIED_HEADER = "Use only the memory context below to answer the question.\nReply with a short entity, phrase, number, or sentence only.\nIf the answer is not supported by the context, reply exactly: I don't know."


def bucket(prompt: Column) -> Column:
    """The rule's number from 1; null where none fits."""
    found = F.lit(None).cast("int")
    for number, (low, high, _, _, new) in reversed(list(enumerate(RULES, 1))):
        found = F.when((prompt + new >= low) & (prompt + new < high), F.lit(number)).otherwise(found)
    return found


def resolved(prompt: Column) -> Column:
    """struct(chunk, window, max_new); lengths that no rule fits take the nearest end."""
    number = F.coalesce(bucket(prompt), F.when(prompt + RULES[0][4] < RULES[0][0], F.lit(1)).otherwise(F.lit(len(RULES))))
    table = F.array(*(F.struct(F.lit(r[2]).alias("chunk"), F.lit(r[3]).alias("window"), F.lit(r[4]).alias("max_new")) for r in RULES))
    return F.get(table, number - 1)


def drop_reason(prompt: Column, dropped: tuple[int, ...] = (1,)) -> Column:
    """Why a prompt isn't taken: too short, too long, or its bucket; null if it is."""
    number = bucket(prompt)
    return F.when(number.isNull(), F.when(prompt < 4096, F.lit("short")).otherwise(F.lit("long"))).when(number.isin(*dropped), F.lit("bucket"))


def block_budget(n: Column, high: int, low: int = 2048, each: int = 256) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), low + each * n))


def neighbours_wanted(units: Column) -> Column:
    return F.when(units <= 20, F.lit(1)).otherwise(F.lit(3))


def request_weight(max_tokens: Column, max_new: Column, default: int, prompt: Column, share: float) -> Column:
    """Tokens that a request may take; a limit of 0 is none."""
    limit = F.coalesce(F.nullif(max_tokens, F.lit(0)), F.nullif(max_new, F.lit(0)), F.lit(default))
    return F.greatest(limit + F.ceil(share * prompt).cast("int"), F.lit(1))


def clip(text: Column, limit: int) -> Column:
    """A third of the budget from the head and the rest from the tail, with a mark between; tiny budgets keep the tail."""
    if limit <= 0:
        return text
    if limit <= len(CUT) + 32:
        return F.when(F.length(text) <= limit, text).otherwise(F.right(text, F.lit(limit)))
    head = max(1, (limit - len(CUT)) // 3)
    tail = max(1, limit - len(CUT) - head)
    left = F.regexp_replace(F.left(text, F.lit(head)), r"(?U)[\s\x1c-\x1f]+\z", "")
    right = F.regexp_replace(F.right(text, F.lit(tail)), r"(?U)^[\s\x1c-\x1f]+", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(left, F.lit(CUT), right))


def learning_rate(step: Column, kind: str, warmup: int, constant: int, total: int) -> Column:
    """The scheduler's factor: warm-up or constant, then cosine or constant."""
    start = warmup if kind == "warmup_cosine" else constant
    progress = F.least(F.lit(1.0), (step - start) / max(1, total - start))
    rest = F.lit(1.0) if kind == "warmup_constant" else 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress))
    if kind == "constant_cosine":
        return F.when(step < start, F.lit(1.0)).otherwise(rest)
    return F.when(step < warmup, (step + 1) / max(1, warmup)).otherwise(rest)


def numbered(items: Column, letter: str) -> Column:
    """`Q1: ...` lines."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit(letter), (i + 1).cast("string"), F.lit(": "), x)), "\n")


def gold_block(answers: Column, letter: str) -> Column:
    return F.concat(F.lit("```text\n"), numbered(answers, letter), F.lit("\n```"))


def ttl_prompt(texts: Column, labels: Column, scenario: Column, reason: bool) -> Column:
    """The user's turn that asks for the classes of several items."""
    head = F.when(scenario != "", F.concat(scenario, F.lit("\n\n"))).otherwise(F.lit(""))
    directive = REASON + TTL_DIRECTIVE[0].lower() + TTL_DIRECTIVE[1:] if reason else TTL_DIRECTIVE
    valid = F.array_join(F.transform(labels, lambda x: x.cast("string")), ", ")
    return F.concat(head, F.lit("Classify each of the following items. Valid labels: "), valid, F.lit(".\n"), numbered(texts, "T"), F.lit("\n\n" + directive))


def messages(docs: Column, user: Column) -> Column:
    memory = F.array_join(docs, SEPARATOR)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), F.concat(memory, F.lit(SEPARATOR), user).alias("content")))


def split_memory(text: Column, memory: Column) -> Column:
    """struct(memory, query) of a user's turn that begins with a known memory; the whole turn is the query otherwise."""
    known = F.startswith(text, F.concat(memory, F.lit(SEPARATOR)))
    query = F.when(known, F.substring(text, F.length(memory) + 1 + len(SEPARATOR), F.length(text))).otherwise(text)
    return F.struct(F.when(known, memory).otherwise(F.lit("")).alias("memory"), strip(query).alias("query"))


def rewritten(messages: Column, memory: Column, query: Column) -> Column:
    """The messages struct(role, content) with the last one's content a new memory before the query, or the query alone where the memory is empty."""
    content = F.when(memory != "", F.concat(memory, F.lit(SEPARATOR), query)).otherwise(query)
    last = F.element_at(messages, -1).withField("content", content)
    return F.concat(F.slice(messages, 1, F.size(messages) - 1), F.array(last))


#: Tokens of a context window, and what is kept free of it. Fixed values.
HARD_LIMIT, RESERVE = 262144, 1024


def memory_budget(user_tokens: Column, max_new: int, strict: bool = False) -> Column:
    """Tokens left for the memory of a group whose longest question takes `user_tokens`; strict: fails where none are left."""
    left = HARD_LIMIT - max_new - RESERVE - user_tokens
    return F.when(left > 0, left).otherwise(F.raise_error(F.lit("no room for memory")).cast("long")) if strict else left


def parsed_spec(spec: Column) -> Column:
    """struct(ds, split, n) of dataset:split or dataset:split:count."""
    parts = F.split(spec, ":")
    return F.struct(F.get(parts, F.lit(0)).alias("ds"), F.get(parts, F.lit(1)).alias("split"), F.nullif(F.get(parts, F.lit(2)), F.lit("")).cast("long").alias("n"))


def tail(text: Column, most: int) -> Column:
    """The last `most` characters."""
    return F.when(F.length(text) <= most, text).otherwise(F.right(text, F.lit(most)))


def to_boundary(n: Column, wanted: Column, chunk: int) -> Column:
    """The tokens granted of those wanted: up to the next chunk's start."""
    return F.least(wanted, (F.floor(n / chunk) + 1) * chunk - n)


def planted(text: Column, spot: Column, needle: str) -> Column:
    """The text with a needle after its first `spot` characters."""
    at = spot.cast("int")
    return F.concat(F.left(text, at), F.lit(needle), F.substring(text, at + 1, F.length(text)))


def synthesis_budget(prompt: Column, window: int = 8192, reserve: int = 400, low: int = 256, high: int = 2048) -> Column:
    """Tokens to generate for a chunk's questions."""
    return F.least(F.lit(high), F.greatest(F.lit(low), window - prompt - reserve)).cast("long")


def update_prompt(block: Column, chunk: Column, budget: Column) -> Column:
    """The user's turn that asks for a rewritten memory. Fixed texts."""
    shown = F.when(F.coalesce(block, F.lit("")) == "", F.lit("(empty)")).otherwise(block)
    rest = F.concat(F.lit("Rewrite the memory to integrate any useful information from the new text. Keep it under about "), budget.cast("string"), F.lit(" tokens. Output ONLY the updated memory."))
    return F.concat(F.lit("Current memory:\n"), shown, F.lit("\n\nNew text:\n"), chunk, F.lit("\n\n"), rest)


def text_form(family: Column, kind: Column) -> Column:
    """Which form of prompt and gold a row takes: open, ttl or ttl_single, single or multi."""
    single = kind == "single"
    return F.when(family == "long", "open").when(family == "ttl", F.when(single, "ttl_single").otherwise("ttl")).when(single, "single").otherwise("multi")


def bare_query(query: Column) -> Column:
    """The utterance inside a known template, the first that matches; other queries as they are. Fixed patterns."""
    patterns = (r"(?s)nothing else\.\s*\n\n(.+?)\s*\n\n\s*label:\s*$", r"(?s)\nText:\s*(.+?)\s*\n\n")
    out = query
    for pattern in reversed(patterns):
        out = F.when(query.rlike(pattern), strip(F.regexp_extract(query, pattern, 1))).otherwise(out)
    return out


def chunk_config(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """Rows (dataset, pack) with the settings (dataset, size) of their dataset: those of `dataset-pack` for packs, if there are any. Settings are a row a dataset."""
    of = lambda name: configs.select(F.col("dataset").alias(f"_{name}"), F.col("size").alias(f"_{name}_size"))
    packed = rows.join(of("own"), F.col("dataset") == F.col("_own"), "left").join(of("packs"), F.col("pack") & (F.concat("dataset", F.lit("-pack")) == F.col("_packs")), "left")
    return packed.withColumn("size", F.coalesce("_packs_size", "_own_size")).drop("_own", "_packs", "_own_size", "_packs_size")


#: Directives of the other prompt forms, and their openings. Fixed texts.
SINGLE_DIRECTIVE = "Put your final answer inside a ```text``` block as `Answer: <answer>`."
MULTI_DIRECTIVE = "Put your final answers inside a ```text``` block, one per line as `A1: ...`, `A2: ...`, matching the question numbers."
RECSYS_DIRECTIVE = 'Put your final recommendations inside a ```text``` block as `Answer: <movie title 1> | <movie title 2> | ...` on one line, separated by " | ". Recommend 20 movie titles, most confident first.'
RECSYS_PACK_DIRECTIVE = "Put your final recommendations inside a ```text``` block, one line per conversation as `A1: <movie title 1> | <movie title 2> | ...`, `A2: ...`, matching the conversation numbers. Recommend 20 movie titles per conversation, most confident first."
RECSYS_OPENING = "Pretend you are the movie recommender system {where} below. Recommend movies by title, as they are named in the memorized dialogues.\n"


def instruction(directive: str, reason: bool) -> str:
    return REASON + directive[0].lower() + directive[1:] if reason else directive


def user_turn(form: str, items: Column, labels: Column, scenario: Column, reason: bool) -> Column:
    """The user's turn of a form: open, single, multi, ttl_single, ttl, recsys_single or recsys. Forms of one item take the first."""
    head = F.when(scenario != "", F.concat(scenario, F.lit(SEPARATOR))).otherwise(F.lit(""))
    one, end = F.get(items, F.lit(0)), lambda directive: F.lit(SEPARATOR + instruction(directive, reason))
    if form == "open":
        return one
    if form == "ttl":
        return ttl_prompt(items, labels, scenario, reason)
    if form == "ttl_single":
        valid = F.array_join(F.transform(labels, lambda x: x.cast("string")), ", ")
        return F.concat(head, F.lit("Classify the following item. Valid labels: "), valid, F.lit(".\nText: "), one, end(LABEL_DIRECTIVE))
    if form == "single":
        return F.concat(head, F.lit("Question: "), one, end(SINGLE_DIRECTIVE))
    if form == "multi":
        return F.concat(head, F.lit("Answer all of the following questions.\n"), numbered(items, "Q"), end(MULTI_DIRECTIVE))
    if form == "recsys_single":
        return F.concat(head, F.lit(RECSYS_OPENING.format(where="in the new conversation") + "Conversation:\n"), one, end(RECSYS_DIRECTIVE))
    if form == "recsys":
        block = F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("C"), (i + 1).cast("string"), F.lit(":\n"), x)), SEPARATOR)
        return F.concat(head, F.lit(RECSYS_OPENING.format(where="for each new conversation")), block, end(RECSYS_PACK_DIRECTIVE))
    raise ValueError(f"unknown form {form}")


def gold_turn(form: str, answers: Column) -> Column:
    """The assistant's turn of a form."""
    one = F.get(answers, F.lit(0))
    if form == "open":
        return one
    if form in ("multi", "recsys"):
        return gold_block(answers, "A")
    if form == "ttl":
        return gold_block(answers, "L")
    return F.concat(F.lit("```text\nAnswer: "), one, F.lit("\n```"))


#: What a needle says. Fixed text.
NEEDLE = "One of the special magic numbers for {key} is: {value}.\n"


def hidden(text: Column, needles: Column, depths: Column) -> Column:
    """The text with needles in order at its sorted depths (shares of its length)."""
    cuts = F.transform(F.array_sort(depths), lambda d: F.floor(F.length(text) * d).cast("int"))

    def pieces(cut: Column) -> Column:
        before = F.transform(cut, lambda c, i: F.concat(F.substring(text, F.when(i > 0, F.get(cut, i - 1)).otherwise(F.lit(0)) + 1, c - F.when(i > 0, F.get(cut, i - 1)).otherwise(F.lit(0))), F.get(needles, i)))
        return F.concat(F.array_join(before, ""), F.substring(text, F.element_at(cut, -1) + 1, F.length(text)))

    return let(cuts, pieces)


def as_list(json: Column) -> Column:
    """An array of texts from JSON that is a list, a text or null."""
    bare = F.trim(json)
    return F.when(bare.isNull() | (bare == "null"), F.array().cast("array<string>")).when(F.startswith(bare, F.lit("[")), F.from_json(bare, "array<string>")).otherwise(F.array(F.get(F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>"), F.lit(0))))


#: Official prompts: what wraps the memory, and what asks. Fixed texts.
OFFICIAL = {
    "c2l": ("", "Answer the following question. Give only the answer, and no extra commentary, formatting, or chattiness.\n\nQuestion: {question}"),
    "locomo": ("{context}", "Based on the above conversations, write a short answer for the following question in a few words. Do not write complete and lengthy sentences. Answer with exact words from the conversations whenever possible.\n\nQuestion: {question}"),
    "longmemeval": (
        "Dialogue between User and Assistant \n<User> The following context is the conversation between the user and the assistant: \n{context}\n <Assistant> I have memorized the conversation and I will answer the question you ask.",
        "The history chats are between you and a user. Based on the relevant chat history, answer the question as concisely as you can, using a single phrase if possible.\n\n {question} \n\n Answer:",
    ),
    "eventqa": (
        "Dialogue between User and Assistant \n<User> The following context is the book excerpt: \n{context}\n <Assistant> I have read the book excerpt and I will answer the question you ask.",
        "Based on the context you memorized, complete the task below:\n\n{question}\n\n The event that happens next is:",
    ),
    "in_context_learning": (
        "Dialogue between User and Assistant  \n<User> The following context is the examples I have learned: \n{context}\n <Assistant> I have learned the examples and I will answer the question you ask.",
        'Use the provided mapping from the context to numerical label to assign a numerical label to the context. Only output "label: {{label}}" and nothing else. \n\n{question} \n\n label:',
    ),
    "recsys_redial": (
        "Dialogue between User and Assistant  \n<User> The following context is the dialogues between a user and recommender system: \n{context}\n <Assistant> I have memorized the dialogues and I will answer the question you ask.",
        "Pretend you are a movie recommender system. You need to recommend movies based on the dialogues you have memorized. Now I will give you a new conversation between a user and you (a recommender system). Based on the conversation, you reply me with 20 recommendations without extra sentences. \n\nFor Example:\n\n[Conversation]\n\nThe recommendations are: \n1.movie1\n2.movie2\n...\n\n Here is the conversation: {question} \n\n The recommendations are: \n",
    ),
    "factconsolidation": (
        "Dialogue between User and Assistant  \n<User> The following context is the facts I have learned: \n{context}\n <Assistant> I have learned the facts and I will answer the question you ask.",
        "Pretend you are a knowledge management system. Each fact in the knowledge pool is provided with a serial number at the beginning, and the newer fact has larger serial number. \n You need to solve the conflicts of facts in the knowledge pool by finding the newest fact with larger serial number. You need to answer a question based on this rule. You should give a very concise answer without saying other words for the question **only** from the knowledge pool you have memorized rather than the real facts in real world. \n\nFor example:\n\n [Knowledge Pool] \n\n Question: Based on the provided Knowledge Pool, what is the name of the current president of Russia? \nAnswer: Donald Trump \n\n Now Answer the Question: Based on the provided Knowledge Pool, {question} \nAnswer:",
    ),
    "unified": (UNIFIED_HEADER + SEPARATOR + "{context}", "Question: {question}\nAnswer:"),
}


def official(kind: str, context: Column, question: Column) -> Column:
    """struct(memory, query) of an official prompt."""
    memory, asked = OFFICIAL[kind]
    return F.struct(_filled(memory, "context", context).alias("memory"), _filled(asked, "question", question).alias("query"))


def _filled(template: str, name: str, value: Column) -> Column:
    head, hole, tail = template.partition("{%s}" % name)
    return F.concat(F.lit(head), value, F.lit(tail)) if hole else F.lit(template)


def default_budget(max_new: Column, group: Column) -> Column:
    """Tokens to generate where a configuration says nothing."""
    return F.coalesce(max_new, F.when(group, 8192).otherwise(1024))


#: Prompts of a model that maintains labels, asks questions about a text, or embeds a query. Fixed texts.
MAPPING = """Required labels ({count} total): {required}

Current label-to-intent mapping:
{block}

New labeled examples:
{chunk}

Rewrite the complete mapping using all evidence accumulated so far. Rules:
- Every training example ends with `label: N`. Only that exact N may update row N.
- Output exactly one line for every required label and no other labels. Copy each numeric key exactly; never create keys by counting rows.
- Use `Label N: <generalized intent>; prototype: <one short example>` on each line.
- Never omit, merge, split, renumber, shift, or reuse labels. If uncertain, retain the current row for that same N.
- Name the shortest general category or requested answer type shared by examples with that exact label. Never copy a single example as the intent.
- Aggregate new evidence into the current row for the same N; do not replace a general intent with the latest example or accumulate prototype lists.
- Keep each line under 20 words so the complete table fits the budget.
Keep the whole mapping under about {budget} tokens. Output ONLY the mapping."""
QUESTIONS = """Based on the following summary text, generate exactly {n} diverse question-answer pairs that cover key facts.

**CRITICAL REQUIREMENTS:**
1. **Question Type:** Generate **"WH-questions"** (Who, What, Where, When, etc.).
2. **Answer Style:** Answers must be **concise** (ideally under 10 words).
3. **Content:** Questions must be answerable *only* from the provided text.
4. **Format:** Your output MUST be a valid JSON object with a single key "qa_pairs".

[SUMMARY TEXT]
{summary}
"""
RETRIEVE = ("Given a web search query, retrieve relevant passages that answer the query", "Instruct: {task}\nQuery:{query}")


def _with(template: str, **values: Column) -> Column:
    """The template with its holes filled, each once and in the order given; what is filled in is never read as a template."""
    out, rest = [], template
    for name, value in values.items():
        head, _, rest = rest.partition("{%s}" % name)
        out += [F.lit(head), value]
    return F.concat(*out, F.lit(rest))


def mapping_prompt(block: Column, chunk: Column, budget: Column, labels: Column) -> Column:
    """The user's turn that asks for a complete mapping of labels."""
    shown = F.when(F.coalesce(block, F.lit("")) == "", F.lit("(empty)")).otherwise(block)
    required = F.array_join(F.transform(labels, lambda x: x.cast("string")), ", ")
    return _with(MAPPING, count=F.size(labels).cast("string"), required=required, block=shown, chunk=chunk, budget=budget.cast("string"))


def questions_prompt(summary: Column, n: Column) -> Column:
    return _with(QUESTIONS, n=n.cast("string"), summary=summary)


def retrieval_query(query: Column, task: str = RETRIEVE[0]) -> Column:
    return _with(RETRIEVE[1], task=F.lit(task), query=query)
