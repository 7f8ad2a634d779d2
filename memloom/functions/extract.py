"""Answers, labels, questions and examples taken out of model outputs and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import collapse, let, strip

FENCE = "```"
#: What opens a block, and what a numbered answer starts with.
OPENING, MARKERS = r"```text[ \t]*\n?", {"multi": "A", "ttl": "L"}


def has_block(output: Column) -> Column:
    return output.rlike(OPENING)


def _rest(output: Column) -> Column:
    return F.regexp_extract(output, rf"(?ds)^.*{OPENING}(.*)$", 1)


def last_block(output: Column) -> Column:
    """The text of the last block, up to the next fence or the end; null without one."""
    return F.when(has_block(output), F.substring_index(_rest(output), FENCE, 1))


def block_closed(output: Column) -> Column:
    return has_block(output) & F.contains(_rest(output), F.lit(FENCE))


def single_answer(output: Column) -> Column:
    """What follows `Answer:` on its line, or the whole block."""
    line = r"(?dmi)^Answer:[ \t]*(.*)"
    return let(last_block(output), lambda block: strip(F.when(block.rlike(line), F.regexp_extract(block, line, 1)).otherwise(block)))


def numbered_answers(output: Column, kind: str = "multi") -> Column:
    """A map from numbers to answers; of equal numbers the last counts. Null without a block."""
    mark = MARKERS[kind]
    pattern = rf"(?dms)^{mark}(\d+):[ \t]*(.*?)(?=^{mark}\d+:|\z)"
    return let(last_block(output), lambda block: _numbered(block, pattern))


def _numbered(block: Column, pattern: str) -> Column:
    """A map from a pattern's first group to its second."""
    numbers = F.transform(F.regexp_extract_all(block, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    bodies = F.transform(F.regexp_extract_all(block, F.lit(pattern), F.lit(2)), strip)
    later = lambda all_, x, i: F.exists(F.slice(all_, i + 2, F.size(all_)), lambda y: y["n"] == x["n"])
    last = let(F.arrays_zip(numbers.alias("n"), bodies.alias("a")), lambda all_: F.filter(all_, lambda x, i: ~later(all_, x, i)))
    return let(last, lambda kept: F.map_from_arrays(F.transform(kept, lambda x: x["n"]), F.transform(kept, lambda x: x["a"])))


def packed_answers(output: Column) -> Column:
    """One `A1: answer` a line, without a block; the last of equal numbers counts."""
    return _numbered(output, r"(?dmi)^\s*A(\d+)\s*[:.]\s*(.+)$")


def raw_answer(output: Column) -> Column:
    """The whole output without an echoed `answer:` before it."""
    return F.regexp_replace(strip(output), "(?i)^\\s*answer\\s*[:：]\\s*", "")


def extracted(output: Column, kind: str, n_questions: Column) -> Column:
    """struct(answers map, has_block, closed, n_found, format_ok) by kind."""
    if kind == "official_pack":
        answers, block, closed = packed_answers(output), None, F.lit(True)
    elif kind == "raw":
        pred = raw_answer(output)
        answers, block, closed = F.when(pred != "", F.create_map(F.lit(1), pred)).otherwise(F.create_map().cast("map<int,string>")), None, F.lit(True)
    elif kind in MARKERS:
        answers, block, closed = numbered_answers(output, kind), has_block(output), block_closed(output)
    else:
        fallback = F.when((F.coalesce(n_questions, F.lit(1)) == 1) & (strip(output) != ""), F.create_map(F.lit(1), strip(output)))
        answers, block, closed = F.when(has_block(output), F.create_map(F.lit(1), single_answer(output))).otherwise(fallback), has_block(output), block_closed(output)

    def whole(found: Column) -> Column:
        n = F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0))
        held = n > 0 if block is None else block
        if kind == "official_pack":
            ok = (n == F.coalesce(n_questions, F.array_max(F.map_keys(found)), F.lit(0))) & (n > 0)
        elif kind == "raw":
            ok = F.when(n_questions.isNotNull(), n > 0)
        else:
            ok = F.when(n_questions.isNotNull(), held & (n == n_questions))
        return F.struct(found.alias("answers"), held.alias("has_block"), closed.alias("closed"), n.alias("n_found"), ok.alias("format_ok"))

    return let(answers, whole)


def label_numbers(text: Column) -> Column:
    """The distinct numbers of `label: N` lines, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?dmi)^label:\s*(\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def pack_questions(prompt: Column) -> Column:
    """Questions of `Qn:` lines; null for fewer than two."""
    found = F.transform(F.regexp_extract_all(prompt, F.lit(r"(?dm)^Q\d+:[ \t]*(.*)$"), F.lit(1)), strip)
    return F.when(F.size(found) >= 2, found)


def pack_answers(answers: Column) -> Column:
    return F.array_join(F.transform(answers, lambda a, i: F.concat(F.lit("A"), (i + 1).cast("string"), F.lit(": "), collapse(a))), "\n")


def icl_examples(text: Column) -> Column:
    """(text, label) of blocks between blank lines whose last line is `label: N`."""
    blocks = F.split(text, r"\n[ \t]*\n")
    pairs = F.transform(blocks, lambda b: F.struct(strip(F.regexp_extract(b, r"(?ds)^(.*)\nlabel: *\d+\s*$", 1)).alias("text"), F.regexp_extract(b, r"(?ds)\n(label: *\d+)\s*$", 1).alias("label")))
    return F.filter(pairs, lambda p: (p["label"] != "") & (p["text"] != ""))


def recommendations(text: Column) -> Column:
    """Titles of a list: split at pipes, or else at lines and commas; without numbering and parentheses."""
    nonblank = lambda parts: F.filter(parts, lambda p: strip(p) != "")
    by_pipe = nonblank(F.split(text, r"\|"))
    parts = F.when(F.size(by_pipe) > 1, by_pipe).otherwise(nonblank(F.split(text, r"[\n,]")))
    clean = lambda p: collapse(F.regexp_replace(F.regexp_replace(strip(p), "^\\s*\\d+[.)、:]?\\s*", ""), r"\([^()]*\)", ""))
    return F.filter(F.transform(parts, clean), lambda p: p != "")


def json_object(text: Column) -> Column:
    """The JSON object in a text: after thinking tags, in a fence or between the outer braces; null if none parses."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull(), c)
    return F.coalesce(valid(strip(bare)), valid(fenced), valid(outer))


def mapped_labels(block: Column, labels: Column) -> Column:
    """Those of the labels that a memory maps to something: `label N:`, `N |` or `N:` at a line's start. A fixed pattern."""
    found = F.regexp_extract_all(block, F.lit(r"(?mi)(?:\blabel\s*:?[ *]*|^\s*)(\d+)\s*(?:\*\*)?\s*(?::|\|)"), F.lit(1))
    return F.array_intersect(labels, F.transform(found, lambda x: x.cast("int")))


def json_value(text: Column) -> Column:
    """The first that parses of a text without thinking tags, its first fenced block, and what its outer braces hold, as a variant; null if none does."""
    bare = strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(.*?)```", 1)
    outer = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)

    def whole(c: Column) -> Column:
        """The value of a text that is one JSON value: in brackets, since the parser ignores what follows a value."""
        listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
        return F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))

    return F.coalesce(*map(whole, (bare, strip(fenced), outer)))


#: What questions and answers may be called, the first that says something counting. Fixed values.
QUESTION, ANSWER = ("q", "question", "Q"), ("a", "answer", "A")


def qa_pairs(text: Column) -> Column:
    """The pairs struct(q, a) of a model's output: a JSON array of objects, or an object that has one as qa_pairs. Items that are no objects or lack a question or an answer go; null where none is left,
    nothing parses or the list is none. Numbers and booleans count as JSON writes them; zero, false and empty texts say nothing."""

    def said(item: Column, names: tuple[str, ...]) -> Column:
        def one(name: str) -> Column:
            value = F.try_variant_get(item, f"$.{name}", "string")
            plain = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")) == "STRING"
            return F.when((value != "") & (plain | ~value.isin("0", "0.0", "false", "[]", "{}")), value)

        return F.coalesce(*map(one, names))

    def pairs(value: Column) -> Column:
        items = F.coalesce(F.try_variant_get(value, "$.qa_pairs", "array<variant>"), F.try_variant_get(value, "$", "array<variant>"))
        each = F.transform(items, lambda x: F.struct(strip(said(x, QUESTION)).alias("q"), strip(said(x, ANSWER)).alias("a")))
        return F.filter(each, lambda x: x["q"].isNotNull() & x["a"].isNotNull())

    return let(json_value(text), lambda v: let(pairs(v), lambda found: F.when(F.size(found) > 0, found)))
