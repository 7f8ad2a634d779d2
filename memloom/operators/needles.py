"""Needles in haystacks: five tasks of retrieval from a long text, as memory-question rows. Draws are hashes of row and place, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.rules import NEEDLE, hidden
from memloom.functions.text import draw, let

#: The tasks, by number, and the texts of their questions. Fixed values.
TASKS = ("s_niah_2", "s_niah_3", "mk_niah_1", "mq_niah", "mv_niah")
ONE = "What is the special magic number for {key} mentioned in the provided text?"
ALL = "What are all the special magic numbers for {key} mentioned in the provided text?"
#: Words of keys. Fixed values.
WORDS = (
    "apple bear castle door eagle forest garden harbor island jungle kite lantern meadow needle ocean palace quartz river summit temple umbrella valley willow zephyr anchor bridge canyon dune ember fjord glacier"
).split()
#: Tokens of a context, less those for prompt, question and answer. Fixed values.
BUDGET = 131_072 - 2_048
#: Needles of a row with several, and characters that count as a token.
SEVERAL, CHARACTERS = 4, 3


def _pick(seed: int, salt: str, place: Column, n: int) -> Column:
    return F.floor(draw(seed, salt, place) * n)


def key(seed: int, place: Column) -> Column:
    words = F.array(*map(F.lit, WORDS))
    word = lambda salt: F.get(words, _pick(seed, salt, place, len(WORDS)).cast("int"))
    return F.concat_ws("-", word("first"), word("second"), (100 + _pick(seed, "number", place, 900)).cast("string"))


def number(seed: int, place: Column) -> Column:
    """Seven digits."""
    return (1_000_000 + _pick(seed, "value", place, 9_000_000)).cast("string")


def code(seed: int, place: Column) -> Column:
    """128 bits as 8-4-4-4-12 hexadecimal digits."""
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.lit("code"), place.cast("string")))
    return let(digest, lambda d: F.concat_ws("-", *(F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def haystack(text: Column, budget: int, at: Column) -> Column:
    """`budget` tokens of the text from a share `at` of where they can start."""
    size = budget * CHARACTERS
    return F.substring(text, (F.floor(at * F.greatest(F.lit(0), F.length(text) - size - 1)) + 1).cast("int"), F.lit(size))


def _filled(template: str, **parts: Column) -> Column:
    out, rest = [], template
    for name, part in parts.items():
        before, _, rest = rest.partition("{" + name + "}")
        out += [F.lit(before), part]
    return F.concat(*out, F.lit(rest))


def rows(texts: DataFrame, seed: int, budget: int = BUDGET) -> DataFrame:
    """Memory-question rows (id, source, task_type, memory_docs, qa, meta) of haystacks (row, text, task), task being a name of TASKS: rows without a text or of another task are left out.

    One needle of a number or of a code; four keys of which one is asked for, their order drawn; four keys that are all asked for; four values of one key that are all wanted.
    """
    many = ~F.col("task").startswith("s_")
    places = F.when(many, F.sequence(F.lit(0), F.lit(SEVERAL - 1))).otherwise(F.array(F.lit(0)))
    place = lambda j: F.col("row") * SEVERAL + j
    keys = F.transform(places, lambda j: key(seed, place(F.when(F.col("task") == "mv_niah", F.lit(0)).otherwise(j))))
    values = F.transform(places, lambda j: F.when(F.col("task") == "s_niah_3", code(seed, place(j))).otherwise(number(seed, place(j))))
    drawn = texts.where(F.col("text").isNotNull() & F.col("task").isin(*TASKS)).select("row", "task", haystack(F.col("text"), budget, draw(seed, "start", F.col("row"))).alias("text"), keys.alias("keys"), values.alias("values"), F.transform(places, lambda j: 0.05 + 0.9 * draw(seed, "depth", place(j))).alias("depths"))
    rank = lambda i: F.when(F.col("task") == "mk_niah_1", draw(seed, "order", place(i))).otherwise(F.lit(0.0))
    needles = F.zip_with("keys", "values", lambda k, v: _filled(NEEDLE, key=k, value=v))
    ordered = F.transform(F.array_sort(F.transform(needles, lambda x, i: F.struct(rank(i).alias("rank"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    item = lambda q, golds: F.struct(q.alias("question"), golds.alias("answer"), F.array(F.lit(0)).alias("evidence_doc_idx"), F.array().cast("array<string>").alias("choices"), F.lit(None).cast("int").alias("category"))
    each = F.zip_with("keys", "values", lambda k, v: item(_filled(ONE, key=k), F.array(v)))
    asked = F.when(F.col("task") == "mv_niah", F.array(item(_filled(ALL, key=F.get("keys", F.lit(0))), F.col("values")))).when(F.col("task") == "mq_niah", each).otherwise(F.slice(each, 1, 1))
    source = F.concat(F.lit("ruler_"), F.replace("task", F.lit("_"), F.lit("")))
    made = drawn.select("row", "task", source.alias("source"), F.array(hidden(F.col("text"), ordered, F.col("depths"))).alias("memory_docs"), asked.alias("qa"))
    meta = F.to_json(F.struct(F.col("source").alias("orig_source"), F.lit(1).alias("n_docs"), "task", F.size("qa").alias("n_questions"), F.lit(budget).alias("ctx_tokens")))
    return made.select(F.concat(F.lit("ruler-"), "task", F.lit("-"), F.col("row").cast("string")).alias("id"), "source", F.lit("AR").alias("task_type"), "memory_docs", "qa", meta.alias("meta"))
