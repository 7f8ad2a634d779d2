"""Synthetic rows of associative recall: pairs of a key and a value that a row holds as its memory, and questions after it. Draws are hashes of row and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import draw

#: Tokens between a key and its value, after a pair, of a question, before an answer, and after it; the first key and the first value. Fixed values.
COLON, SEMICOLON, ASK, ANSWER, END, KEY, VALUE = 3, 4, 5, 6, 7, 10, 200
UNSUPERVISED = -100


def packed(rows: DataFrame, seed: int, pairs: int, questions: int, values: int) -> DataFrame:
    """(row, input_ids, is_evicted, write_mask, segment_ids, labels) of rows (row): `pairs` keys with drawn values are written and evicted once, as segment 0, then up to `questions` different keys are
    asked for, a segment each, of which the value and the end are supervised and nothing is written."""
    place = lambda k: F.col("row") * pairs + k
    value = lambda k: (F.lit(VALUE) + F.floor(draw(seed, "value", place(k)) * values)).cast("int")
    keys = F.sequence(F.lit(0), F.lit(pairs - 1))
    asked = F.slice(F.transform(F.array_sort(F.transform(keys, lambda k: F.struct(draw(seed, "asked", place(k)).alias("draw"), k.alias("k")))), lambda x: x["k"]), 1, min(questions, pairs))
    token = lambda ids, evicted, segment, labels: F.struct(*(x.cast("int").alias(n) for n, x in (("id", ids), ("evicted", evicted), ("segment", segment), ("label", labels))))
    none = F.lit(UNSUPERVISED)
    held = lambda k: F.array(*(token(x, F.lit(1), F.lit(0), none) for x in (k + KEY, F.lit(COLON), value(k), F.lit(SEMICOLON))))

    def question(k: Column, i: Column) -> Column:
        open_, answer = (F.lit(ASK), k + KEY, F.lit(ANSWER)), (value(k), F.lit(END))
        return F.array(*(token(x, F.lit(0), i + 1, none) for x in open_), *(token(x, F.lit(0), i + 1, x) for x in answer))

    tokens = F.concat(F.flatten(F.transform(keys, held)), F.flatten(F.transform(asked, question)))
    part = lambda name: F.transform("t", lambda x: x[name])
    made = rows.select("row", tokens.alias("t"))
    return made.select("row", part("id").alias("input_ids"), F.transform("t", lambda x: x["evicted"] == 1).alias("is_evicted"), F.transform("t", lambda x: x["evicted"].cast("float")).alias("write_mask"), part("segment").alias("segment_ids"), part("label").alias("labels"))
