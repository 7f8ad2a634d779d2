"""Training samples as layouts: lengths of chunks instead of tokens, so that a tokenizer's counts are all that a plan carries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.spans import chunk_spans, fixed_spans
from memloom.functions.text import let

#: What opens the user's turn before the first document, and the longest sample that is kept. Fixed values.
OPENER, MAX_LEN = "<|im_start|>user\n", 128_000


def _cut(n: Column, size: Column) -> Column:
    return F.transform(fixed_spans(n, size), lambda x: x["e"] - x["s"])


def layout(docs: Column, prompt: Column, answer: Column, mode: Column, size: Column, limit: Column, opener: int = len(OPENER), joints: tuple[int, int] = (1, 2)) -> Column:
    """struct(chunk_spans, qa_chunk_idx, total_len, supervised) of a sample of documents of these lengths; null above MAX_LEN.

    prompt and answer are the lengths of the tail: what follows the memory up to the answer, and the answer, which alone is supervised.
    Mode `unit`: every `size` documents, joined by one token (the first of `joints`), are a chunk, cut at half the limit where they exceed it, and the tail is one.
    Mode `token`: documents, joined by two tokens (the second), and the tail are cut every `size` tokens.
    """
    total = lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x)
    n = F.size(docs)
    unit = lambda s: total(F.slice(docs, s + 1, size)) + joints[0] * (F.least(size, n - s) - 1) + F.when(s == 0, opener).otherwise(0)
    units = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1, size)).otherwise(F.array().cast("array<int>")), unit)
    cut = F.flatten(F.transform(units, lambda u: F.when((limit > 0) & (u > limit), _cut(u, F.floor(limit / 2).cast("int"))).otherwise(F.array(u))))
    memory = total(docs) + joints[1] * F.greatest(n - 1, F.lit(0)) + opener
    by_unit = let(cut, lambda c: F.struct(F.concat(c, F.array(prompt + answer)).alias("chunks"), F.array(F.size(c)).alias("qa")))
    by_token = let(_cut(memory + prompt + answer, size), lambda c: F.struct(c.alias("chunks"), F.sequence(F.floor(memory / size).cast("int"), F.size(c) - 1).alias("qa")))
    made = F.when(mode == "unit", by_unit).otherwise(by_token)
    whole = let(made, lambda x: F.struct(chunk_spans(x["chunks"]).alias("chunk_spans"), x["qa"].alias("qa_chunk_idx"), total(x["chunks"]).alias("total_len"), answer.alias("supervised")))
    return let(whole, lambda x: F.when(x["total_len"] <= MAX_LEN, x))


def assembled(docs: Column, prompt: Column, answer: Column, mode: Column, size: Column, limit: Column, chunk_limit: Column, opener: list[int], joints: tuple[list[int], list[int]]) -> Column:
    """A whole sample of token ids: struct(input_ids, loss_mask, chunk_spans, qa_chunk_idx, chunk_limit, token_limit, meta); null above MAX_LEN.

    docs: an array of ids for each document; prompt and answer: ids of the tail; opener: what stands before the first document; joints: what joins documents in the modes `unit` and `token` of layout().
    The answer alone is supervised. Without documents a sample by units has no opener, one by tokens has.
    """
    array = lambda ids: F.array(*map(F.lit, ids)).cast("array<int>")
    lengths = F.transform(docs, F.size)
    plan = layout(lengths, F.size(prompt), F.size(answer), mode, size, limit, len(opener), tuple(map(len, joints)))
    unit = F.flatten(F.transform(docs, lambda d, i: F.concat(F.when(i == 0, array(opener)).when(i % size == 0, array([])).otherwise(array(joints[0])), d)))
    token = F.concat(array(opener), F.flatten(F.transform(docs, lambda d, i: F.concat(F.when(i == 0, array([])).otherwise(array(joints[1])), d))))
    memory = F.when(mode == "unit", unit).otherwise(token)

    def sample(x: Column) -> Column:
        meta = F.struct(F.size(x["chunk_spans"]).alias("n_chunks"), x["total_len"].alias("total_len"), F.size(x["qa_chunk_idx"]).alias("n_qa_chunks"))
        mask = F.concat(F.array_repeat(F.lit(0).cast("tinyint"), x["total_len"] - F.size(answer)), F.array_repeat(F.lit(1).cast("tinyint"), F.size(answer)))
        whole = F.struct(F.concat(memory, prompt, answer).alias("input_ids"), mask.alias("loss_mask"), x["chunk_spans"].alias("chunk_spans"), x["qa_chunk_idx"].alias("qa_chunk_idx"), chunk_limit.alias("chunk_limit"), F.coalesce(limit, F.lit(-1)).alias("token_limit"), meta.alias("meta"))
        return F.when(x.isNotNull(), whole)

    return let(plan, sample)


def numbered(rows: DataFrame, order: str, dataset: str, split: str) -> DataFrame:
    """The rows of a split that have a sample, with ids by their order: dataset-split-number."""
    from memloom.operators.splits import by_id

    placed = by_id(rows.where("sample is not null").withColumn("_all", F.lit(0)), ["_all"], order)
    return placed.withColumn("id", F.concat(F.lit(f"{dataset}-{split}-"), F.col("place").cast("string"))).drop("_all", "place", "n")


def bisected(text: Column, budget: int) -> Column:
    """The pieces of a text, halved (after the last space before the middle) until each is within `budget` estimated tokens of three characters."""
    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        def cut(text: str) -> list[str]:
            done, open_ = [], [text]
            while open_:
                piece = open_.pop()
                if max(1, len(piece) // 3) <= budget:
                    done.append(piece)
                    continue
                middle = len(piece) // 2
                at = piece.rfind(" ", 0, middle)
                at = at + 1 if at > 0 else middle
                open_ += [piece[at:], piece[:at]]
            return done

        return texts.map(lambda t: None if t is None else cut(t))

    return pieces(text)
