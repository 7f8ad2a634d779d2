"""Scores of an answer against a list of accepted ones. Scores are doubles; partial credit is possible."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from memloom.functions.extract import recommendations
from memloom.functions.text import let, normalize, strip


def exact(golds: Column, pred: Column) -> Column:
    return let(normalize(pred), lambda p: F.exists(golds, lambda g: (normalize(g) == p) & (g != "")))


def contained(golds: Column, pred: Column) -> Column:
    return let(normalize(pred), lambda p: F.exists(F.transform(golds, normalize), lambda g: (g != "") & F.contains(p, g)))


def f1_tokens(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda t: (t != "") & (t != "and"))


def _overlap(p: Column, g: Column) -> Column:
    count = lambda words, word: F.size(words) - F.size(F.array_remove(words, word))  # noqa: E731  compiled, unlike a filter
    return F.aggregate(F.array_intersect(p, g), F.lit(0), lambda acc, t: acc + F.least(count(p, t), count(g, t)))


def token_lists_f1(p: Column, g: Column) -> Column:
    """F1 of two multisets of words, each given as a value that is computed already."""
    score = lambda same: F.when(same == 0, F.lit(0.0)).otherwise(2.0 * same / (F.size(p) + F.size(g)))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), F.lit(0.0)).otherwise(let(_overlap(p, g), score))


def shared_f1(same: str, size: str, item_size: str) -> Column:
    """F1 of two multisets of words, of their sizes and of how much they share."""
    return F.when(F.col(same) == 0, F.lit(0.0)).otherwise(2.0 * F.col(same) / (F.col(size) + F.col(item_size)))


def single_f1(pred: Column, gold: Column) -> Column:
    """F1 of the multisets of normalised words."""
    return let(f1_tokens(pred), lambda p: let(f1_tokens(gold), lambda g: token_lists_f1(p, g)))


def token_f1(golds: Column, pred: Column) -> Column:
    return let(f1_tokens(pred), lambda p: F.coalesce(F.array_max(F.transform(F.transform(golds, f1_tokens), lambda g: token_lists_f1(p, g))), F.lit(0.0)))


def comma_f1(pred: Column, gold: Column) -> Column:
    """Of comma-separated answers, each one's best candidate, averaged."""
    parts = lambda c: F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    candidates, answers = parts(pred), parts(gold)
    best = F.transform(answers, lambda a: F.array_max(F.transform(candidates, lambda c: single_f1(c, a))))
    total = F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(candidates) == 0) | (F.size(answers) == 0), F.lit(0.0)).otherwise(total / F.size(answers))


def category_f1(category: Column, golds: Column, pred: Column) -> Column:
    """Category 1 by commas, others as one answer; the best of the accepted answers, 0 without any."""
    usable = F.filter(golds, lambda g: g != "")
    many = F.array_max(F.transform(usable, lambda g: comma_f1(pred, g)))
    one = F.array_max(F.transform(usable, lambda g: single_f1(pred, g)))
    return F.when(F.coalesce(pred, F.lit("")) == "", F.lit(0.0)).otherwise(F.coalesce(F.when(category == 1, many).otherwise(one), F.lit(0.0)))


def needles(golds: Column, pred: Column) -> Column:
    """The share of accepted answers that occur in the text, in any case."""
    hits = F.size(F.filter(golds, lambda g: F.contains(F.lower(pred), F.lower(g))))
    return F.when((F.size(golds) == 0) | (pred == ""), F.lit(0.0)).otherwise(hits / F.size(golds))


def recall_at(golds: Column, pred: Column, k: int) -> Column:
    """The share of titles among the first k recommendations, exact matches alone."""
    preds = F.transform(F.slice(recommendations(pred), 1, k), normalize)
    wanted = F.transform(F.filter(golds, lambda g: g != ""), lambda g: normalize(F.regexp_replace(g, r"\([^()]*\)", "")))
    hits = F.size(F.filter(wanted, lambda g: F.array_contains(preds, g)))
    return F.when((F.size(wanted) == 0) | (F.size(preds) == 0), F.lit(0.0)).otherwise(hits / F.size(wanted))


def auxiliary(golds: Column, pred: Column) -> Column:
    """struct(rule, em, f1), f1 to four places; nothing for an empty answer."""
    empty = F.coalesce(pred, F.lit("")) == ""
    return F.struct(
        F.when(empty, F.lit(False)).otherwise(contained(golds, pred)).alias("rule"),
        F.when(empty, F.lit(False)).otherwise(exact(golds, pred)).alias("em"),
        F.when(empty, F.lit(0.0)).otherwise(F.round(token_f1(golds, pred), 4)).alias("f1"),
    )


def judged(kind: Column, golds: Column, pred: Column, verdict: Column) -> Column:
    """The score by the judge's name; `lm` takes the verdict that a model gave beforehand, and none counts as 0. Unknown names fail."""
    empty = (F.coalesce(pred, F.lit("")) == "") | (F.size(golds) == 0)
    k = F.regexp_extract(kind, r"^recall@(\d+)$", 1)
    preds = lambda n: F.transform(F.slice(recommendations(pred), 1, n), normalize)
    wanted = F.transform(F.filter(golds, lambda g: g != ""), lambda g: normalize(F.regexp_replace(g, r"\([^()]*\)", "")))
    n = F.greatest(F.lit(1), F.coalesce(F.try_to_number(F.nullif(k, F.lit("")), F.lit("999")).cast("int"), F.lit(1)))
    recall = F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.size(F.filter(wanted, lambda g: F.array_contains(preds(n), g))) / F.size(wanted))
    return (
        F.when(empty, F.lit(0.0))
        .when(kind == "em", exact(golds, pred).cast("double"))
        .when(kind == "contains", contained(golds, pred).cast("double"))
        .when(kind == "niah", needles(golds, pred))
        .when(kind == "f1", token_f1(golds, pred))
        .when(kind == "lm", F.coalesce(verdict.cast("double"), F.lit(0.0)))
        .when(k != "", recall)
        .otherwise(F.raise_error(F.concat(F.lit("unknown judge "), kind)).cast("double"))
    )


@F.pandas_udf(DoubleType())
def rouge_l(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The best F-measure of the longest common subsequence with any reference, on runs of a-z and 0-9. SQL has no such recursion over words."""
    import re

    word = re.compile(r"[a-z0-9]+")

    def one(golds: list[str] | None, pred: str | None) -> float:
        p, best = word.findall((pred or "").lower()), 0.0
        for gold in golds if golds is not None else []:
            g = word.findall((gold or "").lower())
            at: dict[str, int] = {}
            for j, y in enumerate(g):
                at[y] = at.get(y, 0) | 1 << j
            open_ = full = (1 << len(g)) - 1  # a row of the recursion, a bit for each place where it doesn't grow
            for x in p:
                if hit := open_ & at.get(x, 0):
                    open_ = (open_ + hit | open_ - hit) & full
            if same := len(g) - open_.bit_count():
                a, b = same / len(p), same / len(g)
                best = max(best, 2 * a * b / (a + b))
        return best

    for golds, preds in batches:
        yield pd.Series([one(g, p) for g, p in zip(golds, preds)])


@F.pandas_udf(DoubleType())
def similar_share(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The share of titles that some recommendation equals or resembles by a ratio of 0.9 (the standard library's matcher)."""
    from difflib import SequenceMatcher

    def one(wanted: list[str], preds: list[str]) -> float:
        if len(wanted) == 0 or len(preds) == 0:
            return 0.0
        return sum(any(g == p or SequenceMatcher(None, g, p).ratio() >= 0.9 for p in preds) for g in wanted) / len(wanted)

    for wanted, preds in batches:
        yield pd.Series([one(w, p) for w, p in zip(wanted, preds)])


def chained(golds: Column, pred: Column, verdict: Column) -> Column:
    """The reward's judge: an exact match is right, else the verdict that a model gave, else containment where there is none."""
    return F.when(exact(golds, pred), 1.0).when(verdict.isNotNull(), verdict.cast("double")).otherwise(judged(F.lit("contains"), golds, pred, verdict))
