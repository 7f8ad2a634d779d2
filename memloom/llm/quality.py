"""Operator 1: document quality by a linear-chain conditional random field over lines.

Every line is a position of the chain, labelled good or bad. Its features are binned measures of its own bytes and words and
of the lines before and after it; two labels are tied by a transition matrix. A document's quality label is the label of its
lines, each document counting once however many lines it has. Forward-backward gives each line's probability of being good,
and their mean, weighted by the lines' bytes, the document's; a last scaling on rows left out of the fit gives the score.

Lines are what \\n separates, with at least one word; texts without words (null and empty ones too) have none and score the
share of good labels. Without labelled rows of both kinds every score is that share (a half without any). Labels are learned from a bounded sample (see learn.SAMPLE_ROWS).
Repeated rows score alike, a score of a half (ties) is good; an empty table gives no rows. A very long text is scored whole, in memory of some 300 bytes a word and 400 a line.
Columns beside doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.base import Words, chunks, release, table
from memloom.llm.learn import SAMPLE_ROWS, adam, held_out, labelled, sigmoid

DIVISOR, REST = 3, 1
BINS, RIDGE, STEPS = 10, 1e-3, 150
MEASURES = 14


def _kinds() -> np.ndarray:
    """Whether a byte is upper case, lower case, digit, white space, sentence mark, other ASCII sign, beyond ASCII."""
    kind = np.zeros((7, 256), np.float32)
    kind[0, 65:91] = kind[1, 97:123] = kind[2, 48:58] = 1
    kind[3, [9, 10, 11, 12, 13, 32]] = 1
    kind[4, [ord(c) for c in ".,;:?'\"-"]] = 1
    kind[6, 128:] = 1
    kind[5] = 1 - kind.sum(0)
    return kind


_KINDS = _kinds()


def measures(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of the lines of all rows, their bytes, and each row's first line (one more at the end)."""
    empty = np.zeros((0, MEASURES)), np.zeros(0), np.zeros(len(off), np.int64)
    words = Words(buf, off, lower=True)
    if not len(words.start):
        return empty
    stops = np.unique(np.concatenate((off, np.flatnonzero(buf == 10) + 1)))
    line_of = np.searchsorted(stops, words.start, "right") - 1
    head = np.flatnonzero(np.append(True, line_of[1:] != line_of[:-1]))  # the first word of each line with words
    per = np.diff(np.append(head, len(line_of)))
    begin, end = words.start[head], words.end[head + per - 1]
    size = (end - begin).astype(float)
    row = np.searchsorted(off, begin, "right") - 1
    first = np.searchsorted(row, np.arange(len(off)))
    out = np.zeros((len(head), MEASURES))
    for k, kind in enumerate(_KINDS):
        sums = np.concatenate(([0.0], np.cumsum(kind[buf], dtype=np.float64)))
        out[:, k] = (sums[end] - sums[begin]) / size
    out[:, 7] = np.log1p(size)
    out[:, 8] = (size + 1) / per - 1  # mean bytes of a word
    line = np.repeat(np.arange(len(head)), per)
    order = np.lexsort((words.hash, line))
    h, at = words.hash[order], line[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1]))
    out[:, 9] = np.bincount(at[fresh], minlength=len(head)) / per  # distinct words
    same = np.zeros(len(line))
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (line[1:] == line[:-1])
    out[:, 10] = np.bincount(line, same, minlength=len(head)) / per  # words that repeat the one before
    last = buf[words.end - 1]
    marked = (_KINDS[5][last] > 0).astype(float)
    out[:, 11] = np.bincount(line, marked, minlength=len(head)) / per  # words that end in a sign
    total = np.add.reduceat(words.hash, head)
    key = np.lexsort((total, row))
    a, b = total[key], row[key]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    group = np.cumsum(new) - 1
    copies = np.empty(len(head))
    copies[key] = np.bincount(group)[group]
    out[:, 12] = np.log(copies)  # lines of the same words in the document
    out[:, 13] = (_KINDS[4][last[head + per - 1]] > 0) + 2.0 * (_KINDS[0][buf[begin]] > 0)  # how the line ends and begins
    return out, size, first


@dataclass
class Model:
    edges: np.ndarray = field(default_factory=lambda: np.zeros((MEASURES, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((3, MEASURES, BINS)))
    ties: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    share: float = 0.5
    fitted: bool = False

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[k], x[:, k], "right") for k in range(MEASURES)], 1)

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        x, size, first = measures(buf, off)
        if not self.fitted or not len(x):
            return np.full(len(off) - 1, self.share)
        mean = self.means(neighbours(self.bins(x), first), size, first)
        return np.where(np.diff(first) > 0, sigmoid(self.slope * _logit(mean) + self.shift), self.share)

    def means(self, cells: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted marginals of documents; a half without lines."""
        good, _ = marginals(emissions(cells, self.weights.reshape(-1), self.bias), self.ties, first)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        weight = np.bincount(row, size, minlength=len(first) - 1)
        return np.where(weight > 0, np.bincount(row, size * good, minlength=len(first) - 1) / np.maximum(weight, 1e-9), 0.5)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def neighbours(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the weights of each line's own bins and of those of the line before and after; -1 past a document's ends."""
    cell = np.arange(MEASURES) * BINS + bins
    before, after = np.full_like(cell, -1), np.full_like(cell, -1)
    before[1:], after[:-1] = cell[:-1] + MEASURES * BINS, cell[1:] + 2 * MEASURES * BINS
    starts = first[:-1][np.diff(first) > 0]
    before[starts] = -1
    after[np.append(starts[1:], len(cell)) - 1] = -1
    return np.concatenate((cell, before, after), 1)


def emissions(cells: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return bias + np.append(weights, 0.0)[cells].sum(1)


def marginals(emission: np.ndarray, ties: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of being good, and that of each pair of labels of a line (rows) and the next."""
    n, counts = len(emission), np.diff(first)
    docs = np.argsort(-counts, kind="stable")
    starts, counts = first[:-1][docs], counts[docs]
    longest = int(counts[0]) if len(counts) else 0
    active = [int(np.searchsorted(-counts, -t, "left")) for t in range(longest)]  # documents with more than t lines
    local = np.stack((np.zeros(n), emission), 1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(longest):
        at = starts[: active[t]] + t
        if t == 0:
            value = local[at]
        else:
            past = alpha[at - 1][:, :, None] + ties
            value = np.logaddexp(past[:, 0], past[:, 1]) + local[at]
        alpha[at] = value - np.logaddexp(value[:, :1], value[:, 1:])
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        ahead = ties + (local[at + 1] + beta[at + 1])[:, None, :]
        value = np.logaddexp(ahead[:, :, 0], ahead[:, :, 1])
        beta[at] = value - np.logaddexp(value[:, :1], value[:, 1:])
    joint = alpha + beta
    good = sigmoid(joint[:, 1] - joint[:, 0])
    pairs = np.zeros((n, 2, 2))
    inner = np.ones(n, bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    at = np.flatnonzero(inner)
    both = alpha[at][:, :, None] + ties + (local[at + 1] + beta[at + 1])[:, None, :]
    both = np.exp(both - both.max((1, 2), keepdims=True))
    pairs[at] = both / both.sum((1, 2), keepdims=True)
    return good, pairs


def slope(cells: np.ndarray, truth: np.ndarray, weight: np.ndarray, first: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The slope of the loss at weights of cells, a bias and four ties: minus the log likelihood of the true labelling, each line's and pair's part of it by the line's weight, and the ridge. Lines of a document have one weight."""
    k = 3 * MEASURES * BINS
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inner = np.append(row[1:] == row[:-1], False)
    goal = np.zeros((len(row), 2, 2))
    goal[np.flatnonzero(inner), truth[inner].astype(int), truth[np.flatnonzero(inner) + 1].astype(int)] = 1
    flat_cells = np.where(cells < 0, k, cells).reshape(-1)

    def gradient(v: np.ndarray) -> np.ndarray:
        good, pairs = marginals(emissions(cells, v[:k], v[k]), v[k + 1 :].reshape(2, 2), first)
        error = (good - truth) * weight
        own = np.bincount(flat_cells, np.repeat(error, cells.shape[1]), minlength=k + 1)[:k]
        tie = ((pairs - goal) * weight[:, None, None]).sum(0).reshape(-1)
        return np.concatenate((own + RIDGE * v[:k], [error.sum()], tie + RIDGE * v[k + 1 :]))

    return gradient


def fit(texts: list[str], y: np.ndarray, steps: int = STEPS) -> Model:
    """The model of labelled texts."""
    if not len(y):
        return Model()
    share = float((y.sum() + 0.5) / (len(y) + 1))
    if y.min() == y.max():
        return Model(share=share)
    found = [measures(buf, off) for _, buf, off in chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"]))]
    x, size = (np.concatenate([f[k] for f in found]) for k in range(2))
    counts = np.concatenate([np.diff(f[2]) for f in found])
    first = np.concatenate(([0], np.cumsum(counts)))
    if not len(x):
        return Model(share=share)
    model = Model(share=share, fitted=True)
    model.edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    cells = neighbours(model.bins(x), first)
    part = np.arange(len(y)) % 5
    if min(len(np.unique(y[(part < 4) & (counts > 0)])), len(np.unique(y[(part == 4) & (counts > 0)]))) < 2:
        part[:] = 0
    row = np.repeat(np.arange(len(y)), counts)
    weight = ((part < 4) / np.maximum(counts, 1))[row] / max(1, int(((part < 4) & (counts > 0)).sum()))
    truth, k = y[row], 3 * MEASURES * BINS
    v = adam(slope(cells, truth, weight, first), np.zeros(k + 5), steps, 0.1)
    model.weights, model.bias, model.ties = v[:k].reshape(3, MEASURES, BINS), float(v[k]), v[k + 1 :].reshape(2, 2)
    scale = np.flatnonzero((part == 4) & (counts > 0))
    if len(scale):
        logit = _logit(model.means(cells, size, first))[scale]

        def slant(ab: np.ndarray) -> np.ndarray:
            error = (sigmoid(ab[0] * logit + ab[1]) - y[scale]) / len(scale)
            return np.array([(error * logit).sum() + 1e-3 * (ab[0] - 1), error.sum()])

        model.slope, model.shift = map(float, adam(slant, np.array([1.0, 0.0]), 600, 0.05))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of documents (doc_id, text), which may have further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(buf, off))], ["doc_id", "score"])
            release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of documents, learned from labels (doc_id, quality)."""
    model = fit(*labelled(docs, labels, "quality", DIVISOR, REST, rows))
    return score(docs, model).select("doc_id", held_out(DIVISOR, REST).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
