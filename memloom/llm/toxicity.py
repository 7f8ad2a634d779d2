"""Operator 4: toxicity by a counterfactually regularised classifier.

Logistic regression over the presence of words and of their beginnings in the whole text, each scaled by the log of the ratio of its odds among toxic texts and among others, so that a rare
word which only toxic texts have isn't outvoted by many common ones. Beside the labels' likelihood the
fit penalises what identity terms change: wherever a labelled sentence names a group, the term is swapped for another of its kind, in one
sentence of each labelled text two terms of a kind are put in for a word, and the squared change of the score is added to the loss, so that naming a group moves a
score as little as the penalty allows.

Labels are learned from a bounded sample of the rows allowed (see learn.SAMPLE_ROWS). Null and empty texts score like a text without known features.
Without labelled rows of both kinds every score is the share of toxic labels (a half without any). Repeated rows score alike, a score of a half (ties) is toxic; an empty
table gives no rows. A very long text is scored whole, its words' beginnings taking some 150 bytes a word meanwhile. Columns beside doc_id and text are left out, but for reject(), which keeps all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.base import _BYTE, CHUNK_BYTES, Words, chunks, mix, powers, release, table
from memloom.llm.learn import SAMPLE_ROWS, adam, held_out, labelled, sigmoid

DIVISOR, REST = 5, 0
#: Bytes of the beginnings of words that count as features.
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
#: Features kept, the rows that must hold one, and the weights of the ridge and of the counterfactual penalty.
FEATURES, LEAST_ROWS, RIDGE, COUNTERFACTUAL = 40_000, 3, 2e-3, 1.0
#: The least and the largest scale of a feature.
SCALES = (0.3, 6.0)
#: Terms that name groups, by kind; a term is swapped for others of its kind. Fixed values.
IDENTITY = (
    "women men girls boys woman man mujeres hombres femmes hommes frauen männer".split(),
    "black white asian african european latino arab negros blancos noirs blancs schwarze weiße".split(),
    "christian christians muslim muslims jewish jews hindu buddhist atheist cristianos musulmanes chrétiens musulmans juifs christen muslime juden".split(),
    "gay straight lesbian bisexual transgender queer homosexual heterosexual".split(),
    "immigrants refugees foreigners natives inmigrantes refugiados étrangers réfugiés ausländer flüchtlinge".split(),
    "disabled deaf blind autistic elderly young old".split(),
)
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows and hashes of features, kind by kind: whole words, then beginnings."""
    words = Words(_LETTERS[buf], off)
    row = words.row()
    yield row, words.hash
    if not len(words.hash):
        return
    size = words.end - words.start
    for length in PREFIXES:
        at = np.flatnonzero(size > length)
        start = words.start[at]
        total = np.zeros(len(at), np.uint64)
        for k, power in enumerate(powers(length)):
            total += _BYTE[words.buf[start + k]] * power
        yield row[at], mix(total + np.uint64(length))


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.keys >> np.uint64(42)] = True

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, -1 if unknown."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, key in features(buf, off):
            near = np.flatnonzero(self.sieve[key >> np.uint64(42)])
            place = self.lookup(key[near])
            rows.append(row[near][place >= 0])
            places.append(place[place >= 0])
        pairs = np.unique(np.concatenate(rows) * (len(self.keys) + 1) + np.concatenate(places))
        row, place = np.divmod(pairs, len(self.keys) + 1)
        return sigmoid(self.bias + np.bincount(row, self.weights[place], minlength=len(off) - 1)) if len(pairs) else np.full(len(off) - 1, sigmoid(np.array(self.bias)))


def presence(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (row, feature) of texts, in order of rows, a chunk at a time."""
    at = 0
    for part, buf, off in chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"]), limit=CHUNK_BYTES // 4):
        found = list(features(buf, off))
        row, key = (np.concatenate([x[k] for x in found]) for k in range(2))
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        yield row[keep] + at, key[keep]
        at += part.num_rows


def counted(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features in order, the rows that have each, and those of label 1."""
    keys, n, n1 = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for row, key in presence(texts):
        new, which = np.unique(key, return_inverse=True)
        both, place = np.unique(np.concatenate((keys, new)), return_inverse=True)
        n = np.bincount(place, np.concatenate((n, np.bincount(which))), minlength=len(both))
        n1 = np.bincount(place, np.concatenate((n1, np.bincount(which, y[row]))), minlength=len(both))
        keys = both
    return keys, n, n1


def placed(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place of the feature) for the model's features in texts."""
    rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, key in presence(texts):
        place = model.lookup(key)
        rows.append(row[place >= 0])
        places.append(place[place >= 0])
    return np.concatenate(rows), np.concatenate(places)


def swaps(texts: list[str], rng: np.random.Generator) -> tuple[list[str], list[str]]:
    """Sentences with an identity term, and the same with another term of its kind."""
    kinds = {term: kind for kind in IDENTITY for term in kind}
    named = re.compile(rf"\b({'|'.join(map(re.escape, kinds))})\b", re.IGNORECASE)
    one, other = [], []
    plain = []
    for text in texts:
        sentences = _SENTENCE.findall(text)
        if sentences:
            plain.append(sentences[int(rng.integers(len(sentences)))])
        if named.search(text):
            for sentence in sentences:
                for hit in named.finditer(sentence):
                    kind = [t for t in kinds[hit[0].lower()] if t != hit[0].lower()]
                    one.append(sentence)
                    other.append(sentence[: hit.start()] + kind[int(rng.integers(len(kind)))] + sentence[hit.end() :])
    for k, sentence in enumerate(plain):
        words = sentence.split() or ["-"]
        kind, spot = IDENTITY[k % len(IDENTITY)], int(rng.integers(len(words)))
        a = int(rng.integers(len(kind)))
        b = (a + 1 + int(rng.integers(len(kind) - 1))) % len(kind)
        one.append(" ".join([*words[:spot], kind[a], *words[spot + 1 :]]))
        other.append(" ".join([*words[:spot], kind[b], *words[spot + 1 :]]))
    return one, other


def gradient(x: np.ndarray, z: np.ndarray, row: np.ndarray, place: np.ndarray, pair_row: np.ndarray, pair_place: np.ndarray, pair_sign: np.ndarray, pairs: int, scale: np.ndarray | float = 1.0) -> np.ndarray:
    """The slope of the loss at x (a weight for each feature of that scale, then the bias): the mean log loss of rows with labels z, the ridge, and the penalty on the mean squared change between the sentences of a pair."""
    f = len(x) - 1
    w = x[:f] * scale
    error = (sigmoid(x[f] + np.bincount(row, w[place], minlength=len(z))) - z) / len(z)
    g = np.bincount(place, error[row], minlength=f)
    change = np.bincount(pair_row, w[pair_place] * pair_sign, minlength=pairs)
    g += COUNTERFACTUAL * 2 / pairs * np.bincount(pair_place, change[pair_row] * pair_sign, minlength=f)
    return np.append(g * scale + RIDGE * x[:f], error.sum())


def fit(texts: list[str], y: np.ndarray, steps: int = 200) -> Model:
    """The classifier of labelled texts."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    if not len(y):
        return none
    share = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return Model(none.keys, none.weights, float(np.log(share / (1 - share))))
    part = np.arange(len(y)) % 5  # every fifth row sets the scale of the scores
    if min(len(np.unique(y[part < 4])), len(np.unique(y[part == 4]))) < 2:
        part[:] = 0
    learn, scale = np.flatnonzero(part < 4), np.flatnonzero(part == 4)
    t, z = [texts[k] for k in learn], y[learn]
    keys, n, n1 = counted(t, z)
    # Chi-square of presence against the label.
    expected = n * z.mean()
    chi = np.where(n >= LEAST_ROWS, (n1 - expected) ** 2 / np.maximum(expected * (1 - z.mean()), 1e-9), -1)
    kept = np.sort(np.argsort(-chi, kind="stable")[: min(FEATURES, int((chi >= 0).sum()))])
    odds = lambda hits, rows: np.log((hits[kept] + 0.5) / (rows + 1))
    weight = np.clip(np.abs(odds(n1, z.sum()) - odds(n - n1, len(z) - z.sum())), *SCALES)
    model = Model(keys[kept], np.zeros(len(kept)), 0.0)
    row, place = placed(model, t)
    one, other = swaps(t, np.random.default_rng(7))
    parts = []
    for sign, sentences in ((1.0, one), (-1.0, other)):
        r, p = placed(model, sentences)
        parts.append((r, p, np.full(len(r), sign)))
    pair_row, pair_place, pair_sign = (np.concatenate([x[k] for x in parts]) for k in range(3))
    pairs, f = max(1, len(one)), len(kept)

    def slope_at(x: np.ndarray) -> np.ndarray:
        return gradient(x, z, row, place, pair_row, pair_place, pair_sign, pairs, weight)

    x = adam(slope_at, np.append(np.zeros(f), np.log(share / (1 - share))), steps, 0.05) * np.append(weight, 1.0)
    slope, shift = 1.0, 0.0
    if len(scale):
        r, p = placed(model, [texts[k] for k in scale])
        logit = x[f] + np.bincount(r, x[p], minlength=len(scale))

        def slant(ab: np.ndarray) -> np.ndarray:
            error = (sigmoid(ab[0] * logit + ab[1]) - y[scale]) / len(scale)
            return np.array([(error * logit).sum() + 1e-3 * (ab[0] - 1), error.sum()])

        slope, shift = adam(slant, np.array([1.0, 0.0]), 600, 0.05)
    del row, place, keys, n, n1, parts, pair_row, pair_place, pair_sign
    release()
    return Model(model.keys, slope * x[:f], float(slope * x[f] + shift))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of documents (doc_id, text), which may have further columns."""
    keys, weights, bias = model.keys, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(keys, weights, bias)
        for batch in batches:
            for part, buf, off in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fitted.scores(buf, off))], ["doc_id", "score"])
            release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of documents that score below the threshold, with all their columns."""
    keys, weights, bias, place = model.keys, model.weights, model.bias, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(keys, weights, bias)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
            found = [fitted.scores(buf, off) for _, buf, off in chunks(texts)]
            yield batch.filter(pa.array(np.concatenate(found) < threshold)) if found else batch
            release()

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of documents, learned from labels (doc_id, toxic)."""
    model = fit(*labelled(docs, labels, "toxic", DIVISOR, REST, rows))
    return score(docs, model).select("doc_id", held_out(DIVISOR, REST).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
