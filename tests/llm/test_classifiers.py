"""Classifiers against plain code: measures of lines, slopes of both losses, neutral mentions of groups, and the held-out rows of the given tables."""

import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from memloom.llm import quality, toxicity
from memloom.llm.base import flat
from memloom.llm.learn import labelled

MARKS = ".,;:?'\"-"


def measured(text):
    """The measures of a text's lines one by one, as (values, bytes)."""
    out, lines = [], []
    for line in text.split("\n"):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
        if words:
            lines.append((line.strip("\x20\t\x0b\x0c\r").encode(), words))
    plain = [tuple(w.lower() if w.isascii() else w.translate({k: k + 32 for k in range(65, 91)}) for w in words) for _, words in lines]
    for (data, words), low in zip(lines, plain, strict=True):
        kinds = [sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data), sum(48 <= b <= 57 for b in data), sum(b in (9, 10, 11, 12, 13, 32) for b in data), sum(b in MARKS.encode() for b in data), 0, sum(b > 127 for b in data)]
        kinds[5] = len(data) - sum(kinds)
        sign = lambda w: w[-1].isascii() and not w[-1].isalnum() and w[-1] not in MARKS
        ends = words[-1][-1] in MARKS
        copies = sum(sorted(x) == sorted(low) for x in plain)
        out.append(([*(k / len(data) for k in kinds), math.log1p(len(data)), (len(data) + 1) / len(words) - 1, len(set(low)) / len(words), sum(a == b for a, b in itertools.pairwise(low)) / len(words), sum(map(sign, words)) / len(words), math.log(copies), ends + 2.0 * ("A" <= words[0][0] <= "Z")], len(data)))
    return out


def test_measures_are_those_of_plain_code():
    texts = ["One line. Two!\n\n  two words \nONE line.\nline. one\n$$$ 99% a a a", "", " \n\t", "é Ünï 12-3\r\nend;", "x", "a\nb\na\nA"]
    x, size, first = quality.measures(*flat(pa.array(texts)))
    for k, text in enumerate(texts):
        expected = measured(text)
        assert first[k + 1] - first[k] == len(expected)
        for got, bytes_, (values, length) in zip(x[first[k] : first[k + 1]], size[first[k] : first[k + 1]], expected, strict=True):
            assert bytes_ == length and got == pytest.approx(values)


def test_slope_of_the_lines_likelihood(monkeypatch):
    """Against differences of the likelihood, summed over all labellings."""
    monkeypatch.setattr(quality, "MEASURES", 2)
    monkeypatch.setattr(quality, "BINS", 2)
    rng = np.random.default_rng(3)
    first, k = np.array([0, 3, 3, 5]), 12
    cells = rng.integers(-1, k, (5, 6))
    truth, weight = np.array([1.0, 1, 1, 0, 0]), np.array([0.2, 0.2, 0.2, 0.5, 0.5])

    def loss(v):
        total = quality.RIDGE / 2 * ((v[:k] ** 2).sum() + (v[k + 1 :] ** 2).sum())
        ties = v[k + 1 :].reshape(2, 2)
        for a, b in itertools.pairwise(first.tolist()):
            if a == b:
                continue
            score = {}
            for labels in itertools.product((0, 1), repeat=b - a):
                score[labels] = sum(y * (v[k] + sum(v[c] for c in cells[a + t] if c >= 0)) for t, y in enumerate(labels)) + sum(ties[x, y] for x, y in itertools.pairwise(labels))
            total += weight[a] * (math.log(sum(map(math.exp, score.values()))) - score[tuple(truth[a:b].astype(int))])
        return total

    v = rng.normal(size=k + 5)
    step = 1e-6 * np.eye(k + 5)
    assert quality.slope(cells, truth, weight, first)(v) == pytest.approx([(loss(v + d) - loss(v - d)) / 2e-6 for d in step], abs=1e-5)


def test_slope_of_scaled_features():
    rng = np.random.default_rng(5)
    f, n, pairs = 5, 8, 3
    row, place = np.repeat(np.arange(n), 3), rng.integers(0, f, 3 * n)
    pair = np.repeat(np.arange(pairs), 4), rng.integers(0, f, 4 * pairs), np.tile([1.0, 1.0, -1.0, -1.0], pairs)
    z, x, scale = rng.integers(0, 2, n).astype(float), rng.normal(size=f + 1), rng.uniform(0.3, 6, f)

    def loss(v):
        w = v[:f] * scale
        logit = v[f] + np.bincount(row, w[place], minlength=n)
        change = np.bincount(pair[0], w[pair[1]] * pair[2], minlength=pairs)
        return np.mean(np.log1p(np.exp(logit)) - z * logit) + toxicity.RIDGE / 2 * (v[:f] ** 2).sum() + toxicity.COUNTERFACTUAL * np.mean(change**2)

    expected = [(loss(x + d) - loss(x - d)) / 2e-6 for d in 1e-6 * np.eye(f + 1)]
    assert toxicity.gradient(x, z, row, place, *pair, pairs, scale) == pytest.approx(expected, abs=1e-4)


def test_rate_of_false_alarms_on_neutral_mentions(monkeypatch):
    """Toxic training texts nearly always name a group, and half of them have nothing else to know them by: the penalty keeps the groups' names from standing for it."""
    rng = np.random.default_rng(6)
    pool = ["".join(rng.choice(list("aeioubcdfg"), 6)) for _ in range(200)]
    terms = ["women", "muslims", "immigrants", "jews", "gay"]
    sentence = lambda *more: " ".join([*rng.choice(pool, 12), *more]) + "."
    texts = [sentence(*(["scum"] if k % 4 == 1 else []), str(rng.choice(terms))) if k % 2 else sentence(*([str(rng.choice(terms))] if k % 20 == 0 else [])) for k in range(800)]
    y = np.array([float(k % 2) for k in range(800)])
    neutral = [sentence(t) for t in terms * 40]
    toxic = [sentence("scum", t) for t in terms * 40] + [sentence("scum") for _ in range(100)]
    rates, recall = [], []
    for weight in (0.0, 1.0):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", weight)
        model = toxicity.fit(texts, y)
        rates.append((model.scores(*flat(pa.array(neutral))) >= 0.5).mean())
        recall.append((model.scores(*flat(pa.array(toxic))) >= 0.5).mean())
    assert rates[1] < rates[0] / 2 and recall[1] > 0.95, (rates, recall)


@pytest.mark.parametrize(("module", "label", "worst"), [(quality, "quality", 0.012), (toxicity, "toxic", 0.012)])
def test_held_out_rows_of_the_given_tables(spark, module, label, worst):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts, y = labelled(documents, labels, label, module.DIVISOR, module.REST)
    held = [r for r in documents.join(labels, "doc_id").select("doc_id", "text", label).collect() if zlib.crc32(str(r.doc_id).encode()) % module.DIVISOR == module.REST]
    found = module.fit(texts, y).scores(*flat(pa.array([r.text for r in held]))) >= 0.5
    truth = np.array([r[label] == 1 for r in held])
    assert (found != truth).mean() <= worst
    if label == "toxic":
        assert (found & truth).sum() >= 0.93 * truth.sum() and (found & ~truth).sum() <= 0.005 * (~truth).sum()
