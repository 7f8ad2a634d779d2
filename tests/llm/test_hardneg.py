"""Hard negatives against all pairs: nulls, non-finite components, ties, repeated rows, hot vectors and labels, large numbers, any size of parts and buckets."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memloom.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<double>, part int, norm string, anchor int, block long"


def some_rows():
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 0.3, (4, 6))
    rows = [(k, int(k % 4), [float(x) for x in centre[k % 4] + rng.normal(0, 0.15, 6)]) for k in range(240)]
    rows += [(300 + k, 1, [0.5] * 6) for k in range(60)]  # one vector very often
    rows += [(400 + k, 2, [0.25, 0.0, 0.5][: k % 4]) for k in range(8)]  # shorter ones, an empty one
    rows += [(50, 2, rows[50][2]), (50, 2, rows[50][2]), (60, 0, rows[3][2]), (60, 0, rows[3][2])]  # repeats and other rows of an id
    rows += [(500, None, [1.0]), (550, 1, None), (600, 1, [1.0, None]), (650, 2, [math.nan] * 6), (700, 3, [math.inf] * 6), (None, 1, [0.5] * 6)]
    rows += [(800, 3, [-1.0] * 6), (850, 7, [0.3] * 6), (-50, 1, [0.4] * 6), (-7, 2, [0.4] * 6)]
    return rows


def usable(rows):
    out = []
    for i, label, vector in rows:
        if i is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            out.append((i, label, [math.floor(256 * x) for x in vector]))
    return out


def by_pairs(rows, every):
    found = []
    for i, label, a in rows:
        if i % every:
            continue
        score = lambda c: sum(x * y for x, y in zip(a, c, strict=False))  # noqa: E731, B023
        near = sorted((-score(c), j) for j, other, c in rows if other == label and j != i)[:5]
        for p, j in near:
            fits = sorted((-score(c), n) for n, other, c in rows if other != label and 50 * -p <= 100 * score(c) <= 95 * -p)
            found += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(fits[:3])]
    return sorted(found)


@pytest.mark.parametrize("step, parts, bytes_", [(512, 64, 4 << 20), (7, 64, 600), (16, 3, 4 << 20)])
def test_against_all_pairs(spark, monkeypatch, step, parts, bytes_):
    monkeypatch.setattr(hardneg, "STEP", step)
    monkeypatch.setattr(hardneg, "PARTS", parts)
    monkeypatch.setattr(hardneg, "LEAST_ROWS", 10)
    monkeypatch.setattr(hardneg, "PART_BYTES", bytes_)
    rows = some_rows()
    df = spark.createDataFrame([(*r, 1, "n", 2, 3) for r in rows], SCHEMA).repartition(3)
    found = hardneg.mine(hardneg.whole_rows(df), F.col("vec_id") % 10 == 0)
    assert found.columns == "anchor_id positive_id rank negative_id positive_score negative_score".split()
    assert sorted(map(tuple, found.collect())) == by_pairs(usable(rows), 10)


def test_no_rows_and_no_anchors(spark):
    for rows in ([], [(1, 2, [0.5])], [(50, 2, [0.5])]):
        df = spark.createDataFrame([(*r, 1, "n", 2, 3) for r in rows], SCHEMA)
        assert hardneg.mine(hardneg.whole_rows(df), F.col("vec_id") % 50 == 0).count() == 0


def test_scores_are_whole_numbers_of_any_size():
    rng = np.random.default_rng(2)
    a, c = (rng.integers(-(2**40), 2**40, (5, 3)).astype(float) for _ in range(2))
    expected = [[max(-hardneg.MOST, min(hardneg.MOST, sum(int(x) * int(y) for x, y in zip(r, s, strict=True)))) for s in c] for r in a]
    assert hardneg.scores(a, c, False).tolist() == expected
    small = rng.integers(-300, 300, (5, 3)).astype(float)
    assert hardneg.scores(small, small, True).tolist() == hardneg.scores(small, small, False).tolist()


def test_buckets_that_cannot_reach_are_not_searched(monkeypatch):
    met = []
    plain = hardneg.scores
    monkeypatch.setattr(hardneg, "STEP", 1)
    monkeypatch.setattr(hardneg, "scores", lambda a, c, exact: met.append(len(c)) or plain(a, c, exact))
    right = pa.table({"vec_id": list(range(100)), "label": [1] * 100, "norm": [float(100 - k) for k in range(100)], "vector": [[float(100 - k)] for k in range(100)]})
    window = [{"lo": 4000, "hi": 9000, "kth": -hardneg.MOST}]
    left = pa.table({"anchor": [0], "vec_id": [500], "label": [2], "norm": [100.0], "vector": [[100.0]], "windows": [window]})
    found = hardneg.nearest(left, right, 2, False).to_pylist()
    assert [(r["id"], r["score"]) for r in found] == [(10, 9000), (11, 8900)] and len(met) < 14
