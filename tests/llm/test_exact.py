"""Exact duplicates against grouping by whole texts: nulls, empty and long texts, ties, repeated rows, hot groups, any block size."""

import collections
import hashlib

import numpy as np
import pytest

from memloom.llm import exact

SCHEMA = "doc_id long, text string, row long, name string, block int, peers int"


def rows_of(texts):
    return [(i, t, 1, "n", 2, 3) for i, t in texts]


def groups(texts):
    same = collections.defaultdict(list)
    for i, t in texts:
        same[t or ""].append(i)
    out = []
    for t, ids in same.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = 0
        for i in ids:
            kept = i == keep and not stays
            stays += kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def some_texts():
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abé "), int(n))) for n in (1, 3, 8, 16, 17, 40, 64, 65, 200)]
    texts = [None, "", "", " ", "x", "x ", "X", *base, *base[3:], base[4] + "z", base[8][:-1], base[8][:-1] + "Q", "z" + base[8][1:], "ab" * 500, "ab" * 500, "ab" * 499 + "ba", "ab" * 501]
    return [(k * 11 % 97, t) for k, t in enumerate(texts)] + [(None, "x"), (None, "only"), (None, "only"), (5, "twice"), (5, "twice"), (5, "other")]


@pytest.mark.parametrize("size, share", [(1, 1000), (4, 3), (8, 1), (2048, 1000)])
def test_against_grouping(spark, size, share):
    texts = some_texts()
    found = exact.duplicates(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3), size, share)
    assert found.columns == "doc_id keep_id group_size kept text_sha256".split()
    assert sorted(map(tuple, found.collect()), key=str) == groups(texts)


def test_empty_table(spark):
    assert exact.duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_names_are_integers_in_order_of_the_blocks(spark):
    texts = [(k, t) for k, t in enumerate(["bb", "aa", "bbaa", "aabb", "c", "", None])]
    named = exact.named_blocks(spark.createDataFrame(rows_of(texts), SCHEMA), 2).collect()
    whole = {r.row: texts[r.doc_id][1] or "" for r in named if r.pos == 0}
    name = {whole[r.row][2 * r.pos : 2 * r.pos + 2]: r.name for r in named}
    assert sorted(name, key=name.get) == sorted(name) and len(set(name.values())) == len(name)


def test_no_python_on_the_main_path(spark):
    plan = exact.duplicates(spark.createDataFrame(rows_of([(1, "a")]), SCHEMA))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
