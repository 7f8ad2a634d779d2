"""Runs of words against brute force: every phase by itself, the contract's rows, nulls, empty and long texts, repeated rows, clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from memloom.llm import periodic
from memloom.llm.base import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, row long, start string, period int, n_runs int"


def runs_by_hand(words, least=24, times=3):
    words, out = list(words), []
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if j > i and len(run) >= max(least, times * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                out.append((i, len(run), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(count, most=70):
    rng = np.random.default_rng(1)
    for _ in range(count):
        n = int(rng.integers(2, most))
        words = rng.integers(0, int(rng.integers(1, 5)), n)
        if rng.random() < 0.6:
            p, a = int(rng.integers(1, 12)), int(rng.integers(0, n))
            words[a:] = words[a + np.arange(n - a) % min(p, n - a)]
        yield words


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (4, 2), (2, 2)])
def test_runs(least, times):
    for words in sequences(300):
        assert list(zip(*(x.tolist() for x in periodic.all_runs(words, least, times)), strict=True)) == runs_by_hand(words, least, times)


def test_blocks_are_longest_earlier_prefixes():
    for words in sequences(60, 40):
        w, starts, at = words.tolist(), [], 0
        while at < len(w):
            starts.append(at)
            at += max(1, max((next((k for k in range(len(w) - at) if w[j + k] != w[at + k]), len(w) - at) for j in range(at)), default=1))
        assert periodic.Substrings(words).blocks() == starts


def test_tree_and_leftmost_squares():
    for words in sequences(60, 40):
        tree, w, n = periodic.Substrings(words), words.tolist(), len(words)
        assert tree.leaves.tolist() == sorted(range(n), key=lambda i: w[i:])
        i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(n), np.arange(n)))
        there = i != j
        i, j = i[there], j[there]
        same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert tree.forward(i, j).tolist() == [same(w[a:], w[b:]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert tree.backward(i, j).tolist() == [same(w[:a][::-1], w[:b][::-1]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        low, high = tree.interval(np.arange(n), np.minimum(3, n - np.arange(n)))
        assert [sorted(tree.leaves[a:b].tolist()) for a, b in zip(low, high, strict=True)] == [[k for k in range(n) if w[k : k + min(3, n - i)] == w[i : i + min(3, n - i)]] for i in range(n)]
        inside = [(s, e, k) for s, e, k in zip(*(x.tolist() for x in periodic.stretches(tree)), strict=True)]
        known = set()
        for s in range(n):
            for k in range(1, (n - s) // 2 + 1):
                square = tuple(w[s : s + 2 * k])
                if square[:k] == square[k:] and square not in known:
                    known.add(square)  # leftmost, as s rises
                    assert any(a <= s and s + 2 * k <= e and k % p == 0 for a, e, p in inside)


def test_rows_and_cuts(monkeypatch):
    for size in (40, periodic.SEQUENCE):
        monkeypatch.setattr(periodic, "SEQUENCE", size)
        monkeypatch.setattr(periodic, "PAIRS", 50)
        texts = list(sequences(40, 120))
        hashes = mix(np.concatenate(texts).astype(np.uint64) + np.uint64(9))
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        first = np.cumsum([0] + [len(t) for t in texts])
        expected = [(s + int(f), n, q) for t, f in zip(texts, first, strict=False) for s, n, q in runs_by_hand(t)]
        assert list(zip(*(x.tolist() for x in periodic.runs_of_rows(hashes, row)), strict=True)) == expected


def described(doc_id, text, periods=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if periods and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(words)
    best = min(found, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def some_texts():
    rng = np.random.default_rng(7)
    vocabulary = "a b ö dd e ; g' 1".split()
    texts = [None, "", " \n", "one", "a " * 24, "a " * 23, "x y z\n" * 8 + "x", "x y z " * 7 + "x y", " ".join(["p q r"] * 30 + ["mid"] + ["p q r"] * 9 + ["q r"]), "ab\tcd  " * 40 + "tail" + " ab cd" * 2]
    for k in range(70):
        texts.append(" ".join(rng.choice(vocabulary, int(rng.integers(1, 300)))) if k % 3 else " ".join(rng.choice(vocabulary, int(rng.integers(20, 90))).tolist() * int(rng.integers(2, 6))))
    texts.append(" ".join(f"w{k % 700}" for k in range(5000)))
    return texts


def test_contract(spark):
    rows = [(k * 13 - 9, t, 1, "s", 2, 3) for k, t in enumerate(some_texts())] + [(None, "x y " * 20, 1, "s", 2, 3), (4, "a b " * 12, 1, "s", 2, 3), (4, "a b " * 12, 1, "s", 2, 3)]
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = periodic.describe(df, periodic=True)
    assert found.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted(map(tuple, found.collect()), key=str) == sorted((described(r[0], r[1]) for r in rows), key=str)
    plain = periodic.describe(df).collect()
    assert sorted(map(tuple, plain), key=str) == sorted((described(r[0], r[1], False) for r in rows), key=str)
    assert periodic.describe(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 6000}
    found = {r.doc_id: tuple(r) for r in periodic.op11_periodic_runs(spark, sf).collect()}
    assert len(texts) > 150 and all(found[k] == described(k, t) for k, t in texts.items())
