"""Schedules of packed rows against the token-by-token definition."""

import random

import pytest

from memloom.functions.rules import RULES
from memloom.functions.spans import NEVER
from memloom.operators import schedules

SCHEMA = "row long, ids array<int>, mask array<int>, positions array<int>, seq int, start string"


def evicted(lengths, window):
    """When each chunk leaves a window of tokens, the first chunk being the sink: the oldest go until the rest fit."""
    held, out = [], [len(lengths)] * len(lengths)
    for i in range(len(lengths)):
        held.append(i)
        while len([j for j in held if j]) > 1 and sum(lengths[j] for j in held) > window:
            oldest = next(j for j in held if j)
            out[oldest] = i
            held.remove(oldest)
    return out


def one_row(ids, mask, positions):
    chunk_ids, steps, seqs = [0] * len(ids), [NEVER] * len(ids), [0] * len(ids)
    valid = [i for i in range(len(ids)) if mask is None or mask[i]]
    starts = [k for k, i in enumerate(valid) if positions is not None and positions[i] == 0] or ([0] if valid else [])
    for seq, (a, b) in enumerate(zip(starts, [*starts[1:], len(valid)], strict=False)):
        own = valid[a:b]
        turns = [p for p, i in enumerate(own) if ids[i] == schedules.TURN]
        sink = -(-next((p for p in turns if p), 32) // 32) * 32
        prompt = min(turns[-1] + 3, len(own)) if turns else len(own)
        rule = next((r for r in RULES if r[0] <= prompt + r[4] < r[1]), RULES[0] if prompt + RULES[0][4] < RULES[0][0] else RULES[-1])
        chunk = [0 if p < sink else 1 + (p - sink) // rule[2] for p in range(len(own))]
        plan = evicted([sink] + [rule[2]] * chunk[-1], rule[3])
        for p, i in enumerate(own):
            chunk_ids[i], steps[i], seqs[i] = chunk[p], plan[chunk[p]], seq
    return chunk_ids, steps, seqs


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(2), []
    for k in range(40):
        ids, mask, positions = [], [], []
        for _ in range(rng.randint(0, 4)):
            n = rng.choice([1, 31, 32, 33, 200, 900, 2500, 9000])
            ids += [schedules.TURN if rng.random() < 0.01 else 5 for _ in range(n)]
            positions += list(range(n))
        mask = [int(rng.random() < 0.9) for _ in ids]
        pad = rng.randint(0, 50)
        ids, mask, positions = ids + [0] * pad, mask + [0] * pad, positions + [0] * pad
        out.append((k, ids, mask if k % 5 else None, positions if k % 3 else None, 1, "s"))
    return [*out, (90, [5] * 40, [1] * 40, [3] * 40, 1, "s"), (91, [schedules.TURN] * 3, [0, 0, 0], [0, 1, 2], 1, "s"), (92, [], [], [], 1, "s"), (93, [7, 7, 7, 7], [1, 1, 1, 1], [4, 5, 0, 1], 1, "s")]


def test_packed_rows(spark, rows):
    found = schedules.segment_schedule(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = {r.row: (r.chunk_ids, r.evict_steps, r.seq_ids) for r in found}
    assert len(found) == len(rows) and got == {r[0]: one_row(*r[1:4]) for r in rows}
    assert any(max(x[2], default=0) > 1 for x in got.values()) and any(set(x[1]) - {NEVER} and min(x[1]) > 5 for x in got.values() if x[1])


def test_no_rows(spark):
    assert schedules.segment_schedule(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- what tokens see


def test_masks_are_those_of_token_pairs(spark):
    from memloom.operators import visibility

    rng, runs = random.Random(6), []
    for key in range(12):
        chunk, length = 0, rng.randint(1, 25)
        for i in range(length):
            chunk += rng.random() < 0.6
            runs.append((key, i, rng.randint(0, 6), rng.randint(0, 2), rng.randint(0, 2), rng.random() < 0.4, chunk, rng.choice([None, chunk + 1, chunk + 3, 99])))
    frame = spark.createDataFrame(runs, "key int, i int, n int, d int, s int, e boolean, c int, g int").repartition(3)
    for names in ({}, {"document": "d"}, {"segment": "s"}, {"evicted": "e"}, {"chunk": "c", "evict_at": "g"}, {"document": "d", "segment": "s", "evicted": "e"}, {"document": "d", "segment": "s", "evicted": "e", "chunk": "c", "evict_at": "g"}):
        got = {(r.key, r.i): r.visible for r in visibility.seen(frame, "key", **names).collect()}
        expected = {}
        for key, i, _, d, s, e, c, _ in runs:
            total = 0
            for key2, j, m, d2, s2, e2, _, g2 in runs:
                if key2 != key or j > i:
                    continue
                passes = ("document" not in names or d2 == d) and ("segment" not in names or s2 in (0, s)) and ("evicted" not in names or not e2 or e) and ("chunk" not in names or g2 is None or g2 > c)
                total += m * passes
            expected[key, i] = total
        assert got == expected, names
