"""Near duplicates whose buckets are cut into parts, against all pairs."""

import numpy as np
import pytest

from memloom.llm import neardup


@pytest.mark.parametrize(("members", "step"), [(4096, 512), (4, 2), (1, 1)])
def test_parts_of_buckets_lose_no_link(spark, monkeypatch, members, step):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    monkeypatch.setattr(neardup, "STEP", step)
    monkeypatch.setattr(neardup, "PIVOTS", 0)  # all that isn't linked by first members is compared in parts
    rng = np.random.default_rng(9)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for family in range(6):
        own = [f"f{family}w{k}" for k in range(20)]
        for _ in range(7):
            words = base + own
            for at in rng.integers(0, len(words), 3):
                words[at] = f"x{rng.integers(0, 99)}"
            texts.append(" ".join(words))
    sets = [frozenset(zip(w, w[1:], strict=False)) for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for _ in root:
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 2).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(root)) and 1 < len(set(root)) < len(root)
