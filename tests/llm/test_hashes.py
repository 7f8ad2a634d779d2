"""Words and slices that plain sums of bytes can't tell apart: Thue-Morse words and their complements, and words that differ in one byte anywhere."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from memloom.llm import bpe, neardup, substrings, tokenfile
from memloom.llm.base import Words, flat, hashes, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[k.bit_count() % 2] for k in range(n))


def pairs():
    """Words and others that are easily taken for them."""
    out = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (8, 16, 64, 512, 1024, 2048, 4096)]
    out += [(thue_morse(n, "abcdefgh", "hgfedcba"), thue_morse(n, "hgfedcba", "abcdefgh")) for n in (64, 512)]  # eight bytes at a time
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 15, 16, 17, 64, 200):
        word = "".join(rng.choice(list("abcxyz"), n))
        out += [(word, word[:k] + "Q" + word[k + 1 :]) for k in {0, n // 2, n - 1}] + [(word, word + "\0"), (word, "\0" + word), (word + "ab", "ab" + word), (word, word * 2)]
    return out


def test_hashes_differ():
    for seed in (0, 1):
        words = sorted({w for pair in pairs() for w in pair})
        buf, off = flat(pa.array(words))
        assert len(set(hashes(buf, off[:-1], np.diff(off), seed).tolist())) == len(words)
    found = Words(*flat(pa.array([" ".join(words)])))
    assert len(set(found.hash.tolist())) == len(words) == len(found.hash)


def test_windows_differ():
    """Windows of two words in Thue-Morse order and its complement, too long for a plain polynomial of an odd base."""
    rng = np.random.default_rng(2)
    for n in (16, 256, 1024, 4096):
        a, b = rng.integers(1, 2**63, 2, dtype=np.uint64)
        order = np.array([k.bit_count() % 2 for k in range(n)])
        assert runs(np.where(order, a, b), n)[0] != runs(np.where(order, b, a), n)[0]


def test_slices_are_told_apart(monkeypatch):
    import public_tokenizers
    import tiktoken

    texts = [t for pair in pairs() for t in pair]
    ranks, library = bpe.Ranks(bpe.default_ranks()), tokenfile.Library(tokenfile.default_tokenizer())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    weak = lambda buf, start, size, seed=0: np.full(len(start), 7, np.uint64) if not seed else hashes(buf, start, size, seed)
    for keys in (hashes, weak):  # and where all long slices had one key, their checks would tell them apart
        monkeypatch.setattr(bpe, "hashes", keys)
        for tokenizer, expected in ((ranks, plain.encode_ordinary), (library, lambda t: library.tokenizer.encode(t, add_special_tokens=False).ids)):
            tokenizer.forget()
            for _ in range(2):
                ids, at = tokenizer.encode(*flat(pa.array(texts)))
                assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [expected(t) for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [w + " " + " ".join(f"x{k}" for k in range(12)) for pair in pairs()[3:8] for w in pair] + [w for pair in pairs() for w in pair]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_ids_decode_to_the_texts(docs):
    for row in bpe.round_trip(docs, bpe.default_ranks()).join(docs, "doc_id").collect():
        assert row.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


def test_passages_and_groups(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen, expected = {}, {}
    for i in sorted(texts):
        words = WORD.findall(texts[i])
        gone = set()
        for k in range(len(words) - 12):
            if seen.setdefault(tuple(words[k : k + 13]), i) < i:
                gone.update(range(k, k + 13))
        expected[i] = len(gone)
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()} == expected
    lower = {i: WORD.findall(t.translate({k: k + 32 for k in range(65, 91)})) for i, t in texts.items()}
    sets = {i: frozenset(zip(w, w[1:], strict=False)) or frozenset([tuple(w)]) for i, w in lower.items()}
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 2).collect()}
    linked = {i: min(j for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
    assert found == linked
