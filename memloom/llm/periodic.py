"""Operator 11: runs of words by the linear method of Gusfield and Stoye for tandem repeats.

A run is a maximal stretch of words with smallest period q that is max(LEAST, 3 q) words long at least. Documents are worked on in chunks; the words of a chunk are one
sequence of integers, in which unique separators keep documents apart. The suffix tree is held as arrays: sorted suffixes (its leaves), the common prefixes of neighbours
(its inner nodes), and for each power of two a name for each substring of that length, from which two positions' common extensions to the right and to the left are read.

Phase 1: the Lempel-Ziv blocks of the sequence. Where a square (a word sequence twice in a row) stands leftmost, it crosses the start h of the block that its end lies in, and h is in its left half
or else the halves reach no further than that block and the one before: so for each h and each k up to the blocks' sizes the common extensions of (h - k, h) and of (h, h + k)
to both sides find all leftmost squares of period k. Phase 2: each is a locus of the tree, an interval of leaves at depth 2 k; from it suffix links (the interval of the next suffix) are walked as long as the stretch of period k lasts,
which completes the vocabulary of squares. Phase 3: the leaves below the vocabulary's loci are all occurrences; those of a period at consecutive words merge into runs.
Only squares whose half is no power are followed: of equal stretches the smallest period stands.

Before that, words that no window of WINDOW words covers which occurs twice in the document are left out, as a run's words are all covered by such windows:
with length >= max(24, 3 q), two thirds of it, 16 words or more, recur q words later.

Null and empty texts have no words and no runs. A document without an id isn't changed by the rule of periods(). Rows of one id (repeated rows, ties) are judged each by itself. Words are told
apart by 64-bit hashes. An empty table gives no rows; further columns are left out. A very long text is a chunk of its own; what of it recurs takes some 200 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from memloom.llm.base import Words, chunks, mix, ragged, release, runs, table

#: Words of a run at least, and times that its period fits in at least.
LEAST, TIMES = 24, 3
#: Two thirds of the shortest run.
WINDOW = 16
#: Pairs of positions that are compared at once, and words of one sequence (a longer stretch is a sequence of its own).
PAIRS, SEQUENCE = 1 << 20, 1 << 18


class Substrings:
    """A sequence of integers with names of its substrings, sorted suffixes and their common prefixes."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.names = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
        while True:  # name substrings of twice the length, until no two are equal
            last, size = self.names[-1].astype(np.int64), 1 << len(self.names) - 1
            after = np.full(self.n, -1, np.int64)
            after[:-size] = last[size:]
            pair = last * (self.n + 1) + after + 1
            order = np.argsort(pair, kind="stable")
            ordered = pair[order]
            fresh = np.append(False, ordered[1:] != ordered[:-1])
            rank = np.cumsum(fresh)
            name = np.empty(self.n, np.int32)
            name[order] = rank
            if rank[-1] == self.n - 1:  # the order of all suffixes
                break
            self.names.append(name)
        self.leaves, self.rank = order, name.astype(np.int64)
        #: common[r]: words that the suffixes of ranks r - 1 and r share.
        self.common = np.zeros(self.n, np.int64)
        self.common[1:] = self.forward(order[:-1], order[1:])
        self.least = [self.common.astype(np.int32)]  # of 2^l neighbours from r on
        while 2 << len(self.least) - 1 <= self.n:
            low, size = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(low[:-size], low[size:]))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on are equal."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            inside = np.maximum(i, j) < self.n
            same = inside & (self.names[level][np.where(inside, i, 0)] == self.names[level][np.where(inside, j, 0)])
            step = same.astype(np.int64) << level
            i, j, total = i + step, j + step, total + step
        return total

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and j are equal."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            size = 1 << level
            inside = np.minimum(i, j) >= size
            same = inside & (self.names[level][np.where(inside, i - size, 0)] == self.names[level][np.where(inside, j - size, 0)])
            step = same.astype(np.int64) << level
            i, j, total = i - step, j - step, total + step
        return total

    def blocks(self) -> list[int]:
        """The starts of the Lempel-Ziv blocks: each is the longest prefix of the rest that also starts earlier, or else one word."""
        earlier = [0] * self.n  # the longest prefix that also starts earlier
        stack: list[tuple[int, int]] = []  # positions by rank, and what the next rank shares with the one below
        common = self.common.tolist()
        for r, at in enumerate(self.leaves.tolist()):
            shared = common[r]
            while stack and stack[-1][0] > at:
                top, low = stack.pop()
                # `at` and the one below are the neighbours of `top` that start earlier
                if shared > earlier[top]:
                    earlier[top] = shared
                if low < shared:
                    shared = low
            if stack and shared > earlier[at]:
                earlier[at] = shared
            stack.append((at, shared if stack else 0))
        starts, at = [], 0
        while at < self.n:
            starts.append(at)
            at += earlier[at] or 1
        return starts

    def interval(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The locus of the first `depth` words from each position on: the interval of its leaves."""
        low = self.rank[at]
        high = low.copy()
        for level in range(len(self.least) - 1, -1, -1):
            size, least = 1 << level, self.least[level]
            spot = low - size + 1  # common[spot .. low]
            fits = spot >= 0
            low = np.where(fits & (least[np.where(fits, spot, 0)] >= depth), low - size, low)
            spot = high + 1
            fits = spot < len(least)
            high = np.where(fits & (least[np.where(fits, spot, 0)] >= depth), high + size, high)
        return low, high + 1


def stretches(tree: Substrings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of maximal stretches of two periods or more, of equal ones that of the smallest period; each leftmost square is in one."""
    h = np.array([*tree.blocks(), tree.n], np.int64)
    size = np.diff(h)
    starts, before, own = h[1:-1], size[:-1], size[1:]
    found = []
    cuts = np.unique(np.append(np.searchsorted(np.cumsum(before + 2 * own), np.arange(0, tree.n * 3 + PAIRS, PAIRS)), len(starts)))
    for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
        for left, most in ((True, before[a:b] + own[a:b]), (False, own[a:b])):
            k = ragged(np.ones(b - a, np.int64), most)
            at = np.repeat(starts[a:b], most)
            i = at - k if left else at
            fits = (i >= 0) & (i + k < tree.n)
            i, k = i[fits], k[fits]
            words = tree.names[0]
            near = (words[i] == words[i + k]) | (i > 0) & (words[i - 1] == words[i + k - 1])  # else both extensions are empty
            i, k = i[near], k[near]
            back = tree.backward(i, i + k)
            total = back + tree.forward(i, i + k)
            hit = total >= k
            found.append(np.stack((i - back, i - back + total + k, k))[:, hit])
    start, end, k = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((k, end, start))
    start, end, k = start[order], end[order], k[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], k[first]


def all_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    nothing = np.zeros(0, np.int64)
    if len(words) < 2:
        return nothing, nothing, nothing
    tree = Substrings(words)
    start, end, k = stretches(tree)
    # The walk by suffix links: from the locus of each position to that of the next one.
    steps = end - start - 2 * k + 1
    at, period = ragged(start, steps), np.repeat(k, steps)
    low, high = tree.interval(at, 2 * period)
    locus, first = np.unique(np.stack((low, period)), axis=1, return_index=True)
    count = (high - low)[first]
    square, period = tree.leaves[ragged(locus[0], count)], np.repeat(locus[1], count)
    order = np.lexsort((square, period))
    square, period = square[order], period[order]
    fresh = np.ones(len(square), bool)
    fresh[1:] = (period[1:] != period[:-1]) | (square[1:] != square[:-1] + 1)
    head = np.flatnonzero(fresh)
    start, period = square[head], period[head]
    length = np.diff(np.append(head, len(square))) - 1 + 2 * period
    long = length >= np.maximum(least, times * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def recurring(hashes: np.ndarray, row: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words a window covers that occurs twice in its row."""
    covered = np.zeros(len(hashes) + 1, np.int64)
    h = runs(hashes, window)
    at = np.flatnonzero(row[: len(h)] == row[window - 1 :]) if len(h) else np.zeros(0, np.int64)
    key = mix(h[at] ^ mix(row[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    ordered = key[order]
    equal = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + window, -1)
    return np.cumsum(covered[:-1]) > 0


def runs_of_rows(hashes: np.ndarray, row: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of the runs of rows of words, which lie one after the other, in order of first word and period."""
    window = -(-least * (times - 1) // times)  # of a run of `least` words; longer ones recur over more
    covered = recurring(hashes, row, window)
    begins, ends = covered.copy(), covered.copy()
    begins[1:] &= ~covered[:-1] | (row[1:] != row[:-1])
    ends[:-1] &= ~covered[1:] | (row[1:] != row[:-1])
    first, size = np.flatnonzero(begins), np.flatnonzero(ends) + 1 - np.flatnonzero(begins)
    first, size = first[size >= least], size[size >= least]
    found = []
    cuts = np.unique(np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + SEQUENCE, SEQUENCE)))
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(first)], strict=True):
        if a == b:
            continue
        at = ragged(first[a:b], size[a:b])
        # Word names from 0 on, and after each stretch a number that no other place has.
        place = np.arange(len(at)) + np.repeat(np.arange(b - a), size[a:b])
        words = np.arange(len(at) + b - a) + len(at)
        words[place] = np.unique(hashes[at], return_inverse=True)[1]
        origin = np.zeros(len(words), np.int64)
        origin[place] = at
        start, length, period = all_runs(words, least, times)
        found.append(np.stack((origin[start], length, period)))
    start, length, period = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def periods(ids: list[int | None], counts: np.ndarray) -> np.ndarray:
    """For each word of rows of `counts` words the word of the same chunk that stands in its place: rows whose id's checksum ends in 0 become periodic from some word on."""
    source = np.arange(int(counts.sum()))
    first = np.cumsum(counts) - counts
    for d, n, f in zip(ids, counts.tolist(), first.tolist(), strict=True):
        if d is None or not n:
            continue
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[f + a : f + n] = f + a + np.arange(n - a) % p
    return source


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _best(found: list[tuple[int, int, int]]) -> tuple:
    """start, length, period and exponent in thousandths of the run of greatest length / period."""
    if not found:
        return None, None, None, None
    top = found[0]
    for run in found[1:]:  # by start, then period: an equal one doesn't replace an earlier one
        if run[1] * top[2] > top[1] * run[2]:
            top = run
    return *top, 1000 * top[1] // top[2]


def _collapsed(buf: np.ndarray, off: np.ndarray, words: Words, source: np.ndarray, gone: np.ndarray) -> list[bytes]:
    """The kept words of each row, joined by one space."""
    kept = source[~gone]
    size = (words.end - words.start + 1)[kept]
    ends = np.concatenate(([0], np.cumsum(size)))
    data = np.append(buf, np.uint8(32))[ragged(words.start[kept], size)] if len(kept) else np.zeros(0, np.uint8)
    data[ends[1:] - 1] = 32
    data = data.tobytes()
    at = ends[words.first - np.concatenate(([0], np.cumsum(gone)))[words.first]].tolist()
    return [data[a : b - 1] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


def describe(df: DataFrame, least: int = LEAST, times: int = TIMES, periodic: bool = False) -> DataFrame:
    """Of each document (doc_id, text): its runs' number, the greatest one, digests of all and of the text without what repeats a run's first period. periodic: after periods()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in chunks(batch):
                words = Words(buf, off)
                row, ids = words.row(), part.column(0).to_pylist()
                source = periods(ids, words.counts()) if periodic else np.arange(len(words.hash))
                start, length, period = runs_of_rows(words.hash[source], row, least, times)
                change = np.bincount(start + period, minlength=len(row) + 1) - np.bincount(start + length, minlength=len(row) + 1)
                texts = _collapsed(buf, off, words, source, np.cumsum(change[:-1]) > 0)
                cut = np.searchsorted(start, words.first).tolist()
                runs_ = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
                rows = []
                for k, first in enumerate(words.first[:-1].tolist()):
                    own = [(s - first, n, p) for s, n, p in runs_[cut[k] : cut[k + 1]]]
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in own)
                    rows.append((ids[k], len(own), *_best(own), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(texts[k]).hexdigest()))
                names = [c.split()[0] for c in _SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if name.endswith("sha256") else pa.int64()) for name, x in zip(names, zip(*rows, strict=True), strict=True)], names)
            release()

    return df.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(table(spark, sf_dir, "documents", "doc_id", "text"), periodic=True)
