"""Operator 6: benchmark passages in documents, by CGK embedding.

Texts are sequences of words (runs of ASCII letters and digits and all other non-ASCII bytes; A-Z in lower case). A document holds an item
if some stretch of it is within floor(rate * words of the item) word edits of the item.

Candidates come from the embedding alone. A random walk reads a word and moves on or not by a random bit of (word, step), which turns few
edits into a small Hamming distance; a walk from any word on is the embedding of the window that starts there, whatever the window's size. Items
are classed by size, a class from its smallest size to twice that. For each class WALKS walks start at every STRIDE(size)-th word of the documents, each as long as
the class's smallest items need, and from every word of an item that has as many words after it; so an occurrence is met in step at
least once, whatever word it starts at. Each walk is sampled by REPEATS bit-sampling hashes of BITS steps, and
windows that share one with an item are candidates. repeats_for() gives the hashes that a recall wants. Of candidates, those whose
stretch lacks more words of the item than the edits allow are out, and the others are verified by the exact edit distance, with the stretch's ends free.

Items are the query set, compared with all rows in blocks: a task holds ITEM_BYTES of them, a larger benchmark is more than one scan,
and its slices are collected one after the other. Items without words match nothing; of equal
items (ties), each is reported. Null and empty documents hold nothing; very long ones are read in chunks of rows whose walks take some
20 bytes a word. An empty table on either side gives no rows. Repeated rows of a document repeat in the result. Columns beside ids and texts are left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.base import Words, chunks, flat, mix, release, table, written

RATE = 0.2
WALKS, REPEATS, BITS = 5, 7, 4
#: Bytes of items that a task holds at once.
ITEM_BYTES = 4 << 20
#: Words whose walks are made at once, and candidates verified at once.
POSITIONS, VERIFIED = 1 << 13, 512
SCHEMA = "doc_id long, item_id long, distance int, first_word long, last_word long"
_GOLD, _PAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0)

_WORDS = np.full(256, 32, np.uint8)
_WORDS[128:] = np.arange(128, 256)
for _range in (range(48, 58), range(97, 123)):
    _WORDS[list(_range)] = list(_range)
_WORDS[65:91] = range(97, 123)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(_WORDS[buf], off)
    return words.hash, words.first


def repeats_for(recall: float, agree: float, bits: int = BITS) -> int:
    """Hashes of `bits` steps that find, at this recall, a window whose embedding agrees with its item's in a share `agree` of the steps."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


class Size:
    """The walks and hashes for items of `least` words and more, up to twice as many."""

    def __init__(self, least: int):
        self.least, self.stride, self.steps = least, max(1, least // 4), least + least // 2
        rng = np.random.default_rng(least)
        self.samples = [[np.sort(rng.choice(self.steps, min(BITS, self.steps), replace=False)) for _ in range(REPEATS)] for _ in range(WALKS)]
        self.factors = rng.integers(1, 2**63, (WALKS, REPEATS, BITS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, words: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """For each hash in turn, its key of the window that starts at each place: words' 64-bit hashes by odd factors of each hash's own."""
        padded, part = np.concatenate((words, np.full(self.steps + 1, _PAD))), np.empty(len(at), np.uint64)
        for k in range(WALKS):
            place, wanted, seen = at.copy(), sorted({int(t) for sample in self.samples[k] for t in sample}), {}
            for step in range(wanted[-1] + 1):
                if step % 64 == 0:  # a word's random bits of the next steps
                    bits = mix(padded + np.uint64(((k + 1 << 32) + step // 64) * int(_GOLD) & (1 << 64) - 1))
                if step in wanted:
                    seen[step] = np.take(padded, place)
                move = np.take(bits, place)
                move >>= np.uint64(step % 64)
                move &= np.uint64(1)
                place += move.view(np.int64)
            for sample, factors in zip(self.samples[k], self.factors[k], strict=True):
                key = seen[int(sample[0])] * factors[0]
                for t, factor in zip(sample[1:].tolist(), factors[1:], strict=False):
                    key += np.multiply(seen[t], factor, out=part)
                yield key


def edit_distances(item: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the least edits between the item and any part of the row, and where the first such part ends."""
    place = np.arange(stretches.shape[1] + 1)
    row = np.zeros((len(stretches), len(place)), np.int64)
    for i, word in enumerate(item.tolist(), 1):
        best = row + 1
        best[:, 1:] = np.minimum(best[:, 1:], row[:, :-1] + (stretches != word))
        best[:, 0] = i
        row = np.minimum.accumulate(best - place, axis=1) + place
    end = row.argmin(1)
    return row[np.arange(len(row)), end], end


class Items:
    """Benchmark items ready to be looked for."""

    def __init__(self, ids: list[int], texts: list[str | None], rate: float):
        hashes, first = word_hashes(*flat(pa.array(texts, pa.string())))
        self.ids, self.words, self.edits = [], [], []
        for item_id, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b > a:
                self.ids.append(item_id)
                self.words.append(hashes[a:b])
                self.edits.append(int(rate * (b - a)))
        by_size: dict[int, list[int]] = {}
        for n, number in sorted((len(words), number) for number, words in enumerate(self.words)):
            least = n if not by_size or n >= 2 * max(by_size) else max(by_size)
            by_size.setdefault(least, []).append(number)
        self.sizes = []
        for least, numbers in by_size.items():
            size = Size(least)
            found: list[list] = [[], [], []]
            for number in numbers:
                words = self.words[number]
                offsets = np.arange(max(0, len(words) - least * 3 // 4) + 1)
                for key in size.keys(words, offsets):
                    for column, value in zip(found, (key, np.full(len(key), number), offsets), strict=True):
                        column.append(value)
            keys, owner, offset = map(np.concatenate, found)
            order = np.argsort(keys)
            keys, width = keys[order], min(24, len(keys).bit_length() + 3)
            sieves = []
            for shift in (np.uint64(64 - width), np.uint64(40 - width)):  # by two parts of a key
                sieve = np.zeros(1 << width, bool)
                sieve[keys >> shift & np.uint64((1 << width) - 1)] = True
                sieves.append((shift, sieve))
            self.sizes.append((size, keys, owner[order], offset[order], sieves))

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (item, row, start) of windows that share a hash with an item."""
        found = []
        for size, keys, owner, offset, ((top, sieve), (low_bits, second)) in self.sizes:
            mask = np.uint64(len(second) - 1)
            # Every stride-th word of each row, counted from the row's first.
            count = -(-np.diff(first) // size.stride)
            row = np.repeat(np.arange(len(count)), count)
            at = first[row] + size.stride * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
            for a in range(0, len(at), POSITIONS):
                part = at[a : a + POSITIONS]
                low = int(part[0])
                stretch = hashes[low : int(part[-1]) + size.steps + 1]
                for key in size.keys(stretch, part - low):
                    near = np.flatnonzero(np.take(sieve, (key >> top).view(np.int64)))
                    near = near[second[key[near] >> low_bits & mask]]
                    lo, hi = np.searchsorted(keys, key[near]), np.searchsorted(keys, key[near], "right")
                    n = hi - lo
                    which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    spot = np.repeat(a + near, n)
                    if len(spot):
                        found.append(np.stack((owner[which], row[spot], at[spot] - offset[which]), 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, distance, first word, word after the last) of the best stretch of each item in each row."""
        found = self.candidates(hashes, first)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        cuts = [*np.flatnonzero(np.append(True, found[1:, 0] != found[:-1, 0])).tolist(), len(found)] if len(found) else []
        for a, b in itertools.pairwise(cuts):
            number = int(found[a, 0])
            item, edits, n = self.words[number], self.edits[number], len(self.words[number])
            own = np.sort(item)
            for c in range(a, b, VERIFIED):
                rows, starts = found[c : min(b, c + VERIFIED), 1:].T
                spots = starts[:, None] - edits + np.arange(n + 2 * edits)
                inside = (spots >= first[rows][:, None]) & (spots < first[rows + 1][:, None])
                stretches = np.where(inside, hashes[np.clip(spots, 0, len(hashes) - 1)], _PAD)
                shared = own[np.minimum(np.searchsorted(own, stretches), n - 1)] == stretches
                left = np.flatnonzero(shared.sum(1) >= n - edits)  # fewer shared words are more edits
                distances, ends = edit_distances(item, stretches[left])
                for k, distance, end in zip(left.tolist(), distances.tolist(), ends.tolist(), strict=True):
                    row, start = int(rows[k]), int(starts[k]) - edits
                    if distance <= edits and distance < best.get((row, number), (edits + 1,))[0]:
                        lo = max(int(first[row]), start)
                        _, size = edit_distances(item[::-1], hashes[lo : start + end][::-1][None])
                        best[row, number] = (distance, start + end - int(size[0]) - int(first[row]), start + end - int(first[row]))
        return [(row, self.ids[number], *x) for (row, number), x in sorted(best.items())]

    def rows(self, batch: pa.RecordBatch, text: str = "text") -> list[tuple[int, int, int, int, int]]:
        """hits() of a batch's texts."""
        hashes, counts = [], []
        for _, buf, off in chunks(batch, text):
            h, first = word_hashes(buf, off)
            hashes.append(h)
            counts.append(np.diff(first))
        return self.hits(np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts))))) if hashes else []


def slices(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str | None]]]:
    """The items (item_id, text) in slices of about ITEM_BYTES, each collected when it is asked for."""
    items = benchmark.select("item_id", "text").where("item_id is not null")
    number = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES)
    for k in range(number):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k) if number > 1 else items
        rows = part.orderBy("item_id", "text").collect()  # bounded by the slice
        yield [r[0] for r in rows], [r[1] for r in rows]


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The items (item_id, text) that documents (doc_id, text) hold: a row for each pair, with the edits and the words of the best stretch."""
    result = None
    for ids, texts in slices(benchmark):

        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            items = Items(ids, texts, rate)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    hits = items.rows(part)
                    columns = list(zip(*hits, strict=True)) if hits else [[]] * 5
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], ["doc_id", "item_id", "distance", "first_word", "last_word"])
                release()

        found = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
        result = found if result is None else written(result, "leaks").unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if result is None else result


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no item, with all their columns. Each row is judged by its own text, so that null and repeated ids are like others."""
    for ids, texts in slices(benchmark):

        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            items = Items(ids, texts, rate)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    clean = np.ones(part.num_rows, bool)
                    clean[[hit[0] for hit in items.rows(part)]] = False
                    yield part.filter(pa.array(clean))
                release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
