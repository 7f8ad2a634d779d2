"""Operator 8: byte-level BPE encoding and decoding.

Pre-tokenisation runs without a regular expression. Every codepoint gets a class (letter, number, white space, other; the
apostrophe and white space also know what follows them), a class is a transition function of a small automaton, and the
composition of such functions is associative: a chunk is laid out as blocks, the functions of each block are composed
for all blocks at once, the blocks' results are scanned, and a second pass gives the state before every codepoint, hence
the boundaries. The slices between boundaries feed a cache; those that are not in it are merged together, pair by pair in
order of rank, as arrays. Byte offsets of the slices and token offsets of the rows are kept; ids decode through one gather.
Slices over CACHED_BYTES are merged one at a time through a heap, in time that grows with n log n, and never cached.

Null and empty texts have no tokens and decode to no bytes; an empty table gives no rows. Equal texts have equal ids, repeated
rows give repeated rows; equal ranks don't exist, and of equal pairs in a slice the leftmost is merged first. A very long text is
a chunk of its own, whose arrays take some 30 bytes a byte. Columns beside doc_id and text are left out. White space is Unicode
White_Space; letters and numbers are the general categories L* and N* of the running Python. Slices are told apart by
length and bytes up to seven bytes, and beyond that by a 63-bit hash and 32 bits of another one; a process holds CACHED of them, some 30 MB with their table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from memloom.llm.base import _STEP, _eights, chunks, flat, hashes, ragged, release, table

#: White_Space beyond ASCII. Fixed values.
_WHITE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe to make one slice with it: one letter, or two. Fixed values of the public pattern.
_ONE, _TWO = "stmd", ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Classes of the automaton: runs of letters, numbers, others; a space before a non-space; other white space before a
#: non-space; white space before white space or the end; an apostrophe that may open a short form of one or two letters; the end of a row.
L, N, O, GLUE, LONE, WIDE, APO1, APO2, END = range(9)  # noqa: E741
#: States, by what the codepoint before was: nothing that continues, a run, a gluing space, a run of white space, and how many letters of a short form are due.
FRESH, IN_L, IN_N, IN_O, AFTER_GLUE, IN_W, DUE1, DUE2 = range(8)
STATES, CLASSES = 8, 9


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a slice begins here, by state and class."""
    to, cut = np.zeros((STATES, CLASSES), np.uint8), np.ones((STATES, CLASSES), bool)
    for state in range(STATES):
        for kind in range(CLASSES):
            if state in (DUE1, DUE2) and kind != END:
                to[state, kind], cut[state, kind] = (FRESH if state == DUE1 else DUE1), False
                continue
            short = kind in (APO1, APO2) and state not in (IN_O, AFTER_GLUE)
            if short:
                to[state, kind] = DUE1 if kind == APO1 else DUE2
                continue
            kind_ = O if kind in (APO1, APO2) else kind
            to[state, kind] = {L: IN_L, N: IN_N, O: IN_O, GLUE: AFTER_GLUE, LONE: FRESH, WIDE: IN_W, END: FRESH}[kind_]
            if kind_ in (L, N, O):
                cut[state, kind] = state not in ({L: IN_L, N: IN_N, O: IN_O}[kind_], AFTER_GLUE)
            elif kind_ == WIDE:
                cut[state, kind] = state != IN_W
    return to, cut


def _monoid(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the classes' functions: the element of each class, the product table, each element's states."""
    known = {tuple(range(STATES)): 0}
    for kind in range(CLASSES):
        known.setdefault(tuple(map(int, to[:, kind])), len(known))
    maps, done = list(known), 0
    while done < len(maps):
        for kind in range(CLASSES):
            new = tuple(int(to[s, kind]) for s in maps[done])
            if new not in known:
                known[new] = len(maps)
                maps.append(new)
        done += 1
    product = np.array([[known[tuple(b[s] for s in a)] for b in maps] for a in maps], np.uint16)
    return np.array([known[tuple(map(int, to[:, k]))] for k in range(CLASSES)], np.uint16), product, np.array(maps, np.uint8)


TO, CUT = _automaton()
ELEMENT, PRODUCT, MAPS = _monoid(TO)
BLOCK = 128
#: Codepoints that may be assigned, beside the planes of private use. Bounds of Unicode's planes, fixed values.
_PLANES = (range(0x40000), range(0xE0000, 0xE1000))


@functools.cache
def categories() -> np.ndarray:
    """The general category of every codepoint, as two letters."""
    found = np.full(0x110000, "Cn", "U2")
    found[0xF0000:] = "Co"
    found[[0xFFFFE, 0xFFFFF, 0x10FFFE, 0x10FFFF]] = "Cn"
    for plane in _PLANES:
        found[plane.start : plane.stop] = [unicodedata.category(chr(c)) for c in plane]
    return found


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of every codepoint."""
    major = categories().view("U1").reshape(-1, 2)[:, 0]
    found = np.where(major == "L", LETTER, np.where(major == "N", NUMBER, OTHER)).astype(np.uint8)
    found[[*range(9, 14), 32, *_WHITE]] = SPACE
    return found


def states(kind: np.ndarray) -> np.ndarray:
    """The automaton's state before each element, by a scan over the compositions of blocks."""
    n = len(kind)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, END, np.uint8)
    padded[:n] = kind
    grid = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    total = np.zeros(rows, np.uint16)
    for k in range(BLOCK):
        total = PRODUCT[total, ELEMENT[grid[k]]]
    span = 1
    while span < rows:  # inclusive scan of the blocks' compositions
        total = np.concatenate((total[:span], PRODUCT[total[:-span], total[span:]]))
        span *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = MAPS[total[:-1], FRESH]
    out = np.empty((BLOCK, rows), np.uint8)
    for k in range(BLOCK):
        out[k] = state
        state = TO[state, grid[k]]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def boundaries(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets at which the slices of all rows begin and end, and the first slice of each row (one more at the end)."""
    nothing = np.zeros(0, np.int64)
    if not len(buf):
        return nothing, nothing, np.zeros(len(off), np.int64)
    lead = (buf & 0xC0) != 0x80
    where = np.flatnonzero(lead)  # byte offset of each codepoint
    points = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if len(where) != n:
        raise ValueError("text is not valid UTF-8")
    kind = classes()[points]
    ends = np.searchsorted(where, off[1:])  # codepoints up to the end of each row
    last = np.zeros(n, bool)
    last[ends[(ends > 0) & (np.diff(off) > 0)] - 1] = True
    space = kind == SPACE
    before_text = np.zeros(n, bool)
    before_text[:-1] = ~space[1:]
    before_text &= ~last
    label = kind.copy()  # L, N and O are LETTER, NUMBER and OTHER
    label[space] = np.where(before_text[space], np.where(points[space] == 32, GLUE, LONE), WIDE)
    apostrophe = np.flatnonzero((points == 39) & ~last)
    if len(apostrophe):
        one = points[apostrophe + 1]
        label[apostrophe[np.isin(one, [ord(c) for c in _ONE])]] = APO1
        two = apostrophe[(~last[apostrophe + 1]) & (apostrophe + 2 < n)]
        for a, b in _TWO:
            label[two[(points[two + 1] == ord(a)) & (points[two + 2] == ord(b))]] = APO2
    rows = np.flatnonzero(last)
    # An END after each row's last codepoint lets no state pass to the next row.
    place = np.arange(n) + np.concatenate(([0], np.cumsum(last)[:-1]))
    stream = np.full(n + len(rows), END, np.uint8)
    stream[place] = label
    begins = CUT[states(stream)[place], label]
    first = where[begins]
    stop = np.append(first[1:], len(buf))
    return first, stop, np.searchsorted(first, off)


def piece_keys(buf: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each slice: length and bytes of short ones, a hash of the rest; and for the rest a check, 32 bits of another hash."""
    size = stop - first
    keys = _eights(np.concatenate((buf, np.zeros(8, np.uint8))), first, np.minimum(size, 7)) | np.minimum(size, 7).astype(np.uint64) << np.uint64(56)
    checks = np.zeros(len(keys), np.uint32)
    long = np.flatnonzero(size > 7)
    if len(long):
        keys[long] = hashes(buf, first[long], size[long]) | np.uint64(1 << 63)
        checks[long] = hashes(buf, first[long], size[long], 1) >> np.uint64(32)
    return keys, checks


class Ranks:
    """The ranks of a file of lines `base64 rank`, and a cache from slices to ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.decimal = [str(k) for k in range(size)]
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_size)[:-1]))
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.ids, self.id_at, self.id_n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.forget()

    #: Slices that the cache holds before it starts anew, and bytes of a slice that it holds at most.
    CACHED, CACHED_BYTES = 400_000, 64
    #: Binary logarithm of the places of the table that finds cached slices by their keys; a key has two places.
    PLACES = 20

    def forget(self) -> None:
        self.n, self.used = 0, 0
        size = 1 << self.PLACES
        self.place_key, self.place_check, self.place_at = np.zeros(size, np.uint64), np.zeros(size, np.uint32), np.zeros(size, np.int32)

    def places(self, keys: np.ndarray, second: bool = False) -> np.ndarray:
        if second:
            keys = keys ^ keys >> np.uint64(31)
        return (keys * _STEP >> np.uint64(64 - self.PLACES)).view(np.int64)

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one slice: a heap holds the pairs by rank and place, links lead from each part to the next one."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n, known = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [known(a << 32 | b, -1) for a, b in itertools.pairwise(ids)] + [-1]
        heap = [r << 32 | k for k, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, k = divmod(heapq.heappop(heap), 1 << 32)
            if rank[k] != r:
                continue  # one of the two has become part of another
            gone = after[k]
            ids[k], rank[gone], ids[gone] = r, -1, -1
            after[k] = right = after[gone]
            rank[k] = -1
            if right < n:
                before[right] = k
                if (new := known(r << 32 | ids[right], -1)) >= 0:
                    rank[k] = new
                    heapq.heappush(heap, new << 32 | k)
            if (left := before[k]) >= 0:
                rank[left] = new = known(ids[left] << 32 | r, -1)
                if new >= 0:
                    heapq.heappush(heap, new << 32 | left)
        return [x for x in ids if x >= 0]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices in turn, and how many each has: the lowest rank of each slice is merged wherever it stands, until none is left."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done_ids, done_owner = [], []
        none = np.int64(1 << 40)
        while len(ids):
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.full(len(ids), none)
            found = (self.pair_keys[at] == key) & (owner[:-1] == owner[1:])
            rank[:-1][found] = self.pair_ranks[at[found]]
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(ids))))
            finished = least == none
            if finished.any():
                done_ids.append(ids[finished])
                done_owner.append(owner[finished])
                live = ~finished
                ids, owner, rank, least = ids[live], owner[live], rank[live], least[live]
                if not len(ids):
                    break
            hit = rank == least
            # In a run of hits that overlap (one pair of equal ids over and over), every second one counts, from the left.
            spot = np.flatnonzero(hit)
            breaks = np.append(True, np.diff(spot) != 1)
            within = np.arange(len(spot)) - np.repeat(np.flatnonzero(breaks), np.diff(np.append(np.flatnonzero(breaks), len(spot))))
            spot = spot[within % 2 == 0]
            ids[spot] = rank[spot]
            keep = np.ones(len(ids), bool)
            keep[spot + 1] = False
            ids, owner = ids[keep], owner[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        owner = np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(done_ids)[order], np.bincount(owner, minlength=len(pieces))

    def add(self, pieces: list[bytes]) -> np.ndarray:
        """Stores the ids of slices and returns the slices' numbers."""
        if len(pieces) == 1 and len(pieces[0]) > self.CACHED_BYTES and pieces[0] not in self.ranks:
            ids = np.array(self.merge_long(pieces[0]), np.int64)
            return self.store(ids, np.array([len(ids)]))
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        rest = np.flatnonzero(whole < 0)
        ids, counts = self.merge([pieces[k] for k in rest.tolist()]) if len(rest) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        known = np.flatnonzero(whole >= 0)
        numbers = np.empty(len(pieces), np.int64)
        numbers[np.concatenate((known, rest))] = self.store(np.concatenate((whole[known], ids)), np.concatenate((np.ones(len(known), np.int64), counts)))
        return numbers

    def store(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n, k = self.n, len(counts)
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.id_at) < n + k:
            self.id_at, self.id_n = np.concatenate((self.id_at, np.zeros_like(self.id_at))), np.concatenate((self.id_n, np.zeros_like(self.id_n)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.id_at[n : n + k], self.id_n[n : n + k] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)
        self.n += k
        return np.arange(n, n + k)

    def numbers(self, keys: np.ndarray, checks: np.ndarray, first: np.ndarray, stop: np.ndarray, buf: np.ndarray) -> np.ndarray:
        """The number of each slice; slices that the cache lacks are stored, long ones after all others."""
        place = self.places(keys)
        index = self.place_at[place].astype(np.int64)
        rest = np.flatnonzero((self.place_key[place] != keys) | (self.place_check[place] != checks))
        second = self.places(keys[rest], True)
        index[rest] = self.place_at[second]
        rest = rest[(self.place_key[second] != keys[rest]) | (self.place_check[second] != checks[rest])]
        if not len(rest):
            return index
        # Equal slices of the chunk are made once: they are told apart by keys and checks, those of up to seven bytes by the bytes themselves.
        order = np.lexsort((checks[rest], keys[rest]))
        key, check = keys[rest][order], checks[rest][order]
        new = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
        which = np.empty(len(rest), np.int64)
        which[order] = np.cumsum(new) - 1
        fresh, marks = key[new], check[new]
        spot, data = rest[order[new]], buf.tobytes()
        pieces = [data[a:b] for a, b in zip(first[spot].tolist(), stop[spot].tolist(), strict=True)]
        is_short = stop[spot] - first[spot] <= self.CACHED_BYTES
        short, known = np.flatnonzero(is_short), np.empty(len(pieces), np.int64)
        if len(short):
            known[short] = self.add([pieces[k] for k in short.tolist()])
            place = self.places(fresh[short])
            place = np.where(self.place_key[place] == 0, place, self.places(fresh[short], True))
            self.place_key[place], self.place_check[place], self.place_at[place] = fresh[short], marks[short], known[short]
        self.kept = self.n, self.used
        for k in np.flatnonzero(~is_short).tolist():
            known[k] = self.add([pieces[k]])[0]
        index[rest] = known[which]
        return index

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in turn, and the offset of each row's first (one more at the end)."""
        first, stop, row = boundaries(buf, off)
        if self.n > self.CACHED:
            self.forget()
        self.kept = None
        index = self.numbers(*piece_keys(buf, first, stop), first, stop, buf)
        counts = self.id_n[index]
        ids = self.ids[ragged(self.id_at[index], counts)]
        if self.kept:  # long slices hardly come again
            self.n, self.used = self.kept
        ends = np.concatenate(([0], np.cumsum(counts)))
        return ids, ends[row]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of rows of ids, and the offset of each row's first byte (one more at the end)."""
        sizes = self.token_size[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.token_bytes[ragged(self.token_at[ids], sizes)], ends[at]


_loaded: dict[str, Ranks] = {}


def ranks(path: str) -> Ranks:
    """The file's ranks, loaded once in each process."""
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def apply_rows(df: DataFrame, path: str, make: Callable, schema: str) -> DataFrame:
    """Runs make(batch, vocabulary, ids, offsets) over the chunks of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks(path)
        for batch in batches:
            for part, buf, off in chunks(batch):
                yield make(part, vocabulary, *vocabulary.encode(buf, off))
            release()

    return df.select("doc_id", "text").mapInArrow(run, schema)


def encode(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless) of documents (doc_id, text), which may have further columns; lossless: the ids decode to the text's bytes."""

    def make(part, vocabulary, ids, at):
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
        buf, off = flat(part.column(1))
        data, ends = vocabulary.decode(ids, at)
        same = [np.array_equal(data[a:b], buf[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], off[:-1], off[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(at), pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "lossless"])

    return apply_rows(df, path, make, "doc_id long, ids array<int>, n_tokens long, lossless boolean")


def decode(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, data binary) of (doc_id, ids). Null ids decode to no bytes."""

    def run(batches):
        vocabulary = ranks(path)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                lists = part.column(1)
                counts = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
                data, at = vocabulary.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(counts))))
                whole = data.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([whole[a:b] for a, b in itertools.pairwise(at.tolist())], pa.binary())], ["doc_id", "data"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the bytes they decode to, for each document (see op8)."""

    def make(part, vocabulary, ids, at):
        decimal = list(map(vocabulary.decimal.__getitem__, ids.tolist()))
        data, byte_at = vocabulary.decode(ids, at)
        data, cuts = memoryview(data.tobytes()), byte_at.tolist()
        columns = [
            part.column(0),
            pa.array(np.diff(at), pa.int64()),
            pa.array([hashlib.sha256(" ".join(decimal[a:b]).encode()).hexdigest() for a, b in itertools.pairwise(at.tolist())], pa.string()),
            pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in itertools.pairwise(cuts)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return apply_rows(df, path, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), default_ranks())
