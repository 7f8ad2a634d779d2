"""Operator 3: repeated passages, found level by level.

Windows of `length` words that also start in a document of a smaller id are found by doubling: the documents are scanned for
windows of half the length (rounded up) that repeat between documents, and only windows whose halves repeat are looked at at
the full length; longest_repeats() goes on to twice, four times the length and so on until no candidates survive. On the first level
one half-length window stands for each full one, the one of least hash inside it, which is the same wherever the full
window occurs; that leaves a fraction of the windows to be sent and loses none.

Documents lie in blocks of bounded bytes by a hash of their ids and texts. On each level a block sends one row for each of its distinct
64-bit hashes, dealt by the hash; what other blocks hold too comes back, on the last level with the smallest document. So rows
grow in proportion to the words whatever the number of blocks, a passage in very many documents is one row a block and never a pair of
documents, and nothing of the corpus goes to the driver but its size.

Null and empty texts have no words, texts of fewer words than a window lose none. Ids are ordered as numbers, negative ones too.
Documents of equal ids (repeated rows, ties) are not smaller than each other; a null id is smaller than none and none is smaller than it.
A very long text is a block's work by itself. An empty table gives no rows. Further columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm.base import Words, chunks, ragged, release, runs, table, written

#: Bytes of text in a block, on average.
BLOCK_BYTES = 5 << 20
LENGTH = 13
_NONE = np.iinfo(np.int64).max


class Block:
    """Word hashes and windows of a block's documents."""

    def __init__(self, rows: pa.Table):
        hashes, counts, ids, known = [], [], [], []
        for batch in rows.select(["doc_id", "text"]).combine_chunks().to_batches():
            known.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            for _, buf, off in chunks(batch):
                words = Words(buf, off)
                hashes.append(words.hash)
                counts.append(words.counts())
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.hash, counts, self.ids, self.known = join(hashes, np.uint64), join(counts, np.int64), join(ids, np.int64), join(known, bool)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.doc = np.repeat(np.arange(len(counts)), counts)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each start of a window, and which starts are of one document (with an id) up to the end."""
        h = runs(self.hash, length)
        return h, (self.doc[: len(h)] == self.doc[length - 1 :]) & self.known[self.doc[: len(h)]] if len(h) else np.zeros(0, bool)

    def anchors(self, half: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The least hash of the windows of `half` words in each window of `length` words."""
        h = runs(self.hash, half)
        n = max(0, len(self.hash) - length + 1)
        least = h[:n].copy()
        for k in range(1, length - half + 1):
            np.minimum(least, h[k : k + n], out=least)
        return least, self.windows(length)[1]

    def owners(self, at: np.ndarray) -> np.ndarray:
        """The document ids of starts."""
        return self.ids[self.doc[at]]


def _least(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the smallest and the largest owner of each, and the place of each hash among them."""
    if not len(h):
        return h, owner, owner, np.zeros(0, np.int64)
    order = np.argsort(h)
    ordered, owner = h[order], owner[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])
    head, place = np.flatnonzero(fresh), np.empty(len(h), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[head], np.minimum.reduceat(owner, head), np.maximum.reduceat(owner, head), place


def _sent(block: int, h: np.ndarray, owner: np.ndarray | None) -> pa.Table:
    """A row for each distinct hash of a block, with the smallest owner if owners are given."""
    h, least = (np.unique(h), None) if owner is None else _least(h, owner)[:2]
    columns = {"hash": pa.array(h.view(np.int64)), "block": pa.array(np.full(len(h), block), pa.int32())}
    return pa.table(columns if owner is None else columns | {"least": pa.array(least)})


def _earliest(block: Block, h: np.ndarray, valid: np.ndarray, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The valid starts, each start's smallest document, and whether its hash is in several documents; right: what came back to the block."""
    at = np.flatnonzero(valid)
    owner, mine = block.owners(at), h[at]
    distinct, least, most, place = _least(mine, owner)
    there = right["hash"].to_numpy().view(np.uint64)
    order = np.argsort(there)
    there = there[order]
    spot = np.minimum(np.searchsorted(there, distinct), max(0, len(there) - 1))
    found = there[spot] == distinct if len(there) else np.zeros(len(distinct), bool)
    several = (least < most) | found
    if "least" in right.column_names and len(there):
        outside = right["least"].to_numpy()[order]
        least = np.where(found, np.minimum(least, outside[spot]), least)
    return at, least[place], several[place]


class Levels:
    """Documents in blocks, and what comes back to them on each level."""

    def __init__(self, df: DataFrame, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()):
        rows = df.select("doc_id", "text", *([F.struct(*carry).alias("rest")] if carry else []))
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(1, -(-total // block_bytes))
        self.docs = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def first(self, half: int, length: int) -> DataFrame:
        """(block, hash) of the windows of `half` words that stand for those of `length` words and are in other blocks too."""

        def send(key: tuple, rows: pa.Table) -> pa.Table:
            release()
            h, valid = Block(rows).anchors(half, length)
            return _sent(key[0].as_py(), h[valid], None)

        sent = self.docs.groupBy("block").applyInArrow(send, "hash long, block int")
        return sent.withColumn("blocks", F.count("*").over(Window.partitionBy("hash"))).where("blocks > 1").select("block", "hash")

    def next(self, replies: DataFrame, half: int, length: int, anchored: bool, last: bool = True) -> DataFrame:
        """(block, hash, least) of windows of `length` words whose windows of `half` words repeat and that other blocks hold too; of the last level, only where another block has the smallest document."""

        def send(key: tuple, rows: pa.Table, right: pa.Table) -> pa.Table:
            release()
            block = Block(rows)
            at = np.flatnonzero(repeated(block, right, half, length, anchored))
            return _sent(key[0].as_py(), block.windows(length)[0][at], block.owners(at))

        sent = self.docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(send, "hash long, block int, least long")
        same = Window.partitionBy("hash")
        known = sent.select("block", "hash", F.col("least").alias("own"), F.min("least").over(same).alias("least"), F.count("*").over(same).alias("blocks"))
        return known.where("least < own" if last else "blocks > 1").select("block", "hash", "least")


def repeated(block: Block, right: pa.Table, half: int, length: int, anchored: bool) -> np.ndarray:
    """Which starts of windows of `length` words may repeat, by what came back about windows of `half` words."""
    h, valid = block.anchors(half, length) if anchored else block.windows(half)
    at, _, several = _earliest(block, h, valid, right)
    known = np.zeros(len(h), bool)
    known[at[several]] = True
    if anchored:
        return known
    n = max(0, len(block.hash) - length + 1)
    return known[:n] & known[length - half : length - half + n] & block.windows(length)[1]


def _covered(block: Block, right: pa.Table, length: int) -> np.ndarray:
    """Which words windows cover that start in a document of a smaller id too."""
    h, valid = block.windows(length)
    at, least, _ = _earliest(block, h, valid, right)
    hit = at[least < block.owners(at)]
    change = np.bincount(hit, minlength=len(block.hash) + 1) - np.bincount(hit + length, minlength=len(block.hash) + 1)
    return np.cumsum(change[:-1]) > 0


def _cut(key: tuple, rows: pa.Table, right: pa.Table, length: int, texts: bool = True) -> pa.Table:
    """Counts of words and of removed ones, the kept words joined by one space, and (if asked for) the text without the removed words."""
    release()
    covered = _covered(Block(rows), right, length)
    out, word = [], 0
    for batch in rows.select(["doc_id", "text"]).combine_chunks().to_batches():
        for part, buf, off in chunks(batch):
            words = Words(buf, off)
            gone = covered[word : word + len(words.hash)]
            word += len(words.hash)
            counts = words.counts()
            removed = np.concatenate(([0], np.cumsum(gone)))[words.first]
            kept_at = words.first - removed
            # Kept words, each with the space after it.
            size = (words.end - words.start + 1)[~gone]
            ends = np.concatenate(([0], np.cumsum(size)))
            data = np.append(buf, np.uint8(32))[ragged(words.start[~gone], size)] if len(size) else np.zeros(0, np.uint8)
            data[ends[1:] - 1] = 32
            data, bounds = data.tobytes(), ends[kept_at].tolist()
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array([data[a : b - 1] if b > a else b"" for a, b in itertools.pairwise(bounds)], pa.binary())]
            if texts:  # a removed word goes with the white space after it
                to = np.minimum(np.append(words.start[1:], len(buf)), np.repeat(off[1:], counts))
                change = np.bincount(words.start[gone], minlength=len(buf) + 1) - np.bincount(to[gone], minlength=len(buf) + 1)
                live = np.cumsum(change[:-1]) == 0
                left, sums = buf[live].tobytes(), np.concatenate(([0], np.cumsum(live)))[off].tolist()
                columns.append(pa.array([t if t is None or not r else left[a:b].decode("utf-8") for t, r, a, b in zip(part.column(1).to_pylist(), np.diff(removed).tolist(), sums[:-1], sums[1:], strict=True)], pa.string()))
            out.append(pa.RecordBatch.from_arrays(columns, _CUT.names[: len(columns)]))
    schema = pa.schema(list(_CUT)[: 5 if texts else 4])
    done = pa.Table.from_batches([b.cast(schema) for b in out], schema)
    return done.append_column("rest", rows["rest"]) if "rest" in rows.column_names else done


_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("text", pa.string())])


def _digest(key: tuple, rows: pa.Table, right: pa.Table, length: int) -> pa.Table:
    cut = _cut(key, rows, right, length, texts=False)
    return cut.drop_columns(["kept"]).append_column("kept_sha256", pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in cut["kept"]], pa.string()))


def _removed(df: DataFrame, length: int, block_bytes: int, end, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    levels = Levels(df, block_bytes, carry)
    half = -(-length // 2)
    replies = levels.next(levels.first(half, length), half, length, anchored=True)
    return levels.docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda key, rows, right: end(key, rows, right, length), schema)


def remove_repeats(df: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of each document (doc_id, text): n_words, n_removed, the kept words joined by one space, and the text without the removed words."""
    return _removed(df, length, block_bytes, _cut, "doc_id long, n_words long, n_removed long, kept binary, text string")


def cut_repeats(df: DataFrame, length: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all their columns kept, with what repeats cut out of text and n_chars (if there) counted anew; untouched texts stay as they are."""
    rest = tuple(c for c in df.columns if c not in ("doc_id", "text"))
    kind = df.select(F.struct(*rest).alias("rest")).schema["rest"].dataType.simpleString() if rest else None
    schema = "doc_id long, n_words long, n_removed long, kept binary, text string" + (f", rest {kind}" if rest else "")
    found = _removed(df, length, block_bytes, _cut, schema, rest)
    chosen = [F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("rest.n_chars")).cast(df.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in df.columns]
    return found.select(*chosen)


def longest_repeats(df: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest of length, 2 length, 4 length ... at which windows of a document repeat in others (doc_id, longest); documents without repeats are left out."""
    levels = Levels(df, block_bytes)
    half, anchored, found = -(-length // 2), True, None
    replies = levels.first(half, length)
    while True:
        replies = written(levels.next(replies, half, length, anchored, last=False), "level")
        level = written(levels.docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_seen(length), "doc_id long, longest int"), "level")
        found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))
        half, length, anchored = length, 2 * length, False


def _seen(length: int):
    """The documents of a block that hold a window of `length` words that other documents hold."""

    def run(key: tuple, rows: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(rows)
        at, _, several = _earliest(block, *block.windows(length), right)
        docs = np.unique(block.owners(at[several]))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "longest": pa.array(np.full(len(docs), length), pa.int32())})

    return run


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(table(spark, sf_dir, "documents", "doc_id", "text"), LENGTH, BLOCK_BYTES, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: The query's rows by SQL alone.
OP3_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
 p AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13),
 h AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 12], ' ')) AS h FROM p),
 m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM h JOIN m USING (h) WHERE least < doc_id),
 e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w),
 k AS (SELECT e.doc_id, sum(CASE WHEN c.j IS NULL THEN 0 ELSE 1 END) AS n, string_agg(CASE WHEN c.j IS NULL THEN word END, ' ' ORDER BY e.j) AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.j = c.j GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
