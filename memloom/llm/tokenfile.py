"""Operator 7: token files of packed ids.

Ids are stored in as many bits as the vocabulary needs, whatever that number is. A segment holds whole documents: blocks of
BLOCK ids, each starting at a byte of its own that the block offsets name, so that any id is found by one offset and one
shift, and a block (or all of them) unpacks as arrays. A segment is a row of a Parquet file, whose writer commits each
file whole on any store that Spark writes to, and repeats it if an executor is lost; files and segments are in order of
doc_id. Beside its payload a segment holds its documents' ids and lengths.

Null and empty texts have the end id alone. Rows of one doc_id stand in the order of a hash of their texts; exact repeats are
interchangeable. A very long text is encoded as a chunk of its own and lies in one segment. An empty table has no segments. Further columns of the input are left out.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm.base import chunks, ragged, release, shared_dir, table
from memloom.llm.bpe import Ranks, categories

#: Ids of a block, and ids after which a segment is closed.
BLOCK, SEGMENT = 1024, 1 << 18
END_ID = 0
SCHEMA = "file int, segment int, bits int, n_ids long, offsets array<int>, payload binary, doc_ids array<long>, lengths array<long>"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> tuple[bytes, np.ndarray]:
    """The ids in `bits` bits each, little-endian, and the byte at which each block starts."""
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros((blocks, BLOCK // 64, 64), np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    out = np.zeros((blocks, BLOCK // 64, bits + 1), np.uint64)  # 64 ids fill `bits` words of 64 bits
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, :, word] |= grid[:, :, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, :, word + 1] |= grid[:, :, k] >> np.uint64(64 - shift)
    size = BLOCK * bits // 8
    last = -(-(len(ids) - (blocks - 1) * BLOCK) * bits // 8) if blocks else 0
    data = np.ascontiguousarray(out[:, :, :bits]).astype("<u8").tobytes()
    return data[: (blocks - 1) * size + last] if blocks else b"", np.arange(blocks, dtype=np.int64) * size


def unpack(payload: bytes, offsets: np.ndarray, n: int, bits: int, block: int | None = None) -> np.ndarray:
    """All n ids, or those of one block, which reads that block's bytes alone."""
    if block is not None:
        stop = offsets[block + 1] if block + 1 < len(offsets) else len(payload)
        return unpack(payload[offsets[block] : stop], np.zeros(1, np.int64), min(BLOCK, n - block * BLOCK), bits)
    if not n:
        return np.zeros(0, np.uint32)
    groups = -(-n // 64)
    words = np.frombuffer(payload.ljust(groups * bits * 8, b"\0"), "<u8").reshape(groups, bits)
    out, mask = np.empty((groups, 64), np.uint32), np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = value & mask
    return out.reshape(-1)[:n]


@functools.cache
def unassigned() -> np.ndarray:
    """Whether a codepoint is unknown to the standard library, so that the tokenizer's later tables may know it as a letter."""
    return categories() == "Cn"


class Library(Ranks):
    """Ids by the tokenizers library. Slices that its pre-tokeniser keeps apart are encoded once each and cached; texts that hold an added token's string or an unassigned codepoint go to it whole."""

    #: More than the parent holds, as a slice costs a call of the library.
    CACHED, PLACES = 800_000, 21

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.bits = bits_for(self.tokenizer.get_vocab_size())
        self.ids, self.id_at, self.id_n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.forget()

    def add(self, pieces: list[bytes]) -> np.ndarray:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return self.store(np.fromiter(itertools.chain.from_iterable(found), np.int64, int(counts.sum())), counts)

    def whole(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows that the library must see whole."""
        data, spots = buf.tobytes(), []
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                spots.append(at)
                at = data.find(token, at + 1)
        if not data.isascii():
            points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
            if unassigned()[points[points > 127]].any():
                spots += np.flatnonzero((buf & 0xC0) != 0x80)[unassigned()[points]].tolist()
        return np.unique(np.searchsorted(off, np.array(spots, np.int64), "right") - 1)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.whole(buf, off)
        if not len(rows):
            return super().encode(buf, off)
        data, sizes = buf.tobytes(), np.diff(off)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([data[off[r] : off[r + 1]].decode("utf-8") for r in rows.tolist()], add_special_tokens=False)]
        kept = np.ones(len(sizes), bool)
        kept[rows] = False
        rest, at = super().encode(buf[np.repeat(kept, sizes)], np.concatenate(([0], np.cumsum(sizes * kept))))
        counts = np.diff(at)
        counts[rows] = list(map(len, found))
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = np.empty(ends[-1], np.int64)
        ids[np.repeat(kept, counts)] = rest
        ids[np.repeat(~kept, counts)] = [x for one in found for x in one]
        return ids, ends


_loaded: dict[str, Library] = {}


def library(path: str) -> Library:
    if path not in _loaded:
        _loaded[path] = Library(path)
    return _loaded[path]


def segments(df: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """The segments of (doc_id, text) in order of doc_id: file is the partition, segment the place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, file, number = library(path), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def close() -> pa.RecordBatch:
            ids, lengths = (np.concatenate([x[k] for x in held]) for k in range(2))
            doc_ids = [d for x in held for d in x[2]]
            payload, offsets = pack(ids, tokenizer.bits)
            return pa.RecordBatch.from_pylist([{"file": file, "segment": number, "bits": tokenizer.bits, "n_ids": len(ids), "offsets": offsets, "payload": payload, "doc_ids": doc_ids, "lengths": lengths}], pa.schema([("file", pa.int32()), ("segment", pa.int32()), ("bits", pa.int32()), ("n_ids", pa.int64()), ("offsets", pa.list_(pa.int32())), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]))

        for batch in batches:
            for part, buf, off in chunks(batch):
                ids, at = tokenizer.encode(buf, off)
                n = np.diff(at)
                out = np.full(len(ids) + len(n), end_id, np.int64)
                out[ragged(at[:-1] + np.arange(len(n)), n)] = ids
                held.append((out, n + 1, part.column(0).to_pylist()))
                if sum(len(x[0]) for x in held) >= SEGMENT:
                    yield close()
                    held, number = [], number + 1
            release()
        if held:
            yield close()

    # Rows of one id, and those without, are dealt on by their texts, so that they are no single task's either.
    keyed = df.select("doc_id", "text", F.xxhash64("text").alias("deal"))
    ordered = keyed.repartitionByRange("doc_id", "deal").sortWithinPartitions("doc_id", "deal", "text").select("doc_id", "text")
    return ordered.mapInArrow(run, SCHEMA)


def read_documents(stored: DataFrame) -> DataFrame:
    """The documents of written segments: doc_id, start, n_tokens and the crc32 of their ids, in their files' order."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], np.array(row["offsets"]), row["n_ids"], row["bits"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], ["file", "segment", "doc_id", "within", "n_tokens", "ids_crc32"])

    parts = stored.select("file", "segment", "n_ids")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # over one row a file
    files = parts.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("segment_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(files, "file").select("file", "segment", (F.col("file_start") + F.col("segment_start")).alias("base"))
    docs = stored.mapInArrow(run, "file int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["file", "segment"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments(table(spark, sf_dir, "documents", "doc_id", "text"), default_tokenizer()).write.parquet(path := shared_dir(spark, "op7"))
    return read_documents(spark.read.schema(SCHEMA).parquet(path))
