"""Shared plumbing of the training-data operators: tables, shared folders, and byte-level text kernels.

Texts are handled as Arrow buffers: one byte array and row offsets, so that a batch is scanned with numpy and not row by row.
Batches are cut into chunks of a bounded number of bytes; a single text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import contextvars
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; others, whatever their names, are not read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where the session has none, a local master gets a temporary one; others raise."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = top.get() if top.isDefined() else ""
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="memloom-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: The tables that a run has made so far; runs beside each other, each in its thread or context, have lists of their own.
_tables: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tables", default=None)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: the frame as Parquet in the shared folder, read again."""
    spark = df.sparkSession
    df.write.parquet(path := shared_dir(spark, what))
    if (held := _tables.get()) is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Run:
    """A run whose tables are its own: `with Run(spark) as run:`; a run that fails leaves none."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Run:
        self.token = _tables.set(self.tables)
        return self

    def __exit__(self, kind, *_) -> None:
        _tables.reset(self.token)
        if kind is not None:
            self.drop(0)

    def drop(self, last: int = 1) -> None:
        """Deletes its tables but for the last, which holds what they were made for."""
        gone = self.tables[: len(self.tables) - last]
        for path in gone:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        del self.tables[: len(gone)]


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Gives freed memory back to the system. A worker process is used again and again, and would keep the room of its largest batch."""
    _trim()(0)


def crc32_of(column: Column) -> Column:
    return F.crc32(F.encode(column, "UTF-8"))


# ---------------------------------------------------------------- byte kernels


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and the offset of each row in them (one more at the end). Null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in slices of up to `limit` bytes of text (one row at least), each with its bytes and offsets."""
    buf, off = flat(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd 64-bit number."""
    global _powers
    if len(_powers) < n:
        step = np.full(max(64, 2 * n), _STEP, np.uint64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(padded: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes, or all `size` of them, from each place on, as one integer; seven bytes follow the last place."""
    value = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))[at].view("<u8").reshape(-1)
    short = np.minimum(size, 7).astype(np.uint64)
    return np.where(size < 8, value & ((np.uint64(1) << (short * np.uint64(8))) - np.uint64(1)), value)


def hashes(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range of one byte or more: eight bytes at a time go through mix() with their place and the range's size before they are
    summed, so that no arrangement of bytes cancels out. Seeds give independent hashes."""
    padded, out, step = np.concatenate((buf, np.zeros(8, np.uint8))), np.empty(len(start), np.uint64), CHUNK_BYTES // 8
    for a in range(0, len(start), step):  # so many at a time that a very long text takes little more than itself
        _hash_into(out[a : a + step], padded, start[a : a + step], size[a : a + step], seed)
    return out


def _hash_into(out: np.ndarray, padded: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> None:
    salt = mix(size.astype(np.uint64) * _STEP + np.uint64(seed + 1))
    out[:] = mix(_eights(padded, start, size) ^ salt)
    long = np.flatnonzero(size > 8)
    if not len(long):
        return
    more = (size[long] - 1) // 8  # eights after the first
    ends = np.cumsum(more)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], CHUNK_BYTES // 8)), len(ends)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own, n = long[a:b], more[a:b]
        head = np.cumsum(n) - n
        place = np.arange(1, int(n.sum()) + 1) - np.repeat(head, n)
        value = _eights(padded, np.repeat(start[own], n) + 8 * place, np.repeat(size[own], n) - 8 * place)
        value = mix(mix(value ^ np.repeat(salt[own], n)) + place.astype(np.uint64) * _STEP)
        out[own] = mix(out[own] + np.add.reduceat(value, head))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a chunk: byte ranges, a 64-bit hash of each, and the first word of each row."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False):
        if lower:
            buf = _LOWER[buf]
        self.buf, self.off = buf, off
        n = len(buf)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
            return
        inside = ~_SPACE[buf]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        if len(self.start):
            self.hash = hashes(buf, self.start, self.end - self.start)
        else:
            self.hash = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts())


def runs(word_hash: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` consecutive words, by its first word; the last length-1 of a chunk have none."""
    n = len(word_hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out ^= out >> np.uint64(29)  # a plain polynomial has arrangements of two words that cancel out
        out *= _STEP
        out += word_hash[k : k + n]
    return mix(out)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i]+counts[i]-1 of all i in turn."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
