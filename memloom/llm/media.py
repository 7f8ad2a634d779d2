"""Operator 5: media columns.

A payload of bytes becomes a WAV of 8-bit mono samples (the wave module), and the stored bytes are read back for everything
that follows. Short-time Fourier transforms of the samples give one spectral peak a band and frame; a peak and the strongest
peak of each of the next frames make a pair, whose two frequencies and distance in time are its fingerprint. Fingerprints are
stored with the frame they start at, as two arrays in time order.

The media are a column of a table in the shared folder; digests and features are made of what is read from it.

A null or empty text is a payload of one unit of zero bytes. Equal texts (repeated rows too) give equal values, whatever the rows beside them. Ties between equally strong peaks
go to the lower frequency; silence has no peaks. A payload shorter than a frame is one frame, filled up with silence. A very long text's
samples take some 40 bytes a byte while its spectra are made, 2,048 frames at a time. An empty table gives no rows. Columns beside doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from memloom.llm.base import chunks, ragged, release, table, written

RATE = 8000
#: Samples of a frame, and between the starts of two frames.
FRAME, HOP = 512, 256
#: Bounds of the bands in bins of the transform; a peak each.
BANDS = (2, 24, 72, 144, 257)
#: Frames after its own in which a peak is paired.
FAN = 2
UNIT = 64
MEDIA = "doc_id long, n_bytes long, media binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, codes array<int>, times array<int>"
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the frames of all rows: the bin of each band's peak (0: none), the strongest of them, and the rows' first frames."""
    size = np.diff(off)
    frames = np.maximum(1, -(-np.maximum(size - FRAME, 0) // HOP) + 1)
    first = np.concatenate(([0], np.cumsum(frames)))
    room = (frames - 1) * HOP + FRAME
    at = np.cumsum(room) - room
    signal = np.zeros(int(room.sum()), np.float32)
    signal[ragged(at, size)] = samples.astype(np.float32) - 128
    starts = np.repeat(at, frames) + HOP * ragged(np.zeros(len(frames), np.int64), frames)
    bins, strong = np.zeros((int(first[-1]), len(BANDS) - 1), np.int32), np.zeros(int(first[-1]), np.int32)
    view = np.lib.stride_tricks.sliding_window_view(signal, FRAME)
    for a in range(0, len(starts), 2048):
        spectrum = np.abs(np.fft.rfft(view[starts[a : a + 2048]] * _WINDOW, axis=1)).astype(np.float32)
        spectrum[spectrum < 1e-2] = 0
        best = np.zeros(len(spectrum), np.float32)
        for k, (lo, hi) in enumerate(zip(BANDS[:-1], BANDS[1:], strict=True)):
            top = spectrum[:, lo:hi].argmax(1)
            height = spectrum[np.arange(len(top)), lo + top]
            found = np.where(height > 0, lo + top, 0)
            bins[a : a + 2048, k] = found
            strong[a : a + 2048] = np.where(height > best, found, strong[a : a + 2048])
            best = np.maximum(best, height)
    return bins, strong, first


def fingerprints(bins: np.ndarray, strong: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and times of all rows' pairs, in time order, and each row's first pair (one more at the end)."""
    n, frames = len(strong), np.diff(first)
    row, time = np.repeat(np.arange(len(frames)), frames), ragged(np.zeros(len(frames), np.int64), frames)
    codes, live = np.zeros((n, FAN, bins.shape[1]), np.int32), np.zeros((n, FAN, bins.shape[1]), bool)
    for step in range(1, FAN + 1):
        same = np.zeros(n, bool)
        same[:-step] = row[:-step] == row[step:]
        other = np.zeros(n, np.int32)
        other[:-step] = strong[step:]
        codes[:, step - 1] = bins << 12 | (other << 2)[:, None] | step
        live[:, step - 1] = (bins > 0) & (same & (other > 0))[:, None]
    keep = live.reshape(n, -1)
    per_frame = keep.sum(1)
    ends = np.concatenate(([0], np.cumsum(per_frame)))
    return codes.reshape(n, -1)[keep], np.repeat(time, per_frame).astype(np.int32), ends[first]


def store(df: DataFrame, what: str = "media") -> DataFrame:
    """doc_id, n_bytes and the media column of (doc_id, text), written to the shared folder and read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in chunks(batch):
                data, sizes = buf.tobytes(), np.diff(off)
                media = [to_wav(data[a:b] + bytes(-(b - a) % UNIT if b > a else UNIT)) for a, b in itertools.pairwise(off.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
            release()

    return written(df.select("doc_id", "text").mapInArrow(run, MEDIA), what)


def fingerprint(stored: DataFrame) -> DataFrame:
    """Digests and fingerprints of a media column (doc_id, n_bytes, media); see op5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in chunks(batch, "media"):
                data, cols = buf.tobytes(), [[] for _ in range(5)]
                back = []
                for a, b in itertools.pairwise(off.tolist()):
                    media = data[a:b]
                    payload = from_wav(media)
                    back.append(payload)
                    for col, value in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()), strict=True):
                        col.append(value)
                at = np.concatenate(([0], np.cumsum(cols[0])))
                bins, strong, first = peaks(np.frombuffer(b"".join(back), np.uint8), at)
                codes, times, ends = fingerprints(bins, strong, first)
                frames = np.diff(first)
                features = [f"{n}:{b - a}:{zlib.crc32(codes[a:b].tobytes()):08x}{zlib.crc32(times[a:b].tobytes()):08x}" for n, a, b in zip(frames.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (codes, times)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4]), pa.array(features), pa.array(frames, pa.int32()), *lists],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "codes", "times"],
                )
            release()

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


def op5_media_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(store(table(spark, sf_dir, "documents", "doc_id", "text")))
