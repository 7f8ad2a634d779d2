"""What the classifiers share: the bounded sample of labelled rows, and a numpy optimiser."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most, those of the smallest hash of their ids; bytes of a text that may be among them, and of all of them together.
SAMPLE_ROWS, TEXT_BYTES, SAMPLE_BYTES = 6000, 1 << 20, 48 << 20


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % divisor


def held_out(divisor: int, rest: int) -> Column:
    """Whether a row is never learned from; null ids are not."""
    return F.coalesce(remainder(F.col("doc_id"), divisor) == rest, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, divisor: int, rest: int, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a sample of the rows to learn from, bounded by `rows`, TEXT_BYTES and SAMPLE_BYTES; texts are whole. Conflicting labels of one id take the larger, of its texts the smallest."""
    usable = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), divisor) != rest))
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= TEXT_BYTES)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # `rows` ids at most
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over `rows` rows at most
    found = found.withColumn("upto", F.sum(F.octet_length("text")).over(upto)).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id", "text", "label")
    found = sorted((r.doc_id, r.text, r.label) for r in found.collect())
    return [t for _, t, _ in found], np.array([1.0 if y else 0.0 for *_, y in found])


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Descends along the gradient; the rate falls linearly to a tenth."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
