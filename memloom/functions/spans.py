"""Chunk spans, eviction schedules and windows over arrays of token ids or lengths. Spans are half-open, indices start at 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import let

#: The step of tokens that are never evicted, and of padding. Fixed value.
NEVER = 1 << 30


def indices(n: Column) -> Column:
    """0 .. n-1, none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def running(lengths: Column) -> Column:
    """0 and the sums up to each length."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def chunk_spans(lengths: Column) -> Column:
    return let(running(lengths), lambda sums: F.transform(lengths, lambda x, i: F.struct(F.get(sums, i).alias("s"), (F.get(sums, i) + x).alias("e"))))


def evict_schedule(lengths: Column, chunk_limit: Column, token_limit: Column, sinks: Column) -> Column:
    """For each chunk the first later chunk at which it no longer fits, by count or by tokens (sinks counted); the number of chunks if it always fits, and for sinks."""
    n = F.size(lengths)

    def leaves(sums: Column, j: Column) -> Column:
        sink_tokens = F.get(sums, F.least(sinks, n))
        later = F.filter(F.sequence(j, n - 1), lambda i: (i > j) & ((i - j + 1 > chunk_limit) | ((token_limit > 0) & (sink_tokens + F.get(sums, i + 1) - F.get(sums, j) > token_limit))))
        return F.when(j < sinks, n).otherwise(F.coalesce(F.get(later, F.lit(0)), n))

    return let(running(lengths), lambda sums: F.transform(indices(n), lambda j: leaves(sums, j)))


def per_token(lengths: Column, values: Column) -> Column:
    """Each chunk's value once for each of its tokens."""
    return F.flatten(F.zip_with(lengths, values, lambda n, v: F.array_repeat(v, n)))


def fixed_spans(n: Column, size: Column) -> Column:
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("s"), F.least(s + size, n).alias("e")))


def sliding_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows that overlap; the first window that reaches the end is the last."""
    all_starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(all_starts, lambda s: (s == 0) | (s - (size - overlap) + size < n))


def marked_spans(ids: Column, marker: int, size: int) -> Column:
    """Spans that begin at each marker (and at the start), cut to `size`."""

    def cut(begins: Column, n: Column) -> Column:
        ends = F.transform(begins, lambda b, k: F.coalesce(F.get(begins, k + 1), n))
        pieces = F.zip_with(begins, ends, lambda b, e: F.transform(F.sequence(b, e - 1, F.lit(size)), lambda s: F.struct(s.alias("s"), F.least(s + size, e).alias("e"))))
        return F.flatten(pieces)

    begins = lambda all_: F.filter(indices(F.size(all_)), lambda i: (i == 0) | (F.get(all_, i) == marker))
    return let(ids, lambda all_: let(begins(all_), lambda found: cut(found, F.size(all_))))


def sink_end(tokens: Column, page: int = 32) -> Column:
    """Tokens rounded up to whole pages."""
    return (F.ceil(tokens / page) * page).cast("int")


def frontier(n: Column, chunk: Column) -> Column:
    """The chunk of the last of n tokens."""
    return F.greatest(F.ceil(n / chunk).cast("int") - 1, F.lit(0))


def merge_adjacent(spans: Column) -> Column:
    """Ordered spans with those that touch joined."""
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]), F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))).otherwise(F.array_append(acc, x))
    return F.aggregate(spans, F.array().cast("array<struct<s:int,e:int>>"), step)


def dropped_pages(spans: Column, n: Column, page: int) -> Column:
    """Full pages that lie in an evicted span; the page of the last token is not full."""
    pages = indices(F.floor(n / page).cast("int"))
    return F.filter(pages, lambda p: F.exists(spans, lambda x: (x["s"] <= p * page) & ((p + 1) * page <= x["e"])))


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(indices(n), lambda i: F.get(a, i) != F.get(b, i))
    return F.coalesce(F.array_min(differ), n)


def segment_ids(positions: Column) -> Column:
    """A new segment wherever positions start at 0 again."""
    return F.transform(positions, lambda p, i: F.size(F.filter(F.slice(positions, 1, i + 1), lambda x: x == 0)) - 1)


def collated(lengths: Column) -> Column:
    """struct(seq_ids, position_ids, cu_seqlens) of sequences packed into one row."""
    seqs = F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n)))
    places = F.flatten(F.transform(lengths, indices))
    return F.struct(seqs.alias("seq_ids"), places.alias("position_ids"), running(lengths).alias("cu_seqlens"))


def behind_sink(spans: Column, sink: int) -> Column:
    """Spans behind a segment of `sink` tokens, which is the first."""
    shifted = F.transform(spans, lambda x: F.struct((x["s"] + sink).alias("s"), (x["e"] + sink).alias("e")))
    return F.concat(F.array(F.struct(F.lit(0).alias("s"), F.lit(sink).alias("e"))), shifted)


def sliding_span(n: Column, sink: int, window: int) -> Column:
    """The evicted span of a sink and a sliding window."""
    return F.struct(F.lit(sink).cast("long").alias("s"), F.greatest(F.lit(sink), n - window).cast("long").alias("e"))


def static_blocks(n: Column, sink: int, recent: int, block: int) -> Column:
    """The full blocks between the sink and the recent tokens."""
    low, high = sink // block, F.floor((n - recent) / block)
    return F.when(high > low, F.sequence(F.lit(low).cast("long"), high - 1)).otherwise(F.array().cast("array<bigint>"))


def compacted(pages: Column, dropped: Column, n: Column, page: int) -> Column:
    """struct(pages, n) of a page table without the pages dropped (by place), its length shrunk by them."""
    kept = F.filter(pages, lambda _, i: ~F.array_contains(dropped, i))
    return F.struct(kept.alias("pages"), (n - F.size(dropped) * page).alias("n"))


def split_by_lengths(memory: Column, lengths: Column, separator: int) -> Column:
    """The documents of a joined text by their lengths, blank ones left out."""
    starts = running(F.transform(lengths, lambda n: n + separator))
    return F.filter(F.transform(lengths, lambda n, i: F.substring(memory, F.get(starts, i) + 1, n)), lambda d: F.trim(d) != "")


def folded(chunks: Column, step, budget: int) -> Column:
    """A memory rewritten chunk by chunk: step(block, chunk) is clipped to `budget` characters. The step stands for a model."""
    return F.aggregate(chunks, F.lit(""), lambda block, chunk: F.left(step(block, chunk), F.lit(budget)))


def chunk_of(ends: Column, n: Column) -> Column:
    """The chunk of the last of n tokens where chunks end anywhere: as many as end before it, the last at most."""
    return F.least(F.size(F.filter(ends, lambda e: e < n)), F.size(ends) - 1)


def answer_loss(labels: Column, losses: Column, ignored: int = -100) -> Column:
    """struct(n, mean) of the losses at positions whose next label counts: the loss shifts labels by one. Without such positions the mean is null."""
    next_ = F.zip_with(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), F.slice(losses, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda y, x: F.when(y != ignored, x))
    return let(F.filter(next_, lambda x: x.isNotNull()), lambda kept: F.struct(F.size(kept).alias("n"), F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept)).alias("mean")))
