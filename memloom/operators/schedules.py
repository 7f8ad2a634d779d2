"""Eviction schedules of texts of any number of chunks, by windows instead of arrays: work grows with the chunks, not with their pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import spans
from memloom.functions.rules import resolved
from memloom.functions.text import let

#: The token that opens a turn, how many tokens a generation's header has, and tokens of a page. Fixed values.
TURN, HEADER, PAGE = 151644, 3, 32


def evict_at(chunks: DataFrame, key: str, chunk_limit: int, token_limit: int | str, sinks: int) -> DataFrame:
    """(key, i, n, evict_at) of chunks (key, i, n): the first later chunk at which one no longer fits, by count or by tokens (sinks
    counted); the number of chunks if it always fits, and for sinks. token_limit may name a column that is one number a key, over 0.

    By tokens that is the number of chunks which end by a limit of their own: ends and limits are sorted together and counted.
    """
    whole, upto = Window.partitionBy(key), Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    by_key = isinstance(token_limit, str)
    marked = chunks.select(key, "i", "n", *([token_limit] if by_key else []), F.sum("n").over(upto).alias("end"), F.count("*").over(whole).alias("chunks"), F.coalesce(F.sum(F.when(F.col("i") < sinks, F.col("n"))).over(whole), F.lit(0)).alias("sink"))
    at = F.col("i") + chunk_limit
    if by_key or token_limit > 0:
        limit = F.col(token_limit) if by_key else F.lit(token_limit)
        ends = marked.select(key, F.col("end").alias("v"), F.lit(0).alias("asks"))
        limits = marked.select(key, (F.col("end") - F.col("n") + limit - F.col("sink")).alias("v"), F.lit(1).alias("asks"), "i", "n", "chunks")
        order = Window.partitionBy(key).orderBy("v", "asks").rowsBetween(Window.unboundedPreceding, 0)
        marked = ends.unionByName(limits, allowMissingColumns=True).withColumn("fit", F.count_if(F.col("asks") == 0).over(order)).where("asks = 1")
        at = F.least(at, F.greatest(F.col("fit"), F.col("i") + 1))
    return marked.select(key, "i", "n", F.when(F.col("i") < sinks, F.col("chunks")).otherwise(F.least(at, F.col("chunks"))).cast("int").alias("evict_at"))


def visible(schedule: DataFrame, key: str) -> DataFrame:
    """(key, i, visible): the tokens that each chunk of a schedule (key, i, n, evict_at) sees, its own among them: all so far but those evicted by then."""
    gone = schedule.groupBy(key, F.col("evict_at").alias("i")).agg(F.sum("n").alias("gone"))
    upto = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    both = schedule.select(key, "i", "n").join(gone, [key, "i"], "left")
    return both.select(key, "i", F.sum(F.col("n") - F.coalesce("gone", F.lit(0))).over(upto).alias("visible"))


def merged(spans_: DataFrame, key: str) -> DataFrame:
    """(key, s, e) of spans (key, s, e) with those that touch or overlap joined: a span that starts beyond the furthest end before it begins a new one."""
    order = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans_.withColumn("_new", F.when(F.col("s") <= reach, 0).otherwise(1))
    islands = begun.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def segments(rows: DataFrame, turn: int = TURN) -> DataFrame:
    """(row, seq, start, n, sink, window, chunk) of rows (row, ids, mask, positions) of tokens: the sequences that are packed into a row.

    A sequence begins wherever a valid token's position is 0, or with the first valid token if none is; tokens before the first one belong to none. Without a mask all tokens are valid, without
    positions they are one sequence. Its sink ends at its first turn after the start, in whole pages, or with the first page; its prompt ends with
    the header of its last turn, or with itself; the prompt's length decides on its chunks and its window.
    """
    valid = F.filter(spans.indices(F.size("ids")), lambda i: F.coalesce(F.get("mask", i), F.lit(1)) != 0)
    placed = rows.select("row", let(valid, lambda at: F.struct(F.transform(at, lambda i: F.get("ids", i)).alias("ids"), F.transform(at, lambda i: F.get("positions", i)).alias("positions"))).alias("x")).select("row", "x.ids", "x.positions")
    zeros = F.filter(spans.indices(F.size("ids")), lambda k: F.get("positions", k) == 0)
    starts = let(zeros, lambda found: F.when((F.size("ids") > 0) & (F.size(found) == 0), F.array(F.lit(0))).otherwise(found))
    cut = let(starts, lambda found: F.transform(found, lambda a, k: F.struct(k.alias("seq"), a.alias("start"), (F.coalesce(F.get(found, k + 1), F.size("ids")) - a).alias("n"))))
    each = placed.select("row", "ids", F.explode(cut).alias("s")).select("row", "s.seq", "s.start", "s.n", F.slice("ids", F.col("s.start") + 1, F.col("s.n")).alias("own"))
    first = let(F.array_position(F.slice("own", 2, F.col("n")), turn), lambda p: F.when(p > 0, p).otherwise(F.lit(PAGE)))
    last = F.col("n") - F.array_position(F.reverse("own"), turn).cast("int")
    prompt = F.when(F.array_contains("own", turn), F.least(last + HEADER, F.col("n"))).otherwise(F.col("n"))
    known = each.select("row", "seq", "start", "n", spans.sink_end(first, PAGE).alias("sink"), resolved(prompt).alias("rule"))
    return known.select("row", "seq", "start", "n", "sink", F.col("rule.window").alias("window"), F.col("rule.chunk").alias("chunk"))


def segment_schedule(rows: DataFrame, turn: int = TURN) -> DataFrame:
    """(row, chunk_ids, evict_steps, seq_ids) of rows (row, ids, mask, positions) of tokens: for each token its chunk in its sequence, the chunk at which that is evicted, and the sequence.

    Chunks are a sink and strides behind it, all counted whole; each sequence of a row has a schedule of its own, by the windows of evict_at() over its chunks. Tokens of no sequence,
    padding among them, have chunk 0, are never evicted and count as sequence 0.
    """
    found = segments(rows, turn).withColumn("key", F.struct("row", "seq"))
    count = F.when(F.col("n") <= F.col("sink"), F.lit(1)).otherwise(1 + F.ceil((F.col("n") - F.col("sink")) / F.col("chunk")).cast("int"))
    chunks = found.select("key", "window", "sink", "chunk", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    plan = evict_at(chunks.select("key", "i", F.when(F.col("i") == 0, F.col("sink")).otherwise(F.col("chunk")).alias("n"), "window"), "key", 1 << 30, "window", 1)
    steps = plan.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "evict_at"))).alias("plan"))  # a chunk is 64 tokens or more of a row
    # A token's chunk follows from its place in its sequence.
    place = F.sequence(F.lit(0), F.col("n") - 1)
    own = F.transform(place, lambda p: F.when(p < F.col("sink"), F.lit(0)).otherwise(1 + F.floor((p - F.col("sink")) / F.col("chunk")).cast("int")))
    tokens = F.transform(own, lambda c: F.struct(c.alias("chunk_id"), F.get("plan", c)["evict_at"].alias("evict_step"), F.col("seq").alias("seq_id")))
    each = found.join(steps, "key").select("row", "start", tokens.alias("tokens"))
    by_row = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "tokens"))).alias("parts"))
    inert = F.struct(F.lit(0).alias("chunk_id"), F.lit(spans.NEVER).alias("evict_step"), F.lit(0).alias("seq_id"))
    whole = rows.select("row", F.size("ids").alias("size"), "mask").join(by_row, "row", "left")
    all_ = spans.indices(F.col("size"))
    valid = F.filter(all_, lambda i: F.coalesce(F.get("mask", i), F.lit(1)) != 0)
    before = F.coalesce(F.get("parts", F.lit(0))["start"], F.col("size"))  # valid tokens before the first sequence
    values = F.concat(F.array_repeat(inert, before), F.coalesce(F.flatten(F.transform("parts", lambda x: x["tokens"])), F.array().cast("array<struct<chunk_id:int,evict_step:int,seq_id:int>>")))
    padding = F.filter(all_, lambda i: F.get("mask", i) == 0)
    scattered = let(values, lambda v: F.concat(F.transform(valid, lambda i, k: F.struct(i.alias("at"), F.get(v, k).alias("v"))), F.transform(padding, lambda i: F.struct(i.alias("at"), inert.alias("v")))))
    ordered = whole.select("row", F.transform(F.array_sort(scattered), lambda x: x["v"]).alias("v"))
    part = lambda c: F.transform("v", lambda x: x[c])
    return ordered.select("row", part("chunk_id").alias("chunk_ids"), part("evict_step").alias("evict_steps"), part("seq_id").alias("seq_ids"))
