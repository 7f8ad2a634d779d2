"""Long texts read window by window into a block of bounded size: a superstep reads one window of every memory at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.extract import label_numbers
from memloom.functions.rules import block_budget
from memloom.functions.text import memory_hash, strip
from memloom.operators.sequential import pack_pieces
from memloom.sources.io import written

#: Characters of a token, where a block is clipped by an estimate.
CHARACTERS = 3


def clipped(text: Column, budget: Column) -> Column:
    """The text's first tokens."""
    return F.left(text, (budget * CHARACTERS).cast("int"))


def read_units(units: DataFrame, step: Callable[[DataFrame], DataFrame], high: int, labels: DataFrame | None = None, clip: Callable[[Column, Column], Column] = clipped) -> DataFrame:
    """(key, block, units) of units (key, i, chunk), i from 0: each memory's block after its last unit.

    step stands for a model: rows (key, block, chunk, budget, labels) to rows (key, text); what it gives is stripped and clipped to the budget, which follows from the number of units. Memories with fewer units
    are done earlier. Each superstep is written and read again, so that plans don't grow with the longest memory; labels (key, labels) are known beforehand.
    """
    held = written(units.select("key", "i", "chunk"), "units")
    sizes = held.groupBy("key").agg((F.max("i") + 1).cast("int").alias("units"))
    known = sizes.join(labels, "key", "left") if labels is not None else sizes.withColumn("labels", F.lit(None).cast("array<int>"))
    known = written(known.select("key", "units", block_budget(F.col("units"), high).alias("budget"), "labels"), "budgets")
    last = known.agg(F.max("units")).first()[0] or 0
    done, state = known.limit(0).select("key", F.lit("").alias("block"), "units"), known.withColumn("block", F.lit(""))
    for k in range(last):
        asked = state.join(held.where(F.col("i") == k).select("key", "chunk"), "key")
        given = step(asked.select("key", "block", "chunk", "budget", "labels")).select("key", strip(F.col("text")).alias("text"))
        state = written(state.drop("block").join(given, "key").withColumn("block", clip(F.coalesce("text", F.lit("")), F.col("budget"))).drop("text"), "blocks")
        done = done.unionByName(state.where(F.col("units") == k + 1).select("key", "block", "units"))
        state = state.where(F.col("units") > k + 1)
    return done


def read_memories(memories: DataFrame, step: Callable[[DataFrame], DataFrame], window: int, high: int) -> DataFrame:
    """(id, block, units) of memories (id, memory_docs): equal memories are read once, in windows of whole documents as far as they fit; memories without text have an empty block."""
    keyed = memories.select("id", memory_hash(F.col("memory_docs")).alias("key"), "memory_docs")
    once = keyed.groupBy("key").agg(F.first("memory_docs").alias("memory_docs"))
    units = once.select("key", F.posexplode(pack_pieces(F.transform("memory_docs", strip), window)).alias("i", "chunk"))
    labels = once.select("key", label_numbers(F.array_join("memory_docs", "\n\n")).alias("labels"))
    read = read_units(units, step, high, labels)
    return keyed.select("id", "key").join(read, "key", "left").select("id", F.coalesce("block", F.lit("")).alias("block"), F.coalesce("units", F.lit(0)).alias("units"))
