"""How many tokens a token sees under the masks of packed training rows, counted by runs of tokens: running sums instead of pairs.

Rows are runs (key, i, n): n tokens in a row that share their flags, in order of i in a key. A token sees those up to itself that every given mask lets through; what is counted is what a run's last token sees.
Flags that may be given: document (only the same one is seen), segment (0 is shared by all, others are seen by themselves alone), evicted (what is evicted is seen only by what is evicted too), and evict_at with
chunk (a run is seen until its chunk's eviction, which comes at a later chunk; chunks rise with i).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seen(runs: DataFrame, key: str, document: str | None = None, segment: str | None = None, evicted: str | None = None, chunk: str | None = None, evict_at: str | None = None) -> DataFrame:
    """(key, i, visible). Sums run over a document's runs, and over a segment's in it: what is shuffled and held are the runs, twice as many with evictions."""
    flags = {"_document": document, "_segment": segment, "_evicted": evicted, "_chunk": chunk, "_gone": evict_at}
    default = {"_document": F.lit(0), "_segment": F.lit(0), "_evicted": F.lit(False), "_chunk": F.lit(0), "_gone": F.lit(1 << 62)}
    rows = runs.select(F.col(key), F.col("i"), F.col("n").cast("long").alias("_n"), *((F.col(c) if c else default[name]).alias(name) for name, c in flags.items()))
    arrive = rows.withColumns({"_at": F.col("_chunk").cast("long"), "_kind": F.lit(1)})
    events = arrive
    if evict_at:  # what goes at a chunk goes before the chunk's first run comes
        leave = rows.where(F.col("_gone").isNotNull()).withColumns({"_at": F.col("_gone").cast("long"), "_kind": F.lit(0), "_n": -F.col("_n")})
        events = arrive.unionByName(leave)
    order = ("_at", "_kind", "i")
    upto = Window.partitionBy(key, "_document").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(key, "_document", "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def total(over: Window, which: Column) -> Column:
        """The tokens of some runs that a run sees: all of them if it is evicted itself, else those that aren't."""
        every, live = F.sum(F.when(which, F.col("_n")).otherwise(0)).over(over), F.sum(F.when(which & ~F.col("_evicted"), F.col("_n")).otherwise(0)).over(over)
        return F.when(F.col("_evicted"), every).otherwise(live) if evicted else every

    shared = total(upto, F.col("_segment") == 0)
    visible = F.when(F.col("_segment") == 0, shared).otherwise(shared + total(own, F.lit(True))) if segment else shared
    return events.withColumn("visible", visible).where("_kind = 1").select(key, "i", "visible")
