"""Operators whose result depends on a running state: greedy packing of pieces, packs of lengths, balanced steps.

Pieces are folded in each row. Packs need all lengths of a pool at once; they work on (index, length) pairs, never
on tokens, and more than POOL rows are split into pools by hash first. Steps are dealt by places, in any number of tasks.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import order_key
from memloom.operators.regroup import range_of
from memloom.operators.splits import by_hash, placed

#: Rows of a pool that is packed at once.
POOL = 1_000_000


def pack_pieces(pieces: Column, window: int) -> Column:
    """Pieces of text joined by line ends while they fit the window (in characters); longer ones are cut by themselves."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["held"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["held"]))

    def step(acc: Column, piece: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(piece), F.lit(window)), lambda at: F.substring(piece, at, F.lit(window)))
        alone = F.struct(F.concat(flushed(acc), parts).alias("done"), F.lit("").alias("held"))
        joined = F.struct(acc["done"].alias("done"), F.when(acc["held"] == "", piece).otherwise(F.concat(acc["held"], F.lit("\n"), piece)).alias("held"))
        fresh = F.struct(flushed(acc).alias("done"), piece.alias("held"))
        fits = F.when(acc["held"] == "", F.length(piece)).otherwise(F.length(acc["held"]) + 1 + F.length(piece)) <= window
        return F.when(F.length(piece) > window, alone).when(fits, joined).otherwise(fresh)

    return F.aggregate(F.filter(pieces, lambda p: p != ""), start, step, flushed)


def _filled(sizes: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """For sizes in rising order: how many of the smallest each pack takes beside the large one that opens it, and the pack of each.

    What the packs take from the small end are stretches of the order, one after the other, so that a stretch's end follows from the sums before it.
    """
    sums, n = [0, *np.cumsum(sizes).tolist()], len(sizes)
    ends, at = [], 0
    while at + len(ends) < n:
        opener = n - 1 - len(ends)
        at = min(bisect_right(sums, sums[at] + target - int(sizes[opener]), at) - 1, opener)
        ends.append(at)
    takes = np.diff(np.array([0, *ends]))
    return takes, np.concatenate((np.repeat(np.arange(len(ends)), takes), np.arange(len(ends))[::-1])).astype(np.int64)


def bin_packs(rows: DataFrame, target: int) -> DataFrame:
    """(pool, idx, n, pack) of rows (idx, n): packs of at most `target`, each opened by the largest that is left and filled with the smallest that are left; of equal sizes the smaller idx opens first. What exceeds the target goes."""

    def run(key: tuple, pool: pa.Table) -> pa.Table:  # noqa: ARG001
        idx, n = pool["idx"].to_numpy(), pool["n"].to_numpy()
        order = np.lexsort((-idx, n))
        return pa.table({"pool": pool["pool"].take(order), "idx": idx[order], "n": n[order], "pack": _filled(n[order], target)[1]})

    fits = rows.select(F.col("idx").cast("long"), F.col("n").cast("long")).where(F.col("n") <= target)
    pools = max(1, -(-fits.count() // POOL))
    pooled = fits.select(F.pmod(F.xxhash64("idx"), F.lit(pools)).cast("int").alias("pool"), "idx", "n")
    return pooled.groupBy("pool").applyInArrow(run, "pool int, idx long, n long, pack long")


def balanced_steps(packs: DataFrame, per_step: int, seed: int = 0, key: str = "pack") -> DataFrame:
    """(key, weight, step, slot) of packs (key, weight): steps of exactly `per_step` packs and of nearly the same weight, in a random order of steps and of packs in them.

    Packs by falling weight are dealt to the steps in rounds, forth and back, so that two steps differ by no more than the largest weight less the smallest: their differences in
    successive rounds have opposite signs and what is left of them is one round's. Places come from counts of ranges and places inside them; no task holds all packs. Packs that fill no step go, which ones is drawn.
    """
    drawn = packs.select(key, F.col("weight").cast("long").alias("weight")).withColumn("_draw", order_key(seed, "pack", F.col(key)))
    total = drawn.count()
    steps, rest = divmod(total, per_step)
    if rest:
        gone = drawn.orderBy(F.desc("_draw"), F.desc(key)).limit(rest).select(key)  # fewer than a step
        drawn = drawn.join(F.broadcast(gone), key, "left_anti")
    # A weight and a draw as one number, so that ranges split among packs of one weight too.
    drawn = drawn.withColumn("_at", -(F.col("weight") + F.conv(F.substring("_draw", 1, 8), 16, 10).cast("double") / 4294967296.0))
    found = placed(drawn.withColumn("_all", F.lit(0)), ["_all"], F.struct("_at", "_draw", key), range_of(drawn, "_at"))
    if not steps:
        return found.select(key, "weight", F.lit(0).cast("long").alias("step"), F.lit(0).alias("slot")).limit(0)
    turn, spot = F.expr(f"place DIV {steps}L"), F.col("place") % steps
    dealt = found.withColumn("_step", F.when(turn % 2 == 0, spot).otherwise(steps - 1 - spot))
    names = by_hash(packs.sparkSession.range(steps).withColumn("_all", F.lit(0)), ["_all"], seed, "step", "id", "step").select(F.col("id").alias("_step"), "step")
    slot = F.row_number().over(Window.partitionBy("step").orderBy("_draw", key)) - 1  # `per_step` packs
    return dealt.join(names, "_step").select(key, "weight", "step", "_draw").withColumn("slot", slot).drop("_draw")


def ranked(steps: DataFrame, ranks: int, batch: int) -> DataFrame:
    """The packs of steps (step, slot) with their rank, micro-batch and place in it: a step's slots go to the ranks one stretch after the other, a rank's in batches of `batch`. Slots are per step: ranks times micro-batches times batch."""
    each = F.max("slot").over(Window.partitionBy("step")) + 1
    found = steps.withColumn("_each", (each / ranks).cast("int"))
    own = F.col("slot") % F.col("_each")
    return found.withColumns({"rank": F.floor(F.col("slot") / F.col("_each")).cast("int"), "micro": F.floor(own / batch).cast("int"), "place": (own % batch).cast("int")}).drop("_each")
