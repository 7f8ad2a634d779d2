"""Which groups of rollouts go on to training: those whose rewards vary, and as many others as keep the trainer from starving.

A run's groups are judged in their order, since what is dropped depends on what was; runs are judged beside each other. Spark finds the rewards and their spread; what is
left for the state is a few counters, so that a run's state is one row, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memloom.functions.text import let

#: Rewards that spread no more are equal. Fixed value.
LEAST = 1e-6


def usable(values: Column) -> Column:
    """The numbers of a group, or null where there are none, or one is missing or not finite."""
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(values) > 0) & finite, values)


def rewards(metric: Column, score: Column, token_scores: Column) -> Column:
    """A group's rewards: its metric, else its score, else the sums of its rows' token scores; the first that is usable, or null."""
    sums = F.transform(token_scores, lambda row: F.aggregate(row, F.lit(0.0), lambda s, x: s + x))
    return F.coalesce(usable(metric), usable(score), usable(sums))


def spread(values: Column) -> Column:
    """The population's standard deviation."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return let(values, lambda v: let(total(v) / F.size(v), lambda mean: F.sqrt(total(F.transform(v, lambda x: (x - mean) * (x - mean))) / F.size(v))))


class Counters(NamedTuple):
    """seen, kept and forced since the start; drops in a row and in the window; the staleness last heard of, NaN before any."""

    seen: int = 0
    kept: int = 0
    forced: int = 0
    row: int = 0
    window: int = 0
    staleness: float = float("nan")


COUNTERS = "seen long, kept long, forced long, row long, window long, staleness double"


class Gate:
    """row: drops in a row at most (None: any number). A window drops at most what the trainer may fall behind, `most` or what the group's status says, less the `floor` groups that it needs; it ends where staleness falls."""

    def __init__(self, floor: int, most: int, row: int | None):
        self.floor, self.most, self.row = floor, most, row

    def step(self, c: Counters, spread: float, staleness: float, most: float) -> tuple[Counters, bool, str]:
        """A missing spread, staleness or most is NaN. Keeps or drops, and why: no_metric, informative, forced_consec, forced_budget, dropped."""
        window = 0 if staleness < c.staleness else c.window
        staleness = c.staleness if staleness != staleness else staleness
        budget = max(int(most if most > 0 else self.most) - self.floor, 0)
        if spread != spread:
            why = "no_metric"
        elif spread > LEAST:
            why = "informative"
        elif self.row is not None and c.row >= self.row:
            why = "forced_consec"
        else:
            why = "forced_budget" if window >= budget else "dropped"
        keep = why != "dropped"
        return Counters(c.seen + 1, c.kept + keep, c.forced + why.startswith("forced"), 0 if keep else c.row + 1, window + (not keep), staleness), keep, why

    def judged(self, counters: Counters, rows: pd.DataFrame, key: str, order: str) -> tuple[Counters, pd.DataFrame]:
        rows, out = rows.sort_values(order, ignore_index=True), []
        for s, stale, most in zip(rows["spread"].astype(float), rows["staleness"].astype(float), rows["most"].astype(float), strict=True):
            counters, keep, why = self.step(counters, s, stale, most)
            out.append((keep, why, counters.seen, counters.kept, counters.forced, counters.window))
        made = pd.DataFrame(out, columns=["keep", "reason", "seen", "kept", "forced", "window_drops"])
        return counters, pd.concat([rows[[key, order]], made], axis=1)


def _schema(groups: DataFrame, key: str, order: str) -> str:
    types = dict(groups.dtypes)
    return f"{key} {types[key]}, {order} {types[order]}, keep boolean, reason string, seen long, kept long, forced long, window_drops long"


def judge(groups: DataFrame, gate: Gate, key: str, order: str) -> DataFrame:
    """(key, order, keep, reason, seen, kept, forced, window_drops) of groups (key, order, spread, staleness, most), all of them at once."""
    return groups.select(key, order, "spread", "staleness", "most").groupBy(key).applyInPandas(lambda rows: gate.judged(Counters(), rows, key, order)[1], _schema(groups, key, order))


class _Processor(StatefulProcessor):
    def __init__(self, gate: Gate, key: str, order: str):
        self.gate, self.key, self.order = gate, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("counters", COUNTERS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        counters = Counters(*self.held.get()) if self.held.exists() else Counters()
        counters, found = self.gate.judged(counters, pd.concat(list(rows)), self.key, self.order)
        self.held.update(tuple(counters))
        yield found

    def close(self) -> None:
        pass


def judge_stream(groups: DataFrame, gate: Gate, key: str, order: str) -> DataFrame:
    """The same of a stream, whose micro-batches bring each key's groups in order. The state store must be RocksDB's."""
    rows = groups.select(key, order, "spread", "staleness", "most")
    return rows.groupBy(key).transformWithStateInPandas(_Processor(gate, key, order), _schema(groups, key, order), "append", "none")
