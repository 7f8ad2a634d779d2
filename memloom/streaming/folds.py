"""Stateful operators over event logs, as batch folds and as Structured Streaming.

A fold is one function of (state, event); batches apply it to each key's events in order, streams keep its state. A step may change the state that it is given, so that it costs the same however much is held.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_scores(scored: DataFrame) -> DataFrame:
    """A stream of scores (id, correct) with the first of each id."""
    return scored.dropDuplicates(["id"])


def completion(scored: DataFrame, totals: DataFrame) -> DataFrame:
    """Runs and how many of their records are scored or failed, against their totals (run, total)."""
    done = scored.groupBy("run").agg(F.count("*").alias("done"), F.count_if("failed").alias("failed"))
    return done.join(totals, "run").withColumn("finished", F.col("done") >= F.col("total"))


def event_windows(events: DataFrame, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Events counted and summed by window and type; events later than the watermark are left out."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


class GroupFilter:
    """Drops groups whose metric hardly varies, but not more than `row` in a row nor more than `budget` in a window; a falling window counter starts a new window. A group without a metric passes."""

    def __init__(self, row: int, budget: int, least: float = 1e-6):
        self.row, self.budget, self.least = row, budget, least

    def start(self) -> dict[str, Any]:
        return {"row": 0, "dropped": 0, "window": None}

    def step(self, state: dict[str, Any], event: dict[str, Any]) -> tuple[dict[str, Any], bool]:
        if state["window"] is not None and event["window"] < state["window"]:
            state = {**state, "dropped": 0}
        state = {**state, "window": event["window"]}
        spread = event["spread"]
        flat = spread is not None and spread <= self.least
        if flat and state["row"] < self.row and state["dropped"] < self.budget:
            return {**state, "row": state["row"] + 1, "dropped": state["dropped"] + 1}, False
        return {**state, "row": 0}, True


class Router:
    """Sends a request to the least loaded server; requests of one group stay on a server until the last of them is released."""

    def __init__(self, servers: int):
        self.servers = servers

    def start(self) -> dict[str, Any]:
        return {"load": [0.0] * self.servers, "held": {}}

    def step(self, state: dict[str, Any], event: dict[str, Any]) -> tuple[dict[str, Any], int | None]:
        load, held, group = state["load"], state["held"], str(event["group"])
        server, count = held.get(group, (None, 0))
        weight = max(int(event["weight"]), 1)
        if event["acquire"]:
            if server is None:
                server = min(range(len(load)), key=lambda k: (load[k], k))
            load[server] += weight
            held[group] = (server, count + 1)
        elif server is not None:
            load[server] = max(0.0, load[server] - weight)
            held.pop(group) if count <= 1 else held.update({group: (server, count - 1)})
        return state, server


class StrideEvict:
    """Chunks that a request's growing sequence has evicted, by fixed strides behind a sink; a request's state goes when it finishes.

    Chunk j leaves at the first chunk i with which j .. i and the sink no longer fit the window.
    """

    def __init__(self, sink: int, chunk: int, window: int):
        self.sink, self.chunk, self.window = sink, chunk, window

    def start(self) -> dict[str, Any]:
        return {}

    def step(self, state: dict[str, Any], event: dict[str, Any]) -> tuple[dict[str, Any], int]:
        request = str(event["request"])
        if event["finish"]:
            state.pop(request, None)
            return state, 0
        n = state.get(request, 0) + int(event["tokens"])
        frontier = max(0, -(-(n - self.sink) // self.chunk) - 1)
        held = (self.window - self.sink) // self.chunk  # chunks that fit beside the sink
        state[request] = n
        return state, max(0, frontier - held + 1)


def _folded(fold, state, rows: pd.DataFrame, key: str, order: str, value: str) -> tuple[dict[str, Any], pd.DataFrame]:
    rows, out = rows.sort_values(order, ignore_index=True), []
    for event in rows.to_dict("records"):
        state, result = fold.step(state, event)
        out.append(result)
    return state, pd.DataFrame({key: rows[key], order: rows[order], value: pd.Series(out, dtype="object")})


#: Arrow types of the values that folds give.
KINDS = {"long": pa.int64(), "boolean": pa.bool_()}


def batch_fold(events: DataFrame, fold, key: str, order: str, value: str, kind: str) -> DataFrame:
    """(key, order, value) of the fold over each key's events, in order. Spark sorts them; a task holds a batch of events and one key's state, never all events of a key."""
    types = dict(events.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            out = []
            for event in batch.to_pylist():
                if state is None or event[key] != last:
                    state, last = fold.start(), event[key]
                state, result = fold.step(state, event)
                out.append(result)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(order), pa.array(out, KINDS[kind])], [key, order, value])

    return events.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{key} {types[key]}, {order} {types[order]}, {value} {kind}")


def stream_fold(events: DataFrame, fold, key: str, order: str, value: str, kind: str) -> DataFrame:
    """The same of a stream, whose micro-batches bring each key's events in order; the state is kept as JSON."""
    types = dict(events.dtypes)

    def run(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else fold.start()
        state, out = _folded(fold, state, pd.concat(list(batches)), key, order, value)
        held.update((json.dumps(state),))
        yield out

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, {order} {types[order]}, {value} {kind}", "state string", "append", GroupStateTimeout.NoTimeout)
