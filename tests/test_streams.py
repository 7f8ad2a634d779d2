"""Streams that stop and start again: scores exactly once, and a gate's state."""

import math
import random

import pytest
from pyspark.sql import functions as F

from memloom.streaming import gate, scores

RECORDS = "id long, attempt int, error string, correct int"


def first_scores(rows):
    """By hand: batches in order, in a batch the smallest attempt without an error; nothing twice."""
    out = {}
    for batch in rows:
        fresh = {}
        for i, attempt, error, correct in sorted(batch, key=lambda r: (r[1], r[3] if r[3] is not None else -1)):
            if error is None and i is not None and i not in out:
                fresh.setdefault(i, (attempt, correct))
        out |= fresh
    return out


@pytest.fixture
def batches():
    rng = random.Random(5)
    return [[(rng.randint(0, 40), rng.randint(1, 5), None if rng.random() < 0.7 else "timeout", rng.randint(0, 1)) for _ in range(25)] + [(None, 1, None, 1)] for _ in range(6)]


def test_scores_are_stored_once(spark, tmp_path, batches):
    sink = scores.ScoreSink(str(tmp_path / "t"), "a", RECORDS)
    requests = spark.createDataFrame([(k,) for k in range(60)], "id long")
    assert sink.open_ids(requests).count() == 60
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, RECORDS).repartition(3)
        sink(frame, k)
        if k % 2:
            sink(frame, k)  # a batch that comes again
        expected = first_scores(batches[: k + 1])
        found = sink.stored(spark).collect()
        assert len(found) == len(expected) and {r.id: (r.attempt, r.correct) for r in found} == expected
    assert {r.id for r in sink.open_ids(requests).collect()} == set(range(60)) - set(expected)
    other = scores.ScoreSink(str(tmp_path / "t"), "b", RECORDS)
    other(spark.createDataFrame([(k, 9, None, 7) for k in range(60)], RECORDS), 0)
    assert {r.id: (r.attempt, r.correct) for r in other.stored(spark).collect()} == {k: (9, 7) for k in range(60)} | expected


class Stops(Exception):
    pass


def test_a_stream_that_stops_before_its_commit(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, RECORDS).coalesce(1).write.json(str(tmp_path / "in" / f"{k}"))
    sink = scores.ScoreSink(str(tmp_path / "t"), "a", RECORDS)
    fails = [2]

    def write(batch, number):
        sink(batch, number)
        if number in fails:
            fails.remove(number)
            raise Stops("between the rows and the commit")

    def run():
        stream = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
        scores.score_available(stream, write, str(tmp_path / "c")).awaitTermination()

    with pytest.raises(Exception, match="between the rows and the commit"):
        run()
    assert sink.stored(spark).select("batch").distinct().count() <= 3
    run()
    found = sink.stored(spark).collect()
    assert len(found) == len({r.id for r in found}) == len({i for rows in batches for i, _, error, _ in rows if error is None and i is not None})
    sink_rows = {r.id: r.correct for r in found}
    run()  # nothing new
    assert {r.id: r.correct for r in sink.stored(spark).collect()} == sink_rows


# ---- the gate


def by_hand(groups, floor, most_, row_limit):
    """(spread or None, staleness or None, most or None) in order -> (keep, reason)."""
    out, row, window, last = [], 0, 0, None
    for spread, staleness, most in groups:
        if staleness is not None:
            if last is not None and staleness < last:
                window = 0
            last = staleness
        budget = max(int(most if most is not None and most > 0 else most_) - floor, 0)
        if spread is None:
            keep, why = True, "no_metric"
        elif spread > 1e-6:
            keep, why = True, "informative"
        elif row_limit is not None and row >= row_limit:
            keep, why = True, "forced_consec"
        elif window >= budget:
            keep, why = True, "forced_budget"
        else:
            keep, why = False, "dropped"
        row, window = (0, window) if keep else (row + 1, window + 1)
        out.append((keep, why))
    return out


def some_groups():
    rng, rows = random.Random(9), []
    for run in range(5):
        for k in range(60):
            rows.append((run, k, rng.choice([0.0, 0.0, 0.0, 1e-7, 0.5, None]), rng.choice([None, float(rng.randint(0, 9))]), rng.choice([None, 0.0, 4.0])))
    return rows


SCHEMA = "run int, k int, spread double, staleness double, most double"


@pytest.mark.parametrize("row", [2, 4, None])
def test_gate_is_a_plain_loop(spark, row):
    rows = some_groups()
    found = gate.judge(spark.createDataFrame(rows, SCHEMA).repartition(4), gate.Gate(2, 5, row), "run", "k").collect()
    reasons = set()
    for run in range(5):
        got = sorted((r for r in found if r.run == run), key=lambda r: r.k)
        expected = by_hand([r[2:] for r in rows if r[0] == run], 2, 5, row)
        assert [(r.keep, r.reason) for r in got] == expected
        assert [r.kept for r in got] == [sum(k for k, _ in expected[: i + 1]) for i in range(60)] and [r.seen for r in got] == list(range(1, 61))
        assert got[-1].forced == sum(why.startswith("forced") for _, why in expected)
        reasons |= {why for _, why in expected}
    assert reasons >= {"no_metric", "informative", "forced_budget", "dropped"} | ({"forced_consec"} if row else set())


def test_gate_of_a_stream_that_starts_again(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, rule = some_groups(), gate.Gate(2, 5, 4)
    expected = {(r.run, r.k): r[2:] for r in gate.judge(spark.createDataFrame(rows, SCHEMA), rule, "run", "k").collect()}
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == part], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        judged = gate.judge_stream(stream, rule, "run", "k").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        judged.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(found) == len(rows) and {(r.run, r.k): r[2:] for r in found} == expected


def test_rewards_and_their_spread(spark):
    nan, inf = math.nan, math.inf
    cases = [([1.0, 0.0], [5.0, 5.0], None, 0.5), ([1.0, nan], [2.0, 4.0], None, 1.0), ([], [inf, 1.0], [[1.0, 1.0], [4.0]], 1.0), (None, None, None, None), ([None, 1.0], None, [[nan]], None), ([3.0], None, None, 0.0), (None, [], [[], []], 0.0)]
    frame = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, metric array<double>, score array<double>, tokens array<array<double>>")
    found = {r.k: r.s for r in frame.select("k", gate.spread(gate.rewards(F.col("metric"), F.col("score"), F.col("tokens"))).alias("s")).collect()}
    assert found == {k: c[3] for k, c in enumerate(cases)}
