"""Operator 12: hard negatives by norm-bucketed inner-product search.

Candidates are sorted by label and norm and dealt into parts of about PART_BYTES; inside a part, buckets of STEP rows follow each other by falling norm. A search
asks, for each of an anchor's windows [lo, hi] of scores, for the k candidates of highest score in it. By Cauchy-Schwarz no score exceeds the product of both norms: once a bucket's
largest norm times the anchor's can't reach the window's lower limit, nor the k-th score found so far, neither can the buckets after it. The same bound prunes whole parts before
anything is shuffled: the parts of largest norm are searched first, and of the others only those go to a block of anchors that one of its anchors still needs.

Positives are a search among rows of the anchor's label with an open window; each positive's score gives a window for the search among all other labels.
Anchors are dealt in blocks of about PART_BYTES, and a task is one block against one part: neither grows with the table, a hot label is more parts, and what a
task sends on is k rows an anchor and window at most. Anchors against all rows in blocks is the work that the operator is asked for; it grows with the product of both.

Scores are exact integers: in doubles while the norms' product is below 2^53, in Python's integers beyond; they saturate at the bounds of a long, as components do. A shorter vector counts as
ending in zeros, an empty one scores 0. Rows without an id take no part, as nothing could name them; nor do those with a null label or vector or a component that is null or not finite.
Of equal scores (ties) the smaller id comes first; rows of one id are no other rows to each other, but repeated candidates count each, and repeated
anchors give repeated rows. An empty table gives no rows. Further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm.base import release, table, written

POSITIVES, NEGATIVES = 5, 3
#: Bytes of components in a part of the candidates and in a block of anchors, on average.
PART_BYTES = 4 << 20
#: Parts at least, where the rows are enough for so many of LEAST_ROWS.
PARTS, LEAST_ROWS = 64, 128
#: Rows of a bucket, and anchors that meet it at once.
STEP = 512
#: The largest integer below which doubles hold all, and the bounds of a long.
EXACT, MOST = float(1 << 53), (1 << 63) - 1
#: Norms are rounded; a product that is this much larger is a bound all the same.
ROOM = 1 + 1e-9
_FOUND = "anchor long, w int, score long, id long"


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of vectors, filled up with zeros to `width` components."""
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width))
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
    return out


def scores(a: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of all rows of a with all of c."""
    if exact:
        return (a @ c.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(c).T, -MOST, MOST).astype(np.int64)


class Best:
    """The k best (score, id) of each anchor and window, and the k-th score where there are k."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.k, self.kth = k, np.full((anchors, windows), -MOST)
        self.at, self.w, self.score, self.id = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, at: np.ndarray, w: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        at, w, score, id_ = (np.concatenate(x) for x in ((self.at, at), (self.w, w), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, w, at))
        at, w, score, id_ = at[order], w[order], score[order], id_[order]
        head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (w[1:] != w[:-1])))
        place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
        keep, last = place < self.k, place == self.k - 1
        self.kth[at[last], w[last]] = np.maximum(self.kth[at[last], w[last]], score[last])
        self.at, self.w, self.score, self.id = at[keep], w[keep], score[keep], id_[keep]


def _windows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi and the k-th score known of each anchor's windows; rows with fewer windows are filled up with empty ones."""
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy()
    there = np.arange(max(1, size.max(initial=1))) < size[:, None]
    out = []
    for name, empty in (("lo", MOST), ("hi", -MOST), ("kth", MOST)):
        x = np.full(there.shape, empty)
        x[there] = lists.flatten().field(name).to_numpy()
        out.append(x)
    return tuple(out)


def nearest(left: pa.Table, right: pa.Table, k: int, same: bool) -> pa.Table:
    """(anchor, w, score, id): the k best candidates (vec_id, label, norm, vector) in each window of the anchors, among those of the anchor's label or (not same) of others."""
    width = max(x["vector"].combine_chunks().value_lengths().to_numpy().max(initial=0) for x in (left, right))
    order = np.lexsort((right["vec_id"].to_numpy(), -right["norm"].to_numpy()))
    c_id, c_label, c_norm, c = (x[order] for x in (right["vec_id"].to_numpy(), right["label"].to_numpy(), right["norm"].to_numpy(), matrix(right["vector"], width)))
    anchor, a_id, a_label, a_norm, a = (*(left[x].to_numpy() for x in ("anchor", "vec_id", "label", "norm")), matrix(left["vector"], width))
    lo, hi, kth = _windows(left["windows"])
    exact = a_norm.max(initial=0) * c_norm.max(initial=0) < EXACT
    out = []
    for s in range(0, len(a), STEP):
        part = slice(s, s + STEP)
        low, high, norm, label, id_ = lo[part], hi[part], a_norm[part], a_label[part], a_id[part]
        best = Best(len(norm), lo.shape[1], k)
        for b in range(0, len(c), STEP):
            floor = np.maximum(np.maximum(low, kth[part]), best.kth)
            live = np.flatnonzero(((low <= high) & (floor <= (norm * c_norm[b] * ROOM + 1)[:, None])).any(1))
            if not len(live):
                break  # the buckets after this one have no larger norms
            bucket = slice(b, b + STEP)
            score = scores(a[part][live], c[bucket], exact)
            fits = (label[live][:, None] == c_label[bucket]) == same
            if same:
                fits &= id_[live][:, None] != c_id[bucket]
            for w in range(lo.shape[1]):
                r, col = np.nonzero(fits & (score >= floor[live, w][:, None]) & (score <= high[live, w][:, None]))
                if len(r):
                    best.add(live[r], np.full(len(r), w), score[r, col], c_id[bucket][col])
        out.append(pa.table({"anchor": anchor[part][best.at], "w": best.w.astype(np.int32), "score": best.score, "id": best.id}))
    return pa.concat_tables(out)


def first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window, with their place from 0."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k)


class Candidates:
    """Rows (vec_id, label, vector) in parts by label and norm, and the largest norm that a part has of each label."""

    def __init__(self, rows: DataFrame):
        known = rows.select("vec_id", "label", "vector", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
        n, components = known.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
        self.parts = max(1, -(-8 * components // PART_BYTES), min(PARTS, n // LEAST_ROWS))
        dealt = known.repartitionByRange(self.parts, "label", F.desc("norm"), F.xxhash64("vec_id"))
        self.rows = written(dealt.withColumn("part", F.spark_partition_id()), "candidates")
        self.tops = written(self.rows.groupBy("part", "label").agg(F.max("norm").alias("top")), "tops")

    def anchors(self, which: Column) -> tuple[DataFrame, int]:
        """(anchor, block, vec_id, label, norm, vector, copies) of the rows that are anchors, in blocks; the number of blocks. Repeated anchors are one, with its copies."""
        chosen = self.rows.where(which).groupBy("vec_id", "label", "vector").agg(F.max("norm").alias("norm"), F.count("*").alias("copies"))
        components = self.rows.where(which).agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
        blocks = max(1, -(-8 * components // PART_BYTES))
        dealt = chosen.repartitionByRange(blocks, "label", "norm", "vec_id")
        dealt = written(dealt.withColumns({"block": F.spark_partition_id(), "anchor": F.monotonically_increasing_id()}), "anchors")
        last = dealt.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]  # Spark may have dealt to more or fewer
        return dealt.withColumn("block", F.expr(f"CAST(block * {blocks}L DIV {last + 1} AS INT)")), blocks

    def search(self, anchors: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
        """(anchor, w, score, id, place) of anchors that have windows (lo, hi)."""
        leads = self.tops.groupBy("label").agg(F.max_by("part", F.struct("top", "part")).alias("part"), F.max("top").alias("top"))
        if same:
            cells = anchors.select("block", "label").distinct().join(leads, "label").select("block", "part").distinct()
        else:  # the largest norms of two labels, so that every anchor meets another one
            large = [r.part for r in leads.orderBy(F.desc("top"), "label").limit(2).collect()]
            cells = anchors.select("block", F.explode(F.array(*map(F.lit, large)).cast("array<int>")).alias("part")).distinct()
        cells = written(cells, "cells")
        seeds = written(first(self._cells(cells, anchors.withColumn("windows", F.transform("windows", lambda x: x.withField("kth", F.lit(-MOST)))), k, same), k), "seeds")
        kth = seeds.where(F.col("place") == k - 1).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("found"))  # a row for each window of the anchor
        known = lambda x, w: x.withField("kth", F.coalesce(F.try_element_at("found", w), F.lit(-MOST)))
        anchors = written(anchors.join(kth, "anchor", "left").withColumn("windows", F.transform("windows", known)).drop("found"), "windows")
        floor = F.array_min(F.transform("windows", lambda x: F.greatest(x["lo"], x["kth"]))).cast("double")
        reach = F.when(floor <= 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(floor, F.col("norm")), F.lit(float("inf"))))
        if same:
            needs = anchors.groupBy("block", "label").agg(F.min(reach).alias("reach")).join(self.tops, "label")
        else:
            every = self.tops.groupBy("part").agg(F.max("top").alias("top")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            needs = anchors.groupBy("block").agg(F.min(reach).alias("reach")).join(every, "block")
        rest = needs.where(F.col("top") * ROOM + 1e-6 >= F.col("reach")).select("block", "part").distinct().join(cells, ["block", "part"], "left_anti")
        return first(seeds.drop("place").unionByName(self._cells(written(rest, "cells"), anchors, k, same)), k)

    def _cells(self, cells: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best of each anchor and window in each cell, a block of anchors against a part of the candidates."""

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            release()
            return nearest(left, right, k, same)

        keys = [F.col(c).alias(c) for c in ("block", "part")]  # new columns, as both sides come from one frame
        left = cells.join(anchors.select("block", "anchor", "vec_id", "label", "norm", "vector", "windows"), "block").select(*keys, "anchor", "vec_id", "label", "norm", "vector", "windows")
        right = cells.join(self.rows, "part").select(*keys, "vec_id", "label", "norm", "vector")
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, _FOUND)


def mine(rows: DataFrame, which: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores of rows (vec_id, label, vector of whole numbers in doubles): for each anchor (rows where `which`) and each of its best
    positives the best negatives whose score is 50 to 95 hundredths of the positive's."""
    candidates = Candidates(rows)
    anchors, blocks = candidates.anchors(which)
    open_ = F.array(F.struct(F.lit(-MOST).alias("lo"), F.lit(MOST).alias("hi")))
    near = written(candidates.search(anchors.withColumn("windows", open_), blocks, positives, True).select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 50 p <= 100 s <= 95 p in whole numbers, without products that a long can't hold; no s fits a negative p.
    p = F.col("positive_score")
    window = F.struct(F.expr("positive_score DIV 2 + positive_score % 2").alias("lo"), (p - F.expr("positive_score DIV 20") - (p % 20 > 0).cast("int")).alias("hi"))
    usable = near.where(p >= 0).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", window.alias("window")))).alias("w"))  # up to `positives` rows
    asked = written(anchors.join(usable.select("anchor", F.transform("w", lambda x: x["window"]).alias("windows")), "anchor"), "asked")
    found = candidates.search(asked, blocks, negatives, False)
    # Positives of a negative score come after all others, so that a window's number is its positive's place.
    named = found.join(near.withColumnRenamed("place", "w"), ["anchor", "w"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id"), "copies"), "anchor")
    each = named.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def whole_rows(df: DataFrame) -> DataFrame:
    """Rows (vec_id, label, vector) of a table (vec_id, label, embedding): components are floor(256 x), rows that lack something are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    return df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite).select("vec_id", "label", vector.alias("vector"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_rows(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 50 == 0)


#: The query's rows by SQL alone.
OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 a AS (SELECT row_number() OVER () AS anchor, vec_id AS anchor_id, label, c FROM v WHERE vec_id % 50 = 0),
 s AS (SELECT a.anchor, a.anchor_id, v.vec_id, v.label = a.label AS same, CAST(list_sum(list_transform(list_zip(a.c, v.c), lambda x: CAST(coalesce(x[1], 0) AS HUGEINT) * coalesce(x[2], 0))) AS BIGINT) AS score FROM a JOIN v ON v.vec_id <> a.anchor_id OR v.label <> a.label),
 p AS (SELECT anchor, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
 n AS (SELECT s.anchor, s.anchor_id, positive_id, positive_score, place, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY s.anchor, place ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT same WHERE place <= 5 AND 50 * CAST(positive_score AS HUGEINT) <= 100 * CAST(score AS HUGEINT) AND 100 * CAST(score AS HUGEINT) <= 95 * CAST(positive_score AS HUGEINT))
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
