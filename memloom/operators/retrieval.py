"""Lexical and vector retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import bm25_tokens, let
from memloom.sources.io import written

K1, B = 1.5, 0.75


def postings(units: DataFrame, terms: DataFrame | None = None, every: bool = False) -> DataFrame:
    """(term, unit_id, tf, size) of units (unit_id, text), for some terms (term) or all: others go before anything is grouped. every: an empty term of each unit too, so that its size is there."""
    tokens = units.select("unit_id", bm25_tokens(F.col("text")).alias("tokens"))
    each = tokens.select("unit_id", F.size("tokens").alias("size"), F.explode(F.concat("tokens", F.array(F.lit(""))) if every else "tokens").alias("term"))
    each = each.join(terms, "term", "left_semi") if terms is not None else each
    return each.groupBy("term", "unit_id").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


#: Bytes of queries up to which their terms are broadcast, and bytes of units' texts that a task takes on average.
QUERY_BYTES, UNIT_BYTES = 32 << 20, 16 << 20


def bm25(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best units (unit_id, text) of each query (query_id, text), ties by unit_id; units that share no term follow with score 0 if fewer than k share one.

    Texts are split once: postings of the queries' terms and each unit's size are written, all else follows from them. Terms of the queries alone are joined with the postings, and lists of equal terms
    never meet each other: rows grow with matches. Units are dealt by their ids, texts before they are split and postings before they meet queries, so that a unit's matches are summed where they arise and a task passes on k
    units a query: what is shuffled grows with the texts, not with units times queries.
    """
    parts = max(units.sparkSession.sparkContext.defaultParallelism, -(-(units.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // UNIT_BYTES))
    small = (queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= QUERY_BYTES
    held = lambda df: F.broadcast(df) if small else df
    wanted = queries.select("query_id", F.explode(F.array_distinct(bm25_tokens(F.col("text")))).alias("term"))
    terms = wanted.select("term").union(units.sparkSession.createDataFrame([("",)], "term string")).distinct()
    known = written(postings(units.repartition(parts, "unit_id"), held(terms), every=True), "postings")
    sizes, found = known.where("term = ''").select("unit_id", "size"), known.where("term <> ''")
    totals = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    weight = found.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals)).select("term", "n", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row of totals
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    together = found.repartition(parts, "unit_id")
    scored = together.join(held(weight), "term").select("term", "unit_id", part.alias("part")).join(held(wanted), "term").groupBy("query_id", "unit_id").agg(F.sum("part").alias("score"))
    # Spark takes the k best of each task before it shuffles, as the rank alone is asked for.
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "unit_id"))).where(F.col("rank") <= k)
    # Queries short of k take the first units that they share no term with; 2k candidates suffice, k of them at most are taken.
    short = queries.select("query_id").join(best.groupBy("query_id").agg(F.count("*").alias("have"), F.collect_set("unit_id").alias("taken")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < k)
    spare = sizes.select("unit_id").orderBy("unit_id").limit(2 * k).agg(F.array_sort(F.collect_list("unit_id")).alias("spare"))
    fill = short.crossJoin(F.broadcast(spare)).select("query_id", F.coalesce("have", F.lit(0)).alias("have"), F.posexplode(F.filter("spare", lambda u: ~F.array_contains(F.coalesce("taken", F.array().cast("array<bigint>")), u))).alias("place", "unit_id"))
    fill = fill.select("query_id", "unit_id", F.lit(0.0).alias("score"), (F.col("have") + F.col("place") + 1).alias("rank")).where(F.col("rank") <= k)
    return best.unionByName(fill).select("query_id", "unit_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def shared_words(rows: DataFrame, items: DataFrame, keys: list[str], item_keys: list[str], small: bool, on: tuple[str, ...] = (), whole: str | None = None, told: tuple[Column, ...] = ()) -> DataFrame:
    """(keys, item_keys, size, item_size, same) of rows (keys, on, size, words) and items (item_keys, on, item_size, words) that are alike in `on` and share a word; same is the size of their words' intersection as multisets.

    An empty word counts as none, but rows and items that both hold it meet, whatever else they share. Words are counted once a row and once an item. Where rows are dealt by some of the keys, none of this shuffles them.
    whole: a text of the row that goes with its empty word alone; told: aggregates over the words that a row and an item share. small: items' words are broadcast.
    """
    held = lambda df: F.broadcast(df) if small else df

    def words(df: DataFrame, size: str, keys: list[str]) -> DataFrame:
        each = F.transform("words", lambda w: F.struct(w.alias("word"), *([F.when(w == "", F.col(whole)).alias(whole)] if whole in df.columns else [])))
        return df.select(*keys, *on, size, F.explode(each).alias("_w")).select(*keys, *on, size, "_w.*")

    def counted(each: DataFrame, size: str, keys: list[str], n: str) -> DataFrame:
        return each.groupBy(*keys, *on, "word").agg(F.count("*").alias(n), F.first(size).alias(size), *([F.first(whole).alias(whole)] if whole in each.columns else []))

    known = counted(words(items, "item_size", item_keys), "item_size", item_keys, "_m")
    wanted = words(rows, "size", keys).join(held(known.select(*on, "word").distinct()), [*on, "word"], "left_semi")
    met = counted(wanted, "size", keys, "_n").join(held(known), [*on, "word"])
    same = F.when(F.col("word") == "", F.lit(0)).otherwise(F.least("_n", "_m"))
    return met.groupBy(*keys, *item_keys).agg(F.first("size").alias("size"), F.first("item_size").alias("item_size"), F.sum(same).alias("same"), *told)


#: Vectors of a block, and queries of a block.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 2048


def _blocks(vectors: DataFrame, key: str, size: int, names: tuple[str, str, str]) -> DataFrame:
    """Blocks of about `size` vectors (key, embedding) as packed ids and unit vectors; vectors are dealt by the hash of their ids."""
    number = max(1, -(-vectors.count() // size))

    def pack(rows: pa.Table) -> pa.Table:
        lists = rows["embedding"].combine_chunks()
        matrix = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
        matrix /= np.maximum(np.sqrt((matrix * matrix).sum(1, keepdims=True)), 1e-12)
        return pa.table({names[0]: pa.array([int(matrix.shape[1])], pa.int32()), names[1]: pa.array([rows[key].to_numpy().astype(np.int64).tobytes()], pa.binary()), names[2]: pa.array([matrix.tobytes()], pa.binary())})

    dealt = vectors.where("embedding is not null").select(key, "embedding", F.pmod(F.xxhash64(key), F.lit(number)).alias("_block"))
    return dealt.groupBy("_block").applyInArrow(pack, f"{names[0]} int, {names[1]} binary, {names[2]} binary")


def cosine(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors (vec_id, embedding) of each query (query_id, embedding), ties by vec_id; a vector isn't its own neighbour. Norms under 1e-12 count as that.

    Every query meets every vector, in blocks: a block of queries and one of vectors are a matrix product, of which k rows a query leave the
    task. So what is shuffled are k rows for each query and block of vectors, not the scores.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, ids, matrix, _, query_ids, query_matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, asked = np.frombuffer(ids, np.int64), np.frombuffer(query_ids, np.int64)
                scores = np.round(np.frombuffer(query_matrix).reshape(len(asked), width) @ np.frombuffer(matrix).reshape(len(ids), width).T, 6)
                scores[asked[:, None] == ids] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                found = np.take_along_axis(scores, order, 1)
                keep = found > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(asked[:, None], keep.shape)[keep]), pa.array(ids[order][keep]), pa.array(found[keep])], ["query_id", "vec_id", "score"])

    held = _blocks(vectors, "vec_id", VECTOR_BLOCK, ("width", "ids", "matrix"))
    asked = _blocks(queries, "query_id", QUERY_BLOCK, ("query_width", "query_ids", "query_matrix"))
    few = held.crossJoin(asked).mapInArrow(best, "query_id long, vec_id long, score double")  # blocks with blocks: a stated set of queries against all rows
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return few.withColumn("rank", rank).where(F.col("rank") <= k)


def containing(docs: DataFrame, items: DataFrame, anchor: int = 3) -> DataFrame:
    """(doc_id, item_id) of documents (doc_id, text) that hold an item's text (item_id, text) as it is.

    Words between single spaces inside an item stand alike in a text that holds it: a run of `anchor` of them, the item's second
    word and those after it, is what texts are joined by, and contains() decides. Items of fewer words are compared with all texts.
    """
    words = items.select("item_id", F.col("text").alias("item"), F.split("text", " ").alias("w"))
    long = words.where(F.size("w") >= anchor + 2).select("item_id", "item", "w")
    runs = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - anchor + 1, F.lit(0))), lambda _, i: F.xxhash64(*(F.get(w, i + k) for k in range(anchor))))
    long = long.withColumn("key", F.xxhash64(*(F.get("w", F.lit(k + 1)) for k in range(anchor)))).drop("w")
    keys = let(F.split("text", " "), lambda w: F.array_distinct(runs(w)))
    near = docs.select("doc_id", F.explode(keys).alias("key")).join(long, "key").select("doc_id", "item_id", "item").distinct()
    found = near.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    short = words.where(F.size("w") < anchor + 2)
    return found.unionByName(docs.select("doc_id", "text").join(short, F.contains("text", F.col("item"))).select("doc_id", "item_id")).distinct()
