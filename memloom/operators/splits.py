"""Samples, splits and groups by place. Places inside a key are found in two passes: counts of parts of the key's order, then
places inside the parts, so that a key that holds a third of all rows is sorted by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import order_key
from memloom.operators.regroup import range_of, take_by_key


def placed(rows: DataFrame, key: list[str], order: Column, part: Column, name: str = "place") -> DataFrame:
    """The rows with their place from 0 in their key by `order`, and n, the rows of the key; part is a coarser order that never contradicts `order`."""
    marked = rows.withColumns({"_order": order, "_part": part})
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a part
    sizes = marked.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumns({"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(Window.partitionBy(*key))}).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_order")) - 1
    return marked.withColumn("_inside", inside).join(starts, [*key, "_part"]).withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_order", "_part", "_start", "_inside")


def by_hash(rows: DataFrame, key: list[str], seed: object, salt: object, id_: str, name: str = "place") -> DataFrame:
    """Places in a random order that is the same everywhere: that of hashes, then ids; 256 parts a key by the hashes' first digits."""
    digest = order_key(seed, salt, F.col(id_))
    return placed(rows, key, F.struct(digest, F.col(id_)), F.substring(digest, 1, 2), name)


def by_id(rows: DataFrame, key: list[str], id_: str, name: str = "place") -> DataFrame:
    """Places in order of a numeric id, by ranges of ids that hold alike, however far apart the ids are."""
    return placed(rows, key, F.col(id_), range_of(rows, id_), name)


def consecutive(rows: DataFrame, key: list[str], id_: str, size: int, name: str = "part", whole: bool = False) -> DataFrame:
    """The rows with the number of their group of `size` consecutive ones of the key; whole: without the rest that fills no group."""
    found = by_id(rows, key, id_, "_place").withColumn(name, F.expr(f"_place DIV {size}"))
    found = found.where(F.col("_place") < F.col("n") - F.col("n") % size) if whole else found
    return found.drop("_place", "n")


def single_dominant(rows: DataFrame, key: str, id_: str, seed: int, group: int) -> DataFrame:
    """(id, split): a twentieth of each key in packs of `group` (the rest of them dropped), of the others the first half to fine-tuning, the second to reinforcement."""
    k = F.expr("n DIV 20")
    rest = F.col("place") - k
    split = F.when(F.col("place") < k, F.when(F.col("place") < k - k % group, "pack_rl").otherwise("dropped")).when(2 * rest < F.col("n") - k - (F.col("n") - k) % 2, "single_sft").otherwise("single_rl")
    return by_hash(rows.select(id_, key), [key], seed, "split", id_).select(id_, split.alias("split"))


def multi_dominant(rows: DataFrame, key: str, id_: str, seed: int) -> DataFrame:
    """(id, split): a twentieth of each key (one at least) to each of two single splits, the others to packs."""
    c = F.greatest(F.lit(1), F.expr("n DIV 20"))
    split = F.when(F.col("place") < c, "single_sft").when(F.col("place") < 2 * c, "single_rl").otherwise("pack_rl")
    return by_hash(rows.select(id_, key), [key], seed, "multi", id_).select(id_, split.alias("split"))


def mixture(rows: DataFrame, source: str, id_: str, each: int, seed: int) -> DataFrame:
    """(id, source, place): `each` rows of every source, those of the smallest hashes; the shuffled order is that of place. A key's smallest are kept by a bounded heap, not by a sort."""
    digest = order_key(seed, F.col(source), F.col(id_))
    part = F.pmod(F.xxhash64(id_), F.lit(64))  # a hot source's smallest are found in parts first
    nearest = lambda w: F.row_number().over(w.orderBy(digest, id_)) <= each
    few = rows.select(id_, source).withColumn("_part", part).withColumn("_in", nearest(Window.partitionBy(source, "_part"))).where("_in")
    return few.withColumn("_in", nearest(Window.partitionBy(source))).where("_in").select(id_, source, order_key(seed, "mix", F.col(id_)).alias("place"))


def manifest(rows: DataFrame, id_: str, size: int, seed: int) -> DataFrame:
    """One row: the size of a sample and the SHA-1 of its sorted ids."""
    taken = take_by_key(rows.select(id_), size, seed, "manifest", id_)
    return taken.agg(F.count("*").alias("sample_rows"), F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(id_)), lambda x: x.cast("string")), ",")).alias("indices_sha1"))


def sums_before(rows: DataFrame, order: str, n: str, name: str) -> DataFrame:
    """The rows with the sum of n over all rows before them in a numeric order without repeats: sums of ranges, then sums inside them."""
    grouped = rows.withColumn("_group", range_of(rows, order))
    above = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = grouped.groupBy("_group").agg(F.sum(n).alias("_sum")).select("_group", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return grouped.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(F.broadcast(starts), "_group").withColumn(name, F.col("_start") + F.col("_inside")).drop("_group", "_inside", "_start")


def until(batches: DataFrame, order: str, kept: str, target: int) -> DataFrame:
    """The batches in order up to the one with which `target` rows are kept."""
    return sums_before(batches, order, kept, "_before").where(F.col("_before") < target).drop("_before")


def eval_single(rows: DataFrame, dataset: str) -> DataFrame:
    """Rows (row_idx, memory_docs, qa) of a single test split, ids by their order."""
    return by_id(rows.withColumn("_all", F.lit(0)), ["_all"], "row_idx").withColumn("id", F.concat(F.lit(f"{dataset}-test_single-"), F.col("place").cast("string"))).drop("_all", "place", "n")


def eval_exploded(rows: DataFrame, dataset: str) -> DataFrame:
    """A row for each question of rows (row_idx, memory_docs, qa), ids by the questions' order over all rows."""
    each = rows.select("row_idx", "memory_docs", F.posexplode("qa").alias("question_no", "question"))
    before = each.groupBy("row_idx").agg(F.count("*").alias("_n"))
    first = sums_before(before, "row_idx", "_n", "_first").select("row_idx", "_first")
    number = F.col("_first") + F.col("question_no")
    return each.join(first, "row_idx").select(F.concat(F.lit(f"{dataset}-test_single-"), number.cast("string")).alias("id"), "memory_docs", F.array("question").alias("qa"), "row_idx")


def eval_packs(rows: DataFrame, dataset: str) -> DataFrame:
    """Rows that share a memory as one, ids by the order in which memories come first."""
    from memloom.operators.regroup import by_memory

    packs = by_memory(rows).withColumn("_all", F.lit(0))
    return by_id(packs, ["_all"], "row_idx").withColumn("id", F.concat(F.lit(f"{dataset}-test_pack-"), F.col("place").cast("string"))).drop("_all", "place", "n")


def eval_wiki(rows: DataFrame, dataset: str, group: int) -> DataFrame:
    """Whole groups of consecutive rows (row_idx, docs, evidence) as packs, evidence moved to the documents' new places."""
    from memloom.operators.regroup import pack_with_offsets

    grouped = consecutive(rows.withColumn("_all", F.lit(0)), ["_all"], "row_idx", group, "pack", whole=True).drop("_all")
    packs = pack_with_offsets(grouped, "pack", "row_idx")
    return packs.withColumn("id", F.concat(F.lit(f"{dataset}-test_pack-"), F.col("pack").cast("string")))


def cap_first(rows: DataFrame, priority: str, digest: Column, id_: str, cap: int) -> DataFrame:
    """The first `cap` rows, those of a smaller priority first, then in a random order that is the same everywhere."""
    found = placed(rows.withColumn("_all", F.lit(0)), ["_all"], F.struct(priority, digest, id_), F.concat(F.col(priority).cast("string"), F.substring(digest, 1, 2)))
    return found.where(F.col("place") < cap).drop("_all", "place", "n")


def giant(rows: DataFrame, pack: str, bucket: str, digest: Column, id_: str, quotas: dict[int, int]) -> DataFrame:
    """Packs first, then single rows until every quota is met; a bucket with a quota takes no more than that, the others all rows up to there."""
    order = F.struct((~F.col(pack)).alias("late"), digest.alias("digest"), F.col(id_).alias("id"))
    found = placed(rows.withColumn("_at", order), [bucket], F.col("_at"), F.concat(F.when(F.col(pack), "0").otherwise("1"), F.substring(digest, 1, 2))).drop("n")
    quota = F.coalesce(*(F.when(F.col(bucket) == b, F.lit(q)) for b, q in quotas.items()))
    last = found.where(F.col("place") == quota - 1).agg(F.max("_at").alias("_stop"), F.count("*").alias("_met"))
    stop = F.when(F.col("_met") == len(quotas), F.col("_stop"))
    kept = found.crossJoin(F.broadcast(last)).where(F.when(quota.isNotNull(), F.col("place") < quota).otherwise(F.col(pack) | stop.isNull() | (F.col("_at") <= stop)))  # one row of totals
    return kept.drop("_at", "place", "_stop", "_met")
