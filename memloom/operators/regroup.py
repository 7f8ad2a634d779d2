"""Regrouping, packing, splitting and sampling of memory-question rows. Every order is a column; random orders are hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import memory_hash, order_key, regroup_key


def ordered(rows: Column) -> Column:
    """Collected structs in the order of their first field."""
    return F.array_sort(F.collect_list(rows))


def by_memory(rows: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows (row_idx, memory_docs, qa) that share a memory as one, questions in order of row_idx. The documents travel once a group: the shuffle is on their hash."""
    key = key if key is not None else regroup_key(F.col("memory_docs"))
    grouped = rows.withColumn("memory_key", key).groupBy("memory_key").agg(F.min("row_idx").alias("row_idx"), F.min_by("memory_docs", "row_idx").alias("memory_docs"), ordered(F.struct("row_idx", "qa")).alias("x"))
    return grouped.select("memory_key", "row_idx", "memory_docs", F.flatten(F.transform("x", lambda r: r["qa"])).alias("qa"))


def split_packs(rows: DataFrame, most: int) -> DataFrame:
    """Rows (id, qa) in packs of up to `most` questions; ids get #packN where there are several."""
    n = F.size("qa")
    parts = rows.withColumn("n", n).withColumn("start", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(most))).otherwise(F.array().cast("array<int>"))))
    number = (F.col("start") / most).cast("int")
    return parts.select(F.when(F.col("n") > most, F.concat("id", F.lit("#pack"), number.cast("string"))).otherwise(F.col("id")).alias("id"), number.alias("pack"), F.slice("qa", F.col("start") + 1, F.lit(most)).alias("qa"))


def dynamic_packs(rows: DataFrame, most: int) -> DataFrame:
    """Rows (row_idx, id, memory_docs, qa) regrouped by memory, then in packs of up to `most` questions."""
    ids = rows.select("row_idx", "id")
    return split_packs(by_memory(rows, memory_hash(F.col("memory_docs"))).join(ids, "row_idx"), most)


def dynamic_pack_rows(rows: DataFrame, most: int) -> DataFrame:
    """Rows (row_idx, id, source, memory_docs, qa, meta, ...) that share a memory as packs of up to `most` questions: the first row's other columns stay, ids are source-dynpack-number (#packN where there are
    several) by the order in which memories come first, and meta, JSON, tells of the pack and of its part."""
    packs = by_memory(rows, memory_hash(F.col("memory_docs"))).select("row_idx", "qa")
    kept = rows.select("row_idx", *(c for c in rows.columns if c not in ("row_idx", "qa")))
    whole = dense_index(packs.join(kept, "row_idx"), "row_idx").withColumn("id", F.concat("source", F.lit("-dynpack-"), F.col("idx").cast("string"))).drop("idx")
    n = F.size("qa")
    starts = F.when(n > most, F.sequence(F.lit(0), n - 1, F.lit(most))).otherwise(F.array(F.lit(0)))
    parts = whole.withColumn("_start", F.explode(starts)).withColumn("_n", n)
    many = F.col("_n") > most
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    told = F.filter(F.array(entry("dynamic_pack", F.lit(True)), *(F.when(many, entry(k, v)) for k, v in (("eval_pack_cap", F.lit(most)), ("eval_pack_orig_n_qa", F.col("_n")), ("eval_pack_start", F.col("_start"))))), lambda x: x.isNotNull())
    meta = F.to_json(F.map_concat(F.coalesce(F.from_json("meta", "map<string,string>"), F.create_map().cast("map<string,string>")), F.map_from_entries(told)))
    suffix = F.concat(F.lit("#pack"), F.expr(f"_start DIV {most}").cast("string"))
    return parts.withColumns({"id": F.when(many, F.concat("id", suffix)).otherwise(F.col("id")), "qa": F.slice("qa", F.col("_start") + 1, F.lit(most)), "meta": meta}).drop("_start", "_n")


def pack_with_offsets(rows: DataFrame, pack: str, order: str) -> DataFrame:
    """Rows (docs, evidence) of each pack as one memory; evidence points to the documents' new places."""
    before = Window.partitionBy(pack).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    moved = rows.withColumn("offset", F.coalesce(F.sum(F.size("docs")).over(before), F.lit(0)).cast("int"))
    moved = moved.withColumn("evidence", F.transform("evidence", lambda e: e + F.col("offset")))
    one = moved.groupBy(pack).agg(ordered(F.struct(order, "docs", "evidence")).alias("x"))
    return one.select(pack, F.flatten(F.transform("x", lambda r: r["docs"])).alias("docs"), F.flatten(F.transform("x", lambda r: r["evidence"])).alias("evidence"))


#: Rows of a range, and ranges at most.
RANGE_ROWS, RANGES = 1 << 16, 1024


def range_of(rows: DataFrame, order: str, per_range: int | None = None) -> Column:
    """The number of the range that a row's place in a numeric order lies in: ranges end at approximate quantiles, so that they hold alike whatever the values are. A null is in the first."""
    total = rows.count()
    number = min(RANGES, -(-total // (per_range or RANGE_ROWS)))
    if number < 2:
        return F.lit(0)
    ends = rows.agg(F.percentile_approx(order, [k / number for k in range(1, number)], 100 * RANGES)).first()[0]  # RANGES numbers at most
    ends = sorted(set(ends or []))
    return F.coalesce(F.size(F.filter(F.lit(ends), lambda e: e < F.col(order))), F.lit(0)) if ends else F.lit(0)


def dense_index(rows: DataFrame, order: str, name: str = "idx", per_range: int | None = None) -> DataFrame:
    """A gapless index from 0 in order of a numeric column, in two passes: counts of ranges of the order, then places inside them; no window goes over all rows."""
    ranged = rows.withColumn("_range", range_of(rows, order, per_range))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + inside).drop("_range", "_start")


def take_by_key(rows: DataFrame, n: int, seed: object, salt: object, key: str) -> DataFrame:
    """A sample of n rows without replacement: those of the smallest hashes."""
    return rows.orderBy(order_key(seed, salt, F.col(key)), key).limit(n)


def admitted(rows: DataFrame, key: str, order: list[Column], quota: Column) -> DataFrame:
    """The first rows of each key up to its quota; a null quota admits all."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where(quota.isNull() | (F.col("_place") <= quota)).drop("_place")


def stratified(rows: DataFrame, label: str, key: str, size: int, seed: object) -> DataFrame:
    """One row of each label, then others up to `size`, by hash."""
    first = rows.groupBy(label).agg(F.min(F.struct(order_key(seed, "label", F.col(key)).alias("h"), F.col(key))).alias("x")).select(F.col(f"x.{key}").alias(key), F.lit(0).alias("_first"))
    marked = rows.join(first, key, "left").withColumn("_rest", F.coalesce("_first", F.lit(1))).drop("_first")
    return marked.orderBy("_rest", order_key(seed, "fill", F.col(key)), key).limit(size).drop("_rest")


def explode_questions(rows: DataFrame) -> DataFrame:
    """A row for each question of rows (id, qa), with ids id#q0, id#q1 ..."""
    return rows.select("id", F.posexplode("qa").alias("question_no", "q")).select(F.concat("id", F.lit("#q"), F.col("question_no").cast("string")).alias("id"), "question_no", "q")


def without_categories(rows: DataFrame, category: str, dropped: tuple[int, ...]) -> DataFrame:
    """The rows of other categories; a null category is kept."""
    return rows.where(F.col(category).isNull() | ~F.col(category).isin(*dropped))


def turn_pairs(turns: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, question, answer) of turns (role, text): a user's turn and the assistant's right after it, both with text."""
    after = Window.partitionBy(key).orderBy(order)
    seen = turns.select("*", F.lead("role").over(after).alias("next_role"), F.lead("text").over(after).alias("answer"))
    whole = (F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.trim("text") != "") & (F.trim("answer") != "")
    return seen.where(whole).select(key, order, F.col("text").alias("question"), "answer")


def running_count(rows: DataFrame, key: str, order: str, test: Column, name: str) -> DataFrame:
    """The rows with how often the test has held up to each of them."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(test, 1).otherwise(0)).over(upto))
