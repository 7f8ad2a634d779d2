"""Operator 13: exact duplicates by deterministic block naming, in DataFrame functions alone.

A text's bytes are cut into blocks of BLOCK bytes, the last one shorter; an empty text is one empty block. Blocks are scattered over buckets, the blocks of a
bucket are sorted by their bytes, and a block's name is its bucket and its rank there: an integer that equal blocks share and no others. Then adjacent pairs of names
are named alike (a last one without a neighbour is a pair with NOTHING), and so on, until a document has one name: documents are
equal exactly if they have that name on the same level. No hash decides anything, it only deals out; what is told apart is told apart by bytes and integers.
A document that holds a name which occurs once in all is like no other and leaves at that level.

Blocks and pairs that hold more than 1/SHARE of all rows are fewer than SHARE; they are counted before the shuffle, and their names are broadcast
(SHARE blocks of BLOCK bytes at most), so that copies of one text never meet in a task. The same holds for groups of equal documents in the end.

Null counts as empty, and all empty texts are equal. Of rows that share a text and the largest id (ties, repeated rows) one stays; rows without an id stay only
where all of their group have none, and then one of them does, with a null keep_id. A very long text is read as one value and dealt out in blocks. An empty table
gives no rows. Further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm.base import table, written

#: Bytes of a block, and of the blocks that a bucket holds on average.
BLOCK, BUCKET_BYTES = 2048, 8 << 20
#: Names that a bucket of a higher level holds on average.
BUCKET_NAMES = 1 << 17
#: What holds over 1/SHARE of all rows is hot; it is less than SHARE keys.
SHARE = 1000
NOTHING = -1


def _ranked(rank: Column) -> Column:
    """The integer name of a rank in its bucket."""
    return F.shiftleft(F.col("bucket").cast("long"), 32) + rank


def blocks(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """(row, pos, blocks, block) of documents (doc_id, text), a row for each block; the first one of a row also has its doc_id and the text's SHA-256."""
    whole = df.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    parts = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / size)).cast("int")
    each = whole.select(F.monotonically_increasing_id().alias("row"), "doc_id", "data", parts.alias("blocks"), F.unhex(F.sha2("data", 256)).alias("digest"))
    each = each.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    return each.select("row", "pos", "blocks", first("doc_id"), first("digest"), F.substring("data", F.col("pos") * size + 1, F.lit(size)).alias("block"))


def named_blocks(df: DataFrame, size: int = BLOCK, share: int = SHARE) -> DataFrame:
    """The blocks of documents with their names and how many blocks have each."""
    found = blocks(df, size)
    counts = written(found.groupBy(F.xxhash64("block").alias("deal")).agg(F.count("*").alias("held")), "deals")
    total = counts.agg(F.sum("held")).first()[0] or 0
    buckets = max(1, -(-total * size // BUCKET_BYTES))
    busy = F.broadcast(counts.where(F.col("held") * share > total).select("deal"))  # fewer than SHARE rows
    often = found.select("block", F.xxhash64("block").alias("deal")).join(busy, "deal", "left_semi").groupBy("block").agg(F.count("*").alias("held")).where(F.col("held") * share > total)
    often = often.select("block", F.col("held").alias("peers"), (F.shiftleft(F.lit(buckets).cast("long"), 32) + F.row_number().over(Window.orderBy("block"))).alias("name"))  # fewer than SHARE rows
    often = F.broadcast(written(often, "often"))
    hot = found.join(often, "block").drop("block")
    bucket = F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int")
    order = Window.partitionBy("bucket").orderBy("block")
    cold = found.join(often, "block", "left_anti").withColumn("bucket", bucket)
    cold = cold.withColumns({"name": _ranked(F.dense_rank().over(order)), "peers": F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))}).drop("block", "bucket")
    return hot.select(cold.columns).unionByName(cold)


def met(rows: DataFrame, facts: DataFrame, keys: list[str], held: str, total: int, share: int = SHARE) -> DataFrame:
    """The rows joined with the one fact of their keys; facts of keys that hold more than 1/SHARE of the rows are broadcast."""
    many = F.col(held) * share > total
    often = F.broadcast(facts.where(many))  # fewer than SHARE rows
    return rows.join(often, keys).unionByName(rows.join(often.select(keys), keys, "left_anti").join(facts.where(~many), keys))


def named_pairs(names: DataFrame, share: int = SHARE) -> DataFrame:
    """Names (row, pos, blocks, name) of one level to those of the next: adjacent pairs of a row, sorted into integers."""
    side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
    pairs = names.groupBy("row", F.expr("pos DIV 2").alias("pos")).agg(F.expr("(max(blocks) + 1) DIV 2").alias("blocks"), side(0).alias("left"), F.coalesce(side(1), F.lit(NOTHING)).alias("right"))
    pairs = written(pairs, "pairs")
    total = pairs.count()
    bucket = F.pmod(F.xxhash64("left", "right"), F.lit(max(1, -(-total // BUCKET_NAMES)))).cast("int")
    distinct = pairs.groupBy("left", "right").agg(F.count("*").alias("peers")).withColumn("bucket", bucket)
    ranked = distinct.withColumn("name", _ranked(F.row_number().over(Window.partitionBy("bucket").orderBy("left", "right")))).drop("bucket")
    return met(pairs, written(ranked, "ranks"), ["left", "right"], "peers", total, share).drop("left", "right")


def identities(named: DataFrame, share: int = SHARE) -> DataFrame:
    """(row, level, name) of the documents that are not told apart by a block or a pair of their own: equal documents and no others share level and name."""

    def shared(level: DataFrame) -> DataFrame:
        return level.join(level.where("peers = 1").select("row").distinct(), "row", "left_anti").select("row", "pos", "blocks", "name")

    live, found, k = written(shared(named), "names"), None, 0
    while True:
        done = live.where("blocks = 1").select("row", F.lit(k).alias("level"), "name")
        found, rest = done if found is None else found.unionByName(done), live.where("blocks > 1")
        if rest.isEmpty():
            return found
        k += 1
        live = written(shared(written(named_pairs(rest, share), "level")), "names")


def duplicates(df: DataFrame, size: int = BLOCK, share: int = SHARE) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of documents (doc_id, text), which may have further columns: a row for each row."""
    named = written(named_blocks(df, size, share), "blocks")
    rows = named.where("pos = 0").select("row", "doc_id", F.lower(F.hex("digest")).alias("text_sha256"))
    found = rows.join(identities(named, share), "row", "left")
    found = written(found, "rows")
    same = found.where("level is not null")
    groups = same.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size"))
    groups = written(groups, "groups")
    together = met(same, groups, ["level", "name"], "group_size", same.count(), share)
    alone = found.where("level is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return together.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256").unionByName(alone)


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


#: The query's rows by SQL alone.
OP13_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
