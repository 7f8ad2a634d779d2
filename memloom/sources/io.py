"""Readers and sinks. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import strip


def json_lines(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """JSON lines without blank ones; a missing path is empty, if allowed."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def shards(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Parquet shards with the file and the row's place in it as order."""
    return spark.read.schema(schema).parquet(pattern).select("*", F.col("_metadata.file_path").alias("shard"), F.col("_metadata.row_index").alias("shard_row"))


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """All texts of a folder in order of their names, joined by blank lines."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "value"))), lambda x: strip(x["value"])), "\n\n").alias("text"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share; a local master without that setting gets a temporary one."""
    import tempfile
    import uuid

    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top and context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(top or tempfile.mkdtemp(prefix='memloom-')).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rows that lie in fewer parts than there are cores, dealt over all of them; larger tables, which have more parts than cores, stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, what: str) -> DataFrame:
    """The frame as Parquet in the shared folder, read again: cuts the lineage."""
    df.write.parquet(path := shared_folder(df.sparkSession, what))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json(df: DataFrame, path: str) -> int:
    """Writes JSON lines and returns how many, counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.json(path)
    return seen.get["n"]


def write_valid(df: DataFrame, path: str, rule) -> int:
    """Writes Parquet; a row that breaks the rule (a column that is null or the complaint) fails the job."""
    from pyspark.sql import Observation

    seen = Observation()
    checked = df.withColumn("_ok", F.when(rule.isNotNull(), F.raise_error(rule).cast("boolean")).otherwise(True)).where("_ok").drop("_ok")
    checked.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def class_names(spark: SparkSession, path: str, feature: str) -> DataFrame:
    """(label, label_text) from the metadata in a Parquet footer, read on the driver."""
    import json

    import pyarrow.parquet as pq

    meta = json.loads(pq.read_schema(path).metadata[b"huggingface"])
    names = meta["info"]["features"][feature]["names"]
    return spark.createDataFrame(list(enumerate(names)), "label int, label_text string")


def complaint() -> Column:
    """What is wrong with a memory-question row; null if nothing."""
    from memloom.schemas import TASKS

    bad_item = F.exists("qa", lambda q: q["question"].isNull() | (F.coalesce(F.size(q["answer"]), F.lit(0)) < 1))
    return (
        F.when(F.col("id").isNull(), "id")
        .when(F.coalesce("source", F.lit("")) == "", "source")
        .when(F.col("task_type").isNull() | ~F.col("task_type").isin(*TASKS), "task_type")
        .when(F.col("memory_docs").isNull() | F.exists("memory_docs", lambda d: d.isNull()), "memory_docs")
        .when(F.coalesce(F.size("qa"), F.lit(0)) < 1, "qa")
        .when(bad_item, "qa item")
    )


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Tokenized samples (input_ids, is_evicted, labels) from JSON lines; a line without one of the fields fails the job."""
    fields = ("input_ids", "is_evicted", "labels")
    rows = json_lines(spark, path, ", ".join(f"{f} array<int>" for f in fields))
    missing = F.coalesce(*(F.when(F.col(f).isNull(), F.lit(f"no {f}")) for f in fields))
    return rows.where(F.when(missing.isNotNull(), F.raise_error(missing).cast("boolean")).otherwise(True))
