"""A Parquet sink of rows as they come from adapters: validated, nested values as JSON, one schema for all that is appended."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from memloom.sources.io import exists

#: Rows of a row group.
BATCH = 1000
#: The column that stays an array of texts. Fixed value.
DOCS = "memory_docs"


def serialized(df: DataFrame) -> DataFrame:
    """The documents as an array of texts (null: none), all other nested columns as JSON."""

    def column(f) -> Column:
        c = F.col(f"`{f.name}`")
        if f.name == DOCS:
            return F.coalesce(F.transform(c, lambda x: x.cast("string")), F.array().cast("array<string>")).alias(f.name)
        nested = isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))
        return (F.to_json(c, {"ignoreNullFields": "false"}) if nested else c).alias(f.name)

    return df.select(*map(column, df.schema.fields))


def restored(df: DataFrame, **kinds: str) -> DataFrame:
    """The rows with JSON columns as values of the kinds given."""
    return df.withColumns({c: F.from_json(c, kind, {"mode": "FAILFAST"}) for c, kind in kinds.items()})


def first_violation(df: DataFrame, rule: Column, order: str) -> tuple[int, str] | None:
    """The number, from 1, of the first row by `order` that breaks the rule (a column that is null or the complaint), and the complaint. Two sums over the rows, nothing is gathered."""
    marked = df.select(F.col(order).alias("at"), rule.alias("what"))
    first = marked.where("what is not null").agg(F.min(F.struct("at", "what")).alias("x")).first().x
    if first is None:
        return None
    return marked.where(F.col("at") < F.lit(first["at"])).count() + 1, first["what"]


def as_stored(df: DataFrame, schema: StructType) -> DataFrame:
    """The rows in the columns and types that are stored; what lacks is null, a column that isn't stored is an error."""
    if extra := [c for c in df.columns if c not in schema.names]:
        raise ValueError(f"not in the stored rows: {', '.join(extra)}")
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def write_rows(df: DataFrame, path: str, rule: Column | None = None, order: str | None = None) -> int:
    """Appends the rows and returns how many, counted as they are written. The first batch decides on the schema, later ones are cast to it. Nothing is written if a row breaks the rule.
    Where there are no rows at all, the folder gets a table of one text column, id."""
    spark = df.sparkSession
    if rule is not None and (found := first_violation(df, rule, order)):
        raise ValueError(f"row {found[0]}: {found[1]}")
    out, there = serialized(df), exists(spark, path)
    if there:
        stored = spark.read.parquet(path)
        if stored.columns == ["id"] and stored.isEmpty():
            there = False
        else:
            out = as_stored(out, stored.schema)
    seen = Observation()
    rows = out.observe(seen, F.count(F.lit(1)).alias("n"))
    if not there and df.isEmpty():
        spark.createDataFrame([], "id string").repartition(1).write.mode("overwrite").parquet(path)
        return 0
    rows.write.mode("append" if there else "overwrite").option("parquet.block.row.count.limit", BATCH).parquet(path)
    return seen.get["n"]


def read_rows(spark: SparkSession, path: str, **kinds: str) -> DataFrame:
    """The rows of write_rows(), JSON columns as values of the kinds given."""
    return restored(spark.read.parquet(path), **kinds)


def write_splits(df: DataFrame, path: str, validation: Column, **counts: Column) -> dict[str, int]:
    """All rows under part=train and those that are validation under part=val too, and the observed counts as JSON under stats: one pass over the rows."""
    spark, seen = df.sparkSession, Observation()
    marked = df.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(validation).alias("validation"), *(c.alias(k) for k, c in counts.items()))
    part = F.explode(F.when(validation, F.array(F.lit("train"), F.lit("val"))).otherwise(F.array(F.lit("train"))))
    marked.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    found = seen.get
    spark.createDataFrame([(json.dumps(found, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/stats")
    return found


#: Rows of a report, and columns.
MOST = 10_000


def markdown(cells: DataFrame, row: str, column: str, title: str) -> DataFrame:
    """(line_no, line) of a Markdown table of cells (row, column, cell): rows and columns in order, `-` where there is no cell. A report has MOST rows and columns at most; more are an error."""
    names = [r[0] for r in cells.select(column).distinct().orderBy(column).limit(MOST + 1).collect()]
    rows = cells.select(row).distinct().limit(MOST + 1).count()
    if max(len(names), rows) > MOST:
        raise ValueError(f"a report of more than {MOST} rows or columns")
    by = cells.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(column, "cell"))).alias("by"))
    line = F.concat(F.lit("| "), F.col(row), *(F.concat(F.lit(" | "), F.coalesce(F.try_element_at("by", F.lit(n)), F.lit("-"))) for n in names), F.lit(" |"))
    body = by.select((F.row_number().over(Window.orderBy(row)) + 3).alias("line_no"), line.alias("line"))  # MOST rows at most
    head = [(1, f"# {title}"), (2, "| " + " | ".join([row, *names]) + " |"), (3, "|---|" + "---|" * len(names))]
    return cells.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines (line_no, line) as one text file."""
    lines.repartition(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)
