"""Scans and sinks. Schemas are given, never inferred, and ids stay strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""'}


def read_csv(
    spark: SparkSession, paths: str | list[str], schema: str | T.StructType, header: bool = True, multiline: bool = False
) -> DataFrame:
    """``multiline`` is for values with line breaks; it keeps Spark from splitting a file, so it is off by default."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).option("header", header).option("multiLine", multiline).csv(paths)


def read_csv_strings(spark: SparkSession, path: str, columns: list[str], header: bool = True, multiline: bool = False) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return read_csv(spark, path, schema, header, multiline)


def read_csv_sniffed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """All-string scan whose first column, whatever its header says, becomes ``key``."""
    df = spark.read.options(**CSV_OPTIONS).option("header", True).csv(path)
    return df.withColumnRenamed(df.columns[0], key)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "emptyValue"}
    df.write.mode("overwrite").options(**options).option("header", header).csv(path)


def read_texts(spark: SparkSession, path: str, key_pattern: str, key: str = "key", drop_final_newline: bool = False) -> DataFrame:
    """Whole files as (key, text); the key is cut out of the file path.

    With ``drop_final_newline`` the one newline that line-based writers put behind the last line goes.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(
        F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1).alias(key),
        (F.regexp_replace("value", r"\n\z", "") if drop_final_newline else F.col("value")).alias("text"),
    )


def read_runs(spark: SparkSession, paths: list[str], schema: str, run_pattern: str, run: str = "run") -> DataFrame:
    """Several files of one layout, each row tagged with the run named in its path."""
    df = read_csv(spark, paths, schema)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1).alias(run))


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def parse_spans(text: Column) -> Column:
    """Lines ``start end`` -> array<struct<start:int,end:int>>."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")

    def span(line):
        parts = F.split(F.trim(line), r"\s+")
        return F.struct(parts[0].cast("int").alias("start"), parts[1].cast("int").alias("end"))

    return F.transform(lines, span)


def parse_alternating(text: Column) -> Column:
    """Alternating key and value lines -> array<struct<key,value>>; a last odd line is dropped."""
    lines = F.split(text, "\n")
    n = F.floor(F.size(lines) / 2).cast("int")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.struct(F.get(lines, i * 2).alias("key"), F.get(lines, i * 2 + 1).alias("value")))


def write_by_key(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder per key value."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def append_new(batch: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch whose key is not stored yet, one per key, for an append."""
    return batch.join(stored.select(*key), key, "left_anti").dropDuplicates(key)


def bucketed_table(spark: SparkSession, name: str, columns: str, path: str, key: list[str], buckets: int) -> None:
    """A table whose files are split by key hash, registered over ``path``, which may hold rows of earlier sessions."""
    keys = ", ".join(key)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")


def fresh_rows(batch: DataFrame, name: str, key: list[str]) -> DataFrame:
    """``append_new`` against a bucketed table: the batch is sent to the table's buckets, stored rows stay where they are."""
    stored = batch.sparkSession.table(name)
    return append_new(batch, stored, key).select(*stored.columns)


def append_bucketed(batch: DataFrame, name: str, key: list[str]) -> None:
    """Append rows with new keys; the join leaves them by bucket, so each bucket gets at most one file per task."""
    fresh_rows(batch, name, key).write.insertInto(name)


def after_last(df: DataFrame, order: str, processed: DataFrame) -> DataFrame:
    """Rows after the last processed position."""
    mark = processed.agg(F.max(order)).scalar()
    return df.filter(F.col(order) > F.coalesce(mark, F.lit(-1)))
