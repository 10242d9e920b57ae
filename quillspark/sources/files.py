"""Files beside the Parquet tables: lists of seeds, look-up tables, and sinks in one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import external_id


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """``url, external_id`` of a list of seeds: one a line, blank lines and those that begin with # left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")
    return lines.distinct().select("url", external_id(F.col("url")).alias("external_id"))


def csv_map(spark: SparkSession, path: str, key: str, value: str, header: bool) -> DataFrame:
    """``<key>, <value>`` of a CSV file with or without a header; of repeated keys the greatest value."""
    rows = spark.read.option("header", header).csv(path)
    named = rows.select(F.col(rows.columns[0]).alias(key), F.col(rows.columns[1]).alias(value))
    return named.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value))


def normalised(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a schema in its order and types; missing ones are null, values that don't fit too, others are dropped."""

    def cell(f: T.StructField) -> Column:
        if f.name not in rows.columns:
            return F.lit(None).cast(f.dataType)
        return F.col(f"`{f.name}`").try_cast(f.dataType) if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`").cast(f.dataType)

    return rows.select(*[cell(f).alias(f.name) for f in schema.fields])


def write(rows: DataFrame, path: str, kind: str = "parquet", schema: T.StructType | None = None) -> None:
    """Write a table as parquet (zstd), csv (with header) or json (one object a line); readers see the old files or the new ones."""
    out = normalised(rows, schema) if schema is not None else rows
    options = {"parquet": {"compression": "zstd"}, "csv": {"header": "true", "escape": '"', "quote": '"'}, "json": {"ignoreNullFields": "false"}}[kind]
    out.write.mode("overwrite").options(**options).format(kind).save(path)
