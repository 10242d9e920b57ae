"""Reading the Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet`` with column pruning and filter push-down left to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``document_id, content_text`` of the latest row of each document; of equally late ones the greatest text, null last."""
    rows = table(spark, folder, "legal_document_contents")
    at = F.col("updated_at") if "updated_at" in rows.columns else F.lit(0)
    return rows.groupBy("document_id").agg(F.max_by("content_text", F.struct(at.alias("at"), "content_text")).alias("content_text"))
