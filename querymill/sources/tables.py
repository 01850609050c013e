"""Readers of raw tables and writers of results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts that a CSV reader takes for missing.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as strings; texts that mean missing are null, and nothing is trimmed.

    Quotes inside a quoted text are doubled.  Texts with line breaks need
    ``multiline``, with which a file is no longer split between tasks.
    """
    df = spark.read.csv(os.path.expanduser(path), header=True, inferSchema=False, quote='"', escape='"', multiLine=multiline, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.select(*[F.when(F.col(f"`{c}`").isin(*NA_TEXTS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or else Parquet."""
    return read_csv(spark, path) if path.lower().endswith((".csv", ".csv.gz")) else spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
