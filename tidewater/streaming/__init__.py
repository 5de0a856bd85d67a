"""The greeting over a stream: a stateless projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators import greeted


def greet_stream(spark: SparkSession, folder: str, schema: str, name: str) -> DataFrame:
    """A streaming DataFrame of the Parquet files that appear in a folder, with greetings."""
    return greeted(spark.readStream.schema(schema).parquet(folder), name)
