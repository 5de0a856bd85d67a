"""Operators on whole DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.greeting import greet, or_default


def greeted(df: DataFrame, name: str, to: str = "greeting", default: bool = False) -> DataFrame:
    """df with a greeting of the column `name`; with `default`, a missing name is greeted as the default."""
    column = F.col(name)
    return df.withColumn(to, greet(or_default(column) if default else column))
